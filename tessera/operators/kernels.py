"""Dense kernels that columns can't express well: cropping with bicubic resampling, hue, and a projection head.

Each works on Arrow batches in bounded pieces of rows; what is broadcast is a head's weights, of a checked size.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import spread
from ..session import ship

ROWS = 64
#: Weights beyond this many bytes aren't sent along.
MOST_WEIGHTS = 512 << 20


def _pieces(batches):
    for b in batches:
        for a in range(0, b.num_rows, ROWS):
            yield b.slice(a, ROWS)


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    near, far = (a + 2) * x**3 - (a + 3) * x**2 + 1, a * (x**3 - 5 * x**2 + 8 * x - 4)
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


@lru_cache(256)
def taps(begin: int, length: int, size: int, side: int, linear: bool = False) -> np.ndarray:
    """side x size weights that resample the stretch [begin, begin + length) of a line of `size` to `side`; a reduction widens the kernel, cubic or linear."""
    scale = length / side
    middle = (np.arange(side)[:, None] + 0.5) * scale + begin - 0.5
    at = np.arange(size)[None, :]
    apart = (at - middle) / max(scale, 1.0)
    weights = np.where((at >= begin) & (at < begin + length), np.maximum(0.0, 1 - np.abs(apart)) if linear else _cubic(apart), 0.0)
    return weights / weights.sum(1, keepdims=True)


def resample(images: DataFrame, side: int, pixels: str = "pixels", box: tuple[str, str, str, str] = ("top", "left", "box_height", "box_width")) -> DataFrame:
    """images (height, width, pixels: red, green, blue by place, and a box) with view: the box at side x side, as bytes like pixels.

    A null image or box gives a null view.
    """
    kept = images.columns

    def run(batches):
        for b in _pieces(batches):
            rows = zip(*(b.column(kept.index(c)).to_pylist() for c in ("height", "width", pixels, *box)), strict=True)
            out = []
            for h, w, data, top, left, bh, bw in rows:
                if data is None or top is None:
                    out.append(None)
                    continue
                m = np.frombuffer(data, np.uint8).reshape(h, w, 3).astype(float)
                m = np.einsum("yh,hwc,xw->yxc", taps(top, bh, h, side), m, taps(left, bw, w, side), optimize=True)
                out.append(np.clip(np.floor(m + 0.5), 0, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*kept, "view"])

    ship(images.sparkSession)
    return images.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema) + ", view binary")


def turned_hue(rgb: np.ndarray, by: np.ndarray) -> np.ndarray:
    """... x 3 colours from 0 to 1 with their hue moved by a share of the circle."""
    r, g, b = (rgb[..., i] for i in range(3))
    high, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    width = high - low
    span = np.where(width > 0, width, 1.0)
    # remainders by what they are here: from -1 to 1 and from 1 to 11 by 6
    red = (g - b) / span
    hue = np.where(high == r, red + 6.0 * (red < 0), np.where(high == g, (b - r) / span + 2, (r - g) / span + 4)) / 6
    hue = hue + by
    hue -= np.floor(hue)
    k = np.array([5.0, 3.0, 1.0]) + (hue * 6)[..., None]
    k -= 6.0 * (k >= 6)
    np.minimum(k, 4 - k, out=k)
    np.maximum(k, 0, out=k)
    np.minimum(k, 1, out=k)
    k *= width[..., None]
    return np.subtract(high[..., None], k, out=k)


def shift_hue(images: DataFrame, pixels: str = "px", by: str = "hue") -> DataFrame:
    """images with pixels (channel by channel, from 0 to 1) at another hue; null rows stay null."""
    kept = images.columns

    def run(batches):
        for b in _pieces(batches):
            out = []
            for px, u in zip(b.column(kept.index(pixels)).to_pylist(), b.column(kept.index(by)).to_pylist(), strict=True):
                out.append(px if px is None or u is None else turned_hue(np.array(px).reshape(3, -1).T, np.array(u)).T.ravel().tolist())
            columns = list(b.columns)
            columns[kept.index(pixels)] = pa.array(out, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, kept)

    ship(images.sparkSession)
    return images.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema))


_GRID = np.array([math.erf(i / 512) for i in range(6 * 512 + 2)])
_SLOPE = 2 / math.sqrt(math.pi) * np.exp(-((np.arange(len(_GRID)) / 512) ** 2)) / 512


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, to about twelve digits: cubics between values and slopes at 512 places a unit; beyond 6 it is 1."""
    at = np.minimum(np.abs(x), 6.0) * 512
    i = at.astype(np.int64)
    t = at - i
    a, b, p, q = _GRID[i], _GRID[i + 1], _SLOPE[i], _SLOPE[i + 1]
    return np.sign(x) * (a + t * (p + t * (3 * (b - a) - 2 * p - q + t * (p + q - 2 * (b - a)))))


def projected(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], prototypes: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """Linear layers with GELU between them, rows made unit, then the products with the prototypes."""
    for i, (weight, bias) in enumerate(layers):
        x = x @ weight.T + bias
        if i < len(layers) - 1:
            x = 0.5 * x * (1 + erf(x / 2**0.5))
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), eps)) @ prototypes.T


def project(rows: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]], prototypes: np.ndarray, vector: str = "embedding") -> DataFrame:
    """rows with logits; a null vector has null logits."""
    size = prototypes.nbytes + sum(w.nbytes + b.nbytes for w, b in layers)
    if size > MOST_WEIGHTS:
        raise ValueError(f"weights of {size} bytes are too large to send along")
    kept, shared = rows.columns, ship(rows.sparkSession).sparkContext.broadcast((layers, prototypes))

    def run(batches):
        for b in _pieces(batches):
            x = b.column(kept.index(vector))
            own = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
            if not len(own):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(len(x), pa.list_(pa.float64()))], [*kept, "logits"])
                continue
            m = x.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
            found = projected(m, *shared.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
            at = np.full(len(x), -1)
            at[own] = np.arange(len(own))
            yield pa.RecordBatch.from_arrays([*b.columns, lists.take(pa.array(at, mask=at < 0))], [*kept, "logits"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", logits array<double>")


#: Sizes of the query's head, and its weights: a rule, so that SQL has them too.
SIZES, PROTOTYPES = (64, 16, 8), 10


def head(sizes: tuple[int, ...] = SIZES, prototypes: int = PROTOTYPES) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Weight (j, i) of layer n is ((7 j + 3 i + n) mod 11 - 5) / 10, its bias j is (j mod 3 - 1) / 10; prototypes follow as a layer without bias."""
    rule = lambda n, out, into: ((7 * np.arange(out)[:, None] + 3 * np.arange(into)[None, :] + n) % 11 - 5) / 10.0
    layers = [(rule(n, out, into), (np.arange(out) % 3 - 1) / 10.0) for n, (into, out) in enumerate(zip(sizes[:-1], sizes[1:], strict=True))]
    return layers, rule(len(layers), prototypes, sizes[-1])


def projection_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logits of every embedding, by prototype."""
    rows = project(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "embedding"), *head())
    return rows.select("vec_id", F.posexplode("logits").alias("k", "logit")).select("vec_id", "k", F.round("logit", 6).alias("logit"))


QUERIES = {"projection_head": projection_head}

_WEIGHT = lambda n, j, i: f"(((7 * {j} + 3 * {i} + {n}) % 11 - 5) / 10.0::DOUBLE)"
_LAYER = lambda n, x, into, out: f"list_transform(range({out}), lambda j: (j % 3 - 1) / 10.0::DOUBLE + list_sum(list_transform(range({into}), lambda i: {x}[i + 1] * {_WEIGHT(n, 'j', 'i')})))"
#: The error function by its series, which is exact to about 9 digits up to 4, where the values of the query stay.
_ERF = "2 / sqrt(pi()) * list_sum(list_transform(range(60), lambda n: CASE n % 2 WHEN 0 THEN 1 ELSE -1 END * pow(v / sqrt(2.0::DOUBLE), 2 * n + 1) / (gamma(n + 1.0::DOUBLE) * (2 * n + 1))))"

ORACLES = {
    "projection_head": f"""WITH a AS (SELECT vec_id, {_LAYER(0, "x", 64, 16)} AS h FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)),
g AS (SELECT vec_id, list_transform(h, lambda v: 0.5::DOUBLE * v * (1 + {_ERF})) AS h FROM a), b AS (SELECT vec_id, {_LAYER(1, "h", 16, 8)} AS z FROM g),
u AS (SELECT vec_id, list_transform(z, lambda v: v / greatest(sqrt(list_inner_product(z, z)), 1e-12::DOUBLE)) AS u FROM b)
SELECT vec_id, CAST(k AS INTEGER) AS k, round(list_sum(list_transform(range(8), lambda i: u[i + 1] * {_WEIGHT(2, "k", "i")})), 6) AS logit FROM u, range({PROTOTYPES}) r(k)"""
}
