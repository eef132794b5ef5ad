"""User functions over images: one image to one, one to many, and numpy kernels for the steps of a recipe.

An image in a row is height, width and pixels (bytes: red, green, blue, by place); a function gets it as an
array height x width x 3.  Functions run on Arrow batches; what they return goes out as bytes with its shape.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from .kernels import taps, turned_hue
from .pixels import LUMA

#: Bytes of results after which they are handed on; bytes and rows of a batch that are taken at once.
OUT_BYTES, PIECE_BYTES, PIECE_ROWS = 4 << 20, 1 << 20, 64
MADE = "view int, dims array<int>, dtype string, data binary"


class Misfit(ValueError):
    """Something given with an image doesn't fit it: an error whatever on_error says."""


def pieces(b: pa.RecordBatch):
    """A batch in slices of about PIECE_BYTES, of at most PIECE_ROWS rows and one at least: what is made of a slice is all that a task holds beside the batch."""
    rows = max(1, min(PIECE_ROWS, b.num_rows * PIECE_BYTES // max(1, b.nbytes)))
    for a in range(0, b.num_rows, rows):
        yield b.slice(a, rows)


def listed(a: pa.Array) -> list:
    """a.to_pylist(), taken by fields and not by values."""
    if pa.types.is_struct(a.type):
        rows = [dict(zip(a.type.names, r, strict=True)) for r in zip(*map(listed, a.flatten()), strict=True)] if a.type.num_fields else [{}] * len(a)
    elif pa.types.is_list(a.type):
        values, ends = listed(a.flatten()), np.cumsum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        rows = [values[b:e] for b, e in zip([0, *ends], ends, strict=False)]
    elif a.null_count or not (pa.types.is_integer(a.type) or pa.types.is_floating(a.type) or pa.types.is_boolean(a.type)):
        return a.to_pylist()
    else:
        return a.to_numpy(zero_copy_only=False).tolist()
    return [r if own else None for r, own in zip(rows, a.is_valid().to_pylist(), strict=True)] if a.null_count else rows


def fanned(images: DataFrame, fn, keep: list[str], given: tuple[str, ...] = (), on_error: str = "drop", many: bool = False, told: tuple | None = None) -> DataFrame:
    """keep, view (from 0), dims, dtype, data: a row for each array in the list that fn(image, *given) returns.

    told: a measure (`VALUES`, `MEAN`, `peak`); its column comes in place of dtype and data, and arrays don't leave the task that makes them.

    An image that is null, and one for which fn returns None or nothing, has no row.  on_error: drop leaves
    out images on which fn fails, fail raises.  many: fn gets a list of images and the Arrow columns of their
    `given`, and returns a list of lists; where it fails, it gets these images one by one.
    """

    def all_of(images, columns):
        if many:
            return fn(images, *columns)
        return [fn(image, *row) for image, *row in zip(images, *(listed(c) for c in columns), strict=True)]

    def made_of(b):
        """(row, arrays) of the images of a slice."""
        column = lambda c: b.column(b.schema.get_field_index(c))
        shapes = list(zip(*(column(c).to_pylist() for c in ("height", "width", "pixels")), strict=True))
        rows = [i for i, (h, w, data) in enumerate(shapes) if data is not None and h is not None and h >= 0]
        image = lambda i: np.frombuffer(shapes[i][2], np.uint8).reshape(shapes[i][0], shapes[i][1], 3)
        of = lambda own: all_of([image(i) for i in own], [column(c).take(pa.array(own, pa.int64())) for c in given])
        try:
            return zip(rows, of(rows), strict=True) if rows else ()
        except Misfit:
            raise
        except Exception:
            if on_error == "fail":
                raise
        found = []
        for i in rows:
            try:
                found += [(i, of([i])[0])]
            except Misfit:
                raise
            except Exception:  # noqa: S112
                continue
        return found

    def run(batches):
        for b in (s for batch in batches for s in pieces(batch)):
            column = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
            rows, found, size = [], [], 0

            def out():
                kept = [column(c).take(pa.array(rows)) for c in keep]  # noqa: B023
                number, arrays = zip(*found, strict=True)  # noqa: B023
                kept += [pa.array(number, pa.int32()), pa.array([list(m.shape) for m in arrays], pa.list_(pa.int32()))]
                if told:
                    made = [told[2](np.ascontiguousarray(m).ravel().astype(np.float64), m.shape) for m in arrays]
                    return pa.RecordBatch.from_arrays([*kept, _measured(made, told[1])], [*keep, "view", "dims", told[0]])
                return pa.RecordBatch.from_arrays([*kept, pa.array([m.dtype.str for m in arrays]), pa.array([np.ascontiguousarray(m).tobytes() for m in arrays], pa.binary())], [*keep, "view", "dims", "dtype", "data"])

            for i, made in made_of(b):
                made = [m for m in made or () if m is not None]
                rows += [i] * len(made)
                found += enumerate(made)
                size += sum(m.nbytes for m in made)
                if size >= OUT_BYTES:
                    yield out()
                    rows, found, size = [], [], 0
            if found:
                yield out()

    ship(images.sparkSession)
    wanted = list(dict.fromkeys([*keep, "height", "width", "pixels", *given]))
    schema = ", ".join(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in keep)
    made = f"view int, dims array<int>, {told[0]} {told[1]}" if told else MADE
    return images.select(*wanted).mapInArrow(run, f"{schema}, {made}" if keep else made)


def transformed(images: DataFrame, fn, keep: list[str], given: tuple[str, ...] = (), on_error: str = "drop", told: tuple | None = None) -> DataFrame:
    """As `fanned`, for a function that returns one array."""

    def one(image, *more):
        made = fn(image, *more)
        return None if made is None else [made]

    return fanned(images, one, keep, given, on_error, told=told).drop("view")


def _measured(found: list, kind: str) -> pa.Array:
    return pa.array(found, pa.list_(pa.float64()) if kind == "array<double>" else pa.float64())


def _each(made: DataFrame, keep: list[str], name: str, kind: str, body) -> DataFrame:
    """keep, dims and one more column: body(array, dims) of what functions returned."""

    def run(batches):
        for b in (s for batch in batches for s in pieces(batch)):
            column = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
            found = [body(np.frombuffer(d, k).astype(np.float64), s) for k, d, s in zip(*(column(c).to_pylist() for c in ("dtype", "data", "dims")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(column(c) for c in (*keep, "dims")), _measured(found, kind)], [*keep, "dims", name])

    schema = ", ".join(f"`{c}` {made.schema[c].dataType.simpleString()}" for c in (*keep, "dims"))
    return made.mapInArrow(run, f"{schema}, {name} {kind}")


#: Measures: a column's name and type, and what it says of an array (its values in order, its shape).
VALUES = ("values", "array<double>", lambda x, dims: x)
MEAN = ("mean", "double", lambda x, dims: float(x.mean()))


def peak(patch: int) -> tuple:
    """A measure: the largest absolute value in each patch x patch square of channel x height x width arrays, by line; what is left over at the edges counts for none."""

    def body(x, dims):
        c, h, w = dims[0], dims[1] // patch, dims[2] // patch
        return np.abs(x.reshape(dims)[:, : h * patch, : w * patch]).reshape(c, h, patch, w, patch).max((0, 2, 4)).ravel()

    return "peaks", "array<double>", body


def values(made: DataFrame, keep: list[str]) -> DataFrame:
    """keep, dims and values of what functions returned, as an array of doubles in the array's own order."""
    return _each(made, keep, *VALUES)


def means(made: DataFrame, keep: list[str]) -> DataFrame:
    """keep, dims and the mean of what functions returned."""
    return _each(made, keep, *MEAN)


def peaks(made: DataFrame, keep: list[str], patch: int) -> DataFrame:
    """keep, dims and peaks of what functions returned: see `peak`."""
    return _each(made, keep, *peak(patch))


# ---- steps on height x width x 3 arrays of whole values from 0 to 255 ----


def whole(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x + 0.5)
    np.floor(x, out=x)
    np.maximum(x, 0, out=x)
    return np.minimum(x, 255, out=x)


def _both(m: np.ndarray, down: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Resampled along columns, then along rows."""
    h, w, c = m.shape
    m = (down @ m.reshape(h, w * c)).reshape(-1, w, c)
    return whole((across @ m).reshape(len(down), len(across), c))


def cropped(image: np.ndarray, top: int, left: int, height: int, width: int, side: int, linear: bool = False) -> np.ndarray:
    """A box of an image at side x side."""
    box = image[top : top + height, left : left + width].astype(float)
    down, across = taps(0, height, height, side, linear), taps(0, width, width, side, linear)
    return _both(box, down, across)


def resized(image: np.ndarray, side: int, linear: bool = True) -> np.ndarray:
    """The short side at `side`, then the central square."""
    h, w = image.shape[:2]
    nh, nw = (side, int(side * w / h)) if h <= w else (int(side * h / w), side)
    m = _both(image.astype(float), taps(0, h, h, nh, linear), taps(0, w, w, nw, linear))
    top, left = round((nh - side) / 2), round((nw - side) / 2)
    return m[top : top + side, left : left + side]


def flipped(image: np.ndarray, horizontal: bool, vertical: bool, quarters: int = 0) -> np.ndarray:
    """Mirrored, then turned counter-clockwise by quarters."""
    image = image[:, ::-1] if horizontal else image
    image = image[::-1] if vertical else image
    return np.rot90(image, quarters) if quarters else image


def luma(image: np.ndarray) -> np.ndarray:
    return image @ np.array(LUMA)


def jittered(image: np.ndarray, brightness: float, contrast: float, saturation: float, hue: float, order=(0, 1, 2, 3)) -> np.ndarray:
    """Four changes of colour, in an order."""
    for step in order:
        if step == 0:
            image = whole(image * brightness)
        elif step == 1:
            image = whole(image * contrast + whole(luma(image).mean()) * (1 - contrast))
        elif step == 2:
            image = whole(image * saturation + luma(image)[..., None] * (1 - saturation))
        else:
            image = whole(turned_hue(image / 255.0, np.array(hue)) * 255.0)
    return image


def grayed(image: np.ndarray) -> np.ndarray:
    return np.repeat(whole(luma(image))[..., None], 3, 2)


@lru_cache(256)
def _mirrored(n: int, r: int) -> np.ndarray:
    """Places of a line of n with r more at both ends, mirrored."""
    return np.pad(np.arange(n), r, mode="reflect" if n > 1 else "edge")


def blurred(image: np.ndarray, sigma: float, kernel: int) -> np.ndarray:
    """Gaussian of `kernel` taps along both sides; mirrored at the edges, which aren't repeated."""
    r = kernel // 2
    weight = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    weight /= weight.sum()
    for axis in (0, 1):
        n = image.shape[axis]
        wide = image.take(_mirrored(n, r), axis)
        image, part = np.zeros(image.shape), np.empty(image.shape)
        for k, w in enumerate(weight):
            np.multiply(wide[k : k + n] if axis == 0 else wide[:, k : k + n], w, out=part)
            image += part
    return whole(image)


def solarized(image: np.ndarray, threshold: float = 128) -> np.ndarray:
    return np.where(image < threshold, image, 255 - image)


def shifted(image: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    h, w = image.shape[:2]
    out = np.empty_like(image)
    out[:] = fill
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = image[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


# ---- steps on arrays of values from 0 to 1 ----


def _clipped(x: np.ndarray) -> np.ndarray:
    """x, which is nobody else's, held between 0 and 1."""
    np.maximum(x, 0, out=x)
    return np.minimum(x, 1, out=x)


def lit(x: np.ndarray, cy: float, cx: float, strength: float, dark_edge: bool) -> np.ndarray:
    """Light that falls off from a point, or toward it; the point is given as shares of the sides."""
    h, w = x.shape[:2]
    d = np.hypot(np.arange(h)[:, None] - cy * h, np.arange(w)[None, :] - cx * w) / (np.hypot(h, w) / 2)
    d = _clipped(d)
    return _clipped(x * (1 - strength * (d if dark_edge else 1 - d))[..., None])


def veiled(x: np.ndarray, t: float, veil) -> np.ndarray:
    return _clipped(x * t + np.array(veil) * (1 - t))


def dimmed(x: np.ndarray, factors) -> np.ndarray:
    return _clipped(x * np.array(factors))


def specked(x: np.ndarray, density: float, random: np.random.Generator) -> np.ndarray:
    """Bright specks at places drawn with repeats; the last one at a place shows."""
    h, w = x.shape[:2]
    n = int(density * h * w)
    if not n:
        return x
    place, light = np.floor(random.random(n) * (h * w)).astype(int), 0.6 + 0.4 * random.random(n)
    last = np.unique(place[::-1], return_index=True)
    out = x.reshape(-1, 3).copy()
    out[last[0]] = light[::-1][last[1]][:, None]
    return out.reshape(x.shape)
