"""Pixel transforms: parameters drawn from keyed hashes, then a deterministic change of the pixels.

An image is an array of doubles, channel by channel, row by row: index (c * height + y) * width + x.
Drawing and applying are separate functions, so either can be checked on its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import between, bind, keyed_uniform, total, uniform_sql
from ..functions.frames import spread
from . import masks

H = W = 8
C = 3
#: Channel means and spreads of two image collections, and the weights of luma.
MEAN = {"benthic": (0.359, 0.413, 0.386), "imagenet": (0.485, 0.456, 0.406)}
STD = {"benthic": (0.219, 0.215, 0.209), "imagenet": (0.229, 0.224, 0.225)}
LUMA = (0.2989, 0.587, 0.114)
#: Ranges of the water effects.
VEIL = ((0.05, 0.25), (0.25, 0.5), (0.3, 0.55))
#: Of particles in the queries, whose images are small; for others the function has the usual range.
DENSITY = (0.05, 0.3)
ATTENUATION = ((0.3, 1.0), (0.6, 1.0), (0.75, 1.0))


def _at(i: Column, h: int, w: int) -> tuple[Column, Column, Column]:
    return (i / (h * w)).cast("int"), (i / w).cast("int") % h, i % w


def remap(px: Column, source, h: int = H, w: int = W) -> Column:
    """The pixel at (c, y, x) of the result is that at source(c, y, x) = (y, x) of px, or a given column where source says so."""

    def one(p: Column, i: Column) -> Column:
        c, y, x = _at(i, h, w)
        found = source(c, y, x)
        value = F.get(p, (c * h + found[0]) * w + found[1])
        return value if len(found) == 2 else F.when(found[2], value).otherwise(found[3])

    return bind(px, lambda p: F.transform(F.sequence(F.lit(0), F.lit(C * h * w - 1)), lambda i: one(p, i)))


def by_pixel(px: Column, change, h: int = H, w: int = W) -> Column:
    """change(value, c, y, x) of every pixel."""
    return F.transform(px, lambda v, i: change(v, *_at(i, h, w)))


def by_channel(c: Column, values) -> Column:
    return F.when(c == 0, values[0]).when(c == 1, values[1]).otherwise(values[2])


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), v))


def solarize(px: Column, threshold: float = 128.0) -> Column:
    return F.transform(px, lambda v: F.when(v < threshold, v).otherwise(255.0 - v))


def rotate(px: Column, quarters: Column, n: int = H) -> Column:
    """Counter-clockwise by quarters of a turn; square images."""
    pick = lambda zero, one, two, three: F.when(quarters == 1, one).when(quarters == 2, two).when(quarters == 3, three).otherwise(zero)
    return remap(px, lambda c, y, x: (pick(y, x, n - 1 - y, n - 1 - x), pick(x, n - 1 - y, n - 1 - x, y)), n, n)


def flip(px: Column, horizontal: Column, vertical: Column, h: int = H, w: int = W) -> Column:
    return remap(px, lambda c, y, x: (F.when(vertical, h - 1 - y).otherwise(y), F.when(horizontal, w - 1 - x).otherwise(x)), h, w)


def vignette(px: Column, cy: Column, cx: Column, strength: Column, dark_edge: Column, h: int = H, w: int = W) -> Column:
    def change(v, c, y, x):
        d = clamp(F.sqrt((y - cy) * (y - cy) + (x - cx) * (x - cx)) / F.lit(math.sqrt(h * h + w * w) / 2))
        return clamp(v * F.when(dark_edge, 1 - strength * d).otherwise(1 - strength * (1 - d)))

    return by_pixel(px, change, h, w)


def turbidity(px: Column, t: Column, veil, h: int = H, w: int = W) -> Column:
    return by_pixel(px, lambda v, c, y, x: clamp(v * t + by_channel(c, veil) * (1 - t)), h, w)


def attenuate(px: Column, factors, h: int = H, w: int = W) -> Column:
    return by_pixel(px, lambda v, c, y, x: clamp(v * by_channel(c, factors)), h, w)


def snow(px: Column, particles: Column, h: int = H, w: int = W) -> Column:
    """particles: array of (place, brightness) in order; where several share a place, the last shows."""
    last = lambda y, x: F.filter(particles, lambda p: p["place"] == y * w + x)
    return by_pixel(px, lambda v, c, y, x: F.coalesce(F.try_element_at(last(y, x), F.lit(-1))["brightness"], v), h, w)


def normalize(px: Column, collection: str = "benthic", h: int = H, w: int = W) -> Column:
    mean, std = ([F.lit(v) for v in t[collection]] for t in (MEAN, STD))
    return by_pixel(px, lambda v, c, y, x: (v / 255.0 - by_channel(c, mean)) / by_channel(c, std), h, w)


def denormalize(px: Column, collection: str = "benthic", h: int = H, w: int = W) -> Column:
    mean, std = ([F.lit(v) for v in t[collection]] for t in (MEAN, STD))
    return by_pixel(px, lambda v, c, y, x: F.floor(clamp(v * by_channel(c, std) + by_channel(c, mean)) * 255.0).cast("double"), h, w)


def luma(px: Column, h: int = H, w: int = W) -> Column:
    """h * w values."""
    n = h * w
    return bind(px, lambda p: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: sum((F.get(p, i + c * n) * LUMA[c] for c in range(C)), F.lit(0.0))))


def grayscale(px: Column, h: int = H, w: int = W) -> Column:
    return bind(luma(px, h, w), lambda g: F.concat(g, g, g))


def color_jitter(px: Column, brightness: Column, contrast: Column, saturation: Column, h: int = H, w: int = W) -> Column:
    """In this order, each clamped to [0, 1]: times brightness, away from the mean luma, away from the pixel's own luma."""
    n = h * w
    bright = F.transform(px, lambda v: clamp(v * brightness))
    stark = lambda b: bind(total(luma(b, h, w)) / n, lambda m: F.transform(b, lambda v: clamp(v * contrast + m * (1 - contrast))))
    vivid = lambda s: bind(luma(s, h, w), lambda g: F.transform(s, lambda v, i: clamp(v * saturation + F.get(g, i % n) * (1 - saturation))))
    return bind(bright, lambda b: bind(stark(b), vivid))


def blur(px: Column, sigma: Column, radius: int = 1, h: int = H, w: int = W) -> Column:
    """Gaussian of 2 * radius + 1 taps along rows, then columns; mirrored at the edges, which aren't repeated."""
    taps = list(range(-radius, radius + 1))

    def mirrored(i: Column, n: int) -> Column:
        return (n - 1) - F.abs((n - 1) - F.abs(i))

    def along(px: Column, weights: Column) -> Column:
        weigh = lambda values: sum((F.get(weights, F.lit(k)) * v for k, v in enumerate(values)), F.lit(0.0))
        rows = by_pixel(px, lambda v, c, y, x: weigh([F.get(px, (c * h + y) * w + mirrored(x + k, w)) for k in taps]), h, w)
        return bind(rows, lambda r: by_pixel(r, lambda v, c, y, x: weigh([F.get(r, (c * h + mirrored(y + k, h)) * w + x) for k in taps]), h, w))

    raw = F.array(*[F.exp(-0.5 * (F.lit(float(k)) / sigma) * (F.lit(float(k)) / sigma)) for k in taps])
    share = bind(raw, lambda r: bind(total(r), lambda t: F.transform(r, lambda v: v / t)))
    return bind(px, lambda p: bind(share, lambda s: along(p, s)))


def translate(px: Column, dy: Column, dx: Column, fill, h: int = H, w: int = W) -> Column:
    return remap(px, lambda c, y, x: (y - dy, x - dx, (y - dy).between(0, h - 1) & (x - dx).between(0, w - 1), by_channel(c, fill)), h, w)


def mask_pixels(px: Column, mask: Column, patch: int = 2, h: int = H, w: int = W) -> Column:
    """0 wherever the patch of the pixel is hidden: on normalised pixels, the mean colour."""
    across = w // patch
    return by_pixel(px, lambda v, c, y, x: F.when(F.get(mask, (y / patch).cast("int") * across + (x / patch).cast("int")), 0.0).otherwise(v), h, w)


def patchify(px: Column, patch: int = 2, h: int = H, w: int = W) -> Column:
    """(h / patch) * (w / patch) arrays of C * patch * patch values, a remainder is left out."""
    down, across = h // patch, w // patch
    inner = lambda px, p, j: (F.get(px, ((j / (patch * patch)).cast("int") * h + (p / across).cast("int") * patch + (j / patch).cast("int") % patch) * w + (p % across) * patch + j % patch))
    return bind(px, lambda q: F.transform(F.sequence(F.lit(0), F.lit(down * across - 1)), lambda p: F.transform(F.sequence(F.lit(0), F.lit(C * patch * patch - 1)), lambda j: inner(q, p, j))))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and px: an image of whole values from 0 to 255 made from each embedding."""
    e = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    value = lambda i: F.get(F.col("embedding"), (i % (H * W) + 21 * (i / (H * W)).cast("int")) % 64).cast("double")
    return e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(C * H * W - 1)), lambda i: F.floor(255 * clamp(4 * value(i) + 0.5)).cast("double")).alias("px"))


def draw(op: str, what: str, low: float = 0.0, high: float = 1.0) -> Column:
    return between(keyed_uniform(0, op, what, F.col("vec_id")), low, high)


def checks(df: DataFrame, px: Column) -> DataFrame:
    """What the checks compare of an image: the sum of its pixels and that of pixel times place."""
    out = df.select("vec_id", px.alias("out_"))
    return out.select("vec_id", F.round(total(F.col("out_")), 6).alias("total"), F.round(total(F.transform("out_", lambda v, i: v * i)) / (C * H * W), 6).alias("moment"))


def _unit(spark, sf_dir):
    return images(spark, sf_dir).select("vec_id", F.transform("px", lambda v: v / 255.0).alias("px"))


def _veil(op="turbidity"):
    return [draw(op, f"veil{c}", *VEIL[c]) for c in range(C)]


def particles(low: float = 0.0005, high: float = 0.003, h: int = H, w: int = W) -> Column:
    n = F.floor(draw("snow", "density", low, high) * (h * w)).cast("int")
    own = lambda what, j: keyed_uniform(0, "snow", what, F.col("vec_id"), j.cast("string"))
    each = lambda j: F.struct(F.floor(own("place", j) * (h * w)).cast("int").alias("place"), between(own("light", j), 0.6, 1.0).alias("brightness"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), each)).otherwise(F.array().cast("array<struct<place:int,brightness:double>>"))


def solarize_query(spark, sf_dir):
    return checks(images(spark, sf_dir), F.when(draw("solarize", "p") < 0.2, solarize(F.col("px"))).otherwise(F.col("px")))


def rotate90(spark, sf_dir):
    return checks(images(spark, sf_dir), rotate(F.col("px"), F.floor(draw("rotate", "k") * 4).cast("int")))


def flip_query(spark, sf_dir):
    return checks(images(spark, sf_dir), flip(F.col("px"), draw("flip", "h") < 0.5, draw("flip", "v") < 0.3))


def _vignetted(px: Column) -> Column:
    return F.when(draw("vignette", "p") < 0.5, vignette(px, draw("vignette", "cy", 0.2 * H, 0.8 * H), draw("vignette", "cx", 0.2 * W, 0.8 * W), draw("vignette", "s", 0.25, 0.6), draw("vignette", "edge") < 0.5)).otherwise(px)


def _turbid(px: Column) -> Column:
    return F.when(draw("turbidity", "p") < 0.4, turbidity(px, draw("turbidity", "t", 0.5, 0.95), _veil())).otherwise(px)


def _attenuated(px: Column) -> Column:
    return F.when(draw("attenuation", "p") < 0.5, attenuate(px, [draw("attenuation", f"c{c}", *ATTENUATION[c]) for c in range(C)])).otherwise(px)


def _snowed(px: Column) -> Column:
    return F.when(draw("snow", "p") < 0.3, bind(particles(*DENSITY), lambda p: snow(px, p))).otherwise(px)


def vignette_query(spark, sf_dir):
    return checks(_unit(spark, sf_dir), _vignetted(F.col("px")))


def turbidity_query(spark, sf_dir):
    return checks(_unit(spark, sf_dir), _turbid(F.col("px")))


def channel_atten(spark, sf_dir):
    return checks(_unit(spark, sf_dir), _attenuated(F.col("px")))


def marine_snow(spark, sf_dir):
    return checks(_unit(spark, sf_dir), _snowed(F.col("px")))


def marine_physics(spark, sf_dir):
    """Vignette, turbidity, attenuation and snow, in this order."""
    d = _unit(spark, sf_dir)
    for step in (_vignetted, _turbid, _attenuated, _snowed):
        d = d.withColumn("px", step(F.col("px")))
    return checks(d, F.col("px"))


def normalize_pixels(spark, sf_dir):
    return checks(images(spark, sf_dir), normalize(F.col("px")))


def denormalize_query(spark, sf_dir):
    return checks(images(spark, sf_dir), denormalize(F.transform("px", lambda v: v / 64.0 - 2.0), "imagenet"))


def grayscale_query(spark, sf_dir):
    return checks(_unit(spark, sf_dir), F.when(draw("gray", "p") < 0.2, grayscale(F.col("px"))).otherwise(F.col("px")))


def color_jitter_query(spark, sf_dir):
    jitter = color_jitter(F.col("px"), draw("jitter", "b", 0.6, 1.4), draw("jitter", "c", 0.6, 1.4), draw("jitter", "s", 0.8, 1.2))
    return checks(_unit(spark, sf_dir), F.when(draw("jitter", "p") < 0.8, jitter).otherwise(F.col("px")))


def blur_3tap(spark, sf_dir):
    return checks(_unit(spark, sf_dir), blur(F.col("px"), draw("blur", "sigma", 0.1, 2.0)))


def blur_9tap(spark, sf_dir):
    """The kernel of one of the recipes."""
    return checks(_unit(spark, sf_dir), blur(F.col("px"), draw("blur", "sigma", 0.1, 2.0), 4))


def translate_fill(spark, sf_dir):
    shift = lambda what: F.floor(draw("translate", what, -0.1 * H, 0.1 * H) + 0.5).cast("int")
    return checks(images(spark, sf_dir), translate(F.col("px"), shift("y"), shift("x"), [F.lit(float(round(m * 255))) for m in MEAN["benthic"]]))


def pixel_mask(spark, sf_dir):
    s = masks.hidden(masks.slots(masks.samples(spark, sf_dir).select("vec_id", "batch"), ["vec_id"], "batch", 1), ["vec_id"])
    d = images(spark, sf_dir).join(s.select("vec_id", "mask"), "vec_id")
    return checks(d, bind(normalize(F.col("px")), lambda n: mask_pixels(n, F.col("mask"))))


def patchify_query(spark, sf_dir):
    d = images(spark, sf_dir).select("vec_id", F.posexplode(patchify(F.col("px"))).alias("patch", "v"))
    return d.select("vec_id", "patch", total(F.col("v")).alias("total"), total(F.transform("v", lambda v, i: v * i)).alias("moment"))


QUERIES = {f.__name__: f for f in (rotate90, channel_atten, marine_snow, marine_physics, normalize_pixels, blur_3tap, blur_9tap, translate_fill, pixel_mask)} | {
    "solarize": solarize_query, "flip": flip_query, "vignette": vignette_query, "turbidity": turbidity_query, "denormalize": denormalize_query,
    "grayscale": grayscale_query, "color_jitter": color_jitter_query, "patchify": patchify_query,
}

# ---- the same in SQL ----

_IMAGES = "im AS (SELECT vec_id, list_transform(range(192), lambda i: floor(255 * least(1, greatest(0, 4 * embedding[(i % 64 + 21 * (i // 64)) % 64 + 1]::DOUBLE + 0.5::DOUBLE)))) AS p FROM embeddings)"
_UNITS = f"{_IMAGES}, un AS (SELECT vec_id, list_transform(p, lambda v: v / 255) AS p FROM im)"
_C, _Y, _X = "((i - 1) // 64)", "((i - 1) // 8 % 8)", "((i - 1) % 8)"


def _u(op: str, what: str, low: float = 0.0, high: float = 1.0) -> str:
    return f"({float(low)}::DOUBLE + {uniform_sql("'0'", f"'{op}'", f"'{what}'", 'vec_id')} * {float(high) - float(low)}::DOUBLE)"


def _sql(expression: str, source: str = "im", more: str = "", extra: str = "") -> str:
    return f"WITH {_UNITS}{more}, d AS (SELECT *{extra} FROM {source}), o AS (SELECT vec_id, {expression} AS p FROM d) SELECT vec_id, round(list_sum(p), 6) AS total, round(list_sum(list_transform(p, lambda v, i: v * (i - 1))) / 192, 6) AS moment FROM o"


def _each(e: str, p: str = "p") -> str:
    return f"list_transform({p}, lambda v, i: {e})"


def _by(values) -> str:
    return f"[{', '.join(str(v) if isinstance(v, str) else f'{v}::DOUBLE' for v in values)}][{_C} + 1]"


_CLAMP = "least(1, greatest(0, {}))".format
_D = f"least(1, sqrt(pow({_Y} - cy, 2) + pow({_X} - cx, 2)) / (sqrt(128.0::DOUBLE) / 2))"
_STEPS = {
    "vignette": (f", {_u('vignette', 'p')} AS u, {_u('vignette', 'cy', 1.6, 6.4)} AS cy, {_u('vignette', 'cx', 1.6, 6.4)} AS cx, {_u('vignette', 's', 0.25, 0.6)} AS s, {_u('vignette', 'edge')} AS e", f"CASE WHEN u < 0.5 THEN {_each(_CLAMP(f'v * (1 - s * CASE WHEN e < 0.5 THEN {_D} ELSE 1 - {_D} END)'))} ELSE p END"),
    "turbidity": (f", {_u('turbidity', 'p')} AS u, {_u('turbidity', 't', 0.5, 0.95)} AS t, [{', '.join(_u('turbidity', f'veil{c}', *VEIL[c]) for c in range(C))}] AS veil", f"CASE WHEN u < 0.4::DOUBLE THEN {_each(_CLAMP(f'v * t + veil[{_C} + 1] * (1 - t)'))} ELSE p END"),
    "channel_atten": (f", {_u('attenuation', 'p')} AS u, [{', '.join(_u('attenuation', f'c{c}', *ATTENUATION[c]) for c in range(C))}] AS f", f"CASE WHEN u < 0.5 THEN {_each(_CLAMP(f'v * f[{_C} + 1]'))} ELSE p END"),
    "marine_snow": (f", {_u('snow', 'p')} AS u, list_transform(range(CAST(floor({_u('snow', 'density', *DENSITY)} * 64) AS BIGINT)), lambda j: [floor({uniform_sql(chr(39) + '0' + chr(39), chr(39) + 'snow' + chr(39), chr(39) + 'place' + chr(39), 'vec_id', 'j')} * 64), 0.6::DOUBLE + {uniform_sql(chr(39) + '0' + chr(39), chr(39) + 'snow' + chr(39), chr(39) + 'light' + chr(39), 'vec_id', 'j')} * 0.4::DOUBLE]) AS q",
                    f"CASE WHEN u < 0.3::DOUBLE THEN {_each(f'coalesce(list_filter(q, lambda z: z[1] = {_Y} * 8 + {_X})[-1][2], v)')} ELSE p END"),
}
_PHYSICS, _from = "", "un"
for _n, (_extra, _e) in _STEPS.items():
    _PHYSICS += f", {_n}_d AS (SELECT *{_extra} FROM {_from}), {_n}_o AS (SELECT vec_id, {_e} AS p FROM {_n}_d)"
    _from = f"{_n}_o"
_MIRROR = "(7 - abs(7 - abs({})))".format
_LUMA = "list_transform(range(64), lambda i: 0.2989::DOUBLE * {0}[i + 1] + 0.587::DOUBLE * {0}[i + 65] + 0.114::DOUBLE * {0}[i + 129])".format
_NORMAL = _each(f"(v / 255 - {_by(MEAN['benthic'])}) / {_by(STD['benthic'])}")
_REMAP = lambda y, x: f"list_transform(range(1, 193), lambda i: p[({_C} * 8 + {y}) * 8 + {x} + 1])"

ORACLES = {n: _sql(e, "un", "", x) for n, (x, e) in _STEPS.items()} | {
    "marine_physics": _sql("p", _from, _PHYSICS),
    "solarize": _sql(f"CASE WHEN u < 0.2::DOUBLE THEN {_each('CASE WHEN v < 128 THEN v ELSE 255 - v END')} ELSE p END", extra=f", {_u('solarize', 'p')} AS u"),
    "rotate90": _sql(f"CASE k WHEN 1 THEN {_REMAP(_X, f'(7 - {_Y})')} WHEN 2 THEN list_reverse(p[1:64]) || list_reverse(p[65:128]) || list_reverse(p[129:192]) WHEN 3 THEN {_REMAP(f'(7 - {_X})', _Y)} ELSE p END", extra=f", floor({_u('rotate', 'k')} * 4) AS k"),
    "flip": _sql(_REMAP(f"CASE WHEN b < 0.3::DOUBLE THEN 7 - {_Y} ELSE {_Y} END", f"CASE WHEN a < 0.5 THEN 7 - {_X} ELSE {_X} END"), extra=f", {_u('flip', 'h')} AS a, {_u('flip', 'v')} AS b"),
    "normalize_pixels": _sql(_NORMAL),
    "denormalize": _sql(_each(f"floor({_CLAMP(f'(v / 64 - 2) * {_by(STD["imagenet"])} + {_by(MEAN["imagenet"])}')} * 255)")),
    "grayscale": _sql(f"CASE WHEN u < 0.2::DOUBLE THEN {_LUMA('p')} || {_LUMA('p')} || {_LUMA('p')} ELSE p END", "un", extra=f", {_u('gray', 'p')} AS u"),
    "color_jitter": f"""WITH {_UNITS}, a AS (SELECT *, {_u('jitter', 'p')} AS u, {_u('jitter', 'b', 0.6, 1.4)} AS b, {_u('jitter', 'c', 0.6, 1.4)} AS c, {_u('jitter', 's', 0.8, 1.2)} AS s FROM un), x AS (SELECT *, list_transform(p, lambda v: {_CLAMP('v * b')}) AS y FROM a),
m AS (SELECT *, list_sum({_LUMA('y')}) / 64 AS m FROM x), z AS (SELECT *, list_transform(y, lambda v: {_CLAMP('v * c + m * (1 - c)')}) AS z FROM m), g AS (SELECT *, {_LUMA('z')} AS g FROM z),
o AS (SELECT vec_id, CASE WHEN u < 0.8::DOUBLE THEN list_transform(z, lambda v, i: {_CLAMP('v * s + g[(i - 1) % 64 + 1] * (1 - s)')}) ELSE p END AS p FROM g) SELECT vec_id, round(list_sum(p), 6) AS total, round(list_sum(list_transform(p, lambda v, i: v * (i - 1))) / 192, 6) AS moment FROM o""",
    "blur_3tap": _sql(f"list_transform(range(1, 193), lambda i: (r[({_C} * 8 + {_MIRROR(f'{_Y} - 1')}) * 8 + {_X} + 1] * g + r[i] + r[({_C} * 8 + {_MIRROR(f'{_Y} + 1')}) * 8 + {_X} + 1] * g) / (1 + 2 * g))", "rw",
                      f", sg AS (SELECT *, exp(-0.5::DOUBLE / pow({_u('blur', 'sigma', 0.1, 2.0)}, 2)) AS g FROM un), rw AS (SELECT vec_id, g, list_transform(range(1, 193), lambda i: (p[({_C} * 8 + {_Y}) * 8 + {_MIRROR(f'{_X} - 1')} + 1] * g + p[i] + p[({_C} * 8 + {_Y}) * 8 + {_MIRROR(f'{_X} + 1')} + 1] * g) / (1 + 2 * g)) AS r FROM sg)"),
    "blur_9tap": _sql(f"list_transform(range(1, 193), lambda i: list_sum(list_transform(range(-4, 5), lambda k: r[({_C} * 8 + {_MIRROR(f'{_Y} + k')}) * 8 + {_X} + 1] * g[k + 5])))", "rw",
                      f", sg AS (SELECT vec_id, p, list_transform(range(-4, 5), lambda k: exp(-0.5::DOUBLE * pow(k / {_u('blur', 'sigma', 0.1, 2.0)}, 2))) AS e FROM un), sh AS (SELECT vec_id, p, list_transform(e, lambda v: v / list_sum(e)) AS g FROM sg), rw AS (SELECT vec_id, g, list_transform(range(1, 193), lambda i: list_sum(list_transform(range(-4, 5), lambda k: p[({_C} * 8 + {_Y}) * 8 + {_MIRROR(f'{_X} + k')} + 1] * g[k + 5]))) AS r FROM sh)"),
    "translate_fill": _sql(f"list_transform(range(1, 193), lambda i: CASE WHEN {_Y} - dy BETWEEN 0 AND 7 AND {_X} - dx BETWEEN 0 AND 7 THEN p[({_C} * 8 + {_Y} - dy) * 8 + {_X} - dx + 1] ELSE {_by([float(round(m * 255)) for m in MEAN['benthic']])} END)", extra=f", CAST(floor({_u('translate', 'y', -0.8, 0.8)} + 0.5::DOUBLE) AS INTEGER) AS dy, CAST(floor({_u('translate', 'x', -0.8, 0.8)} + 0.5::DOUBLE) AS INTEGER) AS dx"),
    "pixel_mask": f"""WITH {masks.HIDDEN_SQL.replace('range(2) v(view)', 'range(1) v(view)')}, mk AS (SELECT s.vec_id, list(h.patch) AS hidden FROM s LEFT JOIN h ON h.vec_id = s.vec_id GROUP BY s.vec_id), {_IMAGES}, nm AS (SELECT vec_id, {_NORMAL} AS p FROM im),
oo AS (SELECT vec_id, list_transform(p, lambda v, i: CASE WHEN list_contains(hidden, CAST({_Y} // 2 * 4 + {_X} // 2 AS INTEGER)) THEN 0 ELSE v END) AS p FROM nm JOIN mk USING (vec_id)) SELECT vec_id, round(list_sum(p), 6) AS total, round(list_sum(list_transform(p, lambda v, i: v * (i - 1))) / 192, 6) AS moment FROM oo""",
    "patchify": f"""WITH {_IMAGES}, e AS (SELECT vec_id, i - 1 AS i, p[i] AS v FROM im, range(1, 193) r(i)), q AS (SELECT vec_id, v, (i // 8 % 8) // 2 * 4 + (i % 8) // 2 AS patch, i // 64 * 4 + (i // 8 % 2) * 2 + i % 2 AS j FROM e)
SELECT vec_id, CAST(patch AS INTEGER) AS patch, sum(v) AS total, sum(v * j) AS moment FROM q GROUP BY vec_id, patch""",
}
