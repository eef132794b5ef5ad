"""Plans of views: recipes as small tables, one row per image and view, boxes from keyed draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import between, bind, keyed_uniform, uniform_sql
from ..functions.frames import spread

#: Fixed values of the recipes: crop share of the area, side in pixels, chances and strengths, by recipe and kind of view.
FIELDS = "recipe string, kind string, low double, high double, side int, blur double, kernel int, solarize double, flip double, jitter double, brightness double, contrast double, saturation double, hue double, gray double, physics boolean, translate double"
RECIPES = [
    ("official", "global1", 0.32, 1.0, 224, 1.0, 9, 0.0, 0.0, 0.8, 0.4, 0.4, 0.2, 0.1, 0.2, False, 0.0),
    ("official", "global2", 0.32, 1.0, 224, 0.1, 9, 0.2, 0.0, 0.8, 0.4, 0.4, 0.2, 0.1, 0.2, False, 0.0),
    ("official", "local", 0.05, 0.32, 112, 0.5, 9, 0.0, 0.0, 0.8, 0.4, 0.4, 0.2, 0.1, 0.2, False, 0.0),
    ("marine", "global1", 0.32, 1.0, 224, 0.8, 15, 0.0, 0.5, 0.8, 0.5, 0.5, 0.3, 0.15, 0.2, True, 0.0),
    ("marine", "global2", 0.32, 1.0, 224, 0.3, 15, 0.25, 0.5, 0.8, 0.5, 0.5, 0.3, 0.15, 0.2, True, 0.0),
    ("marine", "local", 0.05, 0.32, 96, 0.5, 7, 0.0, 0.5, 0.8, 0.5, 0.5, 0.3, 0.15, 0.2, True, 0.0),
    ("default", "global1", 0.4, 1.0, 224, 1.0, 23, 0.0, 0.5, 1.0, 0.4, 0.4, 0.2, 0.1, 0.0, False, 0.1),
    ("default", "global2", 0.4, 1.0, 224, 1.0, 23, 0.0, 0.5, 1.0, 0.4, 0.4, 0.2, 0.1, 0.0, False, 0.1),
    ("default", "local", 0.05, 0.4, 96, 1.0, 5, 0.0, 0.5, 1.0, 0.4, 0.4, 0.2, 0.1, 0.0, False, 0.0),
]
RATIO, TRIES = (0.75, 1.333), 10
MODES = (("official", True), ("marine", True), ("default", True), ("default", False))


def recipes(spark: SparkSession, side: int = 224, local_side: int | None = None) -> DataFrame:
    """The recipe table for other sides; the official recipe's local side is fixed."""
    rows = [(*r[:4], side if r[1] != "local" else (r[4] if r[0] == "official" or local_side is None else local_side), *r[5:]) for r in RECIPES]
    return spark.createDataFrame(rows, FIELDS)


def chosen(official: bool, marine: bool) -> str:
    """Which recipe holds when several are asked for."""
    return "official" if official else "marine" if marine else "default"


def multicrop(images: DataFrame, recipe: str, n_global: int = 2, n_local: int = 8) -> DataFrame:
    """images with a row per view: view, kind and the recipe's fields; global views first, beyond the second like the second."""
    kind = lambda v: F.when(v < n_global, F.concat(F.lit("global"), F.least(v + 1, F.lit(2)).cast("string"))).otherwise("local")
    views = images.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(n_global + n_local - 1)))).withColumn("kind", kind(F.col("view")))
    table = recipes(images.sparkSession).where(F.col("recipe") == recipe)
    return views.join(F.broadcast(table), "kind")  # three rows


def resized_crop_box(height: Column, width: Column, low: Column, high: Column, *key) -> Column:
    """struct(top, left, height, width): the first of ten drawn boxes that fits the image, else the largest central one of a permitted shape."""
    u = lambda what, k: keyed_uniform("box", what, *key, k.cast("string"))
    log = [math.log(r) for r in RATIO]

    def one(k: Column) -> Column:
        def sized(area: Column) -> Column:
            shape = F.exp(between(u("shape", k), *log))
            w, h = F.bround(F.sqrt(area * shape)).cast("int"), F.bround(F.sqrt(area / shape)).cast("int")
            return F.struct(F.floor(u("top", k) * (height - h + 1)).cast("int").alias("top"), F.floor(u("left", k) * (width - w + 1)).cast("int").alias("left"), h.alias("height"), w.alias("width"))

        return bind(height * width * (low + u("area", k) * (high - low)), sized)

    fits = lambda b: (b["width"] > 0) & (b["width"] <= width) & (b["height"] > 0) & (b["height"] <= height)
    # most first draws fit, so the others are only drawn where it didn't
    first = F.get(F.filter(F.transform(F.array(F.lit(0)), one), fits), F.lit(0))
    others = F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(TRIES - 1)), one), fits), F.lit(0))
    shape = width / height
    w = F.when(shape > RATIO[1], F.bround(height * F.lit(RATIO[1])).cast("int")).otherwise(width)
    h = F.when(shape < RATIO[0], F.bround(width / F.lit(RATIO[0])).cast("int")).otherwise(height)
    middle = F.struct(((height - h) / 2).cast("int").alias("top"), ((width - w) / 2).cast("int").alias("left"), h.alias("height"), w.alias("width"))
    return F.coalesce(first, others, middle)


def center_crop_box(height: Column, width: Column, side: int) -> Column:
    """struct(height, width, top, left): the size once the short side has this length, and where a central square begins (halves to even)."""
    short = F.least(height, width)
    h = F.when(height <= width, F.lit(side)).otherwise(F.floor(F.lit(float(side)) * height / short).cast("int"))
    w = F.when(width <= height, F.lit(side)).otherwise(F.floor(F.lit(float(side)) * width / short).cast("int"))
    return F.struct(h.alias("height"), w.alias("width"), F.bround((h - side) / 2.0).cast("int").alias("top"), F.bround((w - side) / 2.0).cast("int").alias("left"))


def side_crop_box(height: Column, width: Column, low: float, high: float, *key) -> Column:
    """struct(left, top, right, bottom): the scale is drawn for the sides, so the image's shape stays."""
    scale = between(keyed_uniform("side", "scale", *key), low, high)
    w, h = F.floor(width * scale).cast("int"), F.floor(height * scale).cast("int")
    left = F.floor(keyed_uniform("side", "left", *key) * (width - w + 1)).cast("int")
    top = F.floor(keyed_uniform("side", "top", *key) * (height - h + 1)).cast("int")
    return F.struct(left.alias("left"), top.alias("top"), (left + w).alias("right"), (top + h).alias("bottom"))


def _sizes(spark, sf_dir) -> DataFrame:
    """Images of various sizes: one per document."""
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"))
    return d.select("doc_id", (F.col("doc_id") * 37 % 500 + 60).cast("int").alias("height"), (F.col("doc_id") * 101 % 900 + 60).cast("int").alias("width"))


def recipe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes(spark)


def multicrop_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multicrop(_sizes(spark, sf_dir), "marine", 3, 4).select("doc_id", "view", "kind", "side", "solarize")


def rrc_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = multicrop(_sizes(spark, sf_dir), "default", 1, 1)
    box = resized_crop_box(F.col("height"), F.col("width"), F.col("low"), F.col("high"), F.col("doc_id"), F.col("view"))
    d = d.select("doc_id", "view", box.alias("b"))
    return d.select("doc_id", "view", F.col("b.top").alias("box_top"), F.col("b.left").alias("box_left"), F.col("b.height").alias("box_height"), F.col("b.width").alias("box_width"))


def center_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _sizes(spark, sf_dir).select("doc_id", center_crop_box(F.col("height"), F.col("width"), 224).alias("b"))
    return d.select("doc_id", F.col("b.height").alias("new_height"), F.col("b.width").alias("new_width"), F.col("b.top").alias("crop_top"), F.col("b.left").alias("crop_left"))


def notebook_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which steps a view of the simpler recipe takes, in its order: flip, crop, jitter, gray, blur, solarize."""
    d = _sizes(spark, sf_dir).select("doc_id", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(b).alias("blur"), F.lit(s).alias("sol")) for k, b, s in (("global1", 1.0, 0.0), ("global2", 0.1, 0.2), ("local", 0.5, 0.0))])))
    u = lambda what: keyed_uniform("plan", what, F.col("doc_id"), F.col("kind"))
    steps = [F.when(u("flip") < 0.5, "flip"), F.lit("crop"), F.when(u("jitter") < 0.8, "jitter"), F.when(u("gray") < 0.2, "gray"), F.when(u("blur") < F.col("blur"), "blur"), F.when(u("solarize") < F.col("sol"), "solarize")]
    return d.select("doc_id", "kind", F.concat_ws(">", *steps).alias("steps"), F.round(between(u("radius"), 0.1, 2.0), 6).alias("radius"))


def notebook_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes drawn anew for display: not those of the crops."""
    b = side_crop_box(F.col("height"), F.col("width"), 0.05, 0.4, F.col("doc_id"))
    d = _sizes(spark, sf_dir).select("doc_id", b.alias("b"))
    return d.select("doc_id", F.col("b.left").alias("x0"), F.col("b.top").alias("y0"), F.col("b.right").alias("x1"), F.col("b.bottom").alias("y1"))


def grid(spark: SparkSession, n_global: int = 2, n_local: int = 3) -> DataFrame:
    """The cells of a contact sheet: a row per mode after the row of the reference, a column per view, with titles."""
    modes = spark.createDataFrame([(i + 1, *m) for i, m in enumerate(MODES)], "line int, recipe string, orientation boolean")
    views = modes.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(n_global + n_local - 1))))
    kind = F.when(F.col("view") < n_global, F.concat(F.lit("global"), F.least(F.col("view") + 1, F.lit(2)).cast("string"))).otherwise("local")
    cells = views.withColumn("kind", kind).join(F.broadcast(recipes(spark)), ["recipe", "kind"])
    number = F.when(F.col("view") < n_global, F.col("view")).otherwise(F.col("view") - n_global)
    letter = F.when(F.col("view") < n_global, "G").otherwise("L")
    cells = cells.select("line", "recipe", "orientation", "view", F.format_string("%s%d (%dpx)", letter, number, F.col("side")).alias("title"))
    return cells.unionByName(spark.createDataFrame([(0, "reference", False, 0, "reference (224px)")], "line int, recipe string, orientation boolean, view int, title string"))


def mode_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark)


QUERIES = {f.__name__: f for f in (recipe_table, multicrop_plan, rrc_box, notebook_plan, notebook_box, mode_grid)} | {"center_crop_box": center_crop}

_NAMES = ", ".join(x.split()[0] for x in FIELDS.split(", "))
_VALUES = "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in RECIPES) + f") AS t({_NAMES})"
_SIZES = "z AS (SELECT doc_id, CAST(doc_id * 37 % 500 + 60 AS INTEGER) AS height, CAST(doc_id * 101 % 900 + 60 AS INTEGER) AS width FROM documents)"
_B = lambda what: uniform_sql("'box'", f"'{what}'", "doc_id", "view", "k")
_S = lambda what: uniform_sql("'side'", f"'{what}'", "doc_id")
_P = lambda what: uniform_sql("'plan'", f"'{what}'", "doc_id", "kind")
_LOG = [math.log(r) for r in RATIO]

ORACLES = {
    "recipe_table": f"SELECT * FROM {_VALUES}",
    "multicrop_plan": f"WITH {_SIZES}, v AS (SELECT doc_id, CAST(view AS INTEGER) AS view, CASE WHEN view < 3 THEN 'global' || least(view + 1, 2) ELSE 'local' END AS kind FROM z, range(7) r(view)) SELECT doc_id, view, kind, side, solarize FROM v JOIN {_VALUES} USING (kind) WHERE recipe = 'marine'",
    "rrc_box": f"""WITH {_SIZES}, v AS (SELECT *, CASE WHEN view = 0 THEN 0.4::DOUBLE ELSE 0.05::DOUBLE END AS low, CASE WHEN view = 0 THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS high FROM z, range(2) r(view)),
t AS (SELECT *, height * width * (low + {_B("area")} * (high - low)) AS area, exp({_LOG[0]}::DOUBLE + {_B("shape")} * {_LOG[1] - _LOG[0]}::DOUBLE) AS shape FROM v, range({TRIES}) q(k)),
s AS (SELECT *, CAST(round_even(sqrt(area * shape), 0) AS INTEGER) AS w, CAST(round_even(sqrt(area / shape), 0) AS INTEGER) AS h FROM t),
f AS (SELECT doc_id, view, k, h, w, CAST(floor({_B("top")} * (height - h + 1)) AS INTEGER) AS y, CAST(floor({_B("left")} * (width - w + 1)) AS INTEGER) AS x FROM s WHERE w > 0 AND w <= width AND h > 0 AND h <= height QUALIFY row_number() OVER (PARTITION BY doc_id, view ORDER BY k) = 1),
m AS (SELECT *, CASE WHEN width / height > {RATIO[1]}::DOUBLE THEN CAST(round_even(height * {RATIO[1]}::DOUBLE, 0) AS INTEGER) ELSE width END AS mw, CASE WHEN width / height < {RATIO[0]}::DOUBLE THEN CAST(round_even(width / {RATIO[0]}::DOUBLE, 0) AS INTEGER) ELSE height END AS mh FROM v)
SELECT m.doc_id, CAST(m.view AS INTEGER) AS view, coalesce(y, (height - mh) // 2) AS box_top, coalesce(x, (width - mw) // 2) AS box_left, coalesce(h, mh) AS box_height, coalesce(w, mw) AS box_width FROM m LEFT JOIN f ON f.doc_id = m.doc_id AND f.view = m.view""",
    "center_crop_box": f"""WITH {_SIZES}, n AS (SELECT doc_id, CASE WHEN height <= width THEN 224 ELSE CAST(floor(224.0::DOUBLE * height / least(height, width)) AS INTEGER) END AS new_height, CASE WHEN width <= height THEN 224 ELSE CAST(floor(224.0::DOUBLE * width / least(height, width)) AS INTEGER) END AS new_width FROM z)
SELECT *, CAST(round_even((new_height - 224) / 2.0::DOUBLE, 0) AS INTEGER) AS crop_top, CAST(round_even((new_width - 224) / 2.0::DOUBLE, 0) AS INTEGER) AS crop_left FROM n""",
    "notebook_plan": f"""WITH d AS (SELECT doc_id, kind, blur, sol FROM documents, (VALUES ('global1', 1.0::DOUBLE, 0.0::DOUBLE), ('global2', 0.1::DOUBLE, 0.2::DOUBLE), ('local', 0.5::DOUBLE, 0.0::DOUBLE)) AS t(kind, blur, sol))
SELECT doc_id, kind, concat_ws('>', CASE WHEN {_P("flip")} < 0.5 THEN 'flip' END, 'crop', CASE WHEN {_P("jitter")} < 0.8::DOUBLE THEN 'jitter' END, CASE WHEN {_P("gray")} < 0.2::DOUBLE THEN 'gray' END, CASE WHEN {_P("blur")} < blur THEN 'blur' END, CASE WHEN {_P("solarize")} < sol THEN 'solarize' END) AS steps, round(0.1::DOUBLE + {_P("radius")} * 1.9::DOUBLE, 6) AS radius FROM d""",
    "notebook_box": f"""WITH {_SIZES}, s AS (SELECT *, 0.05::DOUBLE + {_S("scale")} * (0.4::DOUBLE - 0.05::DOUBLE) AS scale FROM z), b AS (SELECT *, CAST(floor(width * scale) AS INTEGER) AS w, CAST(floor(height * scale) AS INTEGER) AS h FROM s),
p AS (SELECT doc_id, w, h, CAST(floor({_S("left")} * (width - w + 1)) AS INTEGER) AS x0, CAST(floor({_S("top")} * (height - h + 1)) AS INTEGER) AS y0 FROM b) SELECT doc_id, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM p""",
    "mode_grid": f"""WITH m AS (SELECT * FROM (VALUES (1, 'official', true), (2, 'marine', true), (3, 'default', true), (4, 'default', false)) AS t(line, recipe, orientation)), v AS (SELECT *, CAST(view AS INTEGER) AS n, CASE WHEN view < 2 THEN 'global' || (view + 1) ELSE 'local' END AS kind FROM m, range(5) r(view))
SELECT line, v.recipe, orientation, n AS view, CASE WHEN n < 2 THEN 'G' || n ELSE 'L' || (n - 2) END || ' (' || side || 'px)' AS title FROM v JOIN {_VALUES} ON t.recipe = v.recipe AND t.kind = v.kind UNION ALL SELECT 0, 'reference', false, 0, 'reference (224px)'""",
}
