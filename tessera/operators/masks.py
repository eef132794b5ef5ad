"""Masks over a grid of patches: which slots of a batch get one, how large, and where.

All draws are keyed hashes, so a mask depends on its key alone.  A slot's mask is an array over
the patches of its grid; blocks are drawn in bounded numpy work per slot, the rest is columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import bind, keyed_uniform, uniform_sql
from ..functions.frames import spread
from ..session import ship

BATCH, PATCHES, SHARE, LOW, HIGH = 32, 16, 0.5, 0.1, 0.5
TRIES, LEAST_AREA, ASPECT = 10, 4, 0.3


def n_masked(batch: int = BATCH, share: float = SHARE) -> int:
    return int(batch * share)


def target(i: Column, n: int, patches: int, low: float = LOW, high: float = HIGH) -> Column:
    """Patches that the i-th (from 1) of n masks hides: its place among equal steps from low to high."""
    return F.floor(F.lit(float(patches)) * (F.lit(low) + F.lit(high - low) * i / F.lit(float(max(1, n))))).cast("int")


def slots(samples: DataFrame, key: list[str], batch: str, views: int = 2, size: int = BATCH, patches: int = PATCHES, seed: int = 0) -> DataFrame:
    """A row per sample and view: view, place (of its mask in the batch, from 1) and n_target, 0 where there is none.

    Places are a keyed order within the batch, so which samples have masks differs by view.
    """
    n = n_masked(size)
    rows = samples.select("*", F.explode(F.sequence(F.lit(0), F.lit(views - 1))).alias("view"))
    draw = keyed_uniform(seed, "slot", F.col("view"), *[F.col(k) for k in key])
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy(batch, "view").orderBy(draw, *key)))
    return rows.withColumn("n_target", F.when(F.col("place") <= n, target(F.col("place"), n, patches)).otherwise(F.lit(0)))


def complete(mask: Column, n_target: Column, draws: Column) -> Column:
    """mask (array of booleans) with patches added, those of the smallest draws first, until n_target are true."""
    short = n_target - F.size(F.filter(mask, lambda m: m))
    free = F.array_sort(F.filter(F.zip_with(mask, draws, lambda m, u: F.when(~m, u)), lambda u: u.isNotNull()))
    limit = lambda s: F.when(s > 0, F.get(free, s - 1)).otherwise(F.lit(-1.0))
    return bind(limit(short), lambda most: F.zip_with(mask, draws, lambda m, u: m | (u <= most)))


def draws(patches: int, *key) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(patches - 1)), lambda p: keyed_uniform(*key, p.cast("string")))


def hidden(rows: DataFrame, key: list[str], patches: int = PATCHES, seed: int = 0) -> DataFrame:
    """rows of slots() with mask: n_target patches, at random."""
    none = F.array_repeat(F.lit(False), patches)
    return rows.withColumn("mask", complete(none, F.col("n_target"), draws(patches, seed, "patch", F.col("view"), *[F.col(k) for k in key])))


def weight(mask: Column) -> Column:
    """What each hidden patch of a sample weighs: one over their number."""
    return 1.0 / F.greatest(F.size(F.filter(mask, lambda m: m)), F.lit(1))


def block_mask(height: int, width: int, n_target: int, most: int, random: np.random.Generator) -> np.ndarray:
    """A mask of exactly n_target patches: the union of rectangles, each the first of TRIES drawn at once that is smaller than
    the grid and adds between one and the allowed number of patches; where no draw does, single patches by order of a draw."""
    y, x = np.arange(height)[:, None], np.arange(width)[None, :]
    mask = np.zeros((height, width), bool)
    while (room := min(n_target - int(mask.sum()), most)) > 0:
        u = random.random((4, TRIES))
        area, shape = LEAST_AREA + u[0] * (room - LEAST_AREA), ASPECT ** (1 - 2 * u[1])
        h, w = np.rint(np.sqrt(area * shape)).astype(int), np.rint(np.sqrt(area / shape)).astype(int)
        top, left = np.floor(u[2] * (height - h + 1)).astype(int), np.floor(u[3] * (width - w + 1)).astype(int)
        inside = (y >= top[:, None, None]) & (y < (top + h)[:, None, None]) & (x >= left[:, None, None]) & (x < (left + w)[:, None, None])
        new = (inside & ~mask).sum((1, 2))
        fits = np.flatnonzero((h < height) & (w < width) & (new > 0) & (new <= room))
        if not len(fits):
            break
        mask |= inside[fits[0]]
    flat = mask.ravel()
    order = np.argsort(random.random(len(flat)))
    flat[order[~flat[order]][: max(0, n_target - int(flat.sum()))]] = True
    return flat


def block_masks(rows: DataFrame, key: list[str], height: int, width: int, seed: int = 0) -> DataFrame:
    """rows of slots() with mask made of rectangles, of at most half the grid each, drawn from the row's own key."""
    kept = rows.columns

    def run(batches):
        for b in batches:
            at = [b.column(kept.index(c)).to_pylist() for c in [*key, "view", "n_target"]]
            masks = []
            for *k, n in zip(*at, strict=True):
                own = np.random.default_rng(list(hashlib.sha256(repr((seed, k)).encode()).digest()))
                masks.append(block_mask(height, width, n, height * width // 2, own).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(masks, pa.list_(pa.bool_()))], [*kept, "mask"])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", mask array<boolean>")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full batches of embeddings; the last one isn't used if it isn't full."""
    e = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", F.floor(F.col("vec_id") / BATCH).cast("long").alias("batch"), (F.col("vec_id") % BATCH).cast("int").alias("slot"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    full = e.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == BATCH).select("batch")
    return e.join(full, "batch", "left_semi")


def _slots(spark, sf_dir):
    return slots(samples(spark, sf_dir).select("vec_id", "batch", "slot"), ["vec_id"], "batch")


def mask_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.range(1, BATCH + 1).select(F.col("id").cast("int").alias("place"))
    n = n_masked()
    return t.select("place", *[F.when(F.col("place") <= n, target(F.col("place"), n, p)).otherwise(0).alias(f"of_{p}") for p in (16, 196)])


def mask_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir).select("vec_id", "view", "place", "n_target")


def mask_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of both views that begin with the first two patches hidden, made whole."""
    rows = _slots(spark, sf_dir).where("n_target >= 2")
    begun = F.transform(F.sequence(F.lit(0), F.lit(PATCHES - 1)), lambda p: p < 2)
    mask = complete(begun, F.col("n_target"), draws(PATCHES, 0, "patch", F.col("view"), F.col("vec_id")))
    return rows.select("vec_id", "view", F.array_join(F.transform(mask, lambda m: m.cast("int").cast("string")), "").alias("mask"))


def mask_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hidden(_slots(spark, sf_dir), ["vec_id"])
    return rows.select("vec_id", "view", F.posexplode("mask").alias("patch", "masked"), F.round(weight(F.col("mask")), 9).alias("weight")).where("masked").select("vec_id", "view", "patch", "weight")


def mask_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = block_masks(_slots(spark, sf_dir), ["vec_id"], 14, 14)
    return rows.select("vec_id", "view", "n_target", F.size(F.filter("mask", lambda m: m)).alias("n_masked"))


QUERIES = {f.__name__: f for f in (mask_targets, mask_slots, mask_complete, mask_weights, mask_blocks)}


def target_sql(i: str, n: int, patches: int) -> str:
    return f"CASE WHEN {i} <= {n} THEN CAST(floor({patches}.0::DOUBLE * ({LOW}::DOUBLE + {HIGH - LOW}::DOUBLE * {i} / {n}.0::DOUBLE)) AS INTEGER) ELSE 0 END"


SAMPLES_SQL = f"s AS (SELECT vec_id, vec_id // {BATCH} AS batch, CAST(vec_id % {BATCH} AS INTEGER) AS slot, embedding::DOUBLE[] AS x FROM embeddings QUALIFY count(*) OVER (PARTITION BY vec_id // {BATCH}) = {BATCH})"
SLOTS_SQL = f"""{SAMPLES_SQL}, o AS (SELECT vec_id, batch, slot, CAST(view AS INTEGER) AS view, CAST(row_number() OVER (PARTITION BY batch, view ORDER BY {uniform_sql("'0'", "'slot'", "view", "vec_id")}, vec_id) AS INTEGER) AS place FROM s, range(2) v(view)),
t AS (SELECT *, {target_sql("place", n_masked(), PATCHES)} AS n_target FROM o)"""
HIDDEN_SQL = f"""{SLOTS_SQL}, h AS (SELECT vec_id, batch, view, CAST(patch AS INTEGER) AS patch, n_target, 1.0::DOUBLE / n_target AS weight FROM t, range({PATCHES}) p(patch) WHERE n_target > 0 QUALIFY row_number() OVER (PARTITION BY vec_id, view ORDER BY {uniform_sql("'0'", "'patch'", "view", "vec_id", "patch")}) <= n_target)"""

ORACLES = {
    "mask_targets": "SELECT CAST(i AS INTEGER) AS place, " + ", ".join(f"{target_sql('i', n_masked(), p)} AS of_{p}" for p in (16, 196)) + f" FROM range(1, {BATCH + 1}) r(i)",
    "mask_slots": f"WITH {SLOTS_SQL} SELECT vec_id, view, place, n_target FROM t",
    "mask_complete": f"""WITH {SLOTS_SQL}, d AS (SELECT vec_id, view, patch, n_target, patch < 2 AS begun, row_number() OVER (PARTITION BY vec_id, view, patch < 2 ORDER BY {uniform_sql("'0'", "'patch'", "view", "vec_id", "patch")}) AS k FROM t, range({PATCHES}) p(patch) WHERE n_target >= 2)
SELECT vec_id, view, string_agg(CASE WHEN begun OR k <= n_target - 2 THEN '1' ELSE '0' END, '' ORDER BY patch) AS mask FROM d GROUP BY vec_id, view""",
    "mask_weights": f"WITH {HIDDEN_SQL} SELECT vec_id, view, patch, round(weight, 9) AS weight FROM h",
    "mask_blocks": f"WITH {SLOTS_SQL} SELECT vec_id, view, n_target, n_target AS n_masked FROM t",
}
