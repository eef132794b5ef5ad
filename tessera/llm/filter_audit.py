"""How five text filters interact: what each removes in every order that they can be applied in.

A document's failed filters are five bits.  Which step of an order removes it depends on these
bits alone, so one table of 32 masks by 120 orders holds every first failure.  Tasks count their
rows by part, label and mask, look these counts up in the table, and hand back arrays of removals by part, order and step;
Spark adds the arrays up.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from .common import dealt, table, words, written

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_SHARE, UPPER_SHARE, SYMBOLS = 100, 80, 10, "[#$%&*|]"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS, STEPS = 1 << len(FILTERS), len(FILTERS)
#: Cells of a part's array: a step of an order each, then all documents, then failures and lone failures by filter.
CELLS = len(ORDERS) * STEPS
#: Parts whose arrays a task holds at once (16 kB each); more are handed on in between.
PARTS = 1000
#: Up to this many texts that occur twice or more (24 bytes each) are sent to every executor; beyond, they meet documents by text and part.
BROADCAST_COPIES, SALTS = 200_000, 32
PARTIAL = "part string, cell int, n long, good long, toxic long"


def first_failures() -> np.ndarray:
    """For each mask and order, the step (from 0) whose filter is the first to fail; STEPS where none does."""
    found = np.full((MASKS, len(ORDERS)), STEPS, np.int64)
    for mask in range(MASKS):
        for o, order in enumerate(ORDERS):
            failing = [s for s, f in enumerate(order) if mask >> FILTERS.index(f) & 1]
            found[mask, o] = failing[0] if failing else STEPS
    return found


def failed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of every row of docs (doc_id, text, lang; others are ignored).

    A null text is empty and has no words; a null lang is the part ''.  A row fails E if a smaller doc_id has
    its text, so of rows that repeat the smallest id and its text none does, and a row without an id never does, nor makes others fail.  A document
    counts as good (toxic) if any of its labels says so; labels without an id belong to none.  Empty tables give empty results.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    n_words, n_distinct = F.size("fa_words"), F.size(F.array_distinct("fa_words"))
    bits = F.when(n_words < MIN_WORDS, 1).otherwise(0) + F.when(100 * n_distinct < DISTINCT_SHARE * n_words, 2).otherwise(0)
    bits = bits + F.when(100 * F.regexp_count("fa_text", F.lit("[A-Z]")) > UPPER_SHARE * F.length("fa_text"), 4).otherwise(0) + F.when(F.col("fa_text").rlike(SYMBOLS), 8).otherwise(0)
    rows = docs.select(F.col("doc_id").alias("fa_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("fa_text"), words(F.col("text")).alias("fa_words"))
    rows = written(rows.select("fa_id", "part", F.unhex(F.md5("fa_text")).alias("digest"), F.xxhash64("fa_text").alias("hash"), bits.cast("int").alias("mask")), "failed")

    copies = rows.groupBy("digest", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("fa_id").alias("first")).where("n > 1").select("digest", "hash", "first")
    copies = written(copies, "copies")
    if copies.count() <= BROADCAST_COPIES:
        rows = rows.join(F.broadcast(copies), ["digest", "hash"], "left")
    else:
        copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("fa_id", "part"), F.lit(SALTS)).cast("int")).join(copies, ["digest", "hash", "salt"], "left")
    mask = F.col("mask") + F.when(F.col("fa_id") > F.col("first"), 16).otherwise(0)

    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("fa_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows without an id match no label; a salt keeps them from being one task's
    rows = rows.select("fa_id", "part", mask.alias("mask"), F.when(F.col("fa_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(997)).cast("int")).otherwise(0).alias("salt"))
    rows = rows.join(marked.withColumn("salt", F.lit(0)), ["fa_id", "salt"], "left")
    return rows.select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def _removals(batches):
    """Arrays of counts by cell, of every part in a task's rows (part, mask, good, toxic)."""
    table = first_failures()
    steps = np.arange(len(ORDERS)) * STEPS + table  # the cell of a mask in each order, where a step removes it
    removed = table < STEPS
    held: dict[str, np.ndarray] = {}  # counts by mask, for all, good and toxic rows

    def partial():
        for part, by_mask in held.items():
            hit = np.zeros((CELLS + 1 + 2 * STEPS, 3), np.int64)
            for k in range(3):
                weight = np.broadcast_to(by_mask[k][:, None], table.shape)[removed].astype(np.float64)
                hit[:CELLS, k] = np.bincount(steps[removed], weight, CELLS).astype(np.int64)
            hit[CELLS, 0] = by_mask[0].sum()
            for f in range(STEPS):
                hit[CELLS + 1 + f, 0] = by_mask[0][np.arange(MASKS) >> f & 1 == 1].sum()
                hit[CELLS + 1 + STEPS + f, 0] = by_mask[0][1 << f]
            cells = np.arange(len(hit), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(hit), pa.string()), pa.array(cells), *(pa.array(hit[:, k]) for k in range(3))], [c.split()[0] for c in PARTIAL.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        parts = pa.compute.dictionary_encode(batch.column("part"))
        names, at = parts.dictionary.to_pylist(), parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        mask, good, toxic = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "good", "toxic"))
        cell, size = at * MASKS + mask, len(names) * MASKS
        counts = np.stack([np.bincount(cell, minlength=size), np.bincount(cell[good == 1], minlength=size), np.bincount(cell[toxic == 1], minlength=size)]).reshape(3, len(names), MASKS)
        for i, name in enumerate(names):
            held[name] = held[name] + counts[:, i] if name in held else counts[:, i]
        if len(held) > PARTS:
            yield from partial()
            held.clear()
    yield from partial()


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of that step: 600 rows for each lang value of docs.

    kept: left after the step; removed, good_lost, toxic_lost: removed by it; redundant: failing its filter but removed earlier;
    unique_fails: failing its filter only; shapley: removed by its filter at any step, over all orders.
    Nulls, copies and empty tables: as `failed` has them.  Further columns of docs are ignored.
    """
    ship(docs.sparkSession)
    sums = failed(docs, labels).mapInArrow(_removals, PARTIAL).groupBy("part", "cell").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    sums = written(sums, "removals")
    at = lambda cell: F.max(F.when(F.col("cell") == cell, F.col("n")))
    whole = sums.where(F.col("cell") >= CELLS).groupBy("part").agg(at(CELLS).alias("all"), F.array(*(at(CELLS + 1 + f) for f in range(STEPS))).alias("fails"), F.array(*(at(CELLS + 1 + STEPS + f) for f in range(STEPS))).alias("lone"))
    step = (F.col("cell") % STEPS).cast("int")
    steps = sums.where(F.col("cell") < CELLS).join(whole, "part")
    steps = steps.withColumn("filter_order", F.element_at(F.lit(ORDERS), (F.floor(F.col("cell") / STEPS) + 1).cast("int"))).withColumn("step", step + 1)
    steps = steps.withColumn("which", F.instr(F.lit(FILTERS), F.substring("filter_order", step + 1, F.lit(1))))
    gone = F.sum("n").over(W.partitionBy("part", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("all") - gone).alias("kept"),
        F.col("n").alias("removed"),
        (F.element_at("fails", F.col("which")) - F.col("n")).alias("redundant"),
        F.element_at("lone", F.col("which")).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(W.partitionBy("part", "which")).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every step of every order of the five filters, by language."""
    return audit(dealt(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


QUERIES = {"op13_filter_audit": op13_filter_audit}

ORACLES = {
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
             + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum([0] || bits[1:step - 1]) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, bit, sum(n) AS whole, sum(CASE WHEN mask & (bit | earlier::INTEGER) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & bit <> 0 AND mask & earlier::INTEGER = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & bit <> 0 AND mask & earlier::INTEGER <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & bit <> 0 AND mask & earlier::INTEGER = 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & bit <> 0 AND mask & earlier::INTEGER = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, bit, earlier)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
}
