"""Mixing sources to target weights by systematic sampling.

Every document of a source expects `rate = target / source_size` copies.  Within
a source, in order of size (large first) and id, the expected copies are summed up from one
random offset, and a document is emitted once for each integer boundary its own share
crosses.  As sizes fall slowly along that order, what a source gives is within about
one document of its target.

Ranks come from one range shuffle, so no source, however large, is handled by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, named, plain_names, table, words, written

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, 17


def allocate(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets of sources: columns source, source_size, n_docs gain weight, target and the rows before the source.

    Sources by code point, null last, take the weights in turn.  The targets sum to share x all
    sizes; none is above cap x its source's size, and an excess goes to the others by weight.
    With the level L for which sum(least(cap_i, weight_i * L)) is the whole, that is
    least(cap_i, weight_i * L); L is found from prefix sums in order of cap_i / weight_i.
    Its windows see one row per source, never documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    t = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    t = t.withColumn("before", F.sum("n_docs").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n_docs"))
    t = t.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    below = F.sum("most").over(by_ratio.rowsBetween(W.unboundedPreceding, 0)) - F.col("most")
    left = F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    t = t.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything) - below) / left)
    level = F.max(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.col("level"))).over(everything)
    t = t.withColumn("target", F.least(F.col("most"), F.coalesce(F.col("weight") * level, F.col("most"))))
    return t.select("source", "source_size", "n_docs", "before", "weight", "target")


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source, in [0, 1): a function of the seed and the source alone, so reruns agree."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target, copies and taken (copies x size); no row is dropped.

    A column of docs with one of these names is replaced.  Nulls: a null source is a source of
    its own, the last in order; null keys sort last; a null size counts 0.  A source without
    words gets target 0 and no copies.  Repeated rows are documents of their own; equal ones
    may swap copies with each other.  An empty table gives an empty result.
    """
    docs, name = plain_names(docs.drop(*[c for c in docs.columns if c.lower() in ("size", "source_size", "target", "copies", "taken")]))
    source, key = name[source], name[key]
    at, first, shard = (fresh(docs, x) for x in ("mix_at", "mix_first", "mix_shard"))
    sized = docs.withColumn("size", F.coalesce(size.cast("long"), F.lit(0).cast("long")))
    order = [F.col(source).asc_nulls_last(), F.col("size").desc(), F.col(key).asc_nulls_last()]
    ranked = written(sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranked")
    # the id is the partition's number, then 33 bits for the place in it
    ranked = ranked.withColumn(shard, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    shards = ranked.groupBy(shard).agg(F.count(F.lit(1)).alias(first))
    shards = written(shards.withColumn(first, F.sum(first).over(W.orderBy(shard)) - F.col(first)), "shards")
    totals = ranked.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = written(allocate(totals, weights, share, cap), "targets")
    names = {c: fresh(ranked, f"mix_{c}") for c in ("source", "before")}
    plan = plan.select(F.col("source").alias(names["source"]), F.col("before").alias(names["before"]), "source_size", "target")
    joined = ranked.join(shards, shard).join(plan, F.col(source).eqNullSafe(F.col(names["source"])))
    rank = F.col(first) + F.col(at) - F.col(names["before"]) + 1
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = offset(F.col(source), seed)
    copies = F.floor(start + rank * rate) - F.floor(start + (rank - 1) * rate)
    joined = joined.withColumn("copies", F.least(copies, F.ceil(F.lit(float(cap)))).cast("long"))
    return named(joined.withColumn("taken", F.col("copies") * F.col("size")).select(*docs.columns, "size", "source_size", "target", "copies", "taken"), name)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's target and what the mix takes of it."""
    # written, since the range shuffle reads its input twice and words would be counted twice
    docs = written(table(spark, sf_dir, "documents").select("doc_id", "source", F.size(words(F.col("text"))).alias("n")), "sizes")
    return mix(docs, F.col("n")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def emit(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mixed corpus itself: the columns of docs, whatever their names, a row as often as it is taken.

    Nulls, repeated rows and empty tables: as `mix` has them; texts without words are never taken.
    """
    plain, name = plain_names(docs, every=True)
    held = written(plain.select("*", F.size(words(F.col(name[text]))).alias("mix_words"), F.monotonically_increasing_id().alias("mix_row")), "sized")  # words are counted once, and row numbers stay
    # ranges of sizes would put the longest texts into one task, so only sizes are ordered and texts meet their copies by row
    mixed = mix(held.select("mix_row", name[source], name[key], "mix_words"), F.col("mix_words"), name[source], name[key], **options)
    taken = held.join(mixed.where("copies > 0").select("mix_row", "copies"), "mix_row")
    taken = taken.select(*name.values(), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return named(taken.select(*name.values()), name)


QUERIES = {"op2_mix_sources": op2_mix_sources}

ORACLES = {
    "op2_mix_sources": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, 2.0::DOUBLE * CAST(sum(size) AS DOUBLE) AS most,
             [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(most) OVER o - most)) / (sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
      FROM t WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT source, source_size, least(most, coalesce(weight * max(CASE WHEN most / weight >= level THEN level END) OVER (), most)) AS target FROM l),
r AS (SELECT d.doc_id, d.size, a.source_size, a.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id NULLS LAST) AS rank,
             CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0.0::DOUBLE END AS rate,
             CAST('0x' || substr(md5('17|' || coalesce('s' || d.source, 'n')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS start
      FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
c AS (SELECT *, least(CAST(floor(start + rank * rate) - floor(start + (rank - 1) * rate) AS BIGINT), 2) AS copies FROM r)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, copies * size AS taken, copies FROM c"""
}
