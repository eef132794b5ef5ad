"""A Merkle manifest of a table: a hash tree per source, one over their roots, and every row's proof.

Supersteps on RDDs of ((tree, number), digest): children message their digest to their parent, a
parent that has all of its children hashes them and forwards, until every tree has one node left.
Reverse supersteps hand each parent's path down to its children, with their siblings in front.  A
parent has three children, so no message group is large, however large the source; four levels
make one job, whose nodes or paths are then written.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions.frames import numbered
from ..session import ship
from .common import dealt, table, written

#: Children of a node, levels between two written tables, nodes of a task.
FAN, LEVELS, NODES = 3, 4, 100_000
NODE = "level int, tree long, i long, n long, run binary, digest binary"
PATH = "tree long, i long, subroot binary, path binary"


def digest(parts: list[bytes]) -> bytes:
    """sha256 of digests' hexadecimal text, one after the other."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """A row's digest in hexadecimal, with this text."""
    return F.sha2(F.concat(*(_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _field(text)), 256)


def tampered(text: Column) -> Column:
    """The text without line feeds where the id's checksum is even; rows without an id stay as they are."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def leaves(docs: DataFrame, change=tampered) -> DataFrame:
    """tree, i, n (its number in its source and how many there are), doc_id, leaf and changed (the leaf of the changed text, if it differs).

    Sources are numbered null first, then by their bytes; within one, rows ascend by doc_id, null first,
    and by digest.  Numbers come from one range shuffle and the counts of its partitions by source, so a source may be spread over many tasks.
    """
    text = F.col("text")
    hashed = docs.select("doc_id", "source", F.unhex(leaf(text)).alias("leaf"), F.when(~change(text).eqNullSafe(text), F.unhex(leaf(change(text)))).alias("changed"), F.monotonically_increasing_id().alias("row"))
    hashed = written(hashed, "hashed")
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")]
    ranked = written(hashed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    ranked = ranked.withColumn("part", F.shiftright("at", 33))
    cells = ranked.groupBy("part", "source").agg(F.count(F.lit(1)).alias("m"), F.min("at").alias("first"))
    by_source = W.partitionBy("source")
    before = F.sum("m").over(by_source.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("m")
    cells = written(cells.select("part", F.col("source").alias("of"), (before - F.col("first")).alias("shift"), F.sum("m").over(by_source).alias("n")), "cells")
    trees = numbered(cells.groupBy("of").agg(F.first("n").alias("n")).select(F.col("of").alias("named")), [F.col("named").asc_nulls_first()], "tree")
    cells = cells.join(trees, F.col("of").eqNullSafe(F.col("named"))).select(F.col("part").alias("in"), "of", "shift", "n", "tree")
    placed = ranked.join(cells, (F.col("part") == F.col("in")) & F.col("source").eqNullSafe(F.col("of")))
    return written(placed.select("tree", (F.col("at") + F.col("shift")).alias("i"), "n", "doc_id", "leaf", "changed"), "leaves")


def _complete(message):
    """A parent's node from its children's messages."""
    (tree, i), sent = message
    sent = sorted(sent)
    n = sent[0][2]
    if len(sent) != min(FAN, n - FAN * i):
        raise ValueError(f"node {i} of tree {tree} has {len(sent)} children")
    run = [d for _, d, _ in sent]
    return (tree, i), -(-n // FAN), run, digest(run)


def ascend(first: DataFrame) -> list[DataFrame]:
    """All nodes above the rows (tree, i, n, digest), LEVELS levels a table: level, number, how many their level has, children's digests and own."""
    spark = first.sparkSession
    most, whole = first.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    level, found = 0, []
    below = first.select("tree", "i", "n", "digest").rdd.map(lambda r: ((r[0], r[1]), r[2], bytes(r[3])))
    while most > 1:
        made = []
        while most > 1 and len(made) < LEVELS:
            most, level = -(-most // FAN), level + 1
            sent = below.filter(lambda x: x[1] > 1).map(lambda x: ((x[0][0], x[0][1] // FAN), (x[0][1] % FAN, x[-1], x[1])))
            below = sent.groupByKey(-(-whole // NODES)).map(_complete)
            made.append(below.map(lambda x, k=level: (k, *x[0], x[1], b"".join(x[2]), x[3])))
        found.append(written(spark.createDataFrame(spark.sparkContext.union(made), NODE), "nodes"))
        # what goes on is read from the table, so no lineage is longer than these levels
        top = found[-1].where((F.col("level") == level) & (F.col("n") > 1)).select("tree", "i", "n", "digest")
        whole = max(1, top.count())
        below = top.rdd.map(lambda r: ((r[0], r[1]), r[2], bytes(r[3])))
    return found


def _handed_down(joined):
    """Every child's path: its place and siblings, then its parent's."""
    (tree, i), (runs, paths) = joined
    for subroot, path in paths:
        for run in runs:
            for k in range(0, len(run), 32):
                others = run[:k] + run[k + 32 :]
                yield (tree, FAN * i + k // 32), (subroot, bytes([k // 32, len(others) // 32]) + others + path)


def descend(nodes: list[DataFrame], roots: DataFrame) -> DataFrame:
    """tree, i, subroot and path of every row at level 0, from roots (level, tree, subroot, path): where each tree ends and the path above it."""
    spark = roots.sparkSession
    counts = {r[0]: r[1] for t in nodes for r in t.groupBy("level").count().collect()}  # a row per level
    ends = lambda k: roots.where(F.col("level") == k).select("tree", "subroot", "path").rdd.map(lambda r: ((r[0], 0), (bytes(r[1]), bytes(r[2]))))
    table_of = lambda rdd: written(spark.createDataFrame(rdd.map(lambda x: (*x[0], *x[1])), PATH), "paths")
    paths = ends(len(counts))
    for level in range(len(counts), 0, -1):
        runs = nodes[(level - 1) // LEVELS].where(F.col("level") == level).select("tree", "i", "run").rdd.map(lambda r: ((r[0], r[1]), bytes(r[2])))
        paths = runs.cogroup(paths, -(-FAN * counts[level] // NODES)).flatMap(_handed_down).union(ends(level - 1))
        if level > 1 and level % LEVELS == 1:
            paths = table_of(paths).rdd.map(lambda r: ((r[0], r[1]), (bytes(r[2]), bytes(r[3]))))
    return table_of(paths)


def siblings(path: bytes):
    """The levels of a path from a leaf up: its place among its siblings, and their digests."""
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        yield place, [path[at + 2 + 32 * k : at + 34 + 32 * k] for k in range(n)]
        at += 2 + 32 * n


def fold(start: bytes, path: bytes) -> bytes:
    """The root that a leaf's digest and its path lead to."""
    for place, others in siblings(path):
        start = digest([*others[:place], start, *others[place:]])
    return start


def manifest(docs: DataFrame, change=tampered) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of docs.

    `change` alters texts before they are verified; leaf, subroot, root and proof are of the texts as they are.  A null in any
    column is hashed as `-`, an empty text as `0:`; a null source is a tree of its own, the first; rows
    without an id come first in their source, repeated ids in order of their digests, so repeated rows swap proofs at
    most.  Other columns are ignored.  An empty table has an empty manifest.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = leaves(docs, change)
    nodes = ascend(rows.select("tree", "i", "n", F.col("leaf").alias("digest")))
    ends = rows.where("n = 1").select(F.lit(0).alias("level"), "tree", F.col("leaf").alias("subroot"))
    for some in nodes:
        ends = ends.union(some.where("n = 1").select("level", "tree", F.col("digest").alias("subroot")))
    ends = written(ends, "subroots")
    n = ends.count()
    above = ascend(ends.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(n).cast("long").alias("n"), F.col("subroot").alias("digest")))
    peak = above[-1].where("n = 1").select("level", "digest").first() if n > 1 else ends.select(F.lit(0), "subroot").first()
    level, root = (peak[0], bytes(peak[1])) if peak else (0, b"")
    over = descend(above, spark.createDataFrame([(level, 0, root, b"")], "level int, tree long, subroot binary, path binary"))
    roots = written(ends.join(over.select(F.col("i").alias("tree"), "path"), "tree").select("level", "tree", "subroot", "path"), "roots")
    joined = rows.join(descend(nodes, roots), ["tree", "i"]).select("doc_id", "leaf", "changed", "subroot", "path")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def verify(batches):
        for batch in batches:
            given, now, subroot, path = (batch.column(c).to_pylist() for c in ("leaf", "changed", "subroot", "path"))
            proof = [digest([s for _, others in siblings(p) for s in others]).hex() for p in path]
            folded = [fold(g if c is None else c, p) for g, c, p in zip(given, now, path, strict=True)]
            texts = ([x.hex() for x in given], [x.hex() for x in subroot], [root.hex()] * len(given), proof, [f.hex() for f in folded])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(t, pa.string()) for t in texts), pa.array([f == root for f in folded], pa.bool_())], names)

    kind = StructType([joined.schema["doc_id"], *(StructField(c, StringType()) for c in names[1:-1]), StructField("verified", BooleanType())])
    return joined.mapInArrow(verify, kind)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether it still verifies once some texts are tampered with."""
    return manifest(dealt(table(spark, sf_dir, "documents")))


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}


def _sql(levels: int = 10) -> str:
    """The manifest in SQL, a step per level: enough for FAN ** levels rows of a source, and as many sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # the checksum of the id's digits, bit by bit
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))"
    steps = [
        "d AS MATERIALIZED (SELECT *, row_number() OVER () AS r, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, " + leaf("text") + f" AS h, CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295::BIGINT) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS told FROM documents)",
        "l AS MATERIALIZED (SELECT doc_id, r, s, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, h) - 1 AS i, h, " + leaf("told") + " AS f FROM d)",
        "n0 AS MATERIALIZED (SELECT s, i, h, count(*) OVER (PARTITION BY s) AS c FROM l)",
        "p0 AS MATERIALIZED (SELECT r, s, i, f, '' AS proof FROM l)",
    ]

    def up(n: str, p: str, k: int) -> list[str]:
        return [
            f"{n}{k + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM (SELECT s, i // {FAN} AS i, CASE WHEN any_value(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {n}{k} GROUP BY s, i // {FAN}))",
            f"{p}{k + 1} AS MATERIALIZED (SELECT p.r, p.s, p.i // {FAN} AS i, CASE WHEN any_value(b.c) = 1 THEN any_value(p.f) ELSE sha256(string_agg(CASE WHEN b.i = p.i THEN p.f ELSE b.h END, '' ORDER BY b.i)) END AS f, any_value(p.proof) || coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i <> p.i AND b.c > 1), '') AS proof FROM {p}{k} p JOIN {n}{k} b ON b.s = p.s AND b.i // {FAN} = p.i // {FAN} GROUP BY p.r, p.s, p.i)",
        ]

    for k in range(levels):
        steps += up("n", "p", k)
    steps.append(f"m0 AS MATERIALIZED (SELECT 0 AS s, s AS i, h, count(*) OVER () AS c FROM n{levels})")
    steps.append(f"q0 AS MATERIALIZED (SELECT r, 0 AS s, s AS i, f, proof FROM p{levels})")
    for k in range(levels):
        steps += up("m", "q", k)
    return f"WITH {', '.join(steps)} SELECT l.doc_id, l.h AS leaf, n{levels}.h AS subroot, m{levels}.h AS root, sha256(q{levels}.proof) AS proof_sha256, q{levels}.f AS folded_root, q{levels}.f = m{levels}.h AS verified FROM l JOIN n{levels} USING (s) JOIN q{levels} USING (r), m{levels}"


ORACLES = {"op12_merkle_manifest": _sql()}
