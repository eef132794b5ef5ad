"""From listings and label tables to samples: corrupt records, paths, labels, shuffles and batches.

In the queries `documents`, `pages`, `part` and `labels` stand for image ids, listings and labels.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import keyed_uniform, uniform_sql
from ..functions.frames import fresh, numbered

#: Endings of image files, in order of preference, and fields of a sample that aren't its image.
EXTENSIONS = ("jpg", "jpeg", "png", "JPG", "JPEG", "PNG")
META = ("__key__", "__url__", "__local_path__", "__corrupted__", "__worker__", "__rank__")
ENDINGS = (".jpg", ".jpeg", ".png")


def substitute(images: DataFrame, key: str, valid: Column, seed: int = 0, buckets: int = 64) -> DataFrame:
    """images with used: the row's own key if it is valid, else that of another valid row.

    The other row is the first of its bucket by a hash of the key; a bucket is drawn from the
    invalid row's own hash, so no list of all valid rows is needed.  Null if no row is valid.
    """
    at = lambda c, what: F.floor(keyed_uniform(seed, what, c) * buckets).cast("int")
    good = images.where(valid).groupBy(at(F.col(key), "bucket").alias("bucket_")).agg(F.min_by(key, keyed_uniform(seed, "order", F.col(key))).alias("other_"))
    filled = images.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket_")).join(good, "bucket_", "left")
    # an empty bucket takes the next one's row, around the end
    ahead = F.first("other_", True).over(W.orderBy("bucket_").rowsBetween(0, W.unboundedFollowing))
    filled = filled.withColumn("other_", F.coalesce(ahead, F.first("other_", True).over(W.orderBy("bucket_").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    drawn = images.withColumn("bucket_", at(F.col(key), "draw")).join(F.broadcast(filled), "bucket_", "left")  # `buckets` rows
    return drawn.withColumn("used", F.when(valid, F.col(key)).otherwise(F.col("other_"))).drop("bucket_", "other_")


def image_key(members: Column) -> Column:
    """Of the fields of a sample, in their order: the first of EXTENSIONS that is there, else the first that isn't meta and has one of ENDINGS, whatever its case; null if none."""
    first = F.coalesce(*[F.when(F.array_contains(members, e), F.lit(e)) for e in EXTENSIONS])
    like = lambda m: F.lower(m).endswith(ENDINGS[0]) | F.lower(m).endswith(ENDINGS[1]) | F.lower(m).endswith(ENDINGS[2])
    return F.coalesce(first, F.get(F.filter(members, lambda m: ~m.isin(*META) & like(m)), F.lit(0)))


ROOTS, CANDIDATES = ("root/", ""), ("", *ENDINGS, *(e.upper() for e in ENDINGS))


def resolve(ids: DataFrame, files: DataFrame, key: str = "image", roots=ROOTS, endings=CANDIDATES, report: Observation | None = None) -> DataFrame:
    """ids with path: the first candidate (each root with each ending) that files (path) has; ids without one are left out.

    A file is cut to the ids it may stand for (at most one for each root and ending that it begins and ends with) and meets them once; ids aren't multiplied.
    report: an Observation that has n_ids and n_unresolved once a result is there.
    """
    pairs = [(i, r, e) for i, (r, e) in enumerate((r, e) for r in roots for e in endings)]
    path = F.col("path")
    own = lambda r, e: path.startswith(r) & path.endswith(e) & (F.length(path) >= len(r) + len(e))
    cut = lambda r, e: F.substring(path, F.lit(len(r) + 1), F.length(path) - len(r) - len(e))
    stands = F.filter(F.array(*[F.when(own(r, e), F.struct(F.lit(i).alias("priority"), cut(r, e).alias("id"), path.alias("path"))) for i, r, e in pairs]), lambda x: x.isNotNull())
    # of the files that stand for an id, the first: found among files alone, before ids come in
    best = files.where(path.isNotNull()).select(F.inline(stands)).groupBy("id").agg(F.min_by("path", "priority").alias("path"))
    met = ids.select(key).distinct().join(best, F.col(key) == F.col("id"), "left").select(key, "path")
    if report:
        met = met.observe(report, F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("path").isNull()).alias("n_unresolved"))
    return met.where("path IS NOT NULL")


def shuffled(rows: DataFrame, part: str, order: list[str], seed: int, epoch: int, buffer: int = 2000) -> DataFrame:
    """rows with place: each part (a shard) goes through a buffer of at most `buffer` rows, in its order, and comes out mixed.

    The i-th row leaves once i + draw * buffer rows have come in, its draw being keyed by seed, epoch and the row's order columns, so an epoch's order is the
    same on reruns and another in the next epoch; no row moves further than the buffer, and none is lost.  Parts are read by their tasks in order; nothing is sorted as a whole.
    A column named place is replaced; nulls in the order come first.
    """
    rows = rows.drop("place")
    draw = fresh(rows, "draw")
    rows = rows.withColumn(draw, keyed_uniform(seed, epoch, "buffer", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (part, *order)]))
    kept = rows.columns[:-1]
    parts = kept.index(part)

    def mix(batches):
        held: list = []  # (when it leaves, its number, row)
        now, i, place = None, 0, 0

        def out(rows_, schema):
            return pa.RecordBatch.from_arrays([*(pa.array(c, schema.field(k).type) for k, c in enumerate(zip(*(r for r, _ in rows_), strict=True))), pa.array([p for _, p in rows_], pa.int64())], [*kept, "place"])

        schema = None
        for b in batches:
            schema, done = b.schema, []
            for *row, u in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[parts] != now or not i:
                    while held:
                        done.append((heapq.heappop(held)[2], place))
                        place += 1
                    now, i, place = row[parts], 0, 0
                while held and held[0][0] <= i:  # those to come leave later
                    done.append((heapq.heappop(held)[2], place))
                    place += 1
                heapq.heappush(held, (i + u * buffer, i, tuple(row)))
                i += 1
            if done:
                yield out(done, schema)
        if held:
            yield out([(heapq.heappop(held)[2], place + k) for k in range(len(held))], schema)

    given = rows.repartition(part).sortWithinPartitions(part, *order)
    return given.mapInArrow(mix, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", place long")


def shuffle_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each source as the second epoch takes them."""
    return shuffled(_docs(spark, sf_dir).select("source", "doc_id"), "source", ["doc_id"], 7, 1)


def encoded(rows: DataFrame, label: str) -> DataFrame:
    """rows with label_id: the label's place in sorted order; the table of labels is numbered, not the rows."""
    own = fresh(rows, "of_label")
    names = rows.where(F.col(label).isNotNull()).select(F.col(label).alias(own)).distinct()
    names = numbered(names, [own], "label_id").withColumn("label_id", F.col("label_id").cast("int"))
    return rows.join(names, F.col(label) == F.col(own)).drop(own)


def batches(rows: DataFrame, order: list, size: int) -> DataFrame:
    """rows with batch, in the given order; the last batch is left out if it isn't full."""
    whole = fresh(rows, "n_rows")
    found = numbered(rows, order, "batch", whole).withColumn("batch", F.floor(F.col("batch") / size))
    return found.where(F.col("batch") < F.floor(F.col(whole) / size)).drop(whole)


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")


def corrupt_substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substitute(_docs(spark, sf_dir).select("doc_id"), "doc_id", F.col("doc_id") % 7 != 0)


def extract_image_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image's field of samples with one to six fields, one sample per document."""
    d = _docs(spark, sf_dir)
    field = lambda n, name: F.when(F.col("doc_id") % n == 0, name)
    fields = [F.lit("__key__"), field(2, F.lit("json")), field(3, F.lit("maskpng")), field(5, F.concat(F.lit("x ("), "doc_id", F.lit(").JPG"))), field(7, F.lit("PNG")), field(4, F.lit("jpg")), field(11, F.lit("__rank__"))]
    d = d.select("doc_id", F.filter(F.array(*fields), lambda x: x.isNotNull()).alias("members"))
    return d.select("doc_id", image_key(F.col("members")).alias("image_key"))


def resolve_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select(F.concat(F.lit("img"), "doc_id").alias("image"), "doc_id")
    return resolve(d.select("image"), _files(d))


def _files(d: DataFrame) -> DataFrame:
    """A listing in which ids have none, one or two of their candidates."""
    a = d.where("doc_id % 3 = 0").select(F.concat(F.lit("root/"), "image", F.lit(".png")).alias("path"))
    b = d.where("doc_id % 5 = 0").select(F.concat("image", F.lit(".jpg")).alias("path"))
    return a.union(b).union(d.where("doc_id % 15 = 1").select(F.concat(F.lit("root/"), "image").alias("path")))


def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select(F.concat(F.lit("img"), "doc_id").alias("image"), "doc_id")
    return d.select("image").join(resolve(d.select("image"), _files(d)), "image", "left_anti")


def probe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one partition that have a label."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    label = F.when(F.col("p_size") % 5 != 0, F.col("p_brand"))
    return p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "test").when(F.col("p_partkey") % 3 == 1, "train").alias("partition"), label.alias("label")).where((F.col("partition") == "test") & F.col("label").isNotNull())


def drop_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    return d.where(F.col("quality").isNotNull()).select("doc_id", "quality")


def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers are given before rows without a file go, so those that stay may leave gaps."""
    p = encoded(probe_filter(spark, sf_dir), "label")
    return p.where("p_partkey % 4 <> 0").select("p_partkey", "label", "label_id")


def probe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    return d.agg(F.count(F.lit(1)).alias("n_images"), F.countDistinct("source").alias("n_sources"), F.countDistinct("quality").alias("n_classes"), F.sum(F.col("quality").isNull().cast("long")).alias("n_missing"))


def ext_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by ending, united without repeats."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_extract("url", r"^[^?#]*", 0).alias("path"))
    parts = [p.where(F.lower("path").contains(x)) for x in ("/en/", "/de/", "example.com", "example.org")]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.distinct()


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty of all, without replacement, the same for a seed."""
    return _docs(spark, sf_dir).select("doc_id").orderBy(keyed_uniform(42, "sample", F.col("doc_id")), "doc_id").limit(50)


def epoch_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of an epoch, dealt to four ranks."""
    d = _docs(spark, sf_dir).select("doc_id", keyed_uniform(0, 3, F.col("doc_id")).alias("u"))
    b = batches(d, ["u", "doc_id"], 1)
    return b.select("doc_id", F.col("batch").alias("place"), (F.col("batch") % 4).alias("rank"))


def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(_docs(spark, sf_dir).select("doc_id"), ["doc_id"], 32)


def map_filter_kwargs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options that a function takes; the others go."""
    d = _docs(spark, sf_dir).select("doc_id", F.create_map(F.lit("size"), F.col("n_chars").cast("string"), F.lit("mode"), F.col("lang"), F.lit("extra"), F.col("source")).alias("kwargs"))
    kept = F.map_filter("kwargs", lambda k, v: F.array_contains(F.array(F.lit("size"), F.lit("mode")), k))
    return d.select("doc_id", F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("kwargs"))


QUERIES = {f.__name__: f for f in (corrupt_substitute, extract_image_key, resolve_path, missing_files, probe_filter, drop_null, label_encode, probe_counts, ext_union, seeded_sample, epoch_shuffle, batch_assign, shuffle_buffer, map_filter_kwargs)}

_RESOLVED = """d AS (SELECT doc_id, 'img' || doc_id AS image FROM documents), f AS (SELECT 'root/' || image || '.png' AS path FROM d WHERE doc_id % 3 = 0 UNION SELECT image || '.jpg' FROM d WHERE doc_id % 5 = 0 UNION SELECT 'root/' || image FROM d WHERE doc_id % 15 = 1),
c AS (SELECT image, r * 7 + e AS priority, ['root/', ''][r + 1] || image || ['', '.jpg', '.jpeg', '.png', '.JPG', '.JPEG', '.PNG'][e + 1] AS path FROM d, range(2) a(r), range(7) b(e)),
p AS (SELECT image, arg_min(path, priority) AS path FROM c JOIN f USING (path) GROUP BY image)"""
_PROBE = "t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' END AS partition, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS label FROM part), l AS (SELECT * FROM t WHERE partition = 'test' AND label IS NOT NULL)"

ORACLES = {
    "corrupt_substitute": f"""WITH v AS (SELECT doc_id, CAST(floor({uniform_sql("'0'", "'bucket'", "doc_id")} * 64) AS INTEGER) AS b, {uniform_sql("'0'", "'order'", "doc_id")} AS o FROM documents WHERE doc_id % 7 <> 0), g AS (SELECT b, arg_min(doc_id, o) AS other FROM v GROUP BY b),
t AS (SELECT r.b, coalesce((SELECT arg_min(other, g.b) FROM g WHERE g.b >= r.b), (SELECT arg_min(other, g.b) FROM g)) AS other FROM range(64) r(b))
SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN doc_id ELSE other END AS used FROM documents JOIN t ON t.b = CAST(floor({uniform_sql("'0'", "'draw'", "doc_id")} * 64) AS INTEGER)""",
    "extract_image_key": "WITH m AS (SELECT doc_id, list_filter(['__key__', CASE WHEN doc_id % 2 = 0 THEN 'json' END, CASE WHEN doc_id % 3 = 0 THEN 'maskpng' END, CASE WHEN doc_id % 5 = 0 THEN 'x (' || doc_id || ').JPG' END, CASE WHEN doc_id % 7 = 0 THEN 'PNG' END, CASE WHEN doc_id % 4 = 0 THEN 'jpg' END, CASE WHEN doc_id % 11 = 0 THEN '__rank__' END], lambda x: x IS NOT NULL) AS members FROM documents) SELECT doc_id, coalesce("
    + ", ".join(f"CASE WHEN list_contains(members, '{e}') THEN '{e}' END" for e in EXTENSIONS) + r", list_filter(members, lambda m: NOT starts_with(m, '__') AND regexp_matches(lower(m), '[.](jpg|jpeg|png)$'))[1]) AS image_key FROM m",
    "resolve_path": f"WITH {_RESOLVED} SELECT image, path FROM p",
    "missing_files": f"WITH {_RESOLVED} SELECT image FROM d WHERE image NOT IN (SELECT image FROM p)",
    "probe_filter": f"WITH {_PROBE} SELECT p_partkey, partition, label FROM l",
    "drop_null": "SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL",
    "label_encode": f"WITH {_PROBE} SELECT p_partkey, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM l QUALIFY p_partkey % 4 <> 0",
    "probe_counts": "SELECT count(*) AS n_images, count(DISTINCT source) AS n_sources, count(DISTINCT quality) AS n_classes, count(*) FILTER (quality IS NULL) AS n_missing FROM documents LEFT JOIN labels USING (doc_id)",
    "ext_union": "WITH p AS (SELECT regexp_extract(url, '^[^?#]*') AS path FROM pages) " + " UNION ".join(f"SELECT path FROM p WHERE contains(lower(path), '{x}')" for x in ("/en/", "/de/", "example.com", "example.org")),
    "seeded_sample": f"SELECT doc_id FROM documents ORDER BY {uniform_sql("'42'", "'sample'", 'doc_id')}, doc_id LIMIT 50",
    "epoch_shuffle": f"SELECT doc_id, p AS place, p % 4 AS rank FROM (SELECT doc_id, row_number() OVER (ORDER BY {uniform_sql("'0'", "'3'", 'doc_id')}, doc_id) - 1 AS p FROM documents)",
    "batch_assign": "SELECT doc_id, b AS batch FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS b, count(*) OVER () // 32 AS n FROM documents) WHERE b < n",
    "shuffle_buffer": f"""WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, {uniform_sql("'7'", "'1'", "'buffer'", 'source', 'doc_id')} AS u FROM documents)
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY i + u * 2000::DOUBLE, i) - 1 AS place FROM d""",
    "map_filter_kwargs": "SELECT doc_id, 'mode=' || lang || ',size=' || n_chars AS kwargs FROM documents",
}
