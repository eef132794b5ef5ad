"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over neighbouring tokens that ignores some of them.  The hash of the
tokens that it keeps is taken at every place of every item, and of a text where two neighbouring
tokens occur in the benchmark; equal hashes are hits, so a text is found though some tokens were
replaced.  Around a hit, item and text are laid side by side and compared token by token: the text is
contaminated if some WINDOW neighbouring places (all of a shorter item) agree in at least NEEDED of
WINDOW tokens.  The masks leave no such window out, wherever the replaced tokens are.

Items under SHORT tokens have to occur whole, and those under LEAST say nothing about a text.

Everything is DataFrame code.  Text rows are shuffled only to be compared around hits.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, dealt, fresh, table, words, written

#: Places of the kept tokens, counted from two neighbours that every mask keeps.  Of the ways to replace one of
#: 8 tokens, two of 9 to 12 or three of 13, each leaves one of the first two masks whole somewhere.  The last is for short items.
MASKS = ((-2, 0, 1, 2), (0, 1, 4, 6), (0, 1, 2))
WINDOW, NEEDED = 13, 10
SHORT, LEAST = 8, 3
#: Up to this many seeds of the benchmark (12 bytes each and their overhead) are sent to every executor, and its items with them; beyond, both sides are shuffled.
BROADCAST_SEEDS = 500_000
#: Up to this many texts with hits, their 16-byte keys pick those texts before the shuffle; beyond, all texts are shuffled.
BROADCAST_KEYS = 2_000_000
#: The table of neighbours has 2^13 to 2^24 bits (2 MB); beyond PAIRS different ones it isn't used, and all places of a text have seeds.
PAIRS, FEWEST_BITS, MOST_BITS = 4_000_000, 13, 24
#: Items that a text is compared with in one row.
ITEMS_A_ROW = 64


def tokens(text: Column) -> Column:
    """Words without marks of ASCII, in small letters."""
    return words(F.lower(F.translate(F.coalesce(text, F.lit("")), string.punctuation, "")))


def text_key(text: Column) -> Column:
    """What tells texts apart: 128 bits, so that no clean text goes for another one's hash; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def hashed(text: Column) -> Column:
    return F.transform(tokens(text), lambda x: F.xxhash64(x))


def _pair(h: Column, i: Column) -> Column:
    return F.xxhash64(F.get(h, i), F.get(h, i + 1))


def _places(h: Column) -> Column:
    """All places of a token that has a next one."""
    return F.when(F.size(h) > 1, F.sequence(F.lit(0), F.size(h) - 2)).otherwise(F.array().cast("array<int>"))


def _seeds(h: Column, i: Column, masks) -> Column:
    """The hash of each mask laid at place i; null where it would reach beyond the text."""
    whole = lambda mask: (i + mask[0] >= 0) & (i + mask[-1] < F.size(h))
    return F.array(*[F.when(whole(mask), F.xxhash64(F.lit(m), *[F.get(h, i + o) for o in mask])) for m, mask in enumerate(masks)])


def _spread(h: Column, places: Column, masks) -> Column:
    """(place, mask, seed) of all masks at the places."""
    at = lambda i: F.transform(_seeds(h, i, masks), lambda s, m: F.struct(i.alias("place"), m.alias("mask"), s.alias("seed")))
    return F.filter(F.flatten(F.transform(places, at)), lambda x: x["seed"].isNotNull())


def neighbours(items: DataFrame, item: str) -> tuple[Column, int] | None:
    """The bits of all neighbouring tokens of the items, as an array of numbers, and how many bits number one of them; None beyond PAIRS.

    The driver gets at most 2^MOST_BITS bits, whatever the benchmark.
    """
    each = items.select(F.explode(bind(F.col(item), lambda h: F.transform(_places(h), lambda i: _pair(h, i)))).alias("pair")).distinct()
    n = each.count()
    if n > PAIRS:
        return None
    bits = min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(16 * n + 1))))
    of = each.select(F.shiftrightunsigned("pair", 64 - bits + 6).cast("int").alias("word"), F.shiftrightunsigned("pair", 64 - bits).bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    numbers = ["0"] * (1 << (bits - 6))
    for r in of.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits")).collect():
        numbers[r["word"]] = str(r["bits"])
    # worked out once, when the plan is made
    return F.split(F.lit(" ".join(numbers)), " ").cast("array<bigint>"), bits


def known_places(h: Column, table_: tuple[Column, int] | None) -> Column:
    """The places of a text whose two neighbouring tokens may occur in the benchmark; none that do is missing."""
    if table_ is None:
        return _places(h)
    numbers, bits = table_
    there = lambda p: F.getbit(F.get(numbers, F.shiftrightunsigned(p, 64 - bits + 6).cast("int")), F.shiftrightunsigned(p, 64 - bits).bitwiseAND(F.lit(63)).cast("int")) == 1
    return F.filter(_places(h), lambda i: bind(_pair(h, i), there))


def best_window(item: Column, text: Column, diagonal: Column) -> Column:
    """Most agreements in WINDOW neighbouring places of the item, laid at a place of the text (fewer in a shorter item); 0 where all its places are too few."""
    first, last = F.greatest(F.lit(0), -diagonal), F.least(F.size(item), F.size(text) - diagonal) - 1
    count = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)

    def most(same: Column) -> Column:
        n = F.size(same)
        best = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - WINDOW + 1)), lambda i: count(F.slice(same, i, WINDOW))))
        return F.when(WINDOW * count(same) < NEEDED * F.least(F.lit(WINDOW), F.size(item)), F.lit(0)).otherwise(best)

    return bind(F.transform(F.sequence(first, last), lambda i: F.when(F.get(item, i) == F.get(text, i + diagonal), 1).otherwise(0)), most)


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """text_key (text_key() of the text), item_id, matched: items found in texts, and their best window.

    Items with fewer than `least` tokens, null and empty ones too, are found nowhere; those under SHORT only
    whole.  Null and empty texts have no hits.  Each different text is compared once, however often it is
    repeated; of repeated items each stands for all.  Other columns are ignored.
    """
    own = items.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item_id"), hashed(F.col(item_text)).alias("item")).where(F.size("item") >= least)
    own = written(own.distinct(), "items")
    short = F.size("item") < SHORT
    marked = own.select("item_id", short.alias("short"), F.explode(bind(F.col("item"), lambda h: _spread(h, _places(h), MASKS))).alias("s"))
    marked = marked.where(F.col("short") == (F.col("s.mask") == len(MASKS) - 1)).select(F.col("s.seed").alias("seed"), "item_id", F.col("s.place").alias("place"))
    marked = written(marked.distinct(), "seeds")
    small = marked.count() <= BROADCAST_SEEDS
    masks = MASKS if own.where(short).take(1) else MASKS[:-1]
    side = F.broadcast if small else (lambda x: x)
    bits = neighbours(own, "item")
    keyed = docs.select(text_key(F.col(text)).alias("text_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    seeds = bind(hashed(F.col("text")), lambda h: bind(known_places(h, bits), lambda p: _spread(h, p, masks)))
    spread = dealt(keyed).select("text_key", F.explode(seeds).alias("s")).select("text_key", F.col("s.seed").alias("seed"), F.col("s.place").alias("at"))
    hits = spread.join(side(marked), "seed").groupBy("text_key", "item_id").agg(F.collect_set(F.col("at") - F.col("place")).alias("diagonals"))  # fewer than the tokens of both
    # an item's tokens go along once for each text that it hits, in rows of about ITEMS_A_ROW items
    rows = F.pmod(F.xxhash64("item_id"), F.lit(-(-own.count() // ITEMS_A_ROW) or 1))
    asked = hits.join(side(own), "item_id").groupBy("text_key", rows.alias("row")).agg(F.collect_list(F.struct("item_id", "diagonals", "item")).alias("asked"))
    asked = written(asked, "hits")
    keys = asked.select("text_key").distinct()
    if keys.count() <= BROADCAST_KEYS:
        keyed = keyed.join(F.broadcast(keys), "text_key", "left_semi")
    texts = keyed.groupBy("text_key").agg(F.first("text").alias("text"))  # copies are put together before the shuffle
    laid = texts.join(asked, "text_key").select("text_key", hashed(F.col("text")).alias("tokens"), "asked")
    best = lambda t, a: F.array_max(F.transform(a["diagonals"], lambda d: best_window(a["item"], t, d)))
    compare = lambda t: F.transform(F.col("asked"), lambda a: F.struct(a["item_id"].alias("item_id"), F.size(a["item"]).alias("n"), best(t, a).alias("matched")))
    found = laid.select("text_key", F.inline(bind(F.col("tokens"), compare)))
    n, matched = F.col("n"), F.col("matched")
    enough = F.when(n < SHORT, matched == n).otherwise(WINDOW * matched >= NEEDED * F.least(F.lit(WINDOW), n))
    return found.where(enough).groupBy("text_key", "item_id").agg(F.max("matched").alias("matched"))


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, item_id, matched: a row per contaminated document and item; clean documents have none.

    Rows that repeat both id and text are one document; null ids are kept as such.
    """
    found = written(contaminated(docs, items, text, **options), "found")
    keyed = docs.select(F.col(key).alias("doc_id"), text_key(F.col(text)).alias("text_key")).distinct()
    return keyed.join(found, "text_key").select("doc_id", "item_id", "matched")


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs in whose text no item was found; all columns stay."""
    name = fresh(docs, "text_key")
    found = written(contaminated(docs, items, text, **options).select(F.col("text_key").alias(name)).distinct(), "found")
    return docs.join(found, text_key(F.col(text)) == F.col(name), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in which an item of the benchmark was found, with the item and its best window."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontamination": op3_decontamination}


def _oracle() -> str:
    """All windows that pass, without seeds: where so many tokens agree, three neighbours do (a short item's first three)."""
    marks = string.punctuation.replace("'", "''")
    split = lambda t: rf"regexp_extract_all(lower(translate(coalesce({t}, ''), '{marks}', '')), '[^\x20\x09-\x0D]+')"
    three = "concat_ws(' ', w[p + 1], w[p + 2], w[p + 3])"
    return rf"""
WITH d AS (SELECT doc_id, {split("text")} AS w FROM documents GROUP BY ALL),
b AS (SELECT item_id, {split("text")} AS w FROM benchmark WHERE item_id IS NOT NULL GROUP BY ALL),
bs AS (SELECT item_id, w, p, {three} AS s FROM (SELECT item_id, w, unnest(range(0, len(w) - 2)) AS p FROM b WHERE len(w) >= {LEAST})),
ds AS (SELECT doc_id, w, p, s FROM (SELECT doc_id, w, p, {three} AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS p FROM d WHERE len(w) >= 3)) SEMI JOIN bs USING (s)),
h AS (SELECT DISTINCT ds.doc_id, ds.w AS dw, bs.item_id, bs.w AS bw, ds.p - bs.p AS diagonal FROM ds JOIN bs ON ds.s = bs.s),
m AS (SELECT doc_id, item_id, len(bw) AS n, list_transform(range(greatest(0, -diagonal), least(len(bw), len(dw) - diagonal)), lambda i: CASE WHEN bw[i + 1] = dw[i + diagonal + 1] THEN 1 ELSE 0 END) AS same FROM h),
x AS (SELECT doc_id, item_id, n, list_max(list_transform(range(1, greatest(2, len(same) - {WINDOW - 2})), lambda i: list_sum(list_slice(same, i, i + {WINDOW - 1})))) AS matched FROM m)
SELECT doc_id, item_id, CAST(max(matched) AS INTEGER) AS matched FROM x WHERE CASE WHEN n < {SHORT} THEN matched = n ELSE {WINDOW} * matched >= {NEEDED} * least({WINDOW}, n) END GROUP BY doc_id, item_id"""


ORACLES = {"op3_decontamination": _oracle()}
