"""Near-duplicate join: Jaccard similarity of word n-grams by signature trees.

1. Equal sets are one class, known by a hash of the set.
2. Two sets of similarity t share one of the first n - ceil(t n) + 1 members in any order common
   to all.  Members whose hash is in the first SHARE of all come first, rare ones before frequent ones, then the others by
   hash; so only the former are counted.  A very frequent one is dealt to many tasks.  Members of one class alone lead to nothing, and
   with enough of them a class is done.  Classes that share one of their first members meet in
   the bucket of the smallest of them.
3. In a bucket, a tree stands over the sets, ordered by size: nodes hold the union of their sets' bitmaps
   and the range of sizes.  Both sides of a pair of nodes are descended together unless the
   sizes are too far apart, the common bits allow too small an overlap, or all is linked already.
   What is left is compared exactly.
4. Links give components.  A bucket with very many sets is split: first each part is compared with the
   bucket's own class, then whatever isn't linked to it with the sets of about its size, in parts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .arrays import Spans, joined, mixed, pieces, runs, split
from .common import SPACE, dealt, fresh, table, written
from .components import components

N, NUMERATOR, DENOMINATOR = 5, 75, 100
BITS, FAN = 2048, 8
#: The share of hashes whose members are counted, and from where on a count makes no difference.  With 0.55 of
#: them, a text looks at what it shares with very many only if that makes up some half of it; more of them fill more disk.
SHARE, MOST_COUNTED = 0.55, 1_000_000
#: Up to this many texts that are in a bucket, their 8-byte keys pick those texts before the shuffle; beyond, all texts are shuffled.
BROADCAST_KEYS, MOST_MET = 2_000_000, 500_000
PART = 3000
#: A token with so many classes in one task is dealt to SALTS more tasks.
HOT, SALTS = 200, 64
_SEPARATES = np.isin(np.arange(256), np.frombuffer(SPACE.encode(), np.uint8))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def sets(texts: list, n: int = N) -> list[np.ndarray]:
    """The sorted hashes of each text's n-grams; of all its words if they are fewer; none without words."""
    data, starts = joined([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    data = _LOWER[data]
    a, b = split(data, _SEPARATES)
    word = Spans(data).hash(a, b)
    edge = np.searchsorted(a, starts)
    rolled = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for j in range(n):
        rolled = rolled * np.uint64(0x9FB21C651E98DF25) + word[j : j + len(rolled)]
    rolled, out = mixed(rolled), []
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if e - s >= n:
            x = np.sort(rolled[s : e - n + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif e > s:
            short = np.array([e - s], np.uint64)
            for i in range(s, e):
                short = mixed(short * np.uint64(0x9FB21C651E98DF25) + word[i : i + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(members: np.ndarray) -> int | None:
    """A 64-bit hash of a set (two of ten billion sets share one by chance about three times in all); None if it is empty."""
    if not len(members):
        return None
    return int(mixed(np.add.reduce(mixed(members ^ np.uint64(0xA0761D6478BD642F)), keepdims=True) + np.uint64(len(members)))[0].view(np.int64))


def needed(n: int, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> int:
    """How many members of a set of n have to be looked at."""
    return n - -(-n * numerator // denominator) + 1 if n else 0


def counted(members: np.ndarray, below: int, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> int:
    """How many members, by hash, are told to the others: those below a 63-bit number, or as many as are needed."""
    return max(int(np.searchsorted(members >> np.uint64(1), np.uint64(below))), needed(len(members), numerator, denominator))


class Links:
    """Union-find over the sets of a bucket."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def tie(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def alike(a: np.ndarray, b: np.ndarray, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if denominator * len(small) < numerator * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return denominator * common >= numerator * (len(a) + len(b) - common)


class Tree:
    """Levels of nodes over sets in order of size; a node's bitmap is the union of those below it."""

    def __init__(self, members: list[np.ndarray]):
        size = np.array([len(x) for x in members])
        self.order = np.lexsort((np.array([x[0] for x in members]), size))
        bits = np.zeros((len(members), BITS), bool)
        for row, i in enumerate(self.order.tolist()):
            bits[row, (members[i] >> np.uint64(53)).astype(np.int64)] = True
        bitmap = np.packbits(bits, axis=1).view(np.uint64)
        size = size[self.order]
        #: bitmap, smallest size, largest size, most members beyond one a bit
        self.levels = [(bitmap, size, size, size - np.bitwise_count(bitmap).sum(1))]
        while len(self.levels[-1][0]) > 1:
            start = np.arange(0, len(self.levels[-1][0]), FAN)
            bitmap, low, high, extra = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(bitmap, start), np.minimum.reduceat(low, start), np.maximum.reduceat(high, start), np.maximum.reduceat(extra, start)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
        """Whether nodes a and b may hold sets that are alike: by sizes, then by the largest overlap their bits allow."""
        bitmap, low, high, extra = self.levels[level]
        own = (denominator * high[a] >= numerator * low[b]) & (denominator * high[b] >= numerator * low[a])
        at = np.flatnonzero(own)
        for s in range(0, len(at), 4096):
            x, y = a[at[s : s + 4096]], b[at[s : s + 4096]]
            most = np.bitwise_count(bitmap[x] & bitmap[y]).sum(1).astype(np.int64) + np.minimum(extra[x], extra[y])
            own[at[s : s + 4096]] = (denominator + numerator) * most >= numerator * (low[x] + low[y])
        return own


def link(members: list[np.ndarray], hub: int | None = None, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, pairs_with=None) -> list[tuple[int, int]]:
    """Pairs of alike sets that connect all that alike pairs connect.

    hub: a set that all are compared with first.  pairs_with: if given, a table of those sets of
    which one at least has to be in a pair that is compared.
    """
    links, n = Links(len(members)), len(members)
    if n == 2:
        return [(0, 1)] if alike(members[0], members[1], numerator, denominator) else []
    if hub is not None:
        for i in range(n):
            if i != hub and alike(members[hub], members[i], numerator, denominator):
                links.tie(hub, i)
    tree = Tree(members)
    top = len(tree.levels) - 1
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(top, -1, -1):
        if level < top:
            count = len(tree.levels[level][0])
            x = (a[:, None, None] * FAN + np.arange(FAN)[None, :, None]) + np.zeros((1, 1, FAN), np.int64)
            y = (b[:, None, None] * FAN + np.arange(FAN)[None, None, :]) + np.zeros((1, FAN, 1), np.int64)
            own = (x < count) & (y < count) & (x <= y)
            a, b = x[own], y[own]
        root = np.array([links.find(i) for i in tree.order.tolist()])
        start = np.arange(0, n, FAN**level)
        least, most = np.minimum.reduceat(root, start), np.maximum.reduceat(root, start)
        linked = (least[a] == most[a]) & (least[b] == most[b]) & (least[a] == least[b])
        own = ~linked & tree.possible(level, a, b, numerator, denominator)
        a, b = a[own], b[own]
    for i, j in zip(tree.order[a].tolist(), tree.order[b].tolist(), strict=True):
        if i != j and (pairs_with is None or pairs_with[i] or pairs_with[j]) and links.find(i) != links.find(j) and alike(members[i], members[j], numerator, denominator):
            links.tie(i, j)
    return links.edges


def _measure(n: int, numerator: int, denominator: int, below: int):
    """Per text its size, its class and how many of its members are told."""

    def run(batches):
        for b in pieces(batches, most=1 << 20):
            found = sets(b.column(2).to_pylist(), n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in ([len(x) for x in found], [class_of(x) for x in found], [counted(x, below, numerator, denominator) for x in found]))], ["id", "text_key", "n", "class", "told"])

    return run


def _members(n: int, numerator: int, denominator: int, below: int, hot: int):
    """(token, salt, class) of the members that are told; a class that this task has met before isn't told again.

    A token that this task has told of about `hot` classes goes on in parts, by class; that it
    does is marked by a row without a class where its other rows are.
    """

    def run(batches):
        seen: set = set()
        marked: set = set()
        met = np.zeros(1 << 20, np.int64)
        for b in pieces(batches, most=1 << 20):
            tokens, classes = [], []
            for members in sets(b.column(0).to_pylist(), n):
                c = class_of(members)
                if c is not None and c not in seen:
                    seen.add(c)
                    tokens.append(members[: counted(members, below, numerator, denominator)] >> np.uint64(1))
                    classes.append((c, len(tokens[-1])))
            if len(seen) > 200_000:
                seen.clear()
            if not tokens:
                continue
            token, class_ = np.concatenate(tokens).view(np.int64), np.repeat(*np.array(classes, np.int64).T)
            slot = token & (len(met) - 1)
            met += np.bincount(slot, minlength=len(met))
            split_ = met[slot] >= hot
            salt = np.where(split_, 1 + class_ % SALTS, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(salt), pa.array(class_)], ["token", "salt", "class"])
            new = [t for t in np.unique(token[split_]).tolist() if t not in marked]
            if new:
                marked.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([0] * len(new), pa.int32()), pa.nulls(len(new), pa.int64())], ["token", "salt", "class"])
            if len(marked) > 200_000:
                marked.clear()

    return run


def _shared(most: int, below: int):
    """(class, rank, token) of tokens in several classes, from rows sorted by token, salt and class, nulls first.

    rank is the number of classes, up to `most`, and that for a token in parts; of those that aren't counted it is one more.  A row may come twice.
    """

    def ranked(t, s, c, mark, large: bool):
        """large: all these rows are of one token with more than `most` classes."""
        start = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])]))
        n = np.diff(start, append=len(t))
        parted = np.repeat((s[start] > 0) | mark[start] | large, n)
        size = np.repeat(n, n)
        own = ~mark & (parted | (size > 1))
        rank = np.where(t < below, np.where(parted, most, np.minimum(size, most)), most + 1)
        return pa.RecordBatch.from_arrays([pa.array(c[own]), pa.array(rank[own]), pa.array(t[own])], ["class", "rank", "token"])

    def run(batches):
        rows = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)]
        large = None
        for b in batches:
            got = (b.column(0).to_numpy(), b.column(1).to_numpy(), pa.compute.fill_null(b.column(2), 0).to_numpy(), pa.compute.is_null(b.column(2)).to_numpy(zero_copy_only=False))
            t, s, c, mark = rows = [np.concatenate(x) for x in zip(rows, got, strict=True)]
            if not len(t):
                continue
            own = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (c[1:] != c[:-1]) | (mark[1:] != mark[:-1])])
            t, s, c, mark = rows = [x[own] for x in rows]
            if large is not None:  # a token with more than `most` classes, of which some were given out
                n = int(((t == large[0]) & (s == large[1])).sum())
                if n:
                    yield ranked(*(x[:n] for x in rows), True)
                if n == len(t):
                    rows = [x[:0] for x in rows]
                    continue
                t, s, c, mark = rows = [x[n:] for x in rows]
                large = None
            last = len(t) - int(((t == t[-1]) & (s == s[-1])).sum())  # the last group may go on
            if last:
                yield ranked(*(x[:last] for x in rows), False)
            rows = [x[last:] for x in rows]
            if len(rows[0]) > most:
                yield ranked(*rows, True)
                large = rows[0][0], rows[1][0]
                rows = [x[:0] for x in rows]
        if len(rows[0]):
            yield ranked(*rows, False)

    return run


def _once(batches):
    """The texts (text_key, text), each once a task."""
    met: set[int] = set()
    for b in pieces(batches, most=1 << 20):
        own = []
        for i, key in enumerate(b.column(0).to_pylist()):
            if key not in met:
                met.add(key)
                own.append(i)
        if own:
            yield b if len(own) == b.num_rows else b.take(pa.array(own))
        if len(met) > MOST_MET:
            met.clear()


def _deal(n: int):
    """One row per bucket of a text; copies of a text come one after the other, and the first stands for all."""

    def run(batches):
        done = None
        for b in pieces(batches, most=1 << 20):
            rows: list = []
            for key, text, buckets in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != done:
                    rows += [(r["hub"], r["part"], r["class"], r["other"], text) for r in buckets]
                    done = key
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)], ["hub", "part", "class", "other", "text"])

    return run


def _solve(n: int, numerator: int, denominator: int, second: bool):
    """Edges of each bucket, from rows sorted by hub, part and class."""

    def run(batches):
        at, classes, members, other = None, [], [], []

        def edges():
            hub = classes.index(at[0]) if at[0] in classes else None
            found = link(members, None if second else hub, numerator, denominator, other if second else None) if len(members) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([classes[i] for i, _ in found], pa.int64()), pa.array([classes[j] for _, j in found], pa.int64())], ["a", "b"])

        for b in pieces(batches, most=1 << 20):
            found = sets(b.column(4).to_pylist(), n)
            for hub, part, c, o, x in zip(*(b.column(i).to_pylist() for i in range(4)), found, strict=True):
                if (hub, part) != at:
                    if at is not None:
                        yield edges()
                    at, classes, members, other = (hub, part), [], [], []
                if classes and classes[-1] == c:
                    other[-1] |= o
                    continue
                classes.append(c)
                members.append(x)
                other.append(o)
        if at is not None:
            yield edges()

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, part: int = PART, most_counted: int = MOST_COUNTED, hot: int = HOT, share: float = SHARE) -> DataFrame:
    """id, text_key (xxhash64 of the text), n_shingles, component_id of every row of docs.

    Two texts are linked when denominator * |common| >= numerator * |either|.  The component's id is
    the smallest key that links reach; null keys count for nothing there, and a component that has no
    other gets null.  A text that is null or has no word is empty and on its own.  Repeated rows
    are alike, so they share a component.  Other columns are ignored; an empty table gives an empty result.
    Keys are whole numbers.  share: how much of the members is counted; whatever it is, no link is lost.
    """
    found = _rooted(docs, key, text, n, numerator, denominator, part, most_counted, hot, share)
    return found.select("id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component_id"))


def _rooted(docs: DataFrame, key: str, text: str, n: int = N, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, part: int = PART, most_counted: int = MOST_COUNTED, hot: int = HOT, share: float = SHARE) -> DataFrame:
    """id, text_key, n, root of every row, the root null for texts without words; first, bare: the root's smallest (id, text_key) and, of rows without an id, text_key."""
    ship(docs.sparkSession)
    below = min(int(share * (1 << 63)), (1 << 63) - 1)
    rows = dealt(docs).select(F.col(key).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    measured = written(rows.mapInArrow(_measure(n, numerator, denominator, below), "id long, text_key long, n long, class long, told long"), "classes")
    classes = measured.where("class IS NOT NULL").groupBy("class").agg(F.min("text_key").alias("text_key"), F.min("n").alias("n"), F.min("told").alias("told"))
    tokens = rows.select("text").mapInArrow(_members(n, numerator, denominator, below, hot), "token long, salt int, class long")
    shared = tokens.repartition("token", "salt").sortWithinPartitions("token", "salt", "class").mapInArrow(_shared(most_counted, below), "class long, rank long, token long")
    # a class looks at as many members as it needs, in order; those of its own come first
    of = shared.groupBy("class").agg(F.sort_array(F.collect_set(F.struct("rank", "token"))).alias("shared"))  # at most a set's members
    need = F.col("n") - F.ceil(F.col("n") * numerator / F.lit(denominator)) + 1
    look = of.join(classes.select("class", "n", "told"), "class").withColumn("look", (need - (F.col("told") - F.size("shared"))).cast("int")).where("look > 0")
    look = look.select("class", F.explode(F.slice("shared", F.lit(1), F.col("look"))).alias("s")).select(F.col("s.token").alias("token"), "class")
    look = written(look, "looked")
    hubs = look.groupBy("token").agg(F.min("class").alias("hub"), F.max("class").alias("last")).where("hub <> last").select("token", "hub")
    pairs = written(look.join(hubs, "token").select("class", "hub").distinct(), "buckets")
    sizes = written(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > part), "large")

    def solve(buckets: DataFrame, second: bool) -> DataFrame:
        """buckets: class, hub, part, other."""
        asked = buckets.join(classes.select("class", "text_key"), "class").groupBy("text_key").agg(F.collect_list(F.struct("hub", "part", "class", "other")).alias("buckets"))
        asked = written(asked, "asked")
        texts = rows.select("text_key", "text")
        if asked.count() <= BROADCAST_KEYS:
            texts = texts.join(F.broadcast(asked.select("text_key")), "text_key", "left_semi")
        texts = texts.mapInArrow(_once, "text_key long, text string")
        dealt = texts.join(asked, "text_key").select("text_key", "text", "buckets").mapInArrow(_deal(n), "hub long, part long, class long, other boolean, text string")
        return dealt.repartition("hub", "part").sortWithinPartitions("hub", "part", "class").mapInArrow(_solve(n, numerator, denominator, second), "a long, b long")

    parts = F.ceil(F.col("m") / part)
    placed = pairs.join(sizes, "hub", "left").withColumn("parts", F.coalesce(parts, F.lit(1).cast("long"))).withColumn("part", F.when(F.col("m").isNull(), 0).otherwise(F.pmod(F.xxhash64("class"), F.col("parts"))).cast("long"))
    # the hub's own class goes to every part
    first = placed.withColumn("part", F.explode(F.when(F.col("class") == F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("part")))).select("class", "hub", "part", F.lit(False).alias("other"))
    edges = written(solve(first, False), "edges")
    if sizes.take(1):
        roots = components(edges)
        large = placed.where("m IS NOT NULL").select("class", "hub").join(classes.select("class", "n"), "class")
        of = lambda c, name: roots.select(F.col("node").alias(c), F.col("root").alias(name))
        large = large.join(of("class", "own"), "class", "left").join(of("hub", "theirs"), "hub", "left")
        away = ~F.coalesce(F.col("own"), F.col("class")).eqNullSafe(F.coalesce(F.col("theirs"), F.col("hub")))
        # alike sets are in the same band of sizes or in neighbouring ones
        band = F.floor(F.log("n") / F.lit(max(1e-9, 1.001 * math.log(denominator / numerator))))
        large = written(large.select("class", "hub", away.alias("other"), band.alias("band")), "members")
        # those that aren't linked to the hub make tables, band by band; each table meets all classes of its band and the next ones, in parts
        tables = large.where("other").groupBy("hub", "band").agg(F.ceil(F.count(F.lit(1)) / part).alias("tables"))
        near_ = large.select("class", "hub", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band")).join(tables, ["hub", "band"])
        parts_ = near_.groupBy("hub", "band").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts"), F.max("tables").alias("tables"))
        zero, of_band = F.lit(0).cast("long"), F.col("band") * F.lit(1 << 40)
        bucket = of_band + F.col("part") * F.col("tables") + F.col("t")
        dealt_ = lambda what, *salt: F.pmod(F.xxhash64("class", *salt), F.col(what))
        columns = near_.drop("tables").join(parts_, ["hub", "band"]).withColumn("part", dealt_("parts")).withColumn("t", F.explode(F.sequence(zero, F.col("tables") - 1)))
        lines = large.where("other").drop("other").join(parts_, ["hub", "band"]).withColumn("t", dealt_("tables", F.lit(1))).withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1)))
        meet = lambda rows, other: rows.select("class", "hub", bucket.alias("part"), F.lit(other).alias("other"))
        again = meet(columns, False).unionByName(meet(lines, True))
        edges = written(edges.unionByName(solve(again, True)), "edges")
    roots = components(edges).select(F.col("node").alias("class"), "root")
    rooted = measured.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")).select("id", "text_key", "n", "root")
    each = F.struct("id", "text_key")
    smallest = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min(F.when(F.col("id").isNotNull(), each)).alias("first"), F.min(F.when(F.col("id").isNull(), F.col("text_key"))).alias("bare"))
    return rooted.join(smallest, "root", "left")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each component that has a key, that of the smallest key and, of its texts, the smallest text_key.

    Of a component's rows without a key, one stays too.  Rows with the same key and text are one row, the smallest of them by all
    columns that have an order; but texts without words and without a key all stay.  A key that texts of several components
    share keeps a row of each.
    """
    found = written(_rooted(docs, key, text, **options).select("id", "text_key", "root", "first", "bare"), "components")
    names = [fresh(docs, f"jk_{k}") for k in ("id", "text", "row")]
    mine = lambda id_, of: F.col(key).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(of))
    pairs = lambda rows: rows.select(F.col("id").alias(names[0]), F.col("text_key").alias(names[1]))
    stays = F.when(F.col("id").isNull(), F.col("text_key") == F.col("bare")).otherwise(F.struct("id", "text_key") == F.col("first"))
    kept = docs.join(pairs(found.where(F.col("root").isNotNull() & ~stays)).distinct(), mine(*names[:2]), "left_anti")
    alike = found.where("root IS NULL AND id IS NOT NULL").unionByName(found.where(F.col("root").isNotNull() & stays))
    alike = written(pairs(alike).groupBy(*names[:2]).count().where("count > 1").drop("count"), "alike")
    if alike.take(1):
        several = kept.join(alike, mine(*names[:2]))
        columns = [F.col(f"`{c}`") for c in docs.columns]
        ordered = [F.col(f"`{f.name}`") for f in docs.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
        one = several.groupBy(*names[:2]).agg(F.min_by(F.struct(*columns), F.struct(*ordered)).alias(names[2]))
        kept = kept.join(alike, mine(*names[:2]), "left_anti").unionByName(one.select(f"{names[2]}.*"))
    return kept


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and its component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


QUERIES = {"op9_ngram_jaccard": op9_ngram_jaccard}
