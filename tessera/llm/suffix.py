"""Removal of long repeated byte strings with a Burrows-Wheeler transform.

1. Anchors.  Of every LENGTH-byte string, the K-byte piece with the smallest hash is an anchor.  Equal
   strings have equal anchors at equal places, so a string can only repeat around an anchor
   that does.  About one byte in seventy begins an anchor.
2. Contexts.  An anchor's context is all that a LENGTH-byte string around it can reach.  Contexts
   are compared by hash.  One that occurs twice repeats wholly.  Where an anchor has different
   contexts, one copy of each is fetched.
3. Transform.  Contexts of the same anchors meet in one task, many anchors at a time.  From the
   transform of their concatenation, intervals of common prefixes are extended backward, breadth
   first; common prefixes come out by increasing length, and extension stops at LENGTH.
   Neighbours whose boundary is still open then share LENGTH bytes.
   An anchor with more contexts than a transform holds has them dealt by the bytes around it.
4. Removal.  The spans found for a text are joined to it, and what they cover goes.

Texts are known by their md5, so equal texts share anchors' work and nothing depends on row numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .arrays import Spans, joined, mixed, pieces, runs
from .common import dealt, fresh, named, plain_names, table, written

LENGTH, K = 200, 64
CHUNK = 1 << 20  # bytes of contexts in one transform
MOST_CONTEXTS = 20_000  # of one anchor in one transform; beyond, strings are compared one by one
MOST_MET = 1_000_000  # texts that a task remembers
_PLACE = np.uint64((1 << 24) - 1)
_MEMBER = np.dtype([("key", "S16"), ("lo", "<i4"), ("hi", "<i4")])


def anchors(data: np.ndarray, starts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchors of texts that lie one after the other, each with one byte behind it."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n)
    value = Spans(data).hash(at, at + k)
    least = (value & ~_PLACE) | at.astype(np.uint64)
    # sliding minimum over `width` places by doubling
    width, have = length - k + 1, 1
    while have < width:
        step = min(have, width - have)
        if len(least) <= step:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        least = np.minimum(least[:-step], least[step:])
        have += step
    # only windows that lie in one text
    first, end = starts[:-1], starts[1:] - 1
    inside = np.zeros(len(least) + 1, np.int8)
    long = end - first >= length
    np.add.at(inside, first[long], 1)
    np.add.at(inside, np.minimum(end[long] - length + 1, len(least)), -1)
    place = np.unique(least[np.cumsum(inside[:-1]).astype(bool)] & _PLACE).astype(np.int64)
    return place, value[place]


def _find(length: int, k: int):
    """Rows of anchors: equal (hash, context) of a piece together, with their members (text, from, to).

    A task tells of a text at most twice, however many copies it meets: more would change nothing.
    """
    reach = length - k

    def run(batches):
        met: dict[bytes, int] = {}
        for b in pieces(batches, most=1 << 20):
            if len(met) > MOST_MET:
                met.clear()
            own = []
            for i, key in enumerate(b.column(0).to_pylist()):
                met[key] = n = met.get(key, 0) + 1
                if n <= 2:
                    own.append(i)
            if not own:
                continue
            if len(own) < b.num_rows:
                b = b.take(pa.array(own))
            texts = [t or b"" for t in b.column(1).to_pylist()]
            data, starts = joined(texts)
            # a text beyond 16 MB is taken in steps that overlap by what a string can cover
            parts = [(0, len(data))] if len(data) <= 1 << 24 else [(a, min(len(data), a + (1 << 24))) for a in range(0, len(data), (1 << 24) - length)]
            found = []
            for a, e in parts:
                cut = np.concatenate([[0], np.clip(starts[(starts > a) & (starts < e)] - a, 0, None), [e - a + (e < len(data))]])
                place, value = anchors(data[a:e], cut, length, k)
                found.append((place + a, value))
            place, value = np.concatenate([p for p, _ in found]), np.concatenate([v for _, v in found])
            if len(parts) > 1:
                place, own = np.unique(place, return_index=True)
                value = value[own]
            if not len(place):
                continue
            doc = np.searchsorted(starts, place, "right") - 1
            lo, hi = np.maximum(place - reach, starts[doc]), np.minimum(place + length, starts[doc + 1] - 1)
            context = Spans(data).hash(lo, hi) ^ mixed((place - lo).astype(np.uint64))
            member = np.empty(len(place), _MEMBER)
            member["key"] = np.array(b.column(0).to_pylist(), "S16")[doc]
            member["lo"], member["hi"] = lo - starts[doc], hi - starts[doc]
            order = np.lexsort((context, value))
            value, context, member = value[order], context[order], member[order]
            new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (context[1:] != context[:-1])]))
            offsets = np.append(new, len(value)).astype(np.int32) * _MEMBER.itemsize
            members = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(offsets), pa.py_buffer(member.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(value[new].view(np.int64)), pa.array(context[new].view(np.int64)), pa.array(np.diff(np.append(new, len(value)))), members], ["hash", "context", "m", "members"])

    return run


def _spans(batches):
    """(key, from << 32 | to) of all members."""
    for b in batches:
        member = np.frombuffer(b"".join(b.column(0).to_pylist()), _MEMBER)
        keys = pa.Array.from_buffers(pa.binary(16), len(member), [None, pa.py_buffer(np.ascontiguousarray(member["key"]).tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([keys, pa.array(member["lo"].astype(np.int64) << 32 | member["hi"])], ["key", "span"])


def _once(batches):
    """The texts, each once a task."""
    met: set[bytes] = set()
    for b in batches:
        own = []
        for i, key in enumerate(b.column(0).to_pylist()):
            if key not in met:
                met.add(key)
                own.append(i)
        if own:
            yield b if len(own) == b.num_rows else b.take(pa.array(own))
        if len(met) > MOST_MET:
            met.clear()


def suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in order of their first `depth` symbols: each round sorts by three times as many symbols (twice, in very long arrays)."""
    n = len(symbols)
    alphabet = np.zeros(int(symbols.max()) + 1, np.int64)
    alphabet[np.unique(symbols)] = 1
    dense = np.cumsum(alphabet)[symbols]  # from 1; 0 stands for what is behind the end
    bits = int(dense.max()).bit_length()
    have = 63 // bits
    padded, key = np.concatenate([dense, np.zeros(have, np.int64)]), np.zeros(n, np.int64)
    for j in range(have):
        key = key << bits | padded[j : j + n]
    times = 3 if n < 1 << 21 else 2
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.ones(n, np.int64)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.zeros(n + (times - 1) * have, np.int64)
        rank[order] = np.cumsum(new)
        if have >= depth or rank[order[-1]] == n:
            return order
        key = rank[:n]
        for j in range(1, times):
            key = key << (63 // times) | rank[j * have : j * have + n]
        have *= times


def open_boundaries(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes share at least `length` symbols with the one before them in order; symbol 0 separates.

    Breadth-first backward extension: from the interval of each string of l symbols come those of
    all strings one symbol longer at the front; where such an interval ends at a boundary that is
    still open, the common prefix there is l, and the interval is extended in the next round.
    Intervals are read by the transform's runs of equal symbols, few where much repeats.
    """
    n = len(symbols)
    last = symbols[order - 1]  # of two bytes each, which are sorted by counting
    back = np.empty(n, np.int64)  # where a suffix goes when its preceding symbol is put in front
    back[np.argsort(last, kind="stable")] = np.arange(n)
    first, width = runs(last)
    end, symbol, goes = first + width, last[first].astype(np.int64), back[first]
    of = np.repeat(np.arange(len(first)), width)
    still = np.ones(n + 1, bool)
    still[[0, n]] = False
    lo, hi = np.array([0]), np.array([n])
    for l in range(length):
        a, b = of[lo], of[hi - 1]
        size = b - a + 1
        which = np.repeat(np.arange(len(lo)), size)
        run = np.arange(len(which)) + np.repeat(a - (np.cumsum(size) - size), size)
        if l:  # a string with a separator inside is of no use
            own = symbol[run] > 0
            which, run = which[own], run[own]
        start, stop = np.maximum(lo[which], first[run]), np.minimum(hi[which], end[run])
        # the extension by one symbol takes the first place of its first run and the last of its last
        key, place = which << 9 | symbol[run], goes[run] + start - first[run]
        by = np.argsort(key, kind="stable")
        at, _ = runs(key[by])
        lo, hi = place[by[at]], np.maximum.reduceat((place + stop - start)[by], at) if len(at) else at
        own = still[hi]
        lo, hi = lo[own], hi[own]
        still[hi] = False
        if not len(lo):
            break
    return still[:-1]


def repeated(contexts: list[bytes], text: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of the strings of `length` bytes that also start elsewhere: in another text or at another place."""
    data, starts = joined(contexts)
    symbols = data.astype(np.uint16) + 1
    symbols[starts[1:] - 1] = 0
    order = suffixes(symbols, length)
    still = open_boundaries(symbols, order, length)
    of = np.repeat(np.arange(len(contexts)), np.diff(starts))
    offset = np.arange(len(symbols)) - starts[of]
    whole = starts[of + 1] - 1 - starts[of] - offset >= length
    identity = (text[of] << 32 | (place[of] + offset))[order]
    run = np.flatnonzero(~still)
    many = np.minimum.reduceat(identity, run) != np.maximum.reduceat(identity, run)
    member = np.repeat(many, np.diff(run, append=len(order)))
    found = np.zeros(len(symbols), bool)
    found[order] = member
    at = np.flatnonzero(found & whole)
    return of[at], offset[at]


def _merged(context: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, from, to) of runs of neighbouring strings."""
    new = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (start[1:] != start[:-1] + 1)])) if len(start) else np.zeros(0, np.int64)
    end = np.append(new[1:], len(start)) - 1 if len(new) else new
    return context[new], start[new], start[end] + length


def _hashed(texts: list[bytes]) -> np.ndarray:
    """A hash of each text, worked out some at a time."""
    found = [np.zeros(0, np.uint64)]
    for a in range(0, len(texts), 2048):
        data, starts = joined(texts[a : a + 2048])
        found.append(Spans(data).hash(starts[:-1], starts[1:] - 1))
    return np.concatenate(found)


def crowded(contexts: list[bytes], context: np.ndarray, text: np.ndarray, place: np.ndarray, length: int, reach: int, most: int):
    """(context, from, to) of repeated strings in the different contexts of one anchor (context: their hashes), by transforms of at most `most` bytes.

    Strings that begin `low` to `high` bytes before the anchor share what lies between the last beginning and the first end, so contexts
    with other bytes there needn't meet.  Of those that do, stretches that occur twice repeat wholly, and one of each goes on.  Where
    these are too many for a transform, they are dealt again for each half of the beginnings; strings of one beginning are equal or don't meet.
    """
    told = mixed(np.arange(reach + 1, dtype=np.uint64))  # a context's hash tells how many of its bytes are before the anchor
    by = np.argsort(told)
    left = by[np.searchsorted(told[by], context ^ _hashed(contexts))]
    right = np.array([len(c) for c in contexts], np.int64) - left
    cut = lambda own, lo, hi: [contexts[i][a:e] for i, a, e in zip(own.tolist(), lo.tolist(), hi.tolist(), strict=True)]

    def solve(parts):
        own, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
        of, start, end = _merged(*repeated(cut(own, lo, hi), text[own], place[own] + lo, length), length)
        return own[of], lo[of] + start, lo[of] + end

    todo, ready, size = [(np.arange(len(contexts)), 0, reach)], [], 0
    while todo:
        own, low, high = todo.pop()
        lo, hi = left[own] - np.minimum(high, left[own]), left[own] - np.maximum(low, length - right[own]) + length
        own, lo, hi = (x[hi - lo >= length] for x in (own, lo, hi))
        shared = _hashed(cut(own, left[own] - low, left[own] - high + length))
        whole = _hashed(cut(own, lo, hi)) ^ mixed((left[own] - lo).astype(np.uint64))
        order = np.lexsort((whole, shared))
        own, lo, hi, shared, whole = (x[order] for x in (own, lo, hi, shared, whole))
        first, n = runs(shared)
        for a, e in zip(first[n > 1].tolist(), (first + n)[n > 1].tolist(), strict=True):
            head, copies = runs(whole[a:e])
            twice = a + np.flatnonzero(np.repeat(copies > 1, copies))
            if len(twice):
                yield own[twice], lo[twice], hi[twice]
            if len(head) == 1:
                continue
            each = a + head
            own_size = int((hi[each] - lo[each] + 1).sum())
            if own_size > most and low < high:
                middle = (low + high) // 2
                todo += [(own[each], low, middle), (own[each], middle + 1, high)]
                continue
            if ready and size + own_size > most:
                yield solve(ready)
                ready, size = [], 0
            ready.append((own[each], lo[each], hi[each]))
            size += own_size
    if ready:
        yield solve(ready)


def _anchored(batches):
    """(rows, bytes) of each anchor, from contexts that come sorted by anchor and context: one row of each context."""
    rows, size = [], 0
    for b in pieces(batches, "data", 1 << 18):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and row[:2] == rows[-1][:2]:
                continue
            if rows and row[0] != rows[-1][0]:
                yield rows, size
                rows, size = [], 0
            rows.append(row)
            size += len(row[4]) + 1
    if rows:
        yield rows, size


def _transform(length: int, chunk: int, reach: int):
    """Spans from contexts that come sorted by anchor and context (hash, context, key, lo, data)."""

    def told(rows, place, context, lo, hi):
        keys = [rows[c][2] for c in context.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array((place[context] + lo) << 32 | (place[context] + hi))], ["key", "span"])

    def solve(rows, alone=False):
        number: dict = {}
        text = np.array([number.setdefault(r[2], len(number)) for r in rows], np.int64)
        place, contexts = np.array([r[3] for r in rows], np.int64), [r[4] for r in rows]
        if alone:
            found = crowded(contexts, np.array([r[1] for r in rows], np.int64).view(np.uint64), text, place, length, reach, chunk)
        else:
            found = [_merged(*repeated(contexts, text, place, length), length)]
        for spans_ in found:
            yield told(rows, place, *spans_)

    def run(batches):
        rows, size = [], 0
        for own, own_size in _anchored(batches):
            if own_size > chunk:
                yield from solve(own, alone=True)
                continue
            if rows and size + own_size > chunk:
                yield from solve(rows)
                rows, size = [], 0
            rows += own
            size += own_size
        if rows:
            yield from solve(rows)

    return run


def spans(texts: DataFrame, length: int = LENGTH, k: int = K, chunk: int = CHUNK, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """key, span of repeated strings; texts has key (the text's md5) and data (its bytes)."""
    ship(texts.sparkSession)
    every = texts.mapInArrow(_find(length, k), "hash long, context long, m long, members binary")
    # what is counted of an anchor is summed up in each task and joined to its members, where Spark splits the hot ones
    told = every.groupBy("hash").agg(F.sum("m").alias("n"), F.min("context").alias("first"), F.max("context").alias("last")).where("n > 1")
    found = written(every.join(told, "hash").select("hash", "context", "members", "m", (F.col("first") != F.col("last")).alias("differ")), "anchors")
    ask = found.where("differ").groupBy("hash", "context").agg(F.min(F.substring("members", 1, _MEMBER.itemsize)).alias("first"), F.sum("m").alias("n"))
    ask = written(ask, "asked")
    several = found.where("differ").join(ask.where("n > 1").select("hash", "context"), ["hash", "context"])
    whole = found.where("NOT differ").select("members").unionByName(several.select("members")).mapInArrow(_spans, "key binary, span long")
    large = ask.groupBy("hash").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") > most_contexts).select("hash", F.lit(True).alias("large"))
    m = F.col("first")
    ask = ask.join(large, "hash", "left").select("hash", "context", F.coalesce("large", F.lit(False)).alias("large"), F.substring(m, 1, 16).alias("key"), _int(m, 17).alias("lo"), _int(m, 21).alias("hi"))
    ask = ask.groupBy("key").agg(F.collect_list(F.struct("hash", "context", "large", "lo", "hi")).alias("asked"))  # at most a text's anchors

    def fetch(batches):
        done = None
        for b in pieces(batches, "data", 1 << 18):
            keys, texts = b.column(0).to_pylist(), b.column(1)
            asked, ends = b.column(2).flatten(), np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False))
            hashes, contexts, large, lo, hi = asked.flatten()
            for i, key in enumerate(keys):
                if key == done:  # copies of a text come one after the other
                    continue
                done, data = key, texts[i].as_py()
                for a in range(int(ends[i - 1]) if i else 0, int(ends[i]), 4096):
                    part = slice(a, min(a + 4096, int(ends[i])))
                    own = [data[s:e] for s, e in zip(lo[part].to_pylist(), hi[part].to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([hashes[part], contexts[part], large[part], pa.array([key] * len(own), pa.binary()), lo[part], pa.array(own, pa.binary())], names)

    names = ["hash", "context", "large", "key", "lo", "data"]
    once = texts.select("key", "data").mapInArrow(_once, "key binary, data binary")
    contexts = written(once.join(ask, "key").select("key", "data", "asked").mapInArrow(fetch, "hash long, context long, large boolean, key binary, lo long, data binary"), "contexts")
    inside = contexts.where("NOT large").select("hash", "context", "key", "lo", "data").repartition("hash").sortWithinPartitions("hash", "context").mapInArrow(_transform(length, chunk, length - k), "key binary, span long")
    # anchors with very many contexts: every string by its hash, in groups that any number of tasks share
    strings = contexts.where("large").dropDuplicates(["hash", "context"]).mapInArrow(_strings(length), "one long, two long, key binary, start long")
    twice = strings.groupBy("one", "two").agg(F.min(F.struct("key", "start")).alias("a"), F.max(F.struct("key", "start")).alias("b")).where("a <> b").select("one", "two")
    rest = strings.join(twice, ["one", "two"]).select("key", (F.col("start") * F.lit(1 << 32) + F.col("start") + length).alias("span"))
    return whole.unionByName(inside).unionByName(rest)


def _int(binary, at: int):
    """A little-endian int of four bytes, at most 2^31 - 1."""
    byte = lambda i: F.conv(F.hex(F.substring(binary, at + i, 1)), 16, 10).cast("long")
    return byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216


def _strings(length: int):
    def run(batches):
        for b in batches:
            for _, _, _, key, lo, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                flat = np.frombuffer(data, np.uint8)
                at = np.arange(len(flat) - length + 1)
                s = Spans(flat)
                one = s.hash(at, at + length)
                two = mixed(s.hash(at, at + length // 2) + mixed(s.hash(at + length // 2, at + length)))
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([key] * len(at), pa.binary()), pa.array(lo + at)], ["one", "two", "key", "start"])

    return run


def _cut(data: bytes, found) -> tuple[bytes, int]:
    """What is left of a text without its spans, and how many runs went."""
    out, at, n = [], 0, 0
    end = -1
    for span in sorted(found):
        lo, hi = span >> 32, span & 0xFFFFFFFF
        if lo > end:
            n += 1
            out.append(data[at:lo])
            at = hi
        else:
            at = max(at, hi)
        end = max(end, hi)
    out.append(data[at:])
    return b"".join(out), n


def remove(docs: DataFrame, text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that are left).

    A column of docs with one of these names is replaced.  A null text is empty.  Texts under
    `length` bytes keep everything.  Of repeated rows with long enough texts nothing is left: each of
    their strings also starts in the other row.  An empty table gives an empty result.
    """
    docs, name = plain_names(docs.drop(*[c for c in docs.columns if c.lower() in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")]))
    text = name[text]
    key, data, found = (fresh(docs, x) for x in ("sx_key", "sx_data", "sx_found"))
    rows = dealt(docs).withColumn(data, F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = rows.withColumn(key, F.unhex(F.md5(data)))
    texts = rows.select(F.col(key).alias("key"), F.col(data).alias("data"))
    every = spans(texts, length, **options).groupBy(F.col("key").alias(key)).agg(F.collect_set("span").alias(found))
    out = rows.select(*docs.columns, key, data).join(every, key, "left").drop(key)
    kept = docs.columns

    def cut(batches):
        for b in pieces(batches, data, 1 << 22):
            left, removed, n_spans, digest = [], [], [], []
            texts = b.column(b.schema.get_field_index(data)).to_pylist()
            for t, s in zip(texts, b.column(b.schema.get_field_index(found)).to_pylist(), strict=True):
                rest, n = _cut(t, s) if s else (t, 0)
                left.append(rest)
                removed.append(len(t) - len(rest))
                n_spans.append(n)
                digest.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), pa.array(left, pa.binary())], [*kept, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return named(out.mapInArrow(cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"), name)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings of 200 bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
