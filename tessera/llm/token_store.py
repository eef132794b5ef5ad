"""Token ids in binary shards, compressed by a pair grammar.

Documents are dealt out by ranges of their id, encoded, and written shard by shard.  In each
shard, frequent pairs of neighbouring symbols are replaced by nonterminals, round after
round until none is frequent; a pair never crosses a document's end.  A shard keeps its rules and the length of each
rule's expansion, so that one document, or a place in it, can be decoded without the rest.

Symbols are numbered within the shard: first the token ids that it holds, then its rules.

Layout of a shard, little-endian: magic, then the counts of documents, rules, symbols and
different token ids (4 x uint64); these ids in ascending order (uint32); per document its id (int64), whether it has one (uint8), the
place of its first symbol and of its first token (2 x uint64, one entry more than documents); per
rule its two symbols (2 x uint32) and the length of its expansion (uint32); the symbols (uint16, or
uint32 if there are more than 65,536).
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from . import files
from .arrays import pieces
from .common import shared_dir, table, tasks_for, written

MAGIC = b"TSRPAIR2"
END = 1
SHARD_TOKENS = 4_000_000
MIN_COUNT = 16
#: Bytes of ids that one task reads back.
READ_BYTES = 128 << 20
CACHED_WORDS, CHUNK = 1_000_000, 2_000_000
_LETTER = np.isin(np.arange(256), np.arange(97, 123))
#: How a tokenizer has to treat texts so that words can be encoded one by one.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
KNOWN_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>"}
INDEX = "part int, seq int, file string, n_docs long, n_tokens long"
DOCS = "file string, place long, doc_id long, start long, n_tokens long, ids_crc32 long"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts (UTF-8), as the tokenizer gives them for each whole text, then the end id.

    The tokenizer drops white space, makes letters small and separates letters from marks, so a text's
    ids are those of its words in order, split at spaces, at line ends and before a comma or stop
    behind a letter.  Each word is encoded by the library once and kept, up to CACHED_WORDS of them.
    Texts that may hold special tokens are encoded whole.  So are all texts if the file describes any other
    normalizer, splitting or model than KNOWN, with which a word's ids might depend on what is around it.
    """

    def __init__(self, path: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.end = Tokenizer.from_file(path), end
        described = json.loads(self.library.to_str())
        self.by_word = all(described.get(k) == v for k, v in KNOWN.items()) and all(described["model"].get(k) == v for k, v in KNOWN_MODEL.items()) and all(t["content"].startswith("<|") for t in described["added_tokens"])
        self.closes = np.zeros(self.library.get_vocab_size(), bool)
        for word, i in self.library.get_vocab().items():
            self.closes[i] = word.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint16 if len(self.closes) <= 1 << 16 else np.uint32), 0
        self.start, self.length, self.n = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64), 0
        self._put([b"", b"\n"], np.array([self.end]), np.array([0, 1]))

    def _put(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Keep words; ids holds theirs, one word after the other."""
        k, n = self.used + len(ids), self.n + len(words)
        while k > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n > len(self.start):
            self.start, self.length = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : k] = ids
        self.length[self.n : n] = lengths
        self.start[self.n : n] = self.used + np.cumsum(lengths) - lengths
        self.place.update(zip(words, range(self.n, n), strict=True))
        self.used, self.n = k, n

    def _learn(self, words: list[bytes]) -> None:
        """Keep new words.  One of letters only ends at the first token that closes a word, so many go to the library as one text."""
        texts = [w.decode() for w in words]
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        for a in range(0, len(plain), 5000):
            some = plain[a : a + 5000]
            ids = np.array(self.library.encode_batch_fast([" ".join([texts[i] for i in some])], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):
                self._put([words[i] for i in some], ids, np.diff(ends, prepend=0))
        rest = [i for i, w in enumerate(words) if w not in self.place]
        found = [e.ids for e in self.library.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)]
        self._put([words[i] for i in rest], np.fromiter(chain.from_iterable(found), np.int64), np.array([len(x) for x in found], np.int64))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        if self.n > CACHED_WORDS:
            self.clear()
        whole = {}
        for k, t in enumerate(texts):
            if b"<|" in t or not self.by_word:
                whole[k] = b"\n" + t
                if whole[k] not in self.place:
                    ids = np.array(self.library.encode(t.decode(), add_special_tokens=False).ids, np.int64)
                    self._put([whole[k]], ids, np.array([len(ids)]))
        flat = np.frombuffer(b" \n ".join([*(b"" if k in whole else t.replace(b"\n", b" ") for k, t in enumerate(texts)), b""]).lower(), np.uint8)
        mark = np.flatnonzero((flat[1:] == 44) | (flat[1:] == 46)) + 1
        mark = mark[_LETTER[flat[mark - 1]]]  # a comma or stop behind a letter
        words = np.insert(flat, mark, 32).tobytes().split(b" ")
        if whole:
            out, k = [], 0
            for w in words:
                out += [whole[k], w] if w == b"\n" and k in whole else [w]
                k += w == b"\n"
            words = out
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            absent = [words[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(absent)))
            at[missing] = np.fromiter(map(self.place.__getitem__, absent), np.int64, len(absent))
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.start[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(ends[at == 1], prepend=0)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int = END) -> Encoder:
    """This process's encoder: tasks that run in it one after the other share the words it has kept."""
    if (path, end) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


def _maybe(s: np.ndarray, at: np.ndarray, min_count: int) -> np.ndarray:
    """Places whose pair may occur min_count times: others share its hash so often.  No frequent pair is lost."""
    slot = ((s[at] * np.uint32(0x9E3779B1) + s[at + 1]) * np.uint32(0x85EBCA6B)) >> np.uint32(12)
    return at[(np.bincount(slot, minlength=1 << 20) >= min_count)[slot]]


def _groups(s: np.ndarray, at: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of the pairs (s[i], s[i + 1]) there, then of place; and where each pair's places begin, the end included.

    Symbols are below top.  Pair and place are sorted as one number where they fit into 64 bits.
    """
    symbol, place = np.uint64(max(1, (top - 1).bit_length())), np.uint64(max(1, (len(s) - 1).bit_length()))
    pair = s[at].astype(np.uint64)
    pair <<= symbol
    pair |= s[at + 1]
    if 2 * symbol + place <= 64:  # in place: these arrays are the largest of a shard
        pair <<= place
        pair |= at.astype(np.uint64)
        pair.sort()
        at = (pair & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
        pair >>= place
    else:
        by = np.argsort(pair, kind="stable")
        pair, at = pair[by], at[by]
    return at, np.concatenate([[0], np.flatnonzero(pair[1:] != pair[:-1]) + 1, [len(pair)]])


def compress(ids: np.ndarray, starts: np.ndarray, first: int, rules_a_round: int | None = None, min_count: int = MIN_COUNT):
    """(symbols, starts of documents among them, rules as pairs): frequent pairs replaced, most frequent first.

    starts has one entry more than there are documents.  Where pairs overlap, the left one of each two is replaced.
    Rounds follow each other until no pair within a document occurs min_count times.  A pair's count can't grow once both its
    symbols have been there for a round, so a round counts only what was frequent before and what is next to a new symbol.
    """
    s, starts, rules, top = ids.astype(np.uint32), starts.astype(np.int64), [np.zeros((0, 2), np.uint32)], first
    last = lambda: starts[1:][starts[1:] > 0] - 1
    open_ = np.ones(len(s), bool)
    open_[last()] = False
    while True:
        at = _maybe(s, np.flatnonzero(open_).astype(np.int32 if len(s) < 1 << 31 else np.int64), min_count)
        if not len(at):
            break
        at, edge = _groups(s, at, top)
        count = np.diff(edge)
        often = np.flatnonzero(count >= min_count)
        if not len(often):
            break
        at = at[np.repeat(count >= min_count, count)]
        open_[:] = False
        open_[at] = True
        n = count[often]
        order = np.argsort(-n, kind="stable")
        place = np.zeros(len(n), np.int32)
        place[order] = np.arange(1, len(n) + 1)
        if rules_a_round:
            place[order[rules_a_round:]] = 0
        rule = np.zeros(len(s), np.int32)  # the most frequent pair is 1; 0 is none
        rule[at] = np.repeat(place, n)
        at = np.flatnonzero(rule)
        begins = np.ones(len(at), bool)
        begins[1:] = np.diff(at) != 1
        run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        # pairs that overlapping ones have taken every place of make no rule
        which = rule[at]
        used = np.zeros(len(n) + 1, bool)
        used[which] = True
        which = (np.cumsum(used) - 1)[which]
        some = np.zeros(used.sum(), np.int64)
        some[which] = at
        rules.append(np.stack([s[some], s[some + 1]], 1))
        s[at] = (top + which).astype(np.uint32)
        top += len(some)
        open_[at] = True
        open_[at[at > 0] - 1] = True
        kept = np.ones(len(s), bool)
        kept[at + 1] = False
        starts = starts - np.searchsorted(at + 1, starts)
        s, open_ = s[kept], open_[kept]
        open_[last()] = False
    return s, starts, np.concatenate(rules)


def _levels(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(length of every rule's expansion, how deep its rules go); a rule names only terminals and rules before it."""
    length, deep = [], []
    for a, b in rules.tolist():
        a, b = a - first, b - first
        length.append((length[a] if a >= 0 else 1) + (length[b] if b >= 0 else 1))
        deep.append(1 + max(deep[a] if a >= 0 else 0, deep[b] if b >= 0 else 0))
    return np.array(length, np.int64), np.array(deep, np.int64)


def expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, place, length) of every rule's expansion."""
    length, deep = _levels(rules, first)
    place = np.cumsum(length) - length
    tokens = np.zeros(length.sum(), np.uint32)
    for level in range(1, deep.max(initial=0) + 1):
        k = np.flatnonzero(deep == level)
        to = place[k]
        for part in rules[k].T.astype(np.int64):
            own = part < first
            tokens[to[own]] = part[own]
            n = np.where(own, 1, length[np.where(own, 0, part - first)])
            of, m = part[~own] - first, n[~own]
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            tokens[np.repeat(to[~own], m) + step] = tokens[np.repeat(place[of], m) + step]
            to = to + n
    return tokens, place, length


def expand(symbols: np.ndarray, rules: np.ndarray, first: int, known=None) -> np.ndarray:
    tokens, place, length = known or expansions(rules, first)
    if not len(tokens):
        return symbols.astype(np.uint32)
    rule = symbols >= first
    which = np.where(rule, symbols.astype(np.int64) - first, 0)
    n = np.where(rule, length[which], 1)
    ends = np.cumsum(n)
    # terminals are appended after the expansions, each at its own place
    source = np.concatenate([tokens, symbols.astype(np.uint32)])
    base = np.where(rule, place[which], len(tokens) + np.arange(len(symbols)))
    return source[np.repeat(base - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def pack(doc_ids: list, ids: np.ndarray, counts: np.ndarray) -> bytes:
    token_starts = np.concatenate([[0], np.cumsum(counts)])
    held = np.zeros(int(ids.max(initial=0)) + 1, bool)
    held[ids] = True
    first = int(held.sum())
    rank = (np.cumsum(held) - 1).astype(np.uint32)
    symbols, starts, rules = compress(rank[ids], token_starts, first)
    length, _ = _levels(rules, first)
    width = "<u2" if first + len(rules) <= 1 << 16 else "<u4"
    parts = [MAGIC, struct.pack("<4Q", len(doc_ids), len(rules), len(symbols), first), np.flatnonzero(held).astype("<u4").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(), starts.astype("<u8").tobytes(), token_starts.astype("<u8").tobytes(), rules.astype("<u4").tobytes(), length.astype("<u4").tobytes(), symbols.astype(width).tobytes()]
    return b"".join(parts)


class Shard:
    """A shard's tables, read first; symbols are read by document or all at once."""

    def __init__(self, f):
        self.file = f
        if f.read(8) != MAGIC:
            raise ValueError("not a shard")
        n, r, self.n_symbols, self.first = struct.unpack("<4Q", f.read(32))
        take = lambda count, kind: np.frombuffer(f.read(count * np.dtype(kind).itemsize), kind)
        self.terminals = take(self.first, "<u4")
        ids, has = take(n, "<i8"), take(n, np.uint8)
        self.doc_ids = [int(d) if h else None for d, h in zip(ids.tolist(), has.tolist(), strict=True)]
        self.starts, self.token_starts = take(n + 1, "<u8").astype(np.int64), take(n + 1, "<u8").astype(np.int64)
        self.rules, self.lengths = take(2 * r, "<u4").reshape(-1, 2), take(r, "<u4")
        self.kind = np.dtype("<u2" if self.first + r <= 1 << 16 else "<u4")
        self.data = f.tell()
        self.known = None

    def symbols(self, a: int, b: int) -> np.ndarray:
        self.file.seek(self.data + a * self.kind.itemsize)
        return np.frombuffer(self.file.read((b - a) * self.kind.itemsize), self.kind)

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        """What symbols stand for; only the rules that they reach are expanded."""
        if self.known is None:
            own, new = np.zeros(len(self.rules), bool), np.unique(symbols[symbols >= self.first].astype(np.int64) - self.first)
            while len(new):
                own[new] = True
                below = self.rules[new].ravel()
                new = np.unique(below[below >= self.first].astype(np.int64) - self.first)
                new = new[~own[new]]
            at = self.first + np.cumsum(own, dtype=np.int64) - 1
            renumbered = lambda x: np.where(x >= self.first, at[np.where(x >= self.first, x.astype(np.int64) - self.first, 0)], x).astype(np.uint32) if len(at) else x
            return self.terminals[expand(renumbered(symbols), renumbered(self.rules[own]), self.first)]
        return self.terminals[expand(symbols, self.rules, self.first, self.known)]

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.symbols(self.starts[i], self.starts[i + 1]))

    def token(self, i: int, at: int) -> int:
        """The id at a place of document i: lengths tell which symbol covers it, and only that one is expanded."""
        s = self.symbols(self.starts[i], self.starts[i + 1])
        rule = s >= self.first
        n = np.where(rule, np.concatenate([self.lengths, [1]])[np.where(rule, s.astype(np.int64) - self.first, len(self.lengths))], 1)
        ends = np.cumsum(n)
        k = int(np.searchsorted(ends, at, "right"))
        return int(self.ids(s[k : k + 1])[at - (ends[k] - n[k])])

    def all(self) -> np.ndarray:
        self.known = self.known or expansions(self.rules, self.first)
        return self.ids(self.symbols(0, self.n_symbols))


def write(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", folder: str | None = None, shard_tokens: int = SHARD_TOKENS, end: int = END) -> DataFrame:
    """Write all documents in ascending order of their id and return the index of shards, in order.

    Ids are whole numbers.  Null texts are empty: their only id is the end id.  Null ids come last.  Rows that repeat an
    id are all written, in order of their texts' hashes.  Other columns are ignored.
    """
    path, folder = path or default_path(), folder or shared_dir(ship(docs.sparkSession))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
    # rows that share an id, or have none, are dealt to many tasks too
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order, "row").sortWithinPartitions(*order, "text").select("doc_id", "text")

    def store(batches):
        encode, part, seq = encoder(path, end), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        names: list = []
        size = 0

        def flush():
            nonlocal ids, counts, names, size, seq
            uri, out = files.create(folder, f"part-{part:05d}-{seq:05d}", ".ids")
            whole, ids = np.concatenate(ids), []
            with out:
                out.write(pack(names, whole, np.concatenate(counts)))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [uri], "n_docs": pa.array([len(names)], pa.int64()), "n_tokens": pa.array([size], pa.int64())})
            ids, counts, names, size, seq = [], [], [], 0, seq + 1
            return row

        for b in pieces(batches, most=CHUNK):
            got, n = encode(b.column(1).to_pylist())
            ids.append(got)
            counts.append(n)
            names += b.column(0).to_pylist()
            size += len(got)
            if size >= shard_tokens:
                yield flush()
        if names:
            yield flush()

    return written(rows.mapInArrow(store, INDEX), "shards")


def read(index: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """Per document: file, place in it, doc_id, start (ids before it in all shards), n_tokens, ids_crc32.

    Shards are dealt to tasks by the ids they hold, not by the index's own size.
    """
    order = W.orderBy("part", "seq")  # one row per shard
    index = index.withColumn("start", F.sum("n_tokens").over(order) - F.col("n_tokens"))
    size = index.agg(F.sum("n_tokens")).first()[0] or 0

    def fetch(batches):
        for b in batches:
            for uri, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                system, name = files.opened(uri)
                with system.open_input_file(name) as f:
                    shard = Shard(f)
                    ids = shard.all().astype("<u4")
                t, n = shard.token_starts, len(shard.doc_ids)
                crc = [zlib.crc32(ids[t[i] : t[i + 1]].tobytes()) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * n), pa.array(np.arange(n)), pa.array(shard.doc_ids, pa.int64()), pa.array(start + t[:-1]), pa.array(np.diff(t)), pa.array(crc, pa.int64())], ["file", "place", "doc_id", "start", "n_tokens", "ids_crc32"])

    return index.select("file", "start").repartitionByRange(tasks_for(index.sparkSession, 4 * size, read_bytes), "start").mapInArrow(fetch, DOCS)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents' ids, written and read back: a row per document."""
    return read(write(table(spark, sf_dir, "documents"))).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op8_token_store": op8_token_store}
