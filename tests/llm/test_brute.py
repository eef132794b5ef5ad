"""Operators that SQL can't express, against brute force, an exact round trip or held-out labels."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard, language, suffix, token_store, toxicity
from tessera.llm.common import table, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


# ---- near-duplicates ----


def shingles(text, n=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_near(rows, n=5):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    posts = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            posts[x].append(i)
    pairs = {(a, b) for v in posts.values() for a in v for b in v if a < b}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return {(k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows)}


def near(df, **options):
    return {(r["id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, **options).collect()}


def chains(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 6, 20, 60, 150]))]
        for _ in range(r.choice([1, 2, 5, 9])):
            rows.append((len(rows), " ".join(base)))
            k = r.randrange(len(base))
            base = [*base[:k], r.choice(vocabulary), *base[k + r.choice([0, 1]) :]]
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n\t"), (len(rows) + 3, "ONE word"), (len(rows) + 4, "one WORD"), (len(rows) + 5, "É one"), (len(rows) + 6, "é one")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"part": 4, "most_counted": 3}, {"part": 2}, {"hot": 2}, {"hot": 1, "most_counted": 2, "part": 3}, {"share": 0.0}, {"share": 0.05, "part": 4}, {"share": 1.0}])
def test_near_duplicates_on_chains(spark, options):
    rows = chains()
    assert near(docs(spark, rows).repartition(3), **options) == brute_near(rows)


def test_near_duplicates_of_all_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    assert near(d) == brute_near([tuple(r) for r in d.collect()])


def test_near_duplicates_in_a_hot_bucket(spark):
    """Many texts that share most of their words, in buckets far larger than a part."""
    r = random.Random(5)
    base = [f"c{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(1, 6)):
            w[r.randrange(len(w))] = f"x{i}y{r.randrange(50)}"
        rows.append((i, " ".join(w)))
    assert near(docs(spark, rows).repartition(5), part=20) == brute_near(rows)


def test_near_duplicates_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_KEYS", 0)
    rows = chains(4)
    assert near(docs(spark, rows + rows).repartition(3)) == brute_near(rows)


def passages(n):
    """Texts that share a passage of more than half their words, none of them alike."""
    r = random.Random(n)
    shared = " ".join(f"p{i}" for i in range(60))
    return [(i, " ".join(f"a{i}b{k}" for k in range(20)) + " " + shared + " " + " ".join(f"c{i}d{r.randrange(99)}e{k}" for k in range(20))) for i in range(n)]


def test_texts_that_share_a_passage_dont_all_meet(spark, monkeypatch):
    """With all members counted, what is sent to buckets grows no faster than the texts; with the usual share the rows are the same."""
    sent = []

    def watched(df, name="table"):
        out = written(df, name)
        if name == "asked":
            sent[-1] += out.agg(F.sum(F.size("buckets"))).first()[0] or 0
        return out

    monkeypatch.setattr(jaccard, "written", watched)
    for n in (200, 400):
        sent.append(0)
        rows = passages(n)
        assert near(docs(spark, rows).repartition(4), part=100, share=1.0) == {(i, 96, i) for i in range(n)}
    assert sent[1] <= 2.2 * sent[0]
    sent.append(0)
    assert near(docs(spark, passages(200)).repartition(4), part=100) == {(i, 96, i) for i in range(200)}


def test_near_duplicates_keep_columns_and_rows(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(5, text, 1), (3, text + " b", 2), (3, text + " b", 2), (None, text, 3), (9, None, 4), (8, "", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, root long")
    kept = jaccard.keep_one(d)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 8, 9]
    empty = jaccard.keep_one(d.limit(0))
    assert empty.columns == d.columns and empty.count() == 0


def test_one_row_of_each_component_whatever_the_ids(spark):
    """A repeated id loses no unrelated text, and rows without an id are one of their component."""
    a, b, c, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abce")
    rows = [(1, a, 1), (1, b, 2), (1, b + " z", 2), (2, a + " z", 3), (3, b, 4), (7, c, 6), (7, c, 5), (None, c, 7), (None, e, 8), (None, e, 8), (None, e + " z", 9), (4, "", 1), (4, "", 1), (4, None, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n long")
    for parts in (1, 5):
        kept = [tuple(r) for r in jaccard.keep_one(d.repartition(parts)).collect()]
        group = lambda t: (t or "")[:1]
        assert sorted((k or 0, group(t)) for k, t, _ in kept) == [(0, "c"), (0, "e"), (1, "a"), (1, "b"), (4, ""), (7, "c")]
        # of rows with the same id and text the smallest
    alike = [(7, c, 6), (7, c, 5), (7, c, 5), (8, c + " z", 1)]
    assert [tuple(r) for r in jaccard.keep_one(spark.createDataFrame(alike, "doc_id long, text string, n long").repartition(3)).collect()] == [(7, c, 5)]


# ---- repeated strings ----


def brute_cut(texts, length):
    where = defaultdict(int)
    data = [(t or "").encode() for t in texts]
    for b in data:
        for i in range(len(b) - length + 1):
            where[b[i : i + length]] += 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if where[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), len(b) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return out


def cut(df, **options):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove(df, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"chunk": 64}, {"most_contexts": 1}])
def test_repeats_of_short_strings(spark, options):
    r = random.Random(11)
    passages = ["".join(r.choice("abcdeé ") for _ in range(r.randrange(15, 60))) for _ in range(8)]
    texts = []
    for _ in range(40):
        parts = ["".join(r.choice("abcde ") for _ in range(r.randrange(0, 40)))]
        for _ in range(r.randrange(0, 4)):
            p = r.choice(passages)
            a = r.randrange(0, 8)
            parts += [p[a : len(p) - r.randrange(0, 8)], "".join(r.choice("abcde ") for _ in range(r.randrange(0, 30)))]
        texts.append("".join(parts))
    texts += [None, "", "a" * 90, texts[0], "ab" * 40, "x" * 19, "x" * 20, "y" * 21]
    want = brute_cut(texts, 20)
    got = cut(docs(spark, list(enumerate(texts))), length=20, k=8, **options)
    assert [got[i] for i in range(len(texts))] == want


def test_repeats_of_a_crowded_anchor_in_small_transforms(monkeypatch):
    """An anchor with many contexts, some alike to one side, some around, is solved by transforms of about `chunk` bytes, not by one of them all."""
    import numpy as np
    import pyarrow as pa

    from tessera.llm.arrays import Spans, joined, mixed

    r, length, k = random.Random(5), 40, 12
    some = lambda n: bytes(r.choice(b"abcdefgh") for _ in range(n))
    anchor, lefts, rights = some(k), [some(28) for _ in range(9)], [some(28) for _ in range(9)]
    rows, told = [], {}
    for i in range(400):
        left, right = (some(n) + side[n:] for side, n in ((r.choice(lefts), r.randrange(29)), (r.choice(rights)[::-1], r.randrange(29))))
        left, right = left[r.choice([0, 0, r.randrange(29)]) :], right[::-1]
        data, starts = joined([left + anchor + right])
        context = int((Spans(data).hash(starts[:-1], starts[1:] - 1) ^ mixed(np.array([len(left)], np.uint64))).view(np.int64)[0])
        told[context] = (7, context, b"%016d" % i, 0 if len(left) < 28 else 5, left + anchor + right)
    rows = sorted(told.values())
    inside, sizes = suffix.repeated, []
    monkeypatch.setattr(suffix, "repeated", lambda contexts, *more: sizes.append(sum(map(len, contexts))) or inside(contexts, *more))
    batch = pa.RecordBatch.from_pylist([dict(zip(("hash", "context", "key", "lo", "data"), x, strict=True)) for x in rows])

    def covered(chunk):
        sizes.clear()
        found = set()
        for b in suffix._transform(length, chunk, length - k)(iter([batch])):
            for key, span in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found |= {(key, i) for i in range(span >> 32, span & 0xFFFFFFFF)}
        return found, max(sizes)

    whole, size = covered(1 << 20)
    assert size > 20000 and whole
    for chunk in (2000, 600):
        found, size = covered(chunk)
        assert found == whole and size <= chunk


def test_repeats_of_all_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    rows = d.collect()
    want = dict(zip((r["doc_id"] for r in rows), brute_cut([r["text"] for r in rows], 200), strict=True))
    assert cut(d) == want


def test_repeats_keep_columns(spark):
    d = spark.createDataFrame([(1, "abc", "k", 7), (2, None, None, None)], "doc_id long, text string, key string, n_bytes int")
    out = suffix.remove(d)
    assert [c for c in out.columns if c not in ("n_removed", "n_spans", "kept_sha256", "kept")] == ["doc_id", "text", "key", "n_bytes"]
    assert {(r["doc_id"], r["n_bytes"], r["key"]) for r in out.collect()} == {(1, 3, "k"), (2, 0, None)}
    assert suffix.remove(d.limit(0)).count() == 0


# ---- token store ----


def brute_tokens(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.default_path())
    start, out = 0, []
    for k, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        out.append((k, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


HARD = ["", None, "Hello, World. It's 3.14,5 (e.g. this)...", "a,b.c;d", "x y　z ́acute Å", "naïve CAFÉ ﬁne ǅ ß İi", "<|endoftext|> and <|startoftext|>x", "tabs\tand\nlines\r\n\x0b\x0c end", "日本語のテキスト。混ざる text", "🙂👍🏽 emoji", "don't DON'T we'll", "<| not special |>", "e.\n.f ,g", "\x00\x01\x1f", "ΑΣ ΣΑΣ. ς", "a" * 3000, "1234567890 12,345.67"]


def read_tokens(df, **options):
    rows = token_store.read(token_store.write(df, **options)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    return sorted(map(tuple, rows), key=lambda r: r[1])


@pytest.mark.parametrize("options", [{}, {"shard_tokens": 50}])
def test_tokens_of_hard_texts(spark, options):
    rows = list(enumerate(HARD))
    assert read_tokens(docs(spark, rows).repartition(3), **options) == brute_tokens(rows)


def test_tokens_of_all_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    assert read_tokens(d) == brute_tokens([tuple(r) for r in d.collect()])


def test_tokens_at_random_places(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.default_path())
    d = table(spark, sf, "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    index = token_store.write(d).collect()
    r = random.Random(1)
    for row in index:
        with open(row["file"].removeprefix("file://"), "rb") as f:
            shard = token_store.Shard(f)
            assert len(shard.rules) > 0 and shard.n_symbols < row["n_tokens"]
            for i in r.sample(range(len(shard.doc_ids)), 5):
                ids = [*t.encode(texts[shard.doc_ids[i]] or "", add_special_tokens=False).ids, 1]
                assert shard.document(i).tolist() == ids
                for at in (0, len(ids) // 2, len(ids) - 1):
                    assert shard.token(i, at) == ids[at]


def test_pairs_are_replaced_until_none_is_frequent():
    """Copies of a long passage, many frequent pairs and runs: no pair of a document's symbols is left min_count times."""
    r = random.Random(7)
    passage = [r.randrange(5000) for _ in range(700)]
    texts = [[*passage, 4999, r.randrange(5000)] for _ in range(64)] + [[r.randrange(60) for _ in range(2000)] for _ in range(60)] + [[7] * 999, [], [8]]
    ids = np.array([i for t in texts for i in t])
    starts = np.cumsum([0, *map(len, texts)])
    for options in ({}, {"rules_a_round": 50}):
        s, at, rules = token_store.compress(ids, starts, 49_000, **options)
        pairs = Counter(p for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for p in zip(s[a : b - 1].tolist(), s[a + 1 : b].tolist(), strict=True))
        assert max(pairs.values()) < token_store.MIN_COUNT
        assert (token_store.expand(s, rules, 49_000) == ids).all()
        assert all(token_store.expand(s[a:b], rules, 49_000).tolist() == t for a, b, t in zip(at[:-1], at[1:], texts, strict=True))
        assert max(at[1:65] - at[:64]) < 20
    shard = token_store.Shard(io.BytesIO(token_store.pack(list(range(len(texts))), ids, np.diff(starts))))
    assert shard.all().tolist() == ids.tolist() and shard.document(3).tolist() == texts[3] and shard.token(3, 600) == texts[3][600]


def test_tokens_of_repeated_and_null_ids(spark):
    rows = [(2, "b"), (2, "a"), (None, "c"), (1, None)]
    assert read_tokens(docs(spark, rows)) == brute_tokens(rows)
    assert read_tokens(docs(spark, rows).limit(0)) == []


# ---- learned operators ----


def test_language_of_held_out_documents(spark, sf):
    found = language.op6_language(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert found and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.9 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_of_odd_texts(spark):
    learned = [("en", ord("e"), 0), ("en", ord("t"), 1), ("fr", ord("é"), 0), ("fr", ord("e"), 1)]
    d = docs(spark, [(1, None), (2, ""), (3, "123 !"), (4, "é " * 5000), (5, "t e t e t")])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(d, learned).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[4][0] == "fr" and got[5][0] == "en"
    assert {r["lang_pred"] for r in language.identify(d, []).collect()} == {"und"}
    assert language.profiles(d.limit(0)).count() == 0


def test_language_ranks_against_brute_force(spark):
    d = docs(spark, [(1, "aab ab"), (2, "Ba")])
    counts = defaultdict(int)
    for t in ("aab ab", "ba"):
        letters = [c if c.isalpha() else " " for c in t]
        padded = [" ", *letters, " "]
        for i in range(1, len(padded) - 1):
            if padded[i] != " ":
                counts[padded[i]] += 1
                counts[padded[i - 1] + padded[i] + padded[i + 1]] += 1
        for i in range(len(padded) - 1):
            if padded[i : i + 2] != [" ", " "]:
                counts[padded[i] + padded[i + 1]] += 1

    def name(gram):
        found, g = "", gram
        while g:
            found, g = chr(g & ((1 << language.BITS) - 1)) + found, g >> language.BITS
        return found

    got = {name(r["gram"]): r["rank"] for r in language.profiles(d).collect()}
    assert set(got) == set(counts)
    by_rank = sorted(got, key=got.get)
    assert [counts[g] for g in by_rank] == sorted(counts.values(), reverse=True)


def test_toxicity_of_held_out_documents(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    found = toxicity.op1_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in found)
    assert found and right >= 0.9 * len(found)


def test_nearest_examples_are_exact(spark, sf):
    import numpy as np

    sf = sf.replace("sf0.001", "sf0.01")
    d = table(spark, sf, "documents").select("doc_id", "text")
    index = toxicity.learn(d, table(spark, sf, "labels").select("doc_id", "toxic"))
    dense = np.zeros((len(index.ids), len(index.vocabulary)))
    for t in range(len(index.vocabulary)):
        at = slice(index.begin[t, 0], index.begin[t, -1])
        dense[index.example[at], t] = index.value[at]
    texts = [r["text"] for r in d.limit(120).collect()]
    doc, term, weight = index.vectors(texts)
    for i in range(len(texts)):
        own = doc == i
        if not own.any():
            continue
        cosine = dense[:, term[own]] @ weight[own]
        who, got = index.nearest(term[own], weight[own])
        want = np.lexsort((np.arange(len(cosine)), -np.round(cosine, 9)))
        want = [k for k in want[: toxicity.NEIGHBOURS].tolist() if cosine[k] > 0]
        assert np.allclose(got, cosine[want]) and who.tolist() == want


def test_toxicity_of_odd_texts_and_no_labels(spark):
    d = docs(spark, [(1, None), (2, ""), (3, "a b c")])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    index = toxicity.learn(d, labels)
    assert [(r["score"], r["predicted"], r["evidence"]) for r in toxicity.score(d, index).collect()] == [(0.0, 0, [])] * 3
    assert toxicity.score(d.limit(0), index).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.score(d, toxicity.learn(d, labels)).count() == 3
