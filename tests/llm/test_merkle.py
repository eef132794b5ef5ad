"""Merkle manifest: against a tree built in plain Python, and its edges."""

import hashlib
import zlib

import pytest

from tessera.llm import merkle
from tessera.llm.common import table


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes):
    """The root of a list of digests, and each one's path: (siblings before, siblings after) by level."""
    paths, at, owners = [[] for _ in nodes], list(nodes), [[i] for i in range(len(nodes))]
    while len(at) > 1:
        runs = [range(i, min(i + 3, len(at))) for i in range(0, len(at), 3)]
        for run in runs:
            for k in run:
                for o in owners[k]:
                    paths[o].append(([at[j] for j in run if j < k], [at[j] for j in run if j > k]))
        owners = [[o for k in run for o in owners[k]] for run in runs]
        at = [h(*(at[k] for k in run)) for run in runs]
    return at[0], paths


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, lang, source, n_chars)."""
    digest = lambda r, text: h(*(field(x) for x in (r[0], r[3], r[2], r[4], text)))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, digest(r, r[1])))
        trees.append((mine, *tree([digest(r, r[1]) for r in mine])))
    root, over = tree([t[1] for t in trees])
    out = []
    for (mine, subroot, paths), above in zip(trees, over, strict=True):
        for r, path in zip(mine, paths, strict=True):
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = digest(r, text)
            for before, after in path + above:
                folded = h(*before, folded, *after)
            out.append((r[0], digest(r, r[1]), subroot, root, h(*(x for b, a in path + above for x in b + a)), folded, folded == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(n_hot=90):
    rows = [(1, None, "en", None, 3), (None, "a\nb", None, None, None), (2, "", "é", "", 0), (2**60 + 1, "x\n" * 20000, "en", "ü", 9), (5, "one\ntwo", "fr", "z", 7), (5, "one\ntwo", "fr", "z", 7), (None, None, None, "z", None), (None, None, None, "z", None)]
    return rows + [(i, f"text {i}\n{i}", "en", "hot", i) for i in range(10, 10 + n_hot)] + [(3, "\n", "en", "Z", 1)]


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_is_that_of_a_plain_tree(spark, monkeypatch, levels):
    """Null sources, ids and texts, repeated rows, lone leaves, large ids, further columns; the same with more tables between levels."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    d = spark.createDataFrame([(*r, 1, 2, "x") for r in odd()], SCHEMA + ", i int, Leaf int, `a.b` string").repartition(5)
    got = merkle.manifest(d)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(odd())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_small_trees(spark, n):
    rows = [(i, f"a\n{i}", "en", "s", i) for i in range(n)]
    assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == brute(rows)


def test_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_untampered_rows_verify(spark):
    d = spark.createDataFrame(odd(), SCHEMA)
    assert all(r["verified"] for r in merkle.manifest(d, change=lambda text: text).collect())


def test_all_documents(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(map(tuple, merkle.op12_merkle_manifest(spark, sf).collect()), key=repr) == brute(rows)
