"""Filter audit: against plain Python over every order, and its edges."""

import re
from itertools import permutations

import pytest

from tessera.llm import filter_audit

LONG = " ".join(f"w{i}" for i in range(150))
DOCS = [
    (1, LONG, "en"),
    (2, LONG, "fr"),
    (2, LONG, "fr"),
    (None, LONG, "en"),
    (3, None, None),
    (4, "", "en"),
    (5, "A B C " * 60, "en"),
    (6, "a$ b # " + LONG, "xx"),
    (7, "short TEXT", "en"),
    (None, "short TEXT", ""),
    (7, "short TEXT", "en"),
    (8, "word " * 40000, "en"),
    (9, "É\x0bx y " * 60, "de"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (5, 1, 1), (7, 1, None), (None, 1, 1), (99, 1, 1), (8, None, 1)]


def brute(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and t in first and first[t] < i,
        }
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, total = [r for r in rows if r[0] == part], {}
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                failing, alone = sum(r[1][f] for r in mine), sum(r[1][f] and sum(r[1].values()) == 1 for r in mine)
                left = [r for r in left if not r[1][f]]
                total[f] = total.get(f, 0) + len(gone)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for (p, _, _), v in out.items():
            if p == part:
                v[-1] = total[v[-1]]
    return {(*k, *v) for k, v in out.items()}


def frames(spark):
    docs = spark.createDataFrame([(*d, i, "x") for i, d in enumerate(DOCS)], "doc_id long, text string, lang string, part int, `first.n` string")
    return docs.repartition(3), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("few", [False, True])
def test_counts_of_every_order(spark, monkeypatch, few):
    """Nulls, copies, repeated rows and labels, clashing names; texts that meet their copies by part, and arrays handed on early, give the same."""
    if few:
        monkeypatch.setattr(filter_audit, "BROADCAST_COPIES", 0)
        monkeypatch.setattr(filter_audit, "PARTS", 1)
    got = filter_audit.audit(*frames(spark)).collect()
    assert len(got) == 600 * 5 and {tuple(r) for r in got} == brute(DOCS, LABELS)


def test_no_rows(spark):
    docs, labels = frames(spark)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    unlabelled = filter_audit.audit(docs, labels.limit(0)).collect()
    assert {tuple(r) for r in unlabelled} == brute(DOCS, [])


def test_the_table_of_first_failures():
    t = filter_audit.first_failures()
    assert t.shape == (32, 120) and (t[0] == 5).all() and (t[31] == 0).all()
    assert all(t[1 << "ABCDE".index(f), o] == order.index(f) for o, order in enumerate(filter_audit.ORDERS) for f in "ABCDE")
