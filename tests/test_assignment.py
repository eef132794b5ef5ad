"""Balanced assignment over many tasks against one matrix in numpy."""

import numpy as np
import pytest

from tessera.operators import assignment


def whole(m, temperature, rounds):
    q = np.exp((m - m.max(1, keepdims=True)) / temperature)
    q /= q.sum()
    for _ in range(rounds):
        q /= q.sum(0, keepdims=True) * q.shape[1]
        q /= q.sum(1, keepdims=True) * q.shape[0]
    return q * len(q)


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_a_batch_in_many_blocks(spark, monkeypatch, broadcast):
    """One batch over many blocks, one in a single row, repeated keys, carried columns; with and without room to send the factors everywhere."""
    monkeypatch.setattr(assignment, "BROADCAST_BYTES", broadcast)
    r = np.random.default_rng(2)
    m = {0: r.normal(size=(400, 32)), 1: r.normal(size=(1, 7)), 2: np.full((5, 3), 900.0)}
    rows = [(b, i // 2, f"c{i}", x.tolist()) for b, a in m.items() for i, x in enumerate(a)] + [(0, 9, "none", None)]
    d = spark.createDataFrame(rows, "b int, k int, c string, v array<double>").repartition(5)
    packed, parts = assignment.blocks(d.where("v IS NOT NULL"), "b", ["k", "c"], "v", [], block_bytes=32768)
    assert parts == 8 and packed.where("b = 0").count() == 8 and packed.agg({"n": "sum"}).first()[0] == 406
    got = assignment.balanced(d, "b", ["k"], "v", 0.3, 3, ["c"], block_bytes=25600).collect()
    assert len(got) == 406
    for b, a in m.items():
        want = whole(a, 0.3, 3)
        for x in (x for x in got if x["b"] == b):
            i = int(x["c"][1:])
            assert x["k"] == i // 2 and np.allclose(x["q"], want[i], atol=1e-12)


def test_no_rows_and_wide_batches(spark):
    d = spark.createDataFrame([], "b int, k int, v array<float>")
    assert assignment.balanced(d, "b", ["k"], "v", 0.1).count() == 0
    with pytest.raises(ValueError, match="round"):
        assignment.balanced(d, "b", ["k"], "v", 0.1, 0)
    r = np.random.default_rng(3)
    m = r.normal(size=(300, 2048)).astype(np.float32)
    d = spark.createDataFrame([(7, i, x.tolist()) for i, x in enumerate(m)], "b int, k int, v array<float>").repartition(4)
    got = {x["k"]: x["q"] for x in assignment.balanced(d, "b", ["k"], "v", 0.07, 3, block_bytes=1 << 20).collect()}
    want = whole(m.astype(float), 0.07, 3)
    assert all(np.allclose(got[i], want[i], rtol=1e-8, atol=1e-15) for i in range(300))
