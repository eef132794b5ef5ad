"""Endless epochs that are stopped and resumed; folds over steps that come late and in any order."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.streaming import epochs, metrics, ordered
from tests.oracle import connection, same


@pytest.mark.parametrize("n, size, run", [(50, 8, 8), (53, 10, 8), (7, 7, 3), (100, 1, 8), (97, 32, 5)])
def test_every_epoch_takes_full_batches_without_repeats(n, size, run):
    order, seen = epochs.Order(n, size, 3, run), []
    for epoch in range(40):
        steps = [[i for a, b in order.rows(epoch, s) for i in range(a, b)] for s in range(order.steps)]
        flat = [i for s in steps for i in s]
        assert all(len(s) == size for s in steps) and len(set(flat)) == len(flat) and 0 <= min(flat) and max(flat) < n
        seen.append(tuple(flat))
    assert len(set(seen)) > min(5, n // 2) and set(i for f in seen for i in f) == set(range(n))
    with pytest.raises(ValueError, match="fill"):
        epochs.Order(3, 4, 0)


def test_strides_are_found_at_once():
    began = time.time()
    epochs.Order(10**12, 4096, 0).rows(5, 10**6)
    assert time.time() - began < 0.5


def run(spark, folder, rows, upto, **options):
    """Run the named stream until a whole step is there; what it wrote so far."""
    stream = epochs.endless(spark, rows, "id", 8, folder=f"{folder}/table", name="t", steps_a_batch=5, **options)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
    try:
        for _ in range(200):
            time.sleep(0.3)
            if query.exception():
                raise query.exception()
            got = spark.read.schema(stream.schema).parquet(f"{folder}/out") if query.lastProgress else None
            if got is not None and got.where(F.col("step") >= upto).take(1):
                break
    finally:
        query.stop()
    return stream, spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()


def test_a_stream_stopped_in_epoch_two_goes_on_at_its_step(spark, tmp_path):
    """No step is left out or repeated, and every step has the rows that its order says."""
    folder = f"file://{tmp_path}"
    rows = spark.range(50).select("id", (F.col("id") * 2).alias("twice"), F.lit(1).alias("step"))
    _, first = run(spark, folder, rows, 15)
    stream, both = run(spark, folder, spark.range(1).select("id"), 30)  # the table is there already
    assert stream.columns == ["step", "epoch", "batch", "slot", "id", "twice"]
    steps = sorted({r["step"] for r in both})
    assert steps == list(range(len(steps))) and max(r["step"] for r in first) < max(steps) and {r["epoch"] for r in first} >= {0, 1, 2}
    assert len(both) == 8 * len(steps) == len({(r["step"], r["slot"]) for r in both}) and all(r["twice"] == 2 * r["id"] for r in both)
    table = [r["id"] for r in spark.read.parquet(f"{folder}/table/rows").orderBy("at").collect()]
    order = epochs.Order(50, 8, 0)
    by = {(r["epoch"], r["batch"], r["slot"]): r["id"] for r in both}
    for e in range(3):
        for s in range(6):
            if (e, s, 0) in by:
                want = [table[i] for a, b in order.rows(e, s) for i in range(a, b)]
                assert [by[e, s, k] for k in range(8)] == want


def test_a_step_opens_its_own_files_only(spark, tmp_path):
    """A step is still read when the files of all other rows are gone."""
    import json

    folder = epochs.table(spark.range(4000), "id", folder=f"file://{tmp_path}/t")
    files = spark.read.parquet(f"{folder}/rows").groupBy(F.input_file_name().alias("f")).agg(F.min("at").alias("a"), F.count(F.lit(1)).alias("n")).orderBy("a").collect()
    plan = {"files": [(r["f"], r["n"]) for r in files] + [("file:///nowhere", 4000)], "size": 16, "seed": 0, "run": 16}
    schema = spark.createDataFrame([], "step long, epoch long, batch long, slot int, id long").schema
    reader = epochs._Reader(schema, {"plan": json.dumps(plan), "steps": "4", "tasks": "3", "progress": f"file://{tmp_path}/p"})
    order = epochs.Order(8000, 16, 0, 16)
    step = next(s for s in range(order.steps) if all(b <= 4000 for _, b in order.rows(0, s)))
    (batch,) = list(reader.read(epochs.InputPartition((step, step + 1))))
    assert batch.num_rows == 16 and batch.column("batch").to_pylist() == [step] * 16
    assert reader.latestOffset() == {"epoch": 0, "step": 4}
    assert [p.value for p in reader.partitions({"epoch": 0, "step": 4}, {"epoch": 0, "step": 10})] == [(4, 6), (6, 8), (8, 10)]
    again = epochs._Reader(schema, {"plan": json.dumps(plan), "steps": "4", "tasks": "3", "progress": f"file://{tmp_path}/p"})
    assert again.latestOffset() == {"epoch": 0, "step": 14}


# ---- steps in any order ----


def scattered(spark, sf, folder, seed):
    """The events dealt to 20 files, in no order of their steps; a folder that the queries take for their tables."""
    (folder / "in").mkdir(parents=True)
    rows = spark.read.parquet(f"{sf}/events.parquet").toPandas().sample(frac=1.0, random_state=seed)
    rows["ts"] = rows["ts"].astype("datetime64[us]")
    for i, part in enumerate(np.array_split(np.arange(len(rows)), 20)):
        rows.iloc[part].to_parquet(folder / f"in/{i:02d}.parquet", index=False)
    return spark.read.parquet(f"{sf}/events.parquet").schema


@pytest.mark.parametrize("seed", [1, 2])
def test_files_in_any_order_give_the_rows_of_the_sql(spark, sf, tmp_path, seed, monkeypatch):
    schema = scattered(spark, sf, tmp_path, seed)
    monkeypatch.setattr(ordered, "STRETCH", 64)  # only here: workers keep their own, so results don't depend on it
    monkeypatch.setattr(metrics, "events", lambda s, d: s.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in"))
    for name in ("stream_ema", "stream_best"):
        assert same(metrics.QUERIES[name](spark, sf), metrics.ORACLES[name], connection(sf)) > 0


def feed(spark, folder, batches):
    """A stream with a micro-batch for each list of (key, step, value)."""
    folder.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k long, s long, v double").coalesce(1).write.parquet(str(folder / f"w{i}"))
        next((folder / f"w{i}").glob("part*")).rename(folder / f"{i:02d}.parquet")
        time.sleep(0.02)
    return spark.readStream.schema("k long, s long, v double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*.parquet")


def test_rows_of_closed_stretches_are_counted(spark, tmp_path):
    n = ordered.STRETCH
    batches = [[(1, 0, 5.0), (1, n, 4.0), (1, 2 * n, 3.0)], [(1, 1, 1.0), (1, 2 * n - 1, 2.0), (1, None, 9.0), (1, 7, None)]]
    rows = metrics.finished(ordered.running_average(feed(spark, tmp_path / "in", batches), "k", "s", "v", hold=2)).orderBy("version").collect()
    fold = lambda xs: __import__("functools").reduce(lambda a, x: a * 0.9 + x * 0.1, xs, 0.0)
    assert [(r["n"], r["late"]) for r in rows] == [(3, 0), (4, 1)]
    assert math.isclose(rows[0]["ema"], fold([5, 4, 3])) and math.isclose(rows[1]["ema"], fold([5, 4, 2, 3]))


def test_a_key_reads_and_writes_its_rows_own_parts_only():
    """Rows in any order fold to what they do in their own; parts are bounded, but for rows of one step; a row at the end meets one part."""

    class Rows(dict):
        def getValue(self, k):  # noqa: N802
            reads.append(k)
            return (self[k][0],)

        def updateValue(self, k, v):  # noqa: N802
            self[k] = v

    fold, reads = ordered._Average(0.999, "s", "v", "k", None, None), []
    fold.rows = Rows()
    r = np.random.default_rng(0)
    steps, values = np.concatenate([r.permutation(60_000), np.full(9000, 77)]), r.normal(size=69_000)
    shuffled, parts, told = r.permutation(len(steps)), np.empty(0, ordered._PART), b""
    for own in np.array_split(shuffled, 23):
        parts, told = fold.take(parts, told, steps[own], values[own])
    assert sorted(len(x[0]) // ordered._ROW.itemsize for x in fold.rows.values())[-2] <= ordered.PART_ROWS and len(parts) > 7 and parts["n"].sum() == 69_000
    assert {(int(p["start"]),) for p in parts} == set(fold.rows)
    want = 0.0
    for v in values[np.lexsort((values, steps))]:
        want = want * 0.999 + v * 0.001
    assert math.isclose(fold.told((1,), parts, b"", told, 1, 0)["ema"][0], want, rel_tol=1e-9)
    reads.clear()
    parts, told = fold.take(parts, told, np.array([60_000, 60_001]), np.array([1.0, 2.0]))
    assert len(reads) == 1 and parts["n"].sum() == 69_002


def test_what_a_late_row_undoes(spark, tmp_path):
    batches = [[(1, 10, 5.0), (1, 20, 3.0), (2, 5, 1.0)], [(1, 5, 4.0), (1, 15, 3.5)], [(1, 20, 3.0)]]
    told = metrics.finished(ordered.best_so_far(feed(spark, tmp_path / "in", batches), "k", "s", "v", changes=True))
    assert sorted(tuple(r) for r in told.select("k", "s", "v", "best", "version").collect()) == [(1, 5, 4.0, True, 2), (1, 10, 5.0, False, 2), (1, 10, 5.0, True, 1), (1, 15, 3.5, True, 2), (1, 20, 3.0, True, 1), (2, 5, 1.0, True, 1)]
    assert sorted(tuple(r) for r in ordered.settled(told, "k", "s", "v").collect()) == [(1, 5, 4.0), (1, 15, 3.5), (1, 20, 3.0), (2, 5, 1.0)]


def test_a_training_stream_over_shards(spark, tmp_path):
    """Steps of a run's shards come as pixels, every sample once an epoch; the same collection as a table."""
    from tessera.config import RunConfig
    from tessera.sources import images, png
    from tests.test_shards import samples, tar

    made = dict(list(samples().items())[:20])
    for k in range(2):
        tar(tmp_path / f"s{k}.tar", [(f"{n}.{e}", d if e == "png" else b"{}") for n, d in list(made.items())[10 * k : 10 * k + 10] for e in ("json", "png")])
    config = RunConfig(use_shards=True, shard_dir=str(tmp_path), batch_size=5)
    assert config.steps(images.n_samples(spark, images.shard_paths(str(tmp_path)))) == 4
    table = {r["path"].rsplit("/", 1)[1]: bytes(r["pixels"]) for r in images.collection(spark, config).collect()}
    assert table == {n: png.decode(d).tobytes() for n, d in made.items()}
    stream = images.training_stream(spark, config, steps_a_batch=6)
    query = stream.writeStream.format("memory").queryName("training").start()
    try:
        for _ in range(200):
            time.sleep(0.3)
            if query.exception() or spark.table("training").where("epoch = 1 AND batch = 3").count() == 5:
                break
    finally:
        query.stop()
    for epoch in range(2):
        rows = spark.table("training").where(f"epoch = {epoch}").collect()
        assert len(rows) == 20 and {r["sample_key"]: bytes(r["pixels"]) for r in rows} == table and {(r["batch"], r["slot"]) for r in rows} == {(b, s) for b in range(4) for s in range(5)}
