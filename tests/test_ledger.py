"""Writing that commits, patches of any width, buffers that mix, counts of what is skipped."""

import json
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.operators import ingest, losses
from tessera.sources import images, ledger, png
from tests.test_shards import samples


def rows(spark, epochs):
    return spark.createDataFrame([(e, float(abs(e - 4)) + 1, f"r{e}") for e in epochs], "epoch long, loss double, name string").repartition(3)


def files(path):
    return sorted(p.name for p in Path(path).glob("data/*.parquet"))


def test_a_batch_is_there_once_and_whole(spark, tmp_path):
    """A repeated batch adds nothing, and history and best change together."""
    path = f"file://{tmp_path}/l"
    with pytest.raises(ValueError, match="nothing"):
        ledger.history(spark, path)
    ledger.append(rows(spark, range(3)), path, "first", "loss")
    assert ledger.history(spark, path).count() == 3 and [r["epoch"] for r in ledger.best(spark, path).collect()] == [2]
    ledger.append(rows(spark, range(3, 7)), path, "second", "loss")
    before = files(tmp_path / "l")
    ledger.append(rows(spark, range(3, 7)), path, "second", "loss")
    assert files(tmp_path / "l") == before
    assert sorted(r["epoch"] for r in ledger.history(spark, path).collect()) == list(range(7)) and [tuple(r) for r in ledger.best(spark, path).collect()] == [(4, 1.0, "r4")]
    ledger.append(rows(spark, []), path, "third", "loss")
    assert ledger.history(spark, path).count() == 7 and ledger.best(spark, path).count() == 1
    with pytest.raises(Exception, match="only added"):
        rows(spark, [1]).write.format("ledger").mode("overwrite").options(**ledger.options(path)).save()


def test_tasks_that_fail_leave_nothing(spark, tmp_path):
    """Some tasks wrote their files when another one failed; nothing of the batch is there, and the next attempt adds each row once."""
    path = f"file://{tmp_path}/l"
    ledger.append(rows(spark, [0]), path, "a", "loss")

    def fail(frames):
        for f in frames:
            if (f["epoch"] == 5).any():
                import time

                time.sleep(3)
                raise RuntimeError("lost")
            yield f

    broken = rows(spark, range(1, 9)).mapInPandas(fail, "epoch long, loss double, name string")
    with pytest.raises(Exception, match="lost"):
        ledger.append(broken, path, "b", "loss")
    assert ledger.history(spark, path).count() == 1 and [r["epoch"] for r in ledger.best(spark, path).collect()] == [0]
    ledger.append(rows(spark, range(1, 9)), path, "b", "loss")
    assert sorted(r["epoch"] for r in ledger.history(spark, path).collect()) == list(range(9)) and ledger.best(spark, path).first()["epoch"] == 4


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    """A batch that is given to the writer again, as after a crash before its end was noted, adds nothing."""
    ledger.register(spark)
    path, where = f"file://{tmp_path}/l", f"file://{tmp_path}/state"
    for k in range(2):
        rows(spark, range(4 * k, 4 * k + 4)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("epoch long, loss double, name string").parquet(str(tmp_path / "in"))
        stream.writeStream.format("ledger").options(**ledger.options(path, "loss", stream="run")).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["epoch"] for r in ledger.history(spark, path).collect()) == list(range(8)) and ledger.best(spark, path).first()["epoch"] == 4
    names = [r["batch"] for r in ledger._records(path)]
    assert names == ["run-0", "run-1"]
    (tmp_path / "state/commits/1").unlink()  # Spark forgets that the last batch ended
    (tmp_path / "state/commits/.1.crc").unlink(missing_ok=True)
    stream.writeStream.format("ledger").options(**ledger.options(path, "loss", stream="run")).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["epoch"] for r in ledger.history(spark, path).collect()) == list(range(8))
    assert {json.loads(p.read_text())["batch"] for p in (tmp_path / "l/commits").glob("*.json")} == {"run-0", "run-1"}


def test_products_of_wide_patches(spark):
    r = np.random.default_rng(5)
    s, t = r.normal(size=(2, 40, 256)), r.normal(size=(2, 40, 256))
    s[0, 3] = 0
    d = spark.createDataFrame([(b, s[b, i : i + 4].tolist(), t[b, i : i + 4].tolist()) for b in range(2) for i in range(0, 40, 4)] + [(3, None, None)], "b long, s array<array<double>>, t array<array<double>>").repartition(4)
    got = {x["b"]: x for x in losses.gram_batch_loss(d, "b", "s", "t").collect()}
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    assert got.keys() == {0, 1}
    for b in range(2):
        x, y = unit(s[b]), unit(t[b])
        assert got[b]["n"] == 40 and np.isclose(got[b]["loss"], ((x @ x.T - y @ y.T) ** 2).mean(), rtol=1e-9)


def test_a_buffer_mixes_and_loses_nothing(spark):
    d = spark.createDataFrame([(p, i) for p in ("a", "b", None) for i in range(500)] + [("c", None)], "p string, i long").repartition(7)
    epochs = [sorted((r["p"] or "", r["place"], -1 if r["i"] is None else r["i"]) for r in ingest.shuffled(d, "p", ["i"], 1, e, buffer=50).collect()) for e in (0, 0, 1)]
    assert epochs[0] == epochs[1] != epochs[2]
    for found in epochs:
        for p in ("a", "b", ""):
            own = [i for q, _, i in found if q == p]
            assert sorted(own) == list(range(500)) and [k for q, k, _ in found if q == p] == list(range(500))
            assert own != sorted(own) and all(k - i <= 50 and i - k <= 50 for k, i in enumerate(own))
    assert ingest.shuffled(d.limit(0), "p", ["i"], 1, 0).count() == 0


def test_unresolved_ids_are_counted_and_priorities_kept(spark):
    ids = spark.createDataFrame([(x,) for x in ("a", "b", "c.png", "d", "root/e", "", "a")], "image string")
    found = ["root/a.png", "a", "root/b", "b.jpg", "root/c.png", "d.gif", "root/e.JPG", "root/root/e", "root/.png", "a.jpg", None]
    report = Observation("ids")
    got = {r["image"]: r["path"] for r in ingest.resolve(ids, spark.createDataFrame([(x,) for x in found], "path string"), report=report).collect()}
    candidates = lambda x: next((r + x + e for r in ingest.ROOTS for e in ingest.CANDIDATES if r + x + e in found), None)
    want = {x: candidates(x) for x in ("a", "b", "c.png", "d", "root/e", "")}
    assert got == {k: v for k, v in want.items() if v} and report.get == {"n_ids": 6, "n_unresolved": sum(v is None for v in want.values())}


def test_bad_images_of_a_stream_are_counted(spark, tmp_path):
    """Images that come as files are decoded and counted as they come, without a second pass."""
    good = list(samples().values())[:6]
    (tmp_path / "in").mkdir()
    for i, data in enumerate([*good, b"no", b"not either"]):
        (tmp_path / f"in/{i}.png").write_bytes(data)
    stream = spark.readStream.format("binaryFile").schema(spark.read.format("binaryFile").load(str(tmp_path / "in")).schema).load(str(tmp_path / "in"))
    seen = images.counted(images.png_images(stream.select("path", "content")), "images").where("height > 0")
    query = seen.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    told = [p["observedMetrics"]["images"] for p in query.recentProgress if "images" in p["observedMetrics"]]
    assert sum(t["n_images"] for t in told) == 8 and sum(t["n_bad"] for t in told) == 2
    assert sorted(pd.read_parquet(tmp_path / "out")["pixels"]) == sorted(png.decode(x).tobytes() for x in good)


def test_functions_report_unreadable_rows(spark):
    d = spark.createDataFrame([(1, 2), (2, -1)], "i int, height int")
    report = Observation()
    assert images.counted(d, report).where("height > 0").count() == 1 and report.get == {"n_images": 2, "n_bad": 1}
    assert d.select(F.lit(1)).count() == 2


def test_numbers_keep_columns_of_any_name(spark):
    names = ("at", "part", "n", "start", "all", "at_", "part_", "n_rows", "draw", "of_label")
    d = spark.createDataFrame([(i, *[i] * len(names), f"l{i % 3}") for i in range(10)], "i long, " + ", ".join(f"`{c}` long" for c in names) + ", label string")
    for out in (ingest.batches(d, ["i"], 5), ingest.encoded(d, "label"), ingest.shuffled(d, "label", ["i"], 0, 0)):
        rows = out.collect()
        assert len(rows) == 10 and all(r[c] == r["i"] for r in rows for c in names)
