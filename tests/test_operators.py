"""Properties and edge cases of the library's operators, and its sources and sinks."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.functions.columns import l2_normalize, log_softmax
from tessera.operators import history, ingest, losses, masks, pixels, schedules, similarity
from tessera.plans import views
from tessera.sources import images, sinks


# ---- entry points ----


def test_entry_points(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["vec_id", "label", "pred"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


# ---- neighbours ----


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_neighbours_agree_with_numpy(spark):
    r = np.random.default_rng(0)
    m = r.normal(size=(90, 5))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(m)]
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 9)
    np.fill_diagonal(sims, -np.inf)
    got = {(x["q"], x["rank"]): x["r"] for x in similarity.nearest(vectors(spark, rows), k=4, size=16).collect()}
    for i in range(90):
        want = np.lexsort((np.arange(90), -sims[i]))[:4]
        assert [got[i, k + 1] for k in range(4)] == want.tolist()


def test_a_tile_holds_little_and_makes_few_products_twice(spark):
    """Where most vectors are nearly alike and many are equal, a tile gives the neighbours of the plain definition, from arrays of a few MB; its references may be more than its queries."""
    import tracemalloc

    r = np.random.default_rng(2)
    m = np.repeat(r.normal(size=8) + 1e-4 * r.normal(size=(2000, 8)), 3, 0).astype(np.float32)
    u = m / np.sqrt((m.astype(float) ** 2).sum(1, keepdims=True))
    side = lambda role, keys: pa.RecordBatch.from_arrays([pa.array([0] * len(keys), pa.int32()), pa.array([role] * len(keys), pa.int32()), pa.array(keys), pa.array(list(m[keys]), pa.list_(pa.float32()))], ["tile", "role", "key", "v"])
    keys = np.arange(len(m))
    batches = [side(0, keys), *(side(1, keys[a : a + 3000]) for a in range(0, len(m), 3000))]
    tracemalloc.start()
    (out,) = similarity._best(5)(iter(batches))
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    got = {}
    for q, x, s in sorted(zip(*(c.to_pylist() for c in out.columns), strict=True), key=lambda p: (p[0], -p[2], p[1])):
        got.setdefault(q, []).append((x, round(s * 1e9)))
    for i in range(0, len(m), 97):
        sims = np.rint(u[i].astype(float) / np.sqrt((u[i].astype(float) ** 2).sum()) @ (u.astype(float) / np.sqrt((u.astype(float) ** 2).sum(1, keepdims=True))).T * 1e9).astype(int)
        sims[i] = -(10**10)
        want = np.lexsort((keys, -sims))[:5]
        assert len(got[i]) == 5 and all(abs(s - w) <= 100 for (_, s), w in zip(got[i], sims[want], strict=True))
    made = similarity.tiles(vectors(spark, [(i, [1.0, float(i)], 0) for i in range(64)]), vectors(spark, [(i, [1.0, float(i)], 0) for i in range(64)]), "vec_id", "embedding", 4)
    assert made.select("tile").distinct().count() == 16 * 2 and made.where("role = 1").count() == 64 * 16


def test_neighbours_of_few_odd_and_no_rows(spark):
    rows = [(1, [1.0, 0.0], 5), (2, [0.0, 0.0], 5), (3, [1.0, 0.0], None), (4, None, 7)]
    got = similarity.nearest(vectors(spark, rows), k=10).collect()
    assert {(x["q"], x["r"]) for x in got} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}
    assert {(x["vec_id"], x["pred"]) for x in similarity.predict(vectors(spark, rows), k=10).collect()} == {(1, 5), (2, 5)}
    assert similarity.nearest(vectors(spark, rows).limit(0)).count() == 0


def test_majority_ties_take_the_smallest_label(spark):
    rows = [(i, [math.cos(i / 9), math.sin(i / 9)], label) for i, label in enumerate([9, 2, 1, 2, 1])]
    pred = {x["vec_id"]: x["pred"] for x in similarity.predict(vectors(spark, rows), k=4).collect()}
    assert pred[0] == 1


# ---- losses ----


def test_assignments_sum_to_one(spark, sf):
    two = masks.samples(spark, sf).select("vec_id", "batch", F.lit(0).alias("view"), "x")
    out = losses.sinkhorn(two, "batch", ["vec_id", "view"], "x").select("vec_id", F.aggregate("q", F.lit(0.0), lambda a, v: a + v).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in out)


def test_gram_of_equal_sides_is_zero_and_entropies_are_stable(spark):
    d = spark.createDataFrame([([[1.0, 2.0], [0.0, 0.0]], [1000.0, -1000.0, 0.0])], "s array<array<double>>, x array<double>")
    r = d.select(losses.gram_loss(F.col("s"), F.col("s")).alias("g"), log_softmax(F.col("x")).alias("p"), l2_normalize(F.array(F.lit(0.0))).alias("z")).first()
    assert r["g"] == 0 and r["p"][0] == 0 and all(math.isfinite(v) for v in r["p"]) and r["z"] == [0.0]


# ---- masks ----


@pytest.mark.parametrize("n", [0, 1, 7, 60, 98])
def test_block_masks_hide_exactly_what_they_should(n):
    for seed in range(20):
        m = masks.block_mask(14, 14, n, 98, np.random.default_rng(seed))
        assert m.sum() == n


def test_half_of_a_batch_is_masked(spark, sf):
    rows = masks.slots(masks.samples(spark, sf).select("vec_id", "batch"), ["vec_id"], "batch").groupBy("batch", "view").agg(F.sum((F.col("n_target") > 0).cast("int")).alias("n")).collect()
    assert rows and {r["n"] for r in rows} == {16}


# ---- pixels ----


def test_rotations_and_flips_undo_each_other(spark):
    px = [float(i) for i in range(192)]
    d = spark.createDataFrame([(px,)], "px array<double>")
    for _ in range(4):
        d = d.withColumn("px", pixels.rotate(F.col("px"), F.lit(1)))
    d = d.withColumn("twice", pixels.flip(pixels.flip(F.col("px"), F.lit(True), F.lit(True)), F.lit(True), F.lit(True)))
    r = d.first()
    assert r["px"] == px and r["twice"] == px


def test_quarter_turn_is_counter_clockwise(spark):
    px = [1.0, 2.0, 3.0, 4.0] * 3
    d = spark.createDataFrame([(px,)], "px array<double>")
    assert d.select(pixels.rotate(F.col("px"), F.lit(1), 2).alias("p")).first()["p"][:4] == [2.0, 4.0, 1.0, 3.0]


def test_water_effects_stay_in_range(spark, sf):
    d = pixels._unit(spark, sf).limit(50)
    for step in (pixels._vignetted, pixels._turbid, pixels._attenuated, pixels._snowed):
        r = d.select(F.min(F.array_min(step(F.col("px")))).alias("a"), F.max(F.array_max(step(F.col("px")))).alias("b")).first()
        assert r["a"] >= 0 and r["b"] <= 1


def test_blur_keeps_flat_images_and_wide_kernels_work(spark):
    d = spark.createDataFrame([([0.5] * 192,)], "px array<double>")
    for radius in (1, 3):
        assert all(abs(v - 0.5) < 1e-12 for v in d.select(pixels.blur(F.col("px"), F.lit(1.5), radius).alias("p")).first()["p"])


# ---- plans, schedules, history ----


def test_boxes_lie_in_the_image(spark):
    d = spark.range(500).select("id", (F.col("id") % 90 + 1).cast("int").alias("h"), (F.col("id") * 7 % 300 + 1).cast("int").alias("w"))
    box = views.resized_crop_box(F.col("h"), F.col("w"), F.lit(0.05), F.lit(1.0), F.col("id"))
    bad = d.select("h", "w", box.alias("b")).where("b.top < 0 OR b.left < 0 OR b.height < 1 OR b.width < 1 OR b.top + b.height > h OR b.left + b.width > w")
    assert bad.count() == 0
    assert views.chosen(True, True) == "official" and views.chosen(False, True) == "marine" and views.chosen(False, False) == "default"


def test_layer_decay_of_names(spark):
    got = {r["name"]: r["decay"] for r in schedules.lr_decay(spark, "").collect()}
    assert got["cls_token"] == round(0.98**13, 10) and got["backbone.blocks.0.attn.weight"] == round(0.98**12, 10) and got["m.blocks.x.w"] == 1.0


def test_history_is_appended(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1.0, 2.0, 0.0, 0.0, 0.0, 1e-4)], "epoch int, total double, dino double, ibot double, koleo double, gram double, lr double")
    for _ in range(2):
        history.append_history(history.history_rows(rows), str(tmp_path / "h"))
    back = spark.read.option("header", True).csv(str(tmp_path / "h"))
    assert back.count() == 2 and back.first()["lr"] == "1.00000000e-04" and back.first()["total_loss"] == "1.000000"
    assert history.latest(back.withColumn("n", F.monotonically_increasing_id()), ["epoch"], F.col("n")).count() == 1


def test_no_valid_image_and_no_labels(spark):
    d = spark.createDataFrame([(1,), (2,)], "id long")
    assert {r["used"] for r in ingest.substitute(d, "id", F.lit(False)).collect()} == {None}
    assert {r["used"] for r in ingest.substitute(d, "id", F.col("id") == 2).collect()} == {2}
    assert ingest.batches(d, ["id"], 5).count() == 0 and ingest.batches(d.limit(0), ["id"], 5).count() == 0


# ---- sources and sinks ----


def test_labels_are_found_by_name(spark, tmp_path):
    (tmp_path / "l.csv").write_text("extra,partition,image,catami_substrate\n1,test,a,sand\n2,,b,\n")
    assert sorted(tuple(r) for r in images.labels(spark, str(tmp_path / "l.csv")).collect()) == [("a", "test", "sand"), ("b", None, None)]
    assert images.labels(spark, None) is None and images.labels(spark, str(tmp_path / "none.csv")) is None


def test_best_checkpoint_is_kept_apart_and_a_failing_writer_does_not_stop_others(spark, tmp_path):
    rows = spark.createDataFrame([(0, 2.0, True), (1, 1.0, True), (2, 3.0, False)], "epoch int, loss double, is_best boolean")
    sinks.write_checkpoints(rows, str(tmp_path / "c"), {"knn_acc": 0.5})
    assert spark.read.parquet(str(tmp_path / "c/all")).select("knn_acc").distinct().collect() == [(0.5,)]
    assert spark.read.parquet(str(tmp_path / "c/best")).first()["epoch"] == 1 and spark.read.parquet(str(tmp_path / "c/all")).count() == 3
    seen = []

    def broken(batch, number):
        raise RuntimeError("down")

    sinks.to_all([broken, lambda b, n: seen.append((b.count(), n))])(rows, 7)
    assert seen == [(3, 7)]


# ---- streams ----


def write_events(spark, folder, numbers, name):
    rows = [(i, i % 3, float((i * 37) % 101)) for i in numbers]
    spark.createDataFrame(rows, "step long, run long, loss double").coalesce(1).write.mode("overwrite").parquet(str(folder / f"_{name}"))
    next((folder / f"_{name}").glob("part*")).rename(folder / f"{name}.parquet")


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Best so far: the state outlives a stop, nothing is written twice, and a run without new rows adds nothing."""
    from tessera.streaming import metrics

    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        stream = spark.readStream.schema("step long, run long, loss double").parquet(f"{folder}/*.parquet")
        return sorted(tuple(r) for r in metrics.finished(metrics.best_so_far(stream, "run", "step", "loss"), folder=f"file://{tmp_path}/out").collect())

    def want(n):
        best, out = {}, []
        for i in range(n):
            k, v = i % 3, float((i * 37) % 101)
            if v < best.get(k, math.inf):
                best[k] = v
                out.append((k, i, v))
        return sorted(out)

    write_events(spark, folder, range(40), "a")
    assert run() == want(40) == run()
    write_events(spark, folder, range(40, 90), "b")
    assert run() == want(90)


def test_an_endless_stream_deals_every_epoch(spark):
    from tessera.streaming import metrics

    rows = spark.range(50)
    with pytest.raises(ValueError, match="fill"):
        metrics.endless(spark, rows, "id", 51)
    query = metrics.endless(spark, rows, "id", 8, steps_a_batch=12).writeStream.format("memory").queryName("endless").start()
    try:
        import time

        for _ in range(120):
            if spark.table("endless").where("epoch = 2").count():
                break
            time.sleep(0.5)
    finally:
        query.stop()
    epochs = {}
    for r in spark.table("endless").where("epoch < 2").collect():
        epochs.setdefault(r["epoch"], []).append((r["batch"], r["slot"], r["id"]))
    orders = [[i for _, _, i in sorted(x)] for x in epochs.values()]
    assert len(orders) == 2 and all(len(o) == 48 == len(set(o)) for o in orders) and orders[0] != orders[1]


# ---- folds in stretches ----


def test_folds_in_stretches_are_the_whole_fold(spark):
    r = np.random.default_rng(5)
    rows = [(int(k), i, float(v)) for i, (k, v) in enumerate(zip(r.integers(0, 3, 500), r.normal(size=500), strict=True))]
    d = spark.createDataFrame(rows, "k long, i long, v double").repartition(3)
    want, mean = {}, {}
    for k, i, v in rows:
        want[k] = want.get(k, 0.0) * 0.9 + v * 0.1
        s, n = mean.get(k, (0.0, 0))[:2]
        mean[k] = (s + v, n + 1)
    for chunk in (1, 7, 4096):
        got = {x["k"]: x["ema"] for x in schedules.ema(d, "k", "i", "v", chunk=chunk).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
        last = history.running_mean(d, "k", "i", "v", chunk).groupBy("k").agg(F.max_by("running", "i").alias("m")).collect()
        assert all(abs(x["m"] - mean[x["k"]][0] / mean[x["k"]][1]) < 1e-12 for x in last)


def test_neighbours_in_many_tiles_are_the_same(spark):
    r = np.random.default_rng(4)
    m = np.round(r.normal(size=(120, 4)), 1)
    rows = [(i * 7 - 300, v.tolist(), i % 3) for i, v in enumerate(m)]
    want = sorted(tuple(x) for x in similarity.nearest(vectors(spark, rows), k=6).collect())
    assert len(want) == 720 and sorted(tuple(x) for x in similarity.nearest(vectors(spark, rows), k=6, size=7).collect()) == want


def test_all_pairs_have_every_row_on_both_sides(spark, sf):
    keys = {x["vec_id"] for x in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    got = [(x["q"], x["r"]) for x in similarity.knn_pairs(spark, sf).collect()]
    assert len(got) == len(keys) * (len(keys) - 1) and set(got) == {(q, r) for q in keys for r in keys if q != r}


def test_all_pairs_of_odd_rows_are_those_of_their_sql(spark, tmp_path):
    """Vectors of zeros, none and NaN, a key that occurs twice or is missing, halves at the last digit, products under it; in many partitions too."""
    import duckdb

    from tests.oracle import same

    r = np.random.default_rng(6)
    rows = [(i * 3 - 40, v.tolist(), 0) for i, v in enumerate(r.normal(size=(70, 2)))]
    rows += [(500, [0.0, 0.0], 0), (501, None, 0), (502, None, 1), (None, [1.0, 2.0], 0), (None, None, 0), (503, [1.0, 1.0], 0), (503, [1.0, 0.0], 1), (504, [math.nan, 1.0], 0)]
    rows += [(505, [1.0, 0.0], 0), (506, [1.0, 1e-7], 0), (507, [-1e-7, 1.0], 0)]
    vectors(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert same(similarity.knn_pairs(spark, str(tmp_path)), similarity.ORACLES["knn_pairs"], con) == 79 * 78 - 2
    assert same(similarity.pairs(vectors(spark, rows), size=20), similarity.ORACLES["knn_pairs"], con) == 79 * 78 - 2
    assert similarity.pairs(vectors(spark, rows).limit(0)).count() == 0
    with pytest.raises(Exception, match="of one length"):
        similarity.pairs(vectors(spark, [(i, [1.0] * (1 + i % 2 * 2), 0) for i in range(40)])).collect()
    assert [str(x) for x in similarity._rounded(np.array([0.0078125, -0.0078125, -1e-9, 0.25, math.nan]), 6)] == ["0.007813", "-0.007813", "-0.0", "0.25", "nan"]


def test_all_pairs_send_a_vector_once_and_write_a_product_once(spark, tmp_path):
    r = np.random.default_rng(7)
    n = 1300
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(r.normal(size=(n, 16)))], "vec_id long, embedding array<float>, label int")
    made = similarity.blocks(rows, "vec_id", "embedding", 100).collect()
    assert sorted(k for b in made for k in np.frombuffer(b["keys"], np.int64)) == list(range(n))
    assert all(len(b["keys"]) <= 800 and len(b["v"]) == 8 * len(b["keys"]) for b in made) and len({b["block"] for b in made}) == len(made)
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    out = similarity.knn_pairs(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "Broadcast" not in plan
    out.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == n * (n - 1)
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 6.5 * n * (n - 1)
