"""From image files and shards to views: sources, user functions and recipes, on real PNG and JPEG files."""

import io
import struct
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import RunConfig
from tessera.operators import ingest, similarity
from tessera.operators import transforms as t
from tessera.plans import render, views
from tessera.sources import images, sinks


def png(pixels) -> bytes:
    """An RGB image of rows of (r, g, b)."""
    h, w = len(pixels), len(pixels[0])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(int(v) for p in row for v in p) for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def jpeg(spark, path, colour: int, side: int = 24) -> None:
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(side, side, 1)
    for y in range(side):
        for x in range(side):
            image.setRGB(x, y, colour)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))


def named(df):
    return {r["path"].rsplit("/", 1)[1]: r for r in df.collect()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("images")
    (path / "sub").mkdir()
    (path / "a.png").write_bytes(png([[(1, 2, 3), (4, 5, 6)]]))
    (path / "sub/b.PNG").write_bytes(png(np.random.default_rng(0).integers(0, 256, (40, 56, 3))))
    jpeg(spark, path / "sub/c.jpg", 0x6496C8, 32)
    (path / "bad.jpg").write_bytes(b"no image")
    (path / "note.txt").write_text("x")
    return path


def test_images_of_a_folder(spark, folder, tmp_path):
    assert [r["path"].rsplit("/", 1)[1] for r in images.listing(spark, str(folder)).collect()] == ["a.png", "bad.jpg", "b.PNG", "c.jpg"]
    with pytest.raises(ValueError, match="no images"):
        images.listing(spark, str(tmp_path))
    got = named(images.decoded(spark, str(folder)))
    assert set(got) == {"a.png", "b.PNG", "c.jpg"} and (got["a.png"]["height"], got["a.png"]["width"], got["a.png"]["n_channels"]) == (1, 2, 3)
    assert bytes(got["a.png"]["pixels"]) == bytes([1, 2, 3, 4, 5, 6])
    assert np.abs(np.frombuffer(got["c.jpg"]["pixels"], np.uint8).reshape(-1, 3).astype(int) - [100, 150, 200]).max() <= 3
    assert images.decoded(spark, str(folder), "keep").count() == 4
    with pytest.raises(Exception, match="decode"):
        images.decoded(spark, str(folder), "fail").collect()


def test_an_image_that_cannot_be_decoded_is_replaced(spark, folder, tmp_path):
    got = named(images.decoded(spark, str(folder), "substitute"))
    assert set(got) == {"a.png", "b.PNG", "c.jpg", "bad.jpg"}
    assert bytes(got["bad.jpg"]["pixels"]) in {bytes(got[x]["pixels"]) for x in ("a.png", "b.PNG", "c.jpg")}
    (tmp_path / "x.png").write_bytes(b"no")
    assert [r["pixels"] for r in images.decoded(spark, str(tmp_path), "substitute").collect()] == [None]


def shard(path, members) -> None:
    with tarfile.open(path, "w") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def test_samples_of_shards(spark, tmp_path):
    for s in range(2):
        shard(tmp_path / f"s{s}.tar", [(f"d/k{s}.json", b"{}"), (f"d/k{s}.png", b"abc"), (f"m{s}.jpg", b"x"), ("noext", b"y")])
    (tmp_path / "other.txt").write_text("x")
    paths = images.shard_paths(str(tmp_path))
    assert [p.removeprefix("file://") for p in images.shard_paths(f"file://{tmp_path}", "s?.tar")] == paths
    rows = images.shards(spark, paths).collect()
    assert sorted((r["sample_key"], [m["key"] for m in r["members"]]) for r in rows) == [("d/k0", ["json", "png"]), ("d/k1", ["json", "png"]), ("m0", ["jpg"]), ("m1", ["jpg"])]
    assert {bytes(m["content"]) for r in rows for m in r["members"]} == {b"{}", b"abc", b"x"}
    assert images.n_samples(spark, paths) == 4
    orders = {tuple(r["url"] for r in images.shards(spark, paths, seed=k).select("url").collect()) for k in range(8)}
    assert len(orders) > 1 and len({tuple(sorted(o)) for o in orders}) == 1
    with pytest.raises(Exception, match="no shards"):
        images.shards(spark, []).count()
    with pytest.raises(ValueError, match="no shards"):
        images.shard_paths(str(tmp_path), "*.zip")


def test_images_of_shards_are_decoded_and_bad_ones_skipped(spark, tmp_path):
    good = png([[(9, 8, 7)] * 3] * 2)
    shard(tmp_path / "a.tar", [("k.json", b"{}"), ("k.png", good), ("bad.png", b"no"), ("long.x (2).PNG", good), ("none.json", b"{}")])
    samples = images.shards(spark, [str(tmp_path / "a.tar")])
    got = {r["sample_key"]: (r["height"], r["width"], bytes(r["pixels"])) for r in images.unpacked(samples).collect()}
    assert got == {"k": (2, 3, bytes([9, 8, 7] * 6)), "long": (2, 3, bytes([9, 8, 7] * 6))}
    assert images.unpacked(samples, on_corrupt="keep").where("sample_key = 'bad' AND height < 0").count() == 1


def test_fields_end_with_a_dot_and_an_ending(spark):
    rows = [(1, ["jpg"]), (2, ["json", "png"]), (3, ["__key__", "x (20).jpg"]), (4, ["json"]), (5, ["PNG", "jpg"]), (6, ["__url__", "a.JPEG", "b.png"]), (7, ["maskpng"]), (8, ["__rank__.png", "mask.png"]), (9, ["maskpng", "b.Png"]), (10, ["__worker__"])]
    d = spark.createDataFrame(rows, "i int, members array<string>")
    got = {r["i"]: r["k"] for r in d.select("i", ingest.image_key(F.col("members")).alias("k")).collect()}
    assert got == {1: "jpg", 2: "png", 3: "x (20).jpg", 4: None, 5: "jpg", 6: "a.JPEG", 7: None, 8: "__rank__.png", 9: "b.Png", 10: None}


# ---- user functions ----


def test_functions_of_images(spark, folder):
    got = images.decoded(spark, str(folder), "keep")
    one = {r["path"].rsplit("/", 1)[1]: r for r in t.values(t.transformed(got, lambda m: m.mean((0, 1)), ["path"]), ["path"]).collect()}
    assert set(one) == {"a.png", "b.PNG", "c.jpg"} and one["a.png"]["values"] == [2.5, 3.5, 4.5]
    many = t.fanned(got, lambda m: [m[:1], None, m[:, :1]] if m.shape[0] > 1 else [], ["path"]).collect()
    assert sorted(r["view"] for r in many) == [0, 0, 1, 1]
    assert t.transformed(got, lambda m: 1 / 0, ["path"]).count() == 0
    with pytest.raises(Exception, match="division"):
        t.transformed(got, lambda m: 1 / 0, ["path"], on_error="fail").count()


def test_probe_from_images_to_accuracy(spark, tmp_path):
    """Images of two colours, embedded by their mean colour, are told apart by their neighbours."""
    r = np.random.default_rng(1)
    for i in range(24):
        base = (200, 30, 30) if i % 2 else (30, 30, 200)
        (tmp_path / f"{i}.png").write_bytes(png(np.clip(np.array(base) + r.integers(-20, 20, (6, 7, 3)), 0, 255)))
    d = images.decoded(spark, str(tmp_path)).withColumn("id", F.regexp_extract("path", r"(\d+)\.png", 1).cast("long"))
    seen = t.values(render.probed(d, "id", 8), ["id"])
    labels = d.select("id", F.when(F.col("id") != 5, (F.col("id") % 2).cast("int")).alias("label"))
    out = similarity.probe(seen, labels, lambda c: [np.reshape(v, (3, -1)).mean(1) for v in c["values"]], ["values"], "id", k=5).first()
    assert (out["n"], out["accuracy"]) == (23, 1.0)


# ---- recipes ----


@pytest.mark.parametrize("recipe", ["official", "marine", "default"])
def test_recipes_give_all_views(spark, folder, recipe):
    d = images.decoded(spark, str(folder), "keep").where("width > 2 OR height < 0")
    config = RunConfig("x", n_global=3, n_local=2, image_side=32)
    out = render.rendered(d, recipe, config=config, local_side=16)
    rows = out.collect()
    assert sorted(r["view"] for r in rows) == sorted(list(range(5)) * 2)
    sides = {(r["view"] < 3, tuple(r["dims"])) for r in rows}
    assert sides == {(True, (3, 32, 32)), (False, (3, 112, 112) if recipe == "official" else (3, 16, 16))}
    for r in rows:
        x = np.frombuffer(r["data"], r["dtype"]).reshape(r["dims"])
        assert np.isfinite(x).all() and -3 < x.min() and x.max() < 4
    again = {(r["path"], r["view"]): bytes(r["data"]) for r in render.rendered(d.repartition(3), recipe, config=config, local_side=16).collect()}
    assert again == {(r["path"], r["view"]): bytes(r["data"]) for r in rows}
    other = {(r["path"], r["view"]): bytes(r["data"]) for r in render.rendered(d, recipe, config=config, local_side=16, seed=1).collect()}
    assert sum(other[k] != v for k, v in again.items() if "b.PNG" in k[0]) >= 4


def test_chances_of_the_plan(spark):
    d = spark.range(4000).select(F.col("id").cast("string").alias("path"), F.posexplode(render.plan("marine", F.col("id").cast("string"), F.lit(300), F.lit(200), n_global=2, n_local=1)).alias("view", "p"))
    share = lambda c: F.avg(c.cast("double"))
    rows = {r["view"]: r for r in d.groupBy("view").agg(share(F.col("p.horizontal")).alias("h"), share(F.col("p.jitter").isNotNull()).alias("j"), share(F.col("p.gray")).alias("g"), share(F.col("p.sigma").isNotNull()).alias("b"), share(F.col("p.solarize")).alias("s"), share(F.col("p.snow").isNotNull()).alias("w"), F.max("p.snow").alias("most"), F.count_if(F.expr("p.box.top < 0 OR p.box.top + p.box.height > 300 OR p.box.left + p.box.width > 200")).alias("out")).collect()}
    for v, (b, s) in enumerate(((0.8, 0.0), (0.3, 0.25), (0.5, 0.0))):
        r = rows[v]
        for got, want in ((r["h"], 0.5), (r["j"], 0.8), (r["g"], 0.2), (r["b"], b), (r["s"], s), (r["w"], 0.3)):
            assert abs(got - want) < 0.04
        assert r["most"] < 0.003 and r["out"] == 0


def test_steps_of_recipes():
    r = np.random.default_rng(3)
    m = r.integers(0, 256, (9, 7, 3)).astype(float)
    assert (t.cropped(m, 2, 1, 5, 5, 5) == m[2:7, 1:6]).all()
    flat = np.full((20, 30, 3), 77.0)
    for linear in (False, True):
        assert (t.cropped(flat, 3, 4, 11, 9, 16, linear) == 77).all() and t.resized(flat, 8, linear).shape == (8, 8, 3)
    assert (t.flipped(t.flipped(m, True, True), True, True) == m).all() and (t.flipped(m, False, False, 1)[0, 0] == m[0, -1]).all()
    assert (t.jittered(m, 1, 1, 1, 0.0) == m).all() and (t.grayed(m)[..., 0] == t.grayed(m)[..., 2]).all()
    assert (t.jittered(flat, 1.5, 1, 1, 0.0)[0, 0] == 116).all()
    # blur: against every product, with mirrored places
    for kernel in (5, 9, 15, 23):
        w = np.exp(-0.5 * (np.arange(-(kernel // 2), kernel // 2 + 1) / 1.3) ** 2)
        w /= w.sum()
        at = lambda i, n: (p := i % (2 * n - 2)) if (i % (2 * n - 2)) < n else 2 * n - 2 - i % (2 * n - 2)  # noqa: E731, F841
        want = np.zeros_like(m)
        for y in range(9):
            for x in range(7):
                for j, a in enumerate(w):
                    for i, b in enumerate(w):
                        want[y, x] += a * b * m[at(y + j - kernel // 2, 9), at(x + i - kernel // 2, 7)]
        assert np.abs(t.blurred(m, 1.3, kernel) - want).max() <= 0.51
    assert (t.shifted(m, 2, -1, (1, 2, 3))[:2] == (1, 2, 3)).all() and (t.shifted(m, 2, -1, (1, 2, 3))[2:, :-1] == m[:-2, 1:]).all()
    assert t.solarized(np.array([127.0, 128.0])).tolist() == [127, 127]
    x = m / 255
    assert t.lit(x, 0.5, 0.5, 0.4, True).max() <= 1 and np.allclose(t.veiled(x, 1.0, (0, 0, 0)), x) and np.allclose(t.dimmed(x, (1, 0, 1))[..., 1], 0)
    dots = t.specked(np.zeros((50, 50, 3)), 0.01, np.random.default_rng(0))
    assert 0 < (dots[..., 0] > 0).sum() <= 25 and dots[dots > 0].min() >= 0.6 and (t.specked(x, 0.0001, r) == x).all()
    assert np.abs(render.displayed(render.normalised(x, "benthic"), "benthic").astype(int) - m).max() <= 1


def test_plain_recipe_sheet_and_fallback(spark, folder):
    d = images.decoded(spark, str(folder)).where("width > 2")
    rows = render.notebook_views(d, n_local=2).collect()
    assert sorted((r["view"], r["dims"][0]) for r in rows) == sorted([(0, 224), (1, 224), (2, 96), (3, 96)] * 2)
    rows = sinks.sheet(d, "path", 2, 1, 24, 12).collect()
    assert len(rows) == 2 * (1 + 4 * 3) and {r["title"] for r in rows} == {"reference (24px)", "G0 (24px)", "G1 (24px)", "L0 (12px)", "L0 (112px)"}
    one = render.fallback(spark).first()
    m = np.frombuffer(one["pixels"], np.uint8).reshape(512, 512, 3)
    assert m[0, 0].tolist() == [100, 150, 200] and m[250, 250].tolist() == [220, 100, 50]
    assert views.chosen(True, False) == "official"


def test_masks_meet_images_before_views_are_drawn(spark):
    """The same views as by masking them once drawn, but what is shuffled is images; a mask of the wrong size is an error, whatever on_error says."""
    d = spark.range(40).select(F.col("id").alias("path"), F.lit(20).alias("height"), F.lit(24).alias("width"), F.expr("cast(repeat(char(65 + id), 1440) as binary)").alias("pixels"))
    config = RunConfig("x", n_global=2, n_local=1, image_side=32)
    mask = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: (p + F.col("path")) % 3 == 0)
    hidden = d.where("path % 5 > 0").select("path", F.explode(F.array(F.lit(0), F.lit(1))).alias("view"), mask.alias("mask"))
    made = {}
    for name, df in {"drawn": render.rendered(d, "official", config=config, hidden=hidden, patch=8), "after": render.masked(render.rendered(d, "official", config=config), hidden, patch=8)}.items():
        made[name] = {(r["path"], r["view"]): bytes(r["data"]) for r in df.collect()}
        plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("== Initial Plan ==")[0]
        assert ("MapInArrow" in plan[plan.index("Join") :]) == (name == "after")
    assert len(made["drawn"]) == 120 and made["drawn"] == made["after"]
    peaks = t.peaks(render.rendered(d, "official", config=config, hidden=hidden, patch=8), ["path", "view"], 8).where("path = 6 AND view = 1").first()["peaks"]
    assert [x == 0 for x in peaks] == [p % 3 == 0 for p in range(16)]
    with pytest.raises(Exception, match="a mask of 1 for 4 x 4 patches"):
        render.rendered(d, "official", config=config, hidden=hidden.withColumn("mask", F.array(F.lit(True))), patch=8).collect()


def _python_steps(df):
    return str(df._jdf.queryExecution().executedPlan()).count("MapInArrow")


def test_measures_are_taken_where_arrays_are_made(spark, sf):
    """The arrays of a view aren't sent to a further Python worker to be measured, and the measures are those of the arrays."""
    for query in ("plain_views", "rendered_views"):
        assert _python_steps(render.QUERIES[query](spark, sf)) == 2, query
    images = render.synthetic(spark, sf).where("doc_id < 9")
    views = render.rendered(images, "marine", "doc_id", config=RunConfig("-", n_global=1, n_local=1, image_side=16), local_side=8)
    for told, after in ((t.VALUES, t.values), (t.MEAN, t.means), (t.peak(4), lambda made, keep: t.peaks(made, keep, 4))):
        at_once = render.rendered(images, "marine", "doc_id", config=RunConfig("-", n_global=1, n_local=1, image_side=16), local_side=8, told=told)
        want = after(views, ["doc_id", "view"])
        assert at_once.columns == want.columns and sorted(at_once.collect()) == sorted(want.collect())


def test_given_columns_as_lists():
    import pyarrow as pa

    for values in ([None, [{"a": 1, "b": None}, None], []], [{"a": [1, None]}, None], [[True], None, [False]], [{"a": {"b": 1.5}, "c": "x"}] * 3, [[1.5], [None]]):
        column = pa.array(values)
        assert t.listed(column) == values and t.listed(column.slice(1)) == values[1:]


def test_drawing_steps_are_to_the_last_bit_those_of_plain_formulas():
    from tessera.operators.kernels import turned_hue

    r = np.random.default_rng(3)
    for n, turns in ((1, 0), (5, 1), (17, 2), (32, 3)):
        m = np.rot90(r.integers(0, 256, (n, n + 3, 3)).astype(float), turns)
        m[0, 0] = 7
        x = m / 255.0
        for by in (-0.5, -1e-18, 0.0, 0.15, 1.0):
            high, low = x.max(-1), x.min(-1)
            span = np.where(high > low, high - low, 1.0)
            a, b, c = (x[..., i] for i in range(3))
            hue = (np.where(high == a, (b - c) / span % 6, np.where(high == b, (c - a) / span + 2, (a - b) / span + 4)) / 6 + by) % 1.0
            k = (np.array([5.0, 3.0, 1.0]) + hue[..., None] * 6) % 6
            assert (turned_hue(x, np.array(by)) == high[..., None] - (high - low)[..., None] * np.clip(np.minimum(k, 4 - k), 0, 1)).all()
        for sigma, kernel in ((0.1, 7), (1.3, 7)):
            weight = np.exp(-0.5 * (np.arange(-3, 4) / sigma) ** 2)
            weight /= weight.sum()
            want = m
            for axis in (0, 1):
                wide = np.pad(want, [(3, 3) if i == axis else (0, 0) for i in range(3)], mode="reflect" if want.shape[axis] > 1 else "edge")
                want = sum(w * np.take(wide, np.arange(i, i + want.shape[axis]), axis) for i, w in enumerate(weight))
            assert (t.blurred(m, sigma, kernel) == np.clip(np.floor(want + 0.5), 0, 255)).all()
