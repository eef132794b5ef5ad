"""PNG images as arrays against Spark's reader, the index of shards, and reading by stretches and by conditions."""

import io
import struct
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.sources import images, png
from tessera.sources import shards as s


def filtered(rows: np.ndarray, step: int, kinds) -> bytes:
    """The data of an image whose rows of bytes are filtered as kinds say, byte by byte."""
    out, before = [], np.zeros(rows.shape[1], int)
    for row, kind in zip(rows.astype(int), kinds, strict=True):
        left = np.concatenate([np.zeros(step, int), row[:-step]]) if step < len(row) else np.zeros(len(row), int)
        corner = np.concatenate([np.zeros(step, int), before[:-step]]) if step < len(row) else np.zeros(len(row), int)

        def paeth(a, b, c):
            p = a + b - c
            return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]

        guess = {0: 0, 1: left, 2: before, 3: (left + before) // 2, 4: np.array([paeth(*x) for x in zip(left, before, corner, strict=True)])}[kind]
        out.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        before = row
    return b"".join(out)


def file(w, h, depth, colour, data, interlaced=0, palette=None, transparent=None) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced))]
    parts += [chunk(b"PLTE", palette)] if palette else []
    parts += [chunk(b"tRNS", transparent)] if transparent else []
    packed = zlib.compress(data)
    half = len(packed) // 2
    return png.SIGNATURE + b"".join([*parts, chunk(b"tEXt", b"a\0b"), chunk(b"IDAT", packed[:half]), chunk(b"IDAT", packed[half:]), chunk(b"IEND", b"")])


def samples(seed=0):
    """Names and bytes of images of every kind."""
    r, out = np.random.default_rng(seed), {}
    for colour, n in png.SAMPLES.items():
        for depth in {0: (1, 2, 4, 8), 3: (1, 2, 4, 8)}.get(colour, (8,)):
            for h, w in ((1, 1), (7, 13), (20, 9)):
                line = -(-w * n * depth // 8)
                palette = r.integers(0, 256, (1 << depth, 3), dtype=np.uint8).tobytes() if colour == 3 else None
                for name, kinds in (("plain", [0] * h), ("simple", r.integers(0, 3, h)), ("all", r.integers(0, 5, h))):
                    rows = r.integers(0, 256, (h, line), dtype=np.uint8)
                    out[f"c{colour}d{depth}h{h}{name}"] = file(w, h, depth, colour, filtered(rows, max(1, n * depth // 8), kinds), palette=palette)
    whole = r.integers(0, 256, (11, 10, 3), dtype=np.uint8)
    data = b""
    for top, left, down, right in png.PASSES:
        part = whole[top::down, left::right]
        if part.size:
            data += filtered(part.reshape(len(part), -1), 3, r.integers(0, 5, len(part)))
    out["interlaced"] = file(10, 11, 8, 2, data, 1)
    return out


def test_png_pixels_are_those_of_sparks_reader(spark, tmp_path):
    made = samples()
    for name, data in made.items():
        (tmp_path / f"{name}.png").write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1][:-4]: r for r in images.decoded(spark, str(tmp_path), "keep").collect()}
    assert got.keys() == made.keys()
    for name, data in made.items():
        m = png.decode(data)
        assert (got[name]["height"], got[name]["width"]) == m.shape[:2] and bytes(got[name]["pixels"]) == m.tobytes(), name


def test_wide_samples_and_damaged_files():
    r = np.random.default_rng(1)
    rows = r.integers(0, 256, (3, 4 * 6), dtype=np.uint8)
    assert (png.decode(file(4, 3, 16, 2, filtered(rows, 6, [4, 3, 1]))) == rows[:, ::2].reshape(3, 4, 3)).all()
    good = samples()["c2d8h7all"]
    bad = [b"", b"no", good[:40], good[:-1], good[:30] + b"x" + good[31:], good.replace(b"IDAT", b"IDAX"), file(2, 2, 8, 2, b"\0\0"), file(1, 1, 8, 2, b"\7\0\0\0"), file(1, 1, 8, 3, b"\0\1", palette=b"abc"), file(1, 1, 8, 3, b"\0\0"), file(0, 1, 8, 2, b"")]
    for data in bad:
        with pytest.raises(ValueError):
            png.decode(data)


def tar(path, members, kind="w"):
    with tarfile.open(path, kind) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


@pytest.fixture
def folder(tmp_path):
    r = np.random.default_rng(3)
    tar(tmp_path / "a.tar", [(f"d/k{i}.{e}", r.bytes(3000)) for i in range(100) for e in ("png", "json")])
    tar(tmp_path / "b.tar", [("x.png", b"1"), ("noext", b"2"), ("long" * 60 + ".png", b"3")])
    tar(tmp_path / "c.tar", [])
    tar(tmp_path / "z.tar.gz", [("p.png", b"4" * 10), ("p.json", b""), ("q.png", b"5")], "w:gz")
    return tmp_path


def test_index_and_stretches(spark, folder, tmp_path):
    """A large file is read by several tasks, small ones by one; the index is kept; counts come from it."""
    paths = s.paths_below(str(folder), "*.tar*")
    where = f"file://{tmp_path}/index"
    assert s.n_samples(spark, paths, where) == 104
    rows = s.shards(spark, paths, folder=where, task_bytes=100_000)
    want = {}
    for p in paths:
        with tarfile.open(p) as t:
            for m in t:
                if "." in m.name:
                    want.setdefault((p, m.name.partition(".")[0]), []).append((m.name.partition(".")[2], t.extractfile(m).read()))
    got = rows.withColumn("task", F.spark_partition_id()).collect()
    assert {(r["url"], r["sample_key"]): [(m["key"], bytes(m["content"])) for m in r["members"]] for r in got} == want and len(got) == 104
    assert len({r["task"] for r in got if r["url"].endswith("a.tar")}) >= 6
    bare = s.shards(spark, paths, content=False, folder=where).collect()
    assert len(bare) == 104 and all(m["content"] is None for r in bare for m in r["members"])
    (folder / "d.tar").write_bytes((folder / "b.tar").read_bytes())
    (folder / "b.tar").unlink()  # what the index has isn't read again
    assert s.n_samples(spark, [*paths, str(folder / "d.tar")], where) == 106


def test_a_chosen_sample_reads_its_bytes_only(spark, folder):
    """Once everything else of the file is gone, the chosen sample is still read, by conditions and from the index."""
    path = str(folder / "a.tar")
    found = s.index(spark, [path])
    row = found.where("sample_key = 'd/k40'").first()
    whole = open(path, "rb").read()
    want = [whole[m["offset"] : m["offset"] + m["length"]] for m in row["members"]]
    all_ = s.shards(spark, [path, str(folder / "b.tar")], task_bytes=50_000)
    one = all_.where((F.col("sample_key") == "d/k40") & (F.col("url") == path))
    a, b = row["first"], row["members"][-1]["offset"] + row["members"][-1]["length"]
    with open(path, "r+b") as f:
        f.write(b"\0" * a)
        f.seek(b)
        f.write(b"\0" * (len(whole) - b))
    (folder / "b.tar").write_bytes(b"")
    assert [[bytes(m["content"]) for m in r["members"]] for r in one.collect()] == [want]
    assert [[bytes(m["content"]) for m in r["members"]] for r in s.opened(found.where("sample_key = 'd/k40'").withColumn("more", F.lit(1))).collect()] == [want]
    assert "PushedFilters" in one._jdf.queryExecution().toString() or one.count() == 1
    assert all_.where(F.col("sample_key").isin("d/k40", "none")).count() == 1


def test_png_members_never_touch_the_disk(spark, tmp_path, monkeypatch):
    """Only other kinds of images become files, which are gone afterwards; bad ones are counted on the way."""
    made = samples()
    (tmp_path / "t").mkdir()
    tar(tmp_path / "t/a.tar", [(f"{k}.png", v) for k, v in made.items()] + [("bad.png", png.SIGNATURE + b"x"), ("worse.jpg", b"no"), ("none.json", b"{}")])
    before = set(tmp_path.parent.rglob("*"))
    report = Observation("shards")
    got = images.unpacked(images.shards(spark, [str(tmp_path / "t/a.tar")]), "keep", report)
    rows = {r["sample_key"]: r for r in got.collect()}
    assert report.get == {"n_images": len(made) + 2, "n_bad": 2} and len(rows) == len(made) + 2
    assert all(bytes(rows[k]["pixels"]) == png.decode(v).tobytes() for k, v in made.items())
    left = [p for p in set(tmp_path.parent.rglob("*")) - before if p.suffix in (".png", ".jpg")]
    assert not left
    assert images.unpacked(images.shards(spark, [str(tmp_path / "t/a.tar")])).count() == len(made)
    with pytest.raises(Exception, match="decode"):
        images.unpacked(images.shards(spark, [str(tmp_path / "t/a.tar")]), "fail").count()


def test_bad_images_of_a_folder_are_counted(spark, tmp_path):
    for i, data in enumerate([*list(samples().values())[:5], b"no", b"not"]):
        (tmp_path / f"{i}.png").write_bytes(data)
    for how, n in (("drop", 5), ("keep", 7), ("substitute", 7)):
        report = Observation(how)
        assert images.decoded(spark, str(tmp_path), how, report=report).count() == n
        assert report.get == {"n_images": 7, "n_bad": 2}
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no images"):
        images.decoded(spark, str(tmp_path / "none"))
