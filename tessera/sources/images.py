"""Folders of image files, shards of samples in tar files, and tables of labels, as DataFrames."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions.frames import remove, shared_dir, written
from ..operators.ingest import EXTENSIONS, image_key, substitute
from ..session import ship
from ..streaming import epochs
from . import png
from .shards import index, n_samples, opened, shards  # noqa: F401
from .shards import paths_below as shard_paths  # noqa: F401

LABELS = "image string, partition string, catami_substrate string"
IMAGE = "path string, height int, width int, n_channels int, pixels binary"
PIXELS = ("height", "width", "n_channels", "pixels")
#: Up to this many images that can't be decoded, the list of who takes whose pixels is sent to every executor.
BROADCAST_LOST = 200_000
_GLOB = "*.{" + ",".join(EXTENSIONS) + "}"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path of every image file below a folder, in order and without repeats; a folder without any is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _GLOB).load(folder).select("path").distinct()
    if not files.take(1):
        raise ValueError(f"no images below {folder}")
    return files.orderBy("path")


def counted(rows: DataFrame, report: Observation | str) -> DataFrame:
    """rows of images, of which n_images and n_bad (height below 0) are counted on the way to whatever reads them.

    report: an Observation, or for a stream a name, under which each micro-batch's progress tells both.
    """
    return rows.observe(report, F.count(F.lit(1)).alias("n_images"), F.count_if(F.col("height") < 0).alias("n_bad"))


def _red_first(rows: DataFrame) -> DataFrame:
    """Spark's decoded images (origin, height, width, nChannels, data) as path, height, width, n_channels and pixels.

    Spark gives blue first, and one or four channels for gray and transparent images.
    """

    def turn(batches):
        for b in batches:
            pixels = []
            for height, width, n, data in zip(*(b.column(c).to_pylist() for c in ("height", "width", "nChannels", "data")), strict=True):
                m = np.frombuffer(data, np.uint8).reshape(height, width, n) if height >= 0 else np.zeros((0, 0, 3), np.uint8)
                pixels.append((m.repeat(3, 2) if n == 1 and height >= 0 else m[..., 2::-1]).tobytes())
            channels = pa.compute.if_else(pa.compute.greater_equal(b.column("height"), 0), 3, b.column("nChannels")).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("origin"), b.column("height"), b.column("width"), channels, pa.array(pixels, pa.binary())], [c.split()[0] for c in IMAGE.split(", ")])

    ship(rows.sparkSession)
    return rows.select("origin", "height", "width", "nChannels", "data").mapInArrow(turn, IMAGE)


def decoded(spark: SparkSession, folder: str, on_corrupt: str = "drop", seed: int = 0, report: Observation | None = None) -> DataFrame:
    """path, height, width, n_channels and pixels (red first) of a folder's images; a folder without any is an error.

    on_corrupt says what happens to files that can't be decoded: drop leaves them out, keep gives them height -1, substitute
    gives them another image's pixels (the same for a seed; null if none can be decoded), fail raises an error.
    report: an Observation that has n_images and n_bad once a result is there, counted on the way.
    """
    listing(spark, folder)
    raw = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", _GLOB).load(folder).select("image.*")
    told = lambda rows: counted(rows, report) if report else rows
    if on_corrupt == "substitute":
        # one pass finds what can be decoded; a second one makes the pixels, of each image for all who take it
        found = written(told(raw.select(F.col("origin").alias("path"), "height")), "found")
        used = substitute(found, "path", F.col("height") >= 0, seed).where("height < 0").select(F.col("path").alias("lost"), F.col("used").alias("origin"))
        used = written(used, "used")
        takers = used.where("origin IS NOT NULL").groupBy("origin").agg(F.collect_list("lost").alias("lost"))
        takers = F.broadcast(takers) if used.count() <= BROADCAST_LOST else takers
        images = raw.where("height >= 0").join(takers, "origin", "left")
        images = images.select(F.explode(F.concat(F.array("origin"), F.coalesce("lost", F.array().cast("array<string>")))).alias("origin"), "height", "width", "nChannels", "data")
        return _red_first(images).unionByName(used.where("origin IS NULL").select(F.col("lost").alias("path")), allowMissingColumns=True)
    raw = told(raw)
    if on_corrupt == "drop":
        raw = raw.where("height >= 0")
    elif on_corrupt == "fail":
        raw = raw.where(F.when(F.col("height") < 0, F.raise_error(F.concat(F.lit("can't decode "), "origin"))).otherwise(F.lit(True)))
    return _red_first(raw)


def labels(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The used columns of a label table in CSV, all as text; columns are found by their names in the header.  None if no table is named or none is there."""
    if not path:
        return None
    system, place = fs.FileSystem.from_uri(path)
    if system.get_file_info(place).type == fs.FileType.NotFound:
        return None
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[F.col(c.split()[0]).cast("string") for c in LABELS.split(", ")])


def _decoded(contents) -> list[pa.Array]:
    """height, width, n_channels and pixels of PNG images; height -1 where one can't be decoded."""
    sizes, pixels = [], []
    for data in contents:
        try:
            m = png.decode(data or b"")
        except ValueError:
            m = None
        sizes.append((-1, -1, -1) if m is None else m.shape)
        pixels.append(b"" if m is None else m.tobytes())
    return [*(pa.array([x[k] for x in sizes], pa.int32()) for k in range(3)), pa.array(pixels, pa.binary())]


def png_images(rows: DataFrame, content: str = "content") -> DataFrame:
    """rows with height, width, n_channels and pixels in place of the bytes of PNG images, decoded in Arrow batches; also of a stream.

    What can't be decoded has height -1; null bytes too.  Nothing is written for it.
    """
    kept = [c for c in rows.columns if c != content]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *_decoded(b.column(content).to_pylist())], [*kept, *PIXELS])

    ship(rows.sparkSession)
    given = rows.select(*kept, content)
    return given.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema if f.name != content) + "height int, width int, n_channels int, pixels binary")


def image_fields(samples: DataFrame) -> DataFrame:
    """url, sample_key, field and content of the image of each sample; samples without an image's field are left out.  Also of a stream."""
    rows = samples.withColumn("field", image_key(F.transform("members", lambda m: m["key"]))).where("field IS NOT NULL")
    return rows.select("url", "sample_key", "field", F.get(F.filter("members", lambda m: m["key"] == F.col("field")), F.lit(0))["content"].alias("content"))


def unpacked(samples: DataFrame, on_corrupt: str = "drop", report: Observation | None = None) -> DataFrame:
    """url, sample_key, height, width, n_channels and pixels of the image of each sample of shards(), written.

    Samples without an image's field are left out; one that can't be decoded is left out, or kept with height -1, or an error, as `on_corrupt` says.
    PNG images are decoded where they are read.  Others become files of a folder, for Spark's own reader of images, which is deleted once
    their pixels are written.  report: an Observation that has n_images and n_bad once the images are there.
    """
    spark = ship(samples.sparkSession)
    folder = shared_dir(spark)
    columns = ["url", "sample_key", "name", *PIXELS]

    def run(batches):
        system, place = fs.FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)
        for b in batches:
            contents = b.column("content").to_pylist()
            own = np.array([(c or b"").startswith(png.SIGNATURE) for c in contents], bool)
            some, rest = b.filter(pa.array(own)), b.filter(pa.array(~own))
            if some.num_rows:
                yield pa.RecordBatch.from_arrays([some.column("url"), some.column("sample_key"), pa.nulls(some.num_rows, pa.string()), *_decoded(some.column("content").to_pylist())], columns)
            names = []
            for url, key, field, content in zip(*(rest.column(c).to_pylist() for c in ("url", "sample_key", "field", "content")), strict=True):
                names.append(f"{hashlib.sha256(f'{url}|{key}'.encode()).hexdigest()}.{field.rpartition('.')[2]}")
                with system.open_output_stream(f"{place}/{names[-1]}", compression=None) as f:  # the same bytes on every attempt
                    f.write(content or b"")
            n = len(names)
            yield pa.RecordBatch.from_arrays([rest.column("url"), rest.column("sample_key"), pa.array(names, pa.string()), *(pa.nulls(n, pa.int32()) for _ in range(3)), pa.nulls(n, pa.binary())], columns)

    first = written(image_fields(samples).mapInArrow(run, "url string, sample_key string, name string, height int, width int, n_channels int, pixels binary"), "images")
    filed = first.where("name IS NOT NULL").select("url", "sample_key", "name")
    done = first.where("name IS NULL").drop("name")
    if filed.take(1):
        found = _red_first(spark.read.format("image").load(folder).select("image.*")).withColumn("name", F.regexp_extract("path", "[^/]*$", 0)).drop("path")
        done = done.unionByName(filed.join(found, "name").drop("name"))
    if report:
        done = counted(done, report)
    if on_corrupt == "fail":
        done = done.where(F.when(F.col("height") < 0, F.raise_error(F.concat(F.lit("can't decode "), "sample_key"))).otherwise(F.lit(True)))
    out = written(done if on_corrupt == "keep" else done.where("height >= 0"), "pixels")
    remove(folder)
    return out


def collection(spark: SparkSession, config: RunConfig, on_corrupt: str = "drop", report: Observation | None = None) -> DataFrame:
    """path, height, width, n_channels and pixels of a run's images, from its folder or its shards; a sample's path is its file's and its key."""
    if not config.use_shards:
        return decoded(spark, config.data_dir, on_corrupt, report=report)
    found = unpacked(shards(spark, shard_paths(config.shard_dir)), on_corrupt, report)
    return found.select(F.concat_ws("/", "url", "sample_key").alias("path"), *PIXELS)


def training_stream(spark: SparkSession, config: RunConfig, seed: int = 0, **options) -> DataFrame:
    """step, epoch, batch, slot, url, sample_key and the image of a run's shards, epoch after epoch without end, in full batches.

    A micro-batch reads the bytes of its own samples.  Images that can't be decoded here (other kinds than PNG too) have height -1, so that a
    step's size doesn't change before it is known what to do about them.  options: those of `endless` (folder and name, to resume).
    """
    paths = shard_paths(config.shard_dir)
    known = index(spark, paths).withColumn("sample", F.concat_ws("/", "url", "sample_key"))
    stream = epochs.endless(spark, known, "sample", config.batch_size, seed, **options)
    read = opened(stream.drop("sample")).withColumn("field", image_key(F.transform("members", lambda m: m["key"])))
    read = read.withColumn("content", F.get(F.filter("members", lambda m: m["key"] == F.col("field")), F.lit(0))["content"]).drop("members", "field")
    return png_images(read)
