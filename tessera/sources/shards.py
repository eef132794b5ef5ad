"""Tar files of samples: an index of their headers, and a data source that reads the chosen samples' bytes only.

The index has a row per sample, with the place of each member in its file; it is kept in a folder per file, so a
task that reads a stretch of a file opens that file's part of the index only.  Large files are read by several tasks,
a stretch of bytes each; small ones share a task.  Compressed files can't be entered in the middle: they are read from the start, one task each.
"""

from __future__ import annotations

import fnmatch
import hashlib
import tarfile

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..functions.frames import shared_dir
from ..session import ship

SHARD = "url string, sample_key string, members array<struct<key: string, content: binary>>"
INDEX = "url string, sample_key string, first long, bytes long, members array<struct<key: string, offset: long, length: long>>"
#: Bytes of a file that one task reads; neighbours at most GAP bytes apart are fetched with one read of at most MOST bytes.
TASK_BYTES, GAP, MOST = 64 << 20, 1 << 16, 8 << 20
COMPRESSED = (".gz", ".tgz", ".bz2", ".xz", ".zst")


def paths_below(folder: str, pattern: str = "*.tar") -> list[str]:
    """The files below a folder, on any file system, whose name fits a pattern, in order; none is an error."""
    system, place = fs.FileSystem.from_uri(folder)
    found = [i.path for i in system.get_file_info(fs.FileSelector(place, recursive=True)) if i.is_file and fnmatch.fnmatchcase(i.base_name, pattern)]
    if not found:
        raise ValueError(f"no shards {pattern} below {folder}")
    before = folder[: len(folder) - len(place)] if "://" in folder and folder.endswith(place) else ""
    return sorted(before + p for p in found)


def _folder(url: str) -> str:
    return hashlib.md5(url.encode()).hexdigest()


def _packed(url: str) -> bool:
    return url.lower().endswith(COMPRESSED)


def _grouped(tar):
    """(sample, [(key, member)]) of neighbouring members with the same name up to the first dot of its last part."""
    at, members = None, []
    for m in tar:
        folder, _, name = m.name.rpartition("/")
        stem, dot, key = name.partition(".")
        if not m.isfile() or not dot:
            continue
        sample = f"{folder}/{stem}" if folder else stem
        if sample != at and members:
            yield at, members
            members = []
        at = sample
        members.append((key, m))
    if members:
        yield at, members


def headers(url: str):
    """Rows of the index of one file.  Only its headers are read, unless it is compressed; then offsets are those of the unpacked bytes."""
    system, place = fs.FileSystem.from_uri(url)
    if _packed(url):
        with system.open_input_stream(place, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
            yield from _rows(url, tar)
    else:
        with system.open_input_file(place) as file, tarfile.open(fileobj=file, mode="r:") as tar:
            yield from _rows(url, tar)


def _rows(url, tar):
    for sample, members in _grouped(tar):
        yield url, sample, members[0][1].offset_data, sum(m.size for _, m in members), [{"key": k, "offset": m.offset_data, "length": m.size} for k, m in members]
        tar.members.clear()  # a file's headers needn't all be held


def index(spark: SparkSession, paths: list[str], folder: str | None = None) -> DataFrame:
    """url, sample_key, first, bytes and members (key, offset, length) of every sample of tar files; written to a folder, which a later session may name again.

    A file that is in the folder already isn't read again.
    """
    if not paths:
        raise ValueError("no shards")
    folder = folder or shared_dir(ship(spark))
    system, place = fs.FileSystem.from_uri(folder)
    known = {i.base_name for i in system.get_file_info(fs.FileSelector(place, allow_not_found=True))}
    new = [p for p in sorted(set(paths)) if f"shard={_folder(p)}" not in known]
    if new:

        def scan(batches):
            for b in batches:
                for url in b.column(0).to_pylist():
                    yield from _batched(headers(url), _INDEX)

        rows = spark.createDataFrame([(p,) for p in new], "url string").repartition(min(len(new), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(scan, INDEX)
        rows.withColumn("shard", F.md5("url")).write.mode("append").partitionBy("shard").parquet(folder)
    return spark.read.schema(INDEX + ", shard string").parquet(folder).where(F.col("url").isin(*paths)).drop("shard")


_MEMBER = lambda *rest: pa.list_(pa.struct([("key", pa.string()), *rest]))
_INDEX = pa.schema([("url", pa.string()), ("sample_key", pa.string()), ("first", pa.int64()), ("bytes", pa.int64()), ("members", _MEMBER(("offset", pa.int64()), ("length", pa.int64())))])
_SHARD = pa.schema([("url", pa.string()), ("sample_key", pa.string()), ("members", _MEMBER(("content", pa.binary())))])


def _batched(rows, schema: pa.Schema, most: int = 16 << 20):
    """Rows as record batches of at most about `most` bytes of members."""
    held, size = [], 0
    for row in rows:
        held.append(dict(zip(schema.names, row, strict=True)))
        size += sum(len(m.get("content") or b"") for m in row[-1]) + 200
        if size >= most or len(held) >= 5000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def contents(rows):
    """(url, sample_key, members with their content) of rows of the index, which come by file and place; neighbours are fetched with one read."""
    url = file = None
    pending: list = []

    def fetch():
        first = min(m["offset"] for r in pending for m in r["members"])
        file.seek(first)
        data = file.read(max(m["offset"] + m["length"] for r in pending for m in r["members"]) - first)
        for r in pending:
            yield r["url"], r["sample_key"], [{"key": m["key"], "content": data[m["offset"] - first : m["offset"] - first + m["length"]]} for m in r["members"]]
        pending.clear()

    for r in rows:
        if pending and (r["url"] != url or r["first"] > pending[-1]["members"][-1]["offset"] + pending[-1]["members"][-1]["length"] + GAP or r["first"] + r["bytes"] - pending[0]["first"] > MOST or r["first"] < pending[0]["first"]):
            yield from fetch()
        if r["url"] != url:
            url = r["url"]
            if _packed(url):
                raise ValueError(f"{url} is compressed and has to be read from its start")
            system, place = fs.FileSystem.from_uri(url)
            file = system.open_input_file(place)
        pending.append(r)
    if pending:
        yield from fetch()


class Shards(DataSource):
    """Samples of tar files.  Options: paths (one a line); index: the folder of their index; content: false gives no bytes;
    seed: partitions come in an order drawn from it, else by path and place; task_bytes: how much of a file one task reads.

    Conditions that a URL or a sample's key equals a value, or is one of some, are used to leave out files and samples unread.
    """

    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> str:
        return SHARD

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(p for p in options["paths"].split("\n") if p)
        if not self.paths:
            raise ValueError("no shards")
        self.index, self.seed = options["index"], options.get("seed")
        self.content = options.get("content", "true").lower() == "true"
        self.task_bytes = int(options.get("task_bytes") or TASK_BYTES)
        self.keys: set | None = None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if column else set()
            if column == "url":
                self.paths = [p for p in self.paths if p in values]
            elif column == "sample_key":
                self.keys = values if self.keys is None else self.keys & values
            else:
                yield f

    def partitions(self):
        stretches = []  # (url, from, to), to None: to its end
        for p in self.paths:
            system, place = fs.FileSystem.from_uri(p)
            size = system.get_file_info(place).size
            if _packed(p) or size <= self.task_bytes:
                stretches.append((size, (p, 0, None)))
            else:
                stretches += [(self.task_bytes, (p, a, a + self.task_bytes)) for a in range(0, size, self.task_bytes)]
        tasks, held = [], 0
        for size, stretch in stretches:
            if not tasks or held + size > self.task_bytes or self.seed:
                tasks.append([])
                held = 0
            tasks[-1].append(stretch)
            held += size
        if self.seed:
            tasks.sort(key=lambda t: hashlib.md5(f"{self.seed}|{t[0]}".encode()).digest())
        return [InputPartition(t) for t in tasks]

    def read(self, partition):
        for url, a, b in partition.value:
            if _packed(url) and self.content:
                yield from _batched(self._unpacked(url), _SHARD)
                continue
            system, place = fs.FileSystem.from_uri(f"{self.index}/shard={_folder(url)}")
            if system.get_file_info(place).type == fs.FileType.NotFound:
                continue  # a file without samples
            chosen = ds.field("first") >= a
            if b is not None:
                chosen &= ds.field("first") < b
            if self.keys is not None:
                chosen &= ds.field("sample_key").isin(sorted(self.keys))
            rows = ds.dataset(place, filesystem=system, format="parquet").to_table(columns=["url", "sample_key", "first", "bytes", "members"], filter=chosen).sort_by("first").to_pylist()
            if self.content:
                yield from _batched(contents(rows), _SHARD)
            else:
                yield from _batched(((r["url"], r["sample_key"], [{"key": m["key"], "content": None} for m in r["members"]]) for r in rows), _SHARD)

    def _unpacked(self, url):
        system, place = fs.FileSystem.from_uri(url)
        with system.open_input_stream(place, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
            at, members = None, []
            for sample, member, content in self._streamed(tar):
                if sample != at and members:
                    yield url, at, members
                    members = []
                at = sample
                members.append({"key": member, "content": content})
            if members:
                yield url, at, members

    def _streamed(self, tar):
        for m in tar:
            folder, _, name = m.name.rpartition("/")
            stem, dot, key = name.partition(".")
            sample = f"{folder}/{stem}" if folder else stem
            if m.isfile() and dot and (self.keys is None or sample in self.keys):
                yield sample, key, tar.extractfile(m).read()


def shards(spark: SparkSession, paths: list[str], content: bool = True, seed: int | None = None, folder: str | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """url, sample_key and members of tar files that every executor can open by these paths; with a seed, tasks come in an order drawn from it.

    folder: where their index is, or is to be kept; without one it is made anew.  Conditions on url and sample_key leave the rest unread.
    """
    folder = folder or shared_dir(ship(spark))
    index(spark, paths, folder)
    spark.dataSource.register(Shards)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"paths": "\n".join(paths), "index": folder, "content": str(content), "seed": "" if seed is None else str(seed), "task_bytes": str(task_bytes)}
    return spark.read.format("shards").options(**options).load()


def n_samples(spark: SparkSession, paths: list[str], folder: str | None = None) -> int:
    """How many samples shards hold, from their index."""
    return index(spark, paths, folder).count()


def opened(samples: DataFrame) -> DataFrame:
    """Rows of the index with their members' content in place of their places; also of a stream of such rows.

    Rows are read in the order they come, so neighbours should come together; other columns stay, in front.
    """
    others = [c for c in samples.columns if c not in ("url", "sample_key", "first", "bytes", "members")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema if f.name in others)

    def fetch(batches):
        for b in batches:
            rows = b.select(["url", "sample_key", "first", "bytes", "members"]).to_pylist()
            a = 0
            for part in _batched(contents(rows), _SHARD):
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(a, n) for c in others), *part.columns], [*others, *_SHARD.names])
                a += n

    return samples.select(*others, "url", "sample_key", "first", "bytes", "members").mapInArrow(fetch, f"{kinds + ', ' if kinds else ''}{SHARD}")
