"""Helpers on whole DataFrames: dealing out small scans, scratch tables in the shared folder, row numbers."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_SCOPES: ContextVar[tuple[scratch, ...]] = ContextVar("scopes", default=())


class scratch:
    """A scope for scratch folders: those handed out within it can be deleted after it, and no others.

    with scratch() as made: ...; made.discard(keep) deletes them, but for those that `keep` reads.  Scopes may be nested; a
    folder belongs to the innermost one.  Folders handed out outside of any scope stay.
    """

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> scratch:
        self._entered = _SCOPES.set((*_SCOPES.get(), self))
        return self

    def __exit__(self, *error) -> None:
        _SCOPES.reset(self._entered)

    def discard(self, keep: DataFrame | None = None) -> None:
        read = keep.inputFiles() if keep is not None else []
        for path in [p for p in self.paths if not any(p.rpartition("/")[2] in f for f in read)]:
            remove(path)
            self.paths.remove(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer partitions than the session has cores, dealt to all of them; others stay as they are.

    For work that costs much per row: a small table in one file would otherwise be one task.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """A new path under the folder that the driver and all executors share.

    The cluster names that folder in spark.checkpoint.dir.  Only a session of one machine may leave it
    unset and gets a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'tessera-shared')}"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    for scope in _SCOPES.get()[-1:]:
        scope.paths.append(path)
    return path


def remove(uri: str) -> None:
    """Delete a folder, if it is there."""
    system, path = fs.FileSystem.from_uri(uri)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write df once as Parquet in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def numbered(rows: DataFrame, order: list, number: str, total: str | None = None) -> DataFrame:
    """rows with their number (from 0) in an order, and how many there are if `total` is named; a column of theirs with such a name is replaced.

    Numbers come from one range shuffle, written once, and the counts of its partitions, not from one task.
    """
    at, part, n, start, whole = (fresh(rows, c) for c in ("at", "part", "n", "start", "all"))
    local = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ordered")
    # the id is the partition's number, then 33 bits for the place in it
    local = local.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    counts = local.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, 0)
    counts = counts.select(part, (F.sum(n).over(before) - F.col(n)).alias(start), F.sum(n).over(W.partitionBy()).alias(whole))
    joined = local.join(F.broadcast(counts), part)  # a row per partition
    joined = joined.withColumns({number: F.col(start) + F.col(at)} | ({total: F.col(whole)} if total else {}))
    return joined.drop(*{at, part, start, whole} - {number, total})
