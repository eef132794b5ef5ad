"""An unbounded stream of training steps over a table: every epoch deals all rows into full batches, in an order of its own.

The table is written once, in an order drawn from the seed.  An epoch's order is a turn and a stride over runs of
neighbouring rows, so a step's rows are found by their number: a micro-batch opens the files and row groups of its own rows only.
Offsets are (epoch, step), so a stream that is stopped goes on at its next step.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from bisect import bisect_right
from itertools import count, islice
from math import gcd

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.columns import keyed_uniform
from ..functions.frames import fresh, shared_dir
from ..session import ship

#: Neighbouring rows that stay together in a step; rows of a row group, the least that is read at once.
RUN, GROUP_BYTES = 8, 1 << 20


def _draw(most: int, *key) -> int:
    return int.from_bytes(hashlib.md5("|".join(map(str, key)).encode()).digest()[:8], "big") % most


class Order:
    """Which rows of a table of n rows the steps of an epoch take."""

    def __init__(self, n: int, size: int, seed: int, run: int = RUN):
        if n < size:
            raise ValueError(f"{n} rows don't fill a batch of {size}")
        self.n, self.size, self.seed = n, size, seed
        self.run = next(r for r in range(min(run, size), 0, -1) if size % r == 0)
        self.runs, self.steps = n // self.run, n // size

    def rows(self, epoch: int, step: int) -> list[tuple[int, int]]:
        """(first, after the last) number of the runs of a step; a run that goes over the table's end is two."""
        at = _draw(max(1, self.runs), self.seed, epoch, "stride")
        stride = next(islice((s for s in count(at + 1) if gcd(s, self.runs) == 1), 1))
        turn, shift, each = _draw(self.runs, self.seed, epoch, "turn"), _draw(self.n, self.seed, epoch, "shift"), self.size // self.run
        found = []
        for k in range(step * each, (step + 1) * each):
            a = (shift + (turn + k * stride) % self.runs * self.run) % self.n
            found += [(a, a + self.run)] if a + self.run <= self.n else [(a, self.n), (0, a + self.run - self.n)]
        return found


class Steps(DataSource):
    """Rows of the steps of endless epochs.  Options: plan (JSON: files with their rows, size, seed, run), steps (how many a micro-batch
    has), tasks (how many it is read by), progress (a file that remembers how far was planned)."""

    @classmethod
    def name(cls) -> str:
        return "epochs"

    def schema(self):
        raise ValueError("a schema has to be given")

    def streamReader(self, schema):  # noqa: N802
        return _Reader(schema, self.options)


class _Reader(DataSourceStreamReader):
    def __init__(self, schema, options):
        self.columns = [f.name for f in schema.fields]
        plan = json.loads(options["plan"])
        self.files, self.starts, n = [p for p, _ in plan["files"]], [], 0
        for _, rows in plan["files"]:
            self.starts.append(n)
            n += rows
        self.order = Order(n, plan["size"], plan["seed"], plan["run"])
        self.each, self.tasks, self.progress = int(options["steps"]), int(options["tasks"]), options["progress"]
        self.planned: int | None = None

    def _whole(self, offset: dict) -> int:
        return offset["epoch"] * self.order.steps + offset["step"]

    def _offset(self, step: int) -> dict:
        return dict(zip(("epoch", "step"), divmod(step, self.order.steps), strict=True))

    def _remember(self, step: int) -> None:
        self.planned = step
        system, place = fs.FileSystem.from_uri(self.progress)
        with system.open_output_stream(f"{place}.new") as f:
            f.write(str(step).encode())
        system.move(f"{place}.new", place)

    def initialOffset(self):  # noqa: N802
        self._remember(0)  # asked only of a stream that never ran
        return self._offset(0)

    def latestOffset(self):  # noqa: N802
        if self.planned is None:
            system, place = fs.FileSystem.from_uri(self.progress)
            known = system.get_file_info(place).type == fs.FileType.File
            self.planned = int(system.open_input_file(place).read()) if known else 0
        return self._offset(self.planned + self.each)

    def partitions(self, start, end):
        a, b = self._whole(start), self._whole(end)
        self._remember(max(b, self.planned or 0))
        each = max(1, -(-(b - a) // self.tasks))
        return [InputPartition((s, min(s + each, b))) for s in range(a, b, each)]

    def read(self, partition):
        a, b = partition.value
        held: dict = {}
        for whole in range(a, b):
            epoch, step = divmod(whole, self.order.steps)
            rows = pa.concat_tables([t for lo, hi in self.order.rows(epoch, step) for t in self._rows(lo, hi, held)])
            n = rows.num_rows
            given = {"step": [whole] * n, "epoch": [epoch] * n, "batch": [step] * n, "slot": list(range(n))}
            kinds = {"slot": pa.int32()}
            columns = [pa.array(given[c], kinds.get(c, pa.int64())) if c in given else rows.column(c).combine_chunks() for c in self.columns]
            yield pa.RecordBatch.from_arrays(columns, self.columns)

    def _rows(self, lo: int, hi: int, held: dict):
        """Rows lo to hi of the table, from the row groups that have them; the last file and its last groups stay open."""
        while lo < hi:
            k = bisect_right(self.starts, lo) - 1
            end = self.starts[k + 1] if k + 1 < len(self.starts) else self.order.n
            if held.get("file") != k:
                system, place = fs.FileSystem.from_uri(self.files[k])
                file = pq.ParquetFile(system.open_input_file(place))
                ends, n = [], 0
                for g in range(file.metadata.num_row_groups):
                    n += file.metadata.row_group(g).num_rows
                    ends.append(n)
                held.update(file=k, parquet=file, ends=ends, group=None)
            g = bisect_right(held["ends"], lo - self.starts[k])
            first = held["ends"][g - 1] if g else 0
            if held["group"] != g:
                held.update(group=g, rows=held["parquet"].read_row_group(g, [c for c in self.columns if c not in ("step", "epoch", "batch", "slot")]))
            upto = min(hi, end, self.starts[k] + held["ends"][g])
            yield held["rows"].slice(lo - self.starts[k] - first, upto - lo)
            lo = upto


def table(rows: DataFrame, key: str, seed: int = 0, folder: str | None = None) -> str:
    """Write rows in an order drawn from the seed and their key, and return where; a folder that has a table already is left as it is."""
    folder = folder or shared_dir(rows.sparkSession)
    system, place = fs.FileSystem.from_uri(folder)
    if system.get_file_info(f"{place}/rows/_SUCCESS").type != fs.FileType.File:
        order = [keyed_uniform(seed, "order", F.col(key)), F.col(key)]
        at = fresh(rows, "at")
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()).write.option("parquet.block.size", GROUP_BYTES).mode("overwrite").parquet(f"{folder}/rows")
    return folder


def endless(spark: SparkSession, rows: DataFrame, key: str, size: int, seed: int = 0, steps_a_batch: int = 64, run: int = RUN, folder: str | None = None, name: str | None = None) -> DataFrame:
    """A stream without end of step, epoch, batch, slot and the columns of rows.

    Every epoch has n // size full batches without a repeated row; which rows are left over differs by epoch.  A stream that is to be resumed names
    its folder and itself (name): the table is written there once and the stream goes on at its next step.  The last column of
    the written table is the order it was written in; columns of rows named like the four are replaced.
    """
    ship(spark)
    rows = rows.drop("step", "epoch", "batch", "slot")
    folder = table(rows, key, seed, folder)
    held = spark.read.parquet(f"{folder}/rows")
    at = held.columns[-1]
    files = held.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).orderBy("first").collect()  # a row per file
    plan = {"files": [(r["file"], r["n"]) for r in files], "size": size, "seed": seed, "run": run}
    Order(sum(r["n"] for r in files), size, seed, run)
    spark.dataSource.register(Steps)
    schema = "step long, epoch long, batch long, slot int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name != at)
    options = {"plan": json.dumps(plan), "steps": str(steps_a_batch), "tasks": str(spark.sparkContext.defaultParallelism), "progress": f"{folder}/{name or uuid.uuid4().hex}.planned"}
    return spark.readStream.format("epochs").schema(schema).options(**options).load()
