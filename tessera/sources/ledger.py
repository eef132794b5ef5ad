"""A run's history that changes all at once: rows, checkpoints and the best so far become visible with one commit, or not at all.

Writing tasks make files under names of their own; the driver then writes one record that names the files of the tasks that
succeeded and carries the best row so far.  What no record names isn't there: files of failed or repeated tasks don't count.
A record has the name of its batch, so a batch that is written again after a failure changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship


@dataclass
class Written(WriterCommitMessage):
    """A task's file (None for one without rows), its rows, and its best one."""

    file: str | None
    rows: int
    best: dict | None


class _Ledger:
    """The folder of a ledger: files in data/, records in commits/."""

    def __init__(self, path: str, value: str | None, order: str, larger: bool):
        self.path, self.value, self.order, self.larger = path.rstrip("/"), value, order, larger

    def system(self, *parts: str):
        system, place = fs.FileSystem.from_uri("/".join((self.path, *parts)))
        return system, place

    def better(self, a: dict | None, b: dict | None) -> dict | None:
        """The better of two rows: by value, ties by the smaller order; a missing value is never better."""
        if a is None or b is None:
            return a or b
        sign = -1 if self.larger else 1
        return min(a, b, key=lambda r: (sign * r["value"], r["order"]))

    def best_of(self, table: pa.Table) -> dict | None:
        if not self.value:
            return None
        found = None
        for value, order in zip(table.column(self.value).to_pylist(), table.column(self.order).to_pylist(), strict=True):
            if value is not None and value == value:
                found = self.better(found, {"value": value, "order": order, "by": [self.value, self.order]})
        return found

    def store(self, batches) -> Written:
        """One file with all rows of a task; rows are few (a line per epoch, or per step of a batch) and streamed."""
        name, writer, rows, best = f"{uuid.uuid4().hex}.parquet", None, 0, None
        system, place = self.system("data")
        system.create_dir(place, recursive=True)
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if writer is None:
                writer = pq.ParquetWriter(system.open_output_stream(f"{place}/{name}"), table.schema)
            writer.write_table(table)
            rows += table.num_rows
            best = self.better(best, self.best_of(table))
        if writer is None:
            return Written(None, 0, None)
        writer.close()
        return Written(name, rows, best)

    def records(self) -> dict[str, dict]:
        """The records by batch, in order of their commits."""
        system, place = self.system("commits")
        found = [i.path for i in system.get_file_info(fs.FileSelector(place, allow_not_found=True)) if i.path.endswith(".json")]
        read = [json.loads(system.open_input_file(p).read()) for p in found]
        return {r["batch"]: r for r in sorted(read, key=lambda r: r["number"])}

    def commit(self, batch: str, schema: str, messages) -> None:
        known = self.records()
        if batch in known:  # it was there before; the new files don't count
            self.abort(messages)
            return
        last = list(known.values())[-1] if known else {"number": -1, "best": None}
        best = last["best"]
        for m in messages:
            best = self.better(best, m.best if m else None)
        record = {"batch": batch, "number": last["number"] + 1, "schema": schema, "files": [m.file for m in messages if m and m.file], "rows": sum(m.rows for m in messages if m), "best": best}
        system, place = self.system("commits")
        system.create_dir(place, recursive=True)
        new = f"{place}/.{uuid.uuid4().hex}"
        with system.open_output_stream(new) as f:
            f.write(json.dumps(record).encode())
        system.move(new, f"{place}/{batch}.json")

    def abort(self, messages) -> None:
        system, place = self.system("data")
        for m in messages:
            if m and m.file and system.get_file_info(f"{place}/{m.file}").type == fs.FileType.File:
                system.delete_file(f"{place}/{m.file}")


class Ledger(DataSource):
    """Options: path; batch: the batch's name, for writing that isn't a stream (a stream's batches are named by their numbers and the
    option stream); value, order and larger: the column that says which row is best, and the one that says which came first."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def _of(self) -> _Ledger:
        return _Ledger(self.options["path"], self.options.get("value"), self.options.get("order", "epoch"), self.options.get("larger", "false").lower() == "true")

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("a ledger is only added to")
        return _Writer(self._of(), self.options.get("batch") or uuid.uuid4().hex, schema.json())

    def streamWriter(self, schema, overwrite):  # noqa: N802
        return _StreamWriter(self._of(), self.options.get("stream", "batch"), schema.json())


class _Writer(DataSourceArrowWriter):
    def __init__(self, ledger, batch, schema):
        self.ledger, self.batch, self.schema = ledger, batch, schema

    def write(self, iterator):
        return self.ledger.store(iterator)

    def commit(self, messages):
        self.ledger.commit(self.batch, self.schema, messages)

    def abort(self, messages):
        self.ledger.abort(messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, ledger, stream, schema):
        self.ledger, self.stream, self.schema = ledger, stream, schema

    def write(self, iterator):
        return self.ledger.store(iterator)

    def commit(self, messages, batchId):  # noqa: N803
        self.ledger.commit(f"{self.stream}-{batchId}", self.schema, messages)

    def abort(self, messages, batchId):  # noqa: N803
        self.ledger.abort(messages)


def options(path: str, value: str | None = None, order: str = "epoch", larger: bool = False, **more: str) -> dict[str, str]:
    """What a writer of format `ledger` needs; batch names the batch, stream the stream."""
    return {"path": path, "order": order, "larger": str(larger)} | ({"value": value} if value else {}) | more


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Ledger)
    ship(spark)


def append(rows: DataFrame, path: str, batch: str, value: str | None = None, order: str = "epoch", larger: bool = False) -> None:
    """Add rows as one batch: all of them, once, however often the batch is written and whichever tasks fail on the way."""
    register(rows.sparkSession)
    rows.write.format("ledger").mode("append").options(**options(path, value, order, larger, batch=batch)).save()


def _records(path: str) -> list[dict]:
    return list(_Ledger(path, None, "", False).records().values())


def history(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all batches; a ledger without any is an error, since nothing says what its columns are."""
    records = _records(path)
    if not records:
        raise ValueError(f"nothing was written to {path}")
    schema = StructType.fromJson(json.loads(records[-1]["schema"]))
    files = [f"{path.rstrip('/')}/data/{f}" for r in records for f in r["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def best(spark: SparkSession, path: str) -> DataFrame:
    """The row, or rows of that order, that were best when the last batch was added; none without a value."""
    rows = history(spark, path)
    found = _records(path)[-1]["best"]
    if not found:
        return rows.limit(0)
    value, order = found["by"]
    return rows.where((F.col(value) == F.lit(found["value"])) & (F.col(order) == F.lit(found["order"])))
