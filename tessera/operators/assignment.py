"""Balanced assignment of pooled rows to places, where a batch's rows are too many for one task.

A batch's rows are dealt to blocks of bounded size, packed once.  A round is a pass over the blocks: within a block every row
is brought to its total, and the places' partial sums come out; Spark adds them up by place.
Only the places' factors go back to the blocks, so between rounds nothing but numbers per place is moved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import written

#: Bytes of a block's matrix; and of the factors of all batches that are sent to every executor (beyond, they meet blocks by batch and part).
BLOCK_BYTES, BROADCAST_BYTES = 32 << 20, 64 << 20


def _matrix(data: bytes, n: int, temperature: float) -> np.ndarray:
    m = np.frombuffer(data, np.float64).reshape(n, -1)
    return np.exp((m - m.max(1, keepdims=True)) / temperature)


def blocks(rows: DataFrame, batch: str, key: list[str], x: str, carried: list[str], block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The rows packed into blocks (batch, part, n, held, x), and how many parts a batch has at most; written, since every round reads them."""
    sizes = rows.groupBy(batch).agg((F.count(F.lit(1)) * F.max(F.size(x)) * 8).alias("bytes"))
    parts = max(1, -(-(sizes.agg(F.max("bytes")).first()[0] or 0) // block_bytes))
    # a part is about as large as it should be; twice as many leave room for uneven hashes
    parts = 1 if parts == 1 else 2 * parts
    given = rows.select(batch, F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int").alias("part"), F.struct(*key, *carried).alias("held"), F.col(x).cast("array<double>").alias("x"))

    def pack(table: pa.Table) -> pa.Table:
        held, values = table.column("held").combine_chunks(), table.column("x").combine_chunks()
        held = pa.StructArray.from_arrays(held.flatten(), [f.name for f in held.type])  # every field may be null
        whole = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
        data = values.flatten().to_numpy(zero_copy_only=False)
        return table.slice(0, 1).select([batch, "part"]).append_column("n", pa.array([len(held)], pa.int64())).append_column("held", whole).append_column("x", pa.array([data.tobytes()], pa.binary()))

    kinds = {c: given.schema[c].dataType.simpleString() for c in (batch, "held")}
    return written(given.groupBy(batch, "part").applyInArrow(pack, f"`{batch}` {kinds[batch]}, part int, n long, held array<{kinds['held']}>, x binary"), "blocks"), parts


def balanced(rows: DataFrame, batch: str, key: list[str], x: str, temperature: float, rounds: int = 3, carried: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """batch, key, carried, q: exp(x / temperature) scaled so that every place gets the same share of its batch and every row the same total, in turn.

    The row's largest value is taken off before exp; q sums to 1 in each row.  Rows of a batch have arrays of one length; rows without x
    are left out; rows that share a key are rows of their own.  A table without rows gives an empty result.
    """
    if rounds < 1:
        raise ValueError("at least one round")
    carried = carried or []
    given = rows.where(F.col(x).isNotNull())
    packed, parts = blocks(given, batch, key, x, carried, block_bytes)
    of_batch = packed.schema[batch].dataType.simpleString()
    totals = written(packed.groupBy(batch).agg(F.sum("n").alias("whole"), F.max(F.octet_length("x") / F.col("n") / 8).cast("long").alias("places")), "totals")
    small = (totals.agg(F.sum(F.col("places") * 8)).first()[0] or 0) <= BROADCAST_BYTES

    def with_factors(factors: DataFrame) -> DataFrame:
        if small:
            return packed.join(F.broadcast(factors), batch)
        return packed.join(factors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), [batch, "part"])

    def scaled(b: pa.RecordBatch, i: int):
        """A block's matrix, its rows' factors and its places' factors."""
        e = _matrix(b.column("x")[i].as_py(), b.column("n")[i].as_py(), temperature)
        values = b.column("factor")[i].values
        if values is None:
            return e, np.ones(len(e)), None
        factor = values.to_numpy(zero_copy_only=False)
        return e, 1 / (b.column("whole")[i].as_py() * (e @ factor)), factor

    def sums(batches):
        for b in batches:
            for i in range(b.num_rows):
                e, row, _ = scaled(b, i)
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(batch)[i], e.shape[1]), pa.array(np.arange(e.shape[1])), pa.array(row @ e)], [batch, "place", "s"])

    factors = totals.withColumn("factor", F.lit(None).cast("array<double>"))
    for _ in range(rounds):
        by_place = with_factors(factors).mapInArrow(sums, f"`{batch}` {of_batch}, place long, s double").groupBy(batch, "place").agg(F.sum("s").alias("s"))
        # an array per batch: bounded by its places
        column = by_place.groupBy(batch).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda p: p["s"]).alias("s"))
        column = column.join(totals, batch).select(batch, "whole", "places", F.transform("s", lambda s: 1.0 / (F.col("places") * s)).alias("factor"))
        factors = written(column, "factors")

    fields = [packed.schema["held"].dataType.elementType[c] for c in (*key, *carried)]

    def assigned(batches):
        for b in batches:
            for i in range(b.num_rows):
                e, row, factor = scaled(b, i)
                q = row[:, None] * e * factor * b.column("whole")[i].as_py()
                held = b.column("held")[i].values
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * q.shape[1], pa.int32()), pa.array(q.ravel()))
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(batch)[i], len(q)), *(held.field(f.name) for f in fields), values], [batch, *(f.name for f in fields), "q"])

    schema = f"`{batch}` {of_batch}, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "q array<double>"
    return with_factors(factors).mapInArrow(assigned, schema)
