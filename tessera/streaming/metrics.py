"""Step metrics as a stream: means by epoch or by count of steps, running averages by key, best so far, endless epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import shared_dir
from ..operators import history
from .epochs import endless  # noqa: F401
from .ordered import best_so_far, running_average, settled


def events(spark: SparkSession, sf_dir: str, files_a_batch: int = 8) -> DataFrame:
    """The events as a stream of files."""
    given = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(given).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")


def finished(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over what is there and read back all that it wrote; complete results are overwritten batch by batch.

    A named folder keeps the stream's state and results: a stream that is run again with it, after a stop or
    a failure, goes on behind the last finished batch and writes no row twice.
    """
    folder = folder or shared_dir(stream.sparkSession)
    spark = stream.sparkSession
    # a query takes the settings that are there when it starts
    name, provider = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/out").start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")).start()
    spark.conf.set(name, provider) if provider else spark.conf.unset(name)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def means_by(stream: DataFrame, by: Column, name: str) -> DataFrame:
    """name, n_steps and the sum of every metric of a stream (metric, value), one row per step and metric; sums and counts are the stream's state."""
    return stream.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("n_steps"), *[F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0)).alias(m) for m in history.METRICS.values()])


WINDOW = 1000


def _named(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    name = F.element_at(F.create_map(*[F.lit(x) for pair in history.METRICS.items() for x in pair]), F.col("event_type"))
    return e.select((F.dayofmonth("ts") - 1).alias("epoch"), F.col("event_id").alias("step"), name.alias("metric"), "value", "user_id")


def _means(sums: DataFrame, by: str) -> DataFrame:
    return sums.select(by, "n_steps", *[F.round(F.col(m) / F.col("n_steps"), 6).alias(m) for m in history.METRICS.values()])


def stream_epoch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same means as the batch query."""
    return _means(finished(means_by(_named(spark, sf_dir), F.col("epoch"), "epoch"), "complete"), "epoch")


def stream_window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over every WINDOW steps."""
    return _means(finished(means_by(_named(spark, sf_dir), F.floor(F.col("step") / WINDOW), "window"), "complete"), "window")


def stream_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of each user that are below all before, in whatever order they come."""
    return settled(finished(best_so_far(_named(spark, sf_dir), "user_id", "step", "value", changes=True)), "user_id", "step", "value")


def stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = finished(running_average(events(spark, sf_dir), "user_id", "event_id", "value"))
    return rows.groupBy("user_id").agg(F.max_by("ema", "version").alias("ema")).select("user_id", F.round("ema", 6).alias("ema"))


QUERIES = {f.__name__: f for f in (stream_epoch_metrics, stream_window_metrics, stream_best, stream_ema)}

ORACLES = {
    "stream_epoch_metrics": history.ORACLES["epoch_metrics"],
    "stream_window_metrics": "WITH s AS (SELECT event_id // 1000 AS w, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in history.METRICS.items()) + " END AS metric, value FROM events) SELECT w AS \"window\", count(*) AS n_steps, " + ", ".join(f"round(coalesce(sum(value) FILTER (metric = '{m}'), 0) / count(*), 6) AS {m}" for m in history.METRICS.values()) + " FROM s GROUP BY w",
    "stream_best": "SELECT user_id, event_id AS step, value FROM events QUALIFY value < coalesce(min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'infinity'::DOUBLE)",
    "stream_ema": "SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY event_id)), lambda t, s: t * 0.9::DOUBLE + s * 0.1::DOUBLE), 6) AS ema FROM events GROUP BY user_id",
}
