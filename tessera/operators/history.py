"""Epoch metrics, best-so-far tracking, checkpoints and the append-only history.

Step metrics come in long form (epoch, step, metric, value).  A component that a step doesn't store
was off and counts as 0, so means are sums over the number of steps.  In the queries, `events`
stands for step metrics: the step is the event, the epoch its day, the metric its type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = {"view": "total", "click": "dino", "signup": "ibot", "purchase": "koleo", "error": "gram"}
PREVIOUS = (W.unboundedPreceding, -1)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.element_at(F.create_map(*[F.lit(x) for pair in METRICS.items() for x in pair]), F.col("event_type"))
    return e.select((F.dayofmonth("ts") - 1).alias("epoch"), F.col("event_id").alias("step"), name.alias("metric"), "value")


def epoch_means(rows: DataFrame, metrics=tuple(METRICS.values())) -> DataFrame:
    """epoch, n_steps and the mean of every metric over all steps of the epoch."""
    n = F.countDistinct("step")
    return rows.groupBy("epoch").agg(n.alias("n_steps"), *[(F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0)) / n).alias(m) for m in metrics])


def is_best(value: Column, order: Column, larger: bool) -> Column:
    """Whether a value is better than all before it; ties aren't, nulls neither are nor count.

    The window has one row per epoch, so it is one task's.
    """
    before = (F.max if larger else F.min)(value).over(W.orderBy(order).rowsBetween(*PREVIOUS))
    return F.coalesce((value > before) if larger else (value < before), value.isNotNull() & before.isNull())


def history_rows(means: DataFrame) -> DataFrame:
    """The text that an epoch appends to its history: epoch from 1, losses with six decimals, the rate with eight and an exponent."""
    six = lambda c: F.format_string("%.6f", F.col(c).cast("double")).alias(f"{c}_loss")
    return means.select((F.col("epoch") + 1).alias("epoch"), *[six(m) for m in METRICS.values()], F.format_string("%.8e", F.col("lr")).alias("lr"))


def append_history(rows: DataFrame, path: str) -> None:
    """Append rows to a folder of CSV parts with headers; earlier epochs of a run, resumed or not, stay."""
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)  # one row per epoch


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key: an epoch that was run again is in the history twice."""
    return rows.withColumn("rank_", F.row_number().over(W.partitionBy(*key).orderBy(order.desc()))).where("rank_ = 1").drop("rank_")


def running_mean(rows: DataFrame, key: str, order: str, value: str, chunk: int = 4096) -> DataFrame:
    """rows with running: the mean of their key's values so far, in order of a whole number.

    Rows are summed up within stretches of `chunk` numbers; one row per stretch carries the sums over, so no task has all rows of a key.
    """
    part = F.floor(F.col(order) / chunk)
    sums = rows.groupBy(key, part.alias("chunk_")).agg(F.sum(value).alias("s_"), F.count(value).alias("n_"))
    before = W.partitionBy(key).orderBy("chunk_").rowsBetween(*PREVIOUS)
    sums = sums.select(key, "chunk_", F.coalesce(F.sum("s_").over(before), F.lit(0.0)).alias("s_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("n_"))
    so_far = W.partitionBy(key, "chunk_").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("chunk_", part).join(sums, [key, "chunk_"])
    return found.withColumn("running", (F.col("s_") + F.sum(value).over(so_far)) / (F.col("n_") + F.count(value).over(so_far))).drop("chunk_", "s_", "n_")


def checkpoint_name(prefix: str, epoch: Column, loss: Column) -> Column:
    return F.format_string(prefix + "-epoch=%02d-ssl_loss=%.2f.ckpt", epoch, loss)


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epoch_means(steps(spark, sf_dir))


def epoch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(spark, sf_dir).select("epoch", "n_steps", *[F.round(m, 6).alias(m) for m in METRICS.values()])


def loss_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _means(spark, sf_dir).withColumn("lr", F.lit(1e-4) * F.pow(F.lit(0.5), F.col("epoch")))
    return history_rows(m.select("epoch", "lr", *[F.round(x, 6).alias(x) for x in METRICS.values()]))


def checkpoint_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(spark, sf_dir).select("epoch", checkpoint_name("run", F.col("epoch"), F.round("total", 2)).alias("file"))


def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _means(spark, sf_dir).select("epoch", F.round("total", 6).alias("loss"))
    return m.select("epoch", "loss", is_best(F.col("loss"), F.col("epoch"), False).alias("is_best"))


def best_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy is probed every fifth epoch; in others nothing is best."""
    probe = (F.col("epoch") + 1) % 5 == 0
    m = _means(spark, sf_dir).select("epoch", F.when(probe, F.round(F.col("dino") / (F.col("dino") + 1), 6)).alias("knn_acc"))
    return m.select("epoch", "knn_acc", is_best(F.col("knn_acc"), F.col("epoch"), True).alias("is_best"))


def save_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs that are saved: every tenth, the last, and each that is best."""
    b = best_checkpoint(spark, sf_dir)
    last = F.max("epoch").over(W.partitionBy())
    return b.select("epoch", "is_best", (((F.col("epoch") + 1) % 10 == 0) | (F.col("epoch") == last) | F.col("is_best")).alias("saved"))


def running_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean so far within each epoch, as a progress bar shows it."""
    found = running_mean(steps(spark, sf_dir).where("metric = 'total'"), "epoch", "step", "value")
    return found.select("epoch", "step", (F.floor(F.col("running") * 1e6 + 0.5) / 1e6).alias("running"))


def log_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).where("step % 10 = 0").select("step", "metric", "value")


def history_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and day: the latest of those that were appended."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.dayofmonth("ts").alias("epoch"), "event_id", "value")
    return latest(e, ["user_id", "epoch"], F.col("event_id"))


QUERIES = {f.__name__: f for f in (epoch_metrics, loss_history, checkpoint_names, best_checkpoint, best_knn, save_epochs, running_loss, log_decimate, history_dedupe)}

_STEPS = "s AS (SELECT CAST(day(ts) - 1 AS INTEGER) AS epoch, event_id AS step, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METRICS.items()) + " END AS metric, value FROM events)"
_MEANS = f"WITH {_STEPS}, m AS (SELECT epoch, count(DISTINCT step) AS n_steps, " + ", ".join(f"coalesce(sum(value) FILTER (metric = '{m}'), 0) / count(DISTINCT step) AS {m}" for m in METRICS.values()) + " FROM s GROUP BY epoch)"
_BEST = f"{_MEANS}, l AS (SELECT epoch, round(total, 6) AS loss FROM m), b AS (SELECT epoch, loss, coalesce(loss < min(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM l)"

ORACLES = {
    "epoch_metrics": _MEANS + " SELECT epoch, n_steps, " + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS.values()) + " FROM m",
    "loss_history": _MEANS + " SELECT epoch + 1 AS epoch, " + ", ".join(f"printf('%.6f', round({m}, 6)) AS {m}_loss" for m in METRICS.values()) + ", printf('%.8e', 1e-4::DOUBLE * pow(0.5::DOUBLE, epoch)) AS lr FROM m",
    "checkpoint_names": _MEANS + " SELECT epoch, printf('run-epoch=%02d-ssl_loss=%.2f.ckpt', epoch, round(total, 2)) AS file FROM m",
    "best_checkpoint": _BEST + " SELECT epoch, loss, is_best FROM b",
    "best_knn": _MEANS + ", k AS (SELECT epoch, CASE WHEN (epoch + 1) % 5 = 0 THEN round(dino / (dino + 1), 6) END AS knn_acc FROM m), p AS (SELECT *, max(knn_acc) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k) SELECT epoch, knn_acc, coalesce(knn_acc > before, knn_acc IS NOT NULL AND before IS NULL) AS is_best FROM p",
    "save_epochs": _BEST + " SELECT epoch, is_best, (epoch + 1) % 10 = 0 OR epoch = max(epoch) OVER () OR is_best AS saved FROM b",
    "running_loss": f"WITH {_STEPS} SELECT epoch, step, floor(avg(value) OVER (PARTITION BY epoch ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS running FROM s WHERE metric = 'total'",
    "log_decimate": f"WITH {_STEPS} SELECT step, metric, value FROM s WHERE step % 10 = 0",
    "history_dedupe": "SELECT user_id, CAST(day(ts) AS INTEGER) AS epoch, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, day(ts)",
}
