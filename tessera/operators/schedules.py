"""Training schedules as closed forms over a table of iterations, and parameter groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# ---- schedules -------------------------------------------------------------------------------


def iterations(spark: SparkSession, epochs: int, iters: int) -> DataFrame:
    """step (from 0) and epoch of a run."""
    return spark.range(epochs * iters).select(F.col("id").alias("step"), F.floor(F.col("id") / iters).cast("int").alias("epoch"))


def cosine_between(i: Column, n: int, base: float, final: float) -> Column:
    """From base at 0 to final at n along half a cosine."""
    return F.lit(final) - F.lit(final - base) * (F.cos(F.lit(math.pi) * i / F.lit(float(max(1, n)))) + 1) / 2


def learning_rate(i: Column, kind: str, base: float, base_lr: float, warmup: int, n: int) -> Column:
    """Rate of a group at iteration i.

    cosine_warmup: from 1 % to base over the warm-up, then along a cosine to 1 % of base_lr, one floor for
    all groups.  linear_decay: from base to 1 % of it at n.  exponential_decay: 5 % less every iteration.
    Anything else stays at base.
    """
    if kind == "cosine_warmup":
        floor = 0.01 * base_lr
        down = F.lit(floor) + F.lit(base - floor) * (1 + F.cos(F.lit(math.pi) * (i - warmup) / float(max(1, n - warmup)))) / 2
        return F.when(i < warmup, F.lit(base) * (0.01 + 0.99 * i / float(max(1, warmup)))).otherwise(down)
    if kind == "linear_decay":
        return F.lit(base) * (1 - 0.99 * F.least(i, F.lit(n)) / float(n))
    if kind == "exponential_decay":
        return F.lit(base) * F.pow(F.lit(0.95), i)
    return F.lit(base)


def teacher_temperature(i: Column, warmup: int, target: float, start: float = 0.04) -> Column:
    return F.when(i >= warmup, F.lit(target)).otherwise(F.lit(start) + F.lit(target - start) * i / float(max(1, warmup)))


def gram_weight(epoch: Column, base: float, start: int, end: int) -> Column:
    """From 10 % of base at start to all of it at end."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (epoch - start) / float(max(1, end - start))))
    return F.when(epoch < end, F.lit(base) * (0.1 + 0.9 * p)).otherwise(F.lit(base))


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = iterations(spark, 10, 20)
    kinds = ("cosine_warmup", "linear_decay", "exponential_decay", "constant")
    return t.select("step", *[F.round(learning_rate(F.col("step"), k, 2e-4, 1e-4, 40, 200), 12).alias(k) for k in kinds])


def temp_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterations(spark, 10, 20).select("step", F.round(teacher_temperature(F.col("step"), 40, 0.07), 10).alias("temperature"))


def tau_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterations(spark, 10, 20).select("step", F.round(cosine_between(F.col("step"), 200, 0.996, 1.0), 10).alias("tau"))


def wd_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the training loop has it, every group gets the current decay, exempt or not; `exempt` is what was meant for the others."""
    t = iterations(spark, 10, 20).withColumn("decay", F.round(cosine_between(F.col("step"), 200, 0.04, 0.4), 10))
    return t.select("step", "decay", F.lit(0.0).alias("exempt"))


def gram_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fresh run ramps up over epochs 0 to 5, one that was resumed at 4 over nine epochs from there."""
    t = spark.range(20).select(F.col("id").cast("int").alias("epoch"))
    return t.select("epoch", F.round(gram_weight(F.col("epoch"), 2.0, 0, 5), 10).alias("fresh"), F.round(gram_weight(F.col("epoch"), 2.0, 4, 13), 10).alias("resumed"))


# ---- parameters ------------------------------------------------------------------------------

#: What marks an embedding's parameter, and a parameter that isn't decayed.
EMBEDDING = ("pos_embed", "patch_embed", "mask_token", "cls_token", "storage_tokens", "embeddings")
UNDECAYED = ("bias", "norm", "gamma", "fourier_w")
PARAMETERS = [
    ("embeddings.patch_embeddings.weight", 4, True, True), ("backbone.blocks.0.attn.weight", 2, True, True), ("encoder.layer.11.norm.bias", 1, True, True),
    ("layer.3.mlp.weight", 2, True, True), ("m.blocks.x.w", 2, True, True), ("dino_head.last_layer.weight", 2, True, True), ("cls_token", 3, True, True),
    ("backbone.blocks.5.norm1.weight", 1, True, True), ("frozen.blocks.2.attn.weight", 2, False, True), ("_orig_mod.backbone.blocks.0.attn.weight", 2, True, False),
]


def parameters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PARAMETERS, "name string, n_dims int, requires_grad boolean, is_leaf boolean")


def layer_decay(name: Column, rate: float, n_layers: int) -> Column:
    """rate^(n_layers + 1 - layer): 0 for embeddings, 1 + its number for a block or layer in a path, else n_layers + 1."""
    low = F.lower(name)
    embedding = F.lit(False)
    for x in EMBEDDING:
        embedding |= low.contains(x)
    number = lambda x: F.expr(f"try_cast(regexp_extract(split_part(name_, '.{x}.', 2), '^[^.]*', 0) AS int)")
    block = F.when(name.contains(".blocks."), number("blocks")).when(name.contains(".layer."), number("layer"))
    layer = F.when(embedding, F.lit(0)).otherwise(F.coalesce(block + 1, F.lit(n_layers + 1)))
    return F.pow(F.lit(rate), n_layers + 1 - layer)


def grouped(params: DataFrame, rate: float = 0.98, n_layers: int = 12, head: float = 5.0, patch: float = 0.2) -> DataFrame:
    """name, lr_mult and wd_mult of the parameters that are trained."""
    p = params.where("requires_grad AND is_leaf").withColumn("name_", F.col("name"))
    low = F.lower("name")
    lr = layer_decay(F.col("name_"), rate, n_layers) * F.when(low.contains("patch_embed"), F.lit(patch)).otherwise(1.0)
    bare = F.col("n_dims") == 1
    for x in UNDECAYED:
        bare |= low.contains(x)
    return p.select("name", F.when(F.col("name").contains("dino_head") | F.col("name").contains("ibot_head"), F.lit(head)).otherwise(lr).alias("lr_mult"), F.when(bare, 0.0).otherwise(1.0).alias("wd_mult"))


def param_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped(parameters(spark)).select("name", F.round("lr_mult", 10).alias("lr_mult"), "wd_mult")
    return rows.groupBy("lr_mult", "wd_mult").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


def lr_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parameters(spark).withColumn("name_", F.col("name")).select("name", F.round(layer_decay(F.col("name_"), 0.98, 12), 10).alias("decay"))


def strip_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parameters(spark).select("name", F.regexp_replace("name", r"^_orig_mod\.", "").alias("stripped"))


def matched(wanted: DataFrame, given: DataFrame) -> DataFrame:
    """name, state of the parameters (name, shape) that a load can't use: missing, unexpected, or of another shape."""
    w, g = wanted.select("name", F.col("shape").alias("of_")), given.select("name", F.col("shape").alias("has_"))
    both = w.withColumn("w_", F.lit(True)).join(g.withColumn("g_", F.lit(True)), "name", "full")
    state = F.when(F.col("g_").isNull(), "missing").when(F.col("w_").isNull(), "unexpected").when(~F.col("of_").eqNullSafe(F.col("has_")), "shape")
    return both.select("name", state.alias("state")).where("state IS NOT NULL")


def state_dict_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load of some parameters, one of them reshaped, can't use."""
    p = parameters(spark).withColumn("shape", F.array("n_dims"))
    wanted = p.select(F.regexp_replace("name", r"^_orig_mod\.", "").alias("name"), "shape").distinct()
    given = p.where("n_dims > 1").select("name", F.when(F.col("name") == "m.blocks.x.w", F.array(F.lit(3))).otherwise(F.col("shape")).alias("shape"))
    return matched(wanted, given.union(spark.createDataFrame([("extra.weight", [2])], "name string, shape array<int>")))


def ema_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teacher and student, joined by name: teacher * tau + student * (1 - tau), element by element."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    student, teacher = e.select(F.concat(F.lit("p"), "vec_id").alias("name"), "v"), e.select(F.concat(F.lit("p"), "vec_id").alias("name"), F.reverse("v").alias("t"))
    mixed = teacher.join(student, "name").select("name", F.zip_with("t", "v", lambda t, s: t * 0.996 + s * (1 - 0.996)).alias("w"))
    return mixed.select("name", F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("w", F.lit(0)), 8).alias("first"))


def ema(rows: DataFrame, key: str, order: str, value: str, keep: float = 0.9, chunk: int = 4096) -> DataFrame:
    """key, ema: a value per key, from 0, that every row changes to value * keep + new * (1 - keep), in order of a unique whole number.

    The fold is linear, so a stretch of `chunk` numbers is folded for itself, and stretches are added up with
    the weight that the rows behind them leave: no key has all its rows in one row, however many there are.
    """
    part = rows.groupBy(key, F.floor(F.col(order) / chunk).alias("chunk_")).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"]).alias("v_"))
    part = part.select(key, "chunk_", F.size("v_").alias("n_"), F.aggregate("v_", F.lit(0.0), lambda t, s: t * F.lit(keep) + s * F.lit(1 - keep)).alias("e_"))
    behind = F.coalesce(F.sum("n_").over(W.partitionBy(key).orderBy(F.desc("chunk_")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return part.withColumn("e_", F.col("e_") * F.pow(F.lit(keep), behind)).groupBy(key).agg(F.sum("e_").alias("ema"))


def ema_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value per user, updated by every event in order of its id."""
    return ema(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "event_id", "value").select("user_id", F.round("ema", 6).alias("ema"))


def clip_grad_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One factor for all gradients of a step (here a batch of vectors) so that their norm is at most 3."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / 32).cast("long").alias("step"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("s"))
    n = e.groupBy("step").agg(F.sqrt(F.sum("s")).alias("norm"))
    return n.select("step", F.round("norm", 6).alias("norm"), F.round(F.least(F.lit(1.0), 3.0 / (F.col("norm") + 1e-6)), 6).alias("factor"))


def finite_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps whose gradient norm is neither NaN nor infinite."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    x = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).when(F.col("event_id") % 89 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    e = e.select("event_id", x.alias("norm"))
    return e.where(~(F.isnan("norm") | (F.abs("norm") == float("inf")))).select("event_id", F.round("norm", 6).alias("norm"))


QUERIES = {f.__name__: f for f in (lr_schedule, temp_schedule, tau_schedule, wd_schedule, gram_ramp, param_groups, lr_decay, strip_prefix, state_dict_diff, ema_update, ema_fold, clip_grad_norm, finite_guard)}

_PARAMETERS = "(VALUES " + ", ".join(f"('{n}', {d}, {g}, {leaf})" for n, d, g, leaf in PARAMETERS) + ") AS t(name, n_dims, requires_grad, is_leaf)"
_EMBEDDING = " OR ".join(f"contains(lower(name), '{x}')" for x in EMBEDDING)
_LAYER = f"CASE WHEN {_EMBEDDING} THEN 0 ELSE coalesce(CASE WHEN contains(name, '.blocks.') THEN try_cast(split_part(split_part(name, '.blocks.', 2), '.', 1) AS INTEGER) WHEN contains(name, '.layer.') THEN try_cast(split_part(split_part(name, '.layer.', 2), '.', 1) AS INTEGER) END + 1, 13) END"
_DECAY = f"pow(0.98::DOUBLE, 13 - ({_LAYER}))"

ORACLES = {
    "lr_schedule": """SELECT i AS step, round(CASE WHEN i < 40 THEN 2e-4::DOUBLE * (0.01::DOUBLE + 0.99::DOUBLE * i / 40) ELSE 1e-6::DOUBLE + (2e-4::DOUBLE - 1e-6::DOUBLE) * (1 + cos(pi() * (i - 40) / 160)) / 2 END, 12) AS cosine_warmup,
round(2e-4::DOUBLE * (1 - 0.99::DOUBLE * least(i, 200) / 200), 12) AS linear_decay, round(2e-4::DOUBLE * pow(0.95::DOUBLE, i), 12) AS exponential_decay, round(2e-4::DOUBLE, 12) AS constant FROM range(200) t(i)""",
    "temp_schedule": "SELECT i AS step, round(CASE WHEN i >= 40 THEN 0.07::DOUBLE ELSE 0.04::DOUBLE + 0.03::DOUBLE * i / 40 END, 10) AS temperature FROM range(200) t(i)",
    "tau_schedule": "SELECT i AS step, round(1.0::DOUBLE - 0.004::DOUBLE * (cos(pi() * i / 200) + 1) / 2, 10) AS tau FROM range(200) t(i)",
    "wd_schedule": "SELECT i AS step, round(0.4::DOUBLE - 0.36::DOUBLE * (cos(pi() * i / 200) + 1) / 2, 10) AS decay, 0.0::DOUBLE AS exempt FROM range(200) t(i)",
    "gram_ramp": "SELECT i::INTEGER AS epoch, round(CASE WHEN i < 5 THEN 2.0::DOUBLE * (0.1::DOUBLE + 0.9::DOUBLE * i / 5) ELSE 2.0::DOUBLE END, 10) AS fresh, round(CASE WHEN i < 13 THEN 2.0::DOUBLE * (0.1::DOUBLE + 0.9::DOUBLE * least(1, greatest(0, (i - 4) / 9.0::DOUBLE))) ELSE 2.0::DOUBLE END, 10) AS resumed FROM range(20) t(i)",
    "param_groups": f"""WITH p AS (SELECT name, CASE WHEN contains(name, 'dino_head') OR contains(name, 'ibot_head') THEN 5.0::DOUBLE ELSE {_DECAY} * CASE WHEN contains(lower(name), 'patch_embed') THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END END AS lr, CASE WHEN n_dims = 1 OR {" OR ".join(f"contains(lower(name), '{x}')" for x in UNDECAYED)} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS wd_mult FROM {_PARAMETERS} WHERE requires_grad AND is_leaf)
SELECT round(lr, 10) AS lr_mult, wd_mult, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM p GROUP BY round(lr, 10), wd_mult""",
    "lr_decay": f"SELECT name, round({_DECAY}, 10) AS decay FROM {_PARAMETERS}",
    "strip_prefix": f"SELECT name, regexp_replace(name, '^_orig_mod\\.', '') AS stripped FROM {_PARAMETERS}",
    "state_dict_diff": f"""WITH p AS (SELECT * FROM {_PARAMETERS}), w AS (SELECT DISTINCT regexp_replace(name, '^_orig_mod\\.', '') AS name, n_dims AS s FROM p), g AS (SELECT name, CASE WHEN name = 'm.blocks.x.w' THEN 3 ELSE n_dims END AS s FROM p WHERE n_dims > 1 UNION ALL SELECT 'extra.weight', 2)
SELECT name, CASE WHEN g.s IS NULL THEN 'missing' WHEN w.s IS NULL THEN 'unexpected' ELSE 'shape' END AS state FROM w FULL JOIN g USING (name) WHERE g.s IS DISTINCT FROM w.s""",
    "ema_update": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_reverse(embedding::DOUBLE[]) AS t FROM embeddings), m AS (SELECT vec_id, list_transform(v, lambda s, i: t[i] * 0.996::DOUBLE + s * (1 - 0.996::DOUBLE)) AS w FROM e) SELECT 'p' || vec_id AS name, round(list_sum(w), 6) AS total, round(w[1], 8) AS first FROM m",
    "ema_fold": "SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY event_id)), lambda t, s: t * 0.9::DOUBLE + s * 0.1::DOUBLE), 6) AS ema FROM events GROUP BY user_id",
    "clip_grad_norm": "WITH n AS (SELECT vec_id // 32 AS step, sqrt(sum(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS n FROM embeddings GROUP BY vec_id // 32) SELECT step, round(n, 6) AS norm, round(least(1.0::DOUBLE, 3.0::DOUBLE / (n + 1e-6::DOUBLE)), 6) AS factor FROM n",
    "finite_guard": "SELECT event_id, round(value, 6) AS norm FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0",
}
