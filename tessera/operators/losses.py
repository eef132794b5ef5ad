"""Objectives of self-distillation as queries: assignments, cross-view entropies, masked patches, Gram matrices.

A sample carries its views in one row, so pairs of views are formed inside the row.
Only what spans a batch (the assignment's sums, means) is shuffled, by batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bind, dot, l2_normalize, log_softmax, total
from ..functions.frames import written
from . import masks, similarity
from .assignment import balanced

DIM, GLOBALS, LOCALS, TOKENS, WIDTH = 64, 2, 8, 16, 4
STUDENT_TEMPERATURE, TEACHER_TEMPERATURE, SINKHORN_TEMPERATURE, ROUNDS = 0.1, 0.07, 0.07, 3


def sinkhorn(rows: DataFrame, batch: str, key: list[str], x: str, temperature: float = SINKHORN_TEMPERATURE, rounds: int = ROUNDS, keep: bool = False) -> DataFrame:
    """batch, key, q (and x, with keep): balanced assignment of a batch's rows to the places of the array x, an array per row.

    exp(x / temperature), the row's largest value taken off first, is scaled so that every place gets the same share of the
    batch and every row the same total, in turn; the result sums to 1 in each row.  A batch, a bounded number of
    rows, is one matrix in one task.  Rows without x are left out.
    """

    def balance(table: pa.Table) -> pa.Table:
        values = table.column(x).combine_chunks()
        m = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
        q = np.exp((m - m.max(1, keepdims=True)) / temperature)
        n, k = q.shape
        q /= q.sum()
        for _ in range(rounds):
            q /= q.sum(0, keepdims=True) * k
            q /= q.sum(1, keepdims=True) * n
        return table.select([batch, *key, *([x] if keep else [])]).append_column("q", pa.array(list(q * n), pa.list_(pa.float64())))

    given = rows.where(F.col(x).isNotNull()).select(batch, *key, x)
    schema = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in (batch, *key, *([x] if keep else [])))
    return given.groupBy(batch).applyInArrow(balance, f"{schema}, q array<double>")


def turned(x: Column | str, v: int) -> Column:
    """View v of a sample's vector: element k is element (k + v) mod DIM."""
    return F.concat(F.slice(x, v + 1, DIM), F.slice(x, 1, v)) if v else F.col(x) if isinstance(x, str) else x


def cross_entropies(students: Column, teachers: Column, skip_same: bool) -> Column:
    """Sum over pairs of a student's and a teacher's view of minus the products of targets and log-probabilities.

    students: array of arrays of log-probabilities, teachers: of targets.  skip_same leaves out pairs of equal number.
    """
    pair = lambda s, i: F.aggregate(F.transform(teachers, lambda t, j: F.when(F.lit(skip_same) & (i == j), F.lit(0.0)).otherwise(-dot(t, s))), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.transform(students, pair), F.lit(0.0), lambda a, x: a + x)


def n_pairs(students: int, teachers: int, skip_same: bool) -> int:
    return students * teachers - (min(students, teachers) if skip_same else 0)


def tokens(x: Column | str, by: int = 0) -> Column:
    """TOKENS patches of WIDTH values; by: how far the values are turned."""
    return F.transform(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda p: F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.get(x, (p * WIDTH + i + by) % DIM)))


def gram_loss(student: Column, teacher: Column, negatives: str = "keep") -> Column:
    """Mean squared difference of the products of all pairs of unit patches.

    negatives: keep; remove (products under 0 count as 0 on both sides); remove_teacher (on the
    teacher's side, and on the student's where the teacher's is under 0).
    """

    def difference(s: Column, t: Column) -> Column:
        zero = F.lit(0.0)
        if negatives == "remove":
            s, t = F.greatest(s, zero), F.greatest(t, zero)
        elif negatives == "remove_teacher":
            s, t = F.when((t < 0) & (s < 0), zero).otherwise(s), F.greatest(t, zero)
        return (s - t) * (s - t)

    def mean(s: Column, t: Column) -> Column:
        line = lambda i: total(F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda j: difference(dot(F.get(s, i), F.get(s, j)), dot(F.get(t, i), F.get(t, j)))))
        return total(F.transform(F.sequence(F.lit(0), F.size(s) - 1), line)) / (F.size(s) * F.size(s)).cast("double")

    unit = lambda x: F.transform(x, lambda v: l2_normalize(v))
    return bind(unit(student), lambda s: bind(unit(teacher), lambda t: mean(s, t)))


#: Values of a block of products that are summed up at once.
BLOCK = 1 << 16


def gram_batch_loss(rows: DataFrame, batch: str, student: str, teacher: str) -> DataFrame:
    """batch, n, loss over all pairs of patches of a batch, without forming one: the squared norm of S S' - T T' is
    |S'S|^2 + |T'T|^2 - 2 |S'T|^2, and these are sums of width x width products.

    Tasks multiply their patches as matrices, of any width; partial products are cut into blocks of lines and added up by place.
    A batch's patches have one width; null patches don't count.
    """

    def partial(batches):
        for b in batches:
            keys = b.column(batch).dictionary_encode()
            at = keys.indices.to_numpy(zero_copy_only=False)
            for k in np.unique(at):
                own = b.filter(pa.array(at == k))
                s, t = (_unit(own.column(c)) for c in ("s", "t"))
                for which, (x, y, sign) in enumerate(((s, s, 1.0), (t, t, 1.0), (s, t, -2.0))):
                    m = x.T @ y
                    lines = max(1, BLOCK // m.shape[1])
                    cut = [m[i : i + lines].ravel() for i in range(0, len(m), lines)]
                    n = len(cut)
                    yield pa.RecordBatch.from_arrays([pa.array([keys.dictionary[int(k)].as_py()] * n, keys.dictionary.type), pa.array([which] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([sign] * n), pa.array([len(s) if which == 0 and i == 0 else 0 for i in range(n)], pa.int64()), pa.array(cut, pa.list_(pa.float64()))], [batch, "which", "block", "sign", "n", "m"])

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table.column("m")[0].values))
        for chunk in table.column("m").chunks:
            total += chunk.flatten().to_numpy(zero_copy_only=False).reshape(len(chunk), -1).sum(0)
        square = table.column("sign")[0].as_py() * float(total @ total)
        return table.slice(0, 1).select([batch]).append_column("n", pa.array([sum(table.column("n").to_pylist())], pa.int64())).append_column("square", pa.array([square]))

    each = rows.select(batch, F.explode(F.arrays_zip(F.col(student).alias("s"), F.col(teacher).alias("t"))).alias("p")).select(batch, "p.s", "p.t").where("s IS NOT NULL AND t IS NOT NULL")
    kind = f"`{batch}` {rows.schema[batch].dataType.simpleString()}"
    sums = each.mapInArrow(partial, f"{kind}, which int, block int, sign double, n long, m array<double>").groupBy(batch, "which", "block").applyInArrow(added, f"{kind}, n long, square double")
    return sums.groupBy(batch).agg(F.sum("n").alias("n"), F.sum("square").alias("s")).select(batch, "n", (F.col("s") / (F.col("n") * F.col("n"))).alias("loss"))


def _unit(values: pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors; a row of zeros stays."""
    m = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(np.float64)
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)


# ---- queries ----


def _views(spark, sf_dir) -> DataFrame:
    return masks.samples(spark, sf_dir).select("vec_id", "batch", "x")


def _assigned(rows: DataFrame) -> DataFrame:
    """batch, vec_id, x and teachers: the assignments of both global views, made over the batch's views together."""
    two = rows.select("vec_id", "batch", F.inline(F.array(*[F.struct(F.lit(v).alias("view"), turned("x", v).alias("x")) for v in range(GLOBALS)])))
    rows = sinkhorn(two, "batch", ["vec_id", "view"], "x", keep=True)
    views = F.sort_array(F.collect_list(F.struct("view", "q", "x")))
    return rows.groupBy("batch", "vec_id").agg(F.transform(views, lambda s: s["q"]).alias("teachers"), F.get(views, F.lit(0))["x"].alias("x"))


def sinkhorn_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = _views(spark, sf_dir).select("vec_id", "batch", F.inline(F.array(*[F.struct(F.lit(v).alias("view"), turned("x", v).alias("x")) for v in range(GLOBALS)])))
    return sinkhorn(two, "batch", ["vec_id", "view"], "x").select("vec_id", "view", F.posexplode("q").alias("k", "q")).select("vec_id", "view", "k", F.round("q", 6).alias("q"))


def _dino(samples: DataFrame) -> DataFrame:
    """batch, g and l: the global and the local part, from one pass over the samples and their assignments."""
    rows = _assigned(samples)
    students = lambda first, n: F.array(*[log_softmax(turned("x", v), STUDENT_TEMPERATURE) for v in range(first, first + n)])
    part = lambda first, n, skip: bind(students(first, n), lambda s: cross_entropies(s, F.col("teachers"), skip))
    rows = rows.select("batch", part(0, GLOBALS, True).alias("g"), part(GLOBALS, LOCALS, False).alias("l"))
    mean = lambda c, n, skip: (F.sum(c) / (F.count(F.lit(1)) * n_pairs(n, GLOBALS, skip))).alias(c)
    return rows.groupBy("batch").agg(mean("g", GLOBALS, True), mean("l", LOCALS, False))


def dino_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dino(_views(spark, sf_dir)).select("batch", F.round("g", 6).alias("loss"))


def dino_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dino(_views(spark, sf_dir)).select("batch", F.round("l", 6).alias("loss"))


def _masked(samples: DataFrame) -> DataFrame:
    """batch, vec_id, view, patch, weight, student and teacher of every hidden patch of both views."""
    rows = masks.hidden(masks.slots(samples, ["vec_id"], "batch"), ["vec_id"]).where("n_target > 0")
    viewed = lambda by: F.when(F.col("view") == 0, tokens("x", by)).otherwise(tokens("x", by + 1))
    each = F.arrays_zip(F.col("mask"), viewed(0).alias("student"), viewed(1).alias("teacher"))
    rows = rows.select("batch", "vec_id", "view", masks.weight(F.col("mask")).alias("weight"), F.posexplode(each).alias("patch", "p")).where("p.mask")
    return rows.select("batch", "vec_id", "view", "patch", "weight", "p.student", "p.teacher")


def _ibot(samples: DataFrame) -> DataFrame:
    """batch, loss: the hidden patches of both views are pooled and assigned together."""
    rows = balanced(_masked(samples), "batch", ["vec_id", "view", "patch"], "teacher", TEACHER_TEMPERATURE, ROUNDS, ["weight", "student"])
    ce = -F.col("weight") * dot(F.col("q"), log_softmax(F.col("student"), STUDENT_TEMPERATURE))
    return rows.groupBy("batch").agg((F.sum(ce) / (GLOBALS * masks.BATCH)).alias("loss"))


def ibot_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assignment of every hidden patch, by place."""
    rows = balanced(_masked(_views(spark, sf_dir)), "batch", ["vec_id", "view", "patch"], "teacher", TEACHER_TEMPERATURE, ROUNDS)
    return rows.select("vec_id", "view", "patch", F.posexplode("q").alias("k", "q")).select("vec_id", "view", "patch", "k", F.round("q", 6).alias("q"))


def ibot_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All slots of both views count in the denominator, those without a mask too."""
    return _ibot(_views(spark, sf_dir)).select("batch", F.round("loss", 6).alias("loss"))


def masked_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden patches in order of view, sample and patch, by the mask that student and teacher share."""
    rows = masks.hidden(masks.slots(masks.samples(spark, sf_dir), ["vec_id"], "batch"), ["vec_id"])
    each = rows.select("vec_id", "view", F.posexplode(F.arrays_zip(F.col("mask"), tokens("x").alias("t"))).alias("patch", "p")).where("p.mask")
    return each.select("vec_id", "view", "patch", F.round(total(F.col("p.t")), 6).alias("total"))


def token_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first token, and the last twelve."""
    rows = _views(spark, sf_dir).select("vec_id", tokens("x").alias("t"))
    last = F.slice("t", -12, 12)
    return rows.select("vec_id", F.round(total(F.get("t", F.lit(0))), 6).alias("cls"), F.size(last).alias("n"), F.round(total(F.flatten(last)), 6).alias("patches"))


def _gram(negatives: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _views(spark, sf_dir).select("vec_id", tokens("x").alias("s"), tokens("x", 1).alias("t"))
        return rows.select("vec_id", F.round(gram_loss(F.col("s"), F.col("t"), negatives), 6).alias("loss"))

    return query


def _gram_batch(samples: DataFrame) -> DataFrame:
    return gram_batch_loss(samples.select("batch", tokens("x").alias("s"), tokens("x", 1).alias("t")), "batch", "s", "t")


def gram_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gram_batch(_views(spark, sf_dir)).select("batch", "n", F.round("loss", 6).alias("loss"))


def log_softmax_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", log_softmax(F.transform("embedding", lambda x: x.cast("double")), STUDENT_TEMPERATURE).alias("p"))
    return rows.select("vec_id", F.round(total(F.col("p")), 6).alias("total"), F.round(F.array_max("p"), 6).alias("most"))


def center_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running centre per place, 0 before: a tenth of the batch's mean."""
    rows = _views(spark, sf_dir).select("batch", F.posexplode("x").alias("k", "v"))
    return rows.groupBy("batch", "k").agg(F.round(F.avg("v") * 0.1, 8).alias("center"))


def total_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both cross-view parts by their share of pairs, masked patches, a tenth of the entropy part and all of the Gram part."""
    name = lambda df, c: df.select("batch", F.col("loss").alias(c))
    rows = written(_views(spark, sf_dir), "samples")  # read by all parts
    parts = [_dino(rows), name(_ibot(rows), "i"), name(similarity.koleo_of(rows), "e"), name(_gram_batch(rows), "m")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "batch")
    gg, lg = GLOBALS * (GLOBALS - 1), GLOBALS * LOCALS
    dino = F.lit(gg / (gg + lg)) * F.col("g") + F.lit(lg / (gg + lg)) * F.col("l")
    return out.select("batch", F.round(dino + F.col("i") + 0.1 * F.col("e") + F.col("m"), 5).alias("loss"))


QUERIES = {f.__name__: f for f in (dino_global, dino_local, ibot_targets, ibot_loss, masked_gather, token_slice, gram_batch, center_update, total_loss)} | {
    "sinkhorn": sinkhorn_query, "log_softmax": log_softmax_query, "gram_image": _gram("keep"), "gram_remove_neg": _gram("remove"), "gram_teacher_neg": _gram("remove_teacher"),
}


def _view_sql(x: str, v: str) -> str:
    return f"list_transform(range({DIM}), lambda k: {x}[(k + {v}) % {DIM} + 1])"


def _log_softmax_sql(x: str, t: float) -> str:
    return f"list_transform({x}, lambda a: (a - list_max({x})) / {t}::DOUBLE - ln(list_sum(list_transform({x}, lambda b: exp((b - list_max({x})) / {t}::DOUBLE)))))"


def _token_sql(x: str, p: str, by: str) -> str:
    return f"list_transform(range({WIDTH}), lambda i: {x}[(4 * {p} + i + {by}) % {DIM} + 1])"


_Q = [f"v AS (SELECT vec_id, batch, CAST(view AS INTEGER) AS view, {_view_sql('x', 'view')} AS x FROM s, range({GLOBALS}) r(view))", "e AS (SELECT vec_id, batch, view, CAST(k AS INTEGER) AS k, exp((x[k + 1] - list_max(x)) / 0.07::DOUBLE) AS q FROM v, range(64) r(k))", "q0 AS (SELECT * REPLACE (q / sum(q) OVER (PARTITION BY batch) AS q), count(*) OVER (PARTITION BY batch, k) AS n FROM e)"]
for _r in range(ROUNDS):
    _Q += [f"p{_r} AS (SELECT * REPLACE (q / (sum(q) OVER (PARTITION BY batch, k) * {DIM}) AS q) FROM q{_r})", f"q{_r + 1} AS (SELECT * REPLACE (q / (sum(q) OVER (PARTITION BY batch, vec_id, view) * n) AS q) FROM p{_r})"]
_SINKHORN = f"{masks.SAMPLES_SQL}, {', '.join(_Q)}, w AS (SELECT vec_id, batch, view, k, q * n AS q FROM q{ROUNDS})"


def _dino_sql(first: int, n: int, skip: bool) -> str:
    return f"""st AS (SELECT vec_id, batch, view, CAST(k AS INTEGER) AS k, l[k + 1] AS l FROM (SELECT vec_id, batch, view, {_log_softmax_sql("y", STUDENT_TEMPERATURE)} AS l FROM (SELECT vec_id, batch, CAST(view AS INTEGER) AS view, {_view_sql("x", "view")} AS y FROM s, range({first}, {first + n}) r(view))), range(64) r(k)),
dl AS (SELECT w.batch, -sum(w.q * st.l) / (count(DISTINCT w.vec_id) * {n_pairs(n, GLOBALS, skip)}) AS loss FROM w JOIN st ON w.vec_id = st.vec_id AND w.k = st.k {"AND w.view <> st.view" if skip else ""} GROUP BY w.batch)"""


_TOKENS = f"tk AS (SELECT vec_id, batch, CAST(p AS INTEGER) AS p, {_token_sql('x', 'p', '0')} AS a, {_token_sql('x', 'p', '1')} AS b, {_token_sql('x', 'p', '2')} AS c FROM s, range({TOKENS}) r(p))"
_UNITS = f"WITH {masks.SAMPLES_SQL}, {_TOKENS}, un AS (SELECT vec_id, batch, p, list_transform(a, lambda y: y / greatest(sqrt(list_inner_product(a, a)), 1e-12::DOUBLE)) AS a, list_transform(b, lambda y: y / greatest(sqrt(list_inner_product(b, b)), 1e-12::DOUBLE)) AS b FROM tk)"
_PAIRS = f"{_UNITS}, pr AS (SELECT x.vec_id, list_inner_product(x.a, y.a) AS s, list_inner_product(x.b, y.b) AS t FROM un x JOIN un y ON x.vec_id = y.vec_id)"
_IQ = ["i0 AS (SELECT *, q / sum(q) OVER (PARTITION BY batch) AS q0 FROM (SELECT vec_id, batch, view, patch, weight, y, CAST(k AS INTEGER) AS k, exp((z[k + 1] - list_max(z)) / 0.07::DOUBLE) AS q, count(*) OVER (PARTITION BY batch, k) AS n FROM pick, range(4) r(k)))"]
for _r in range(ROUNDS):
    _IQ += [f"j{_r} AS (SELECT * REPLACE (q{0} / (sum(q{0}) OVER (PARTITION BY batch, k) * {WIDTH}) AS q{0}) FROM i{_r})", f"i{_r + 1} AS (SELECT * REPLACE (q{0} / (sum(q{0}) OVER (PARTITION BY batch, vec_id, view, patch) * n) AS q{0}) FROM j{_r})"]
_TARGETS = f"""{masks.HIDDEN_SQL}, {_TOKENS}, pick AS (SELECT h.vec_id, h.batch, h.view, h.patch, h.weight, CASE WHEN h.view = 0 THEN tk.a ELSE tk.b END AS y, CASE WHEN h.view = 0 THEN tk.b ELSE tk.c END AS z FROM h JOIN tk ON tk.vec_id = h.vec_id AND tk.p = h.patch),
{", ".join(_IQ)}, it AS (SELECT vec_id, batch, view, patch, weight, y, k, q0 * n AS q FROM i{ROUNDS})"""
_IBOT = f"""{_TARGETS}, lp AS (SELECT batch, weight, k, q, {_log_softmax_sql("y", STUDENT_TEMPERATURE)} AS ls FROM it),
ib AS (SELECT batch, -sum(weight * q * ls[k + 1]) / {GLOBALS * masks.BATCH} AS loss FROM lp GROUP BY batch)"""

_GG, _LG = GLOBALS * (GLOBALS - 1), GLOBALS * LOCALS
_GLOBAL, _LOCAL = f"WITH {_SINKHORN}, {_dino_sql(0, GLOBALS, True)}", f"WITH {_SINKHORN}, {_dino_sql(GLOBALS, LOCALS, False)}"
_GRAM_BATCH = f"{_UNITS} SELECT x.batch, CAST(sqrt(count(*)) AS BIGINT) AS n, avg(pow(list_inner_product(x.a, y.a) - list_inner_product(x.b, y.b), 2)) AS loss FROM un x JOIN un y ON x.batch = y.batch GROUP BY x.batch"

ORACLES = {
    "sinkhorn": f"WITH {_SINKHORN} SELECT vec_id, view, k, round(q, 6) AS q FROM w",
    "dino_global": f"{_GLOBAL} SELECT batch, round(loss, 6) AS loss FROM dl",
    "dino_local": f"{_LOCAL} SELECT batch, round(loss, 6) AS loss FROM dl",
    "ibot_targets": f"WITH {_TARGETS} SELECT vec_id, view, patch, k, round(q, 6) AS q FROM it",
    "ibot_loss": f"WITH {_IBOT} SELECT batch, round(loss, 6) AS loss FROM ib",
    "masked_gather": f"WITH {masks.HIDDEN_SQL}, {_TOKENS} SELECT h.vec_id, h.view, h.patch, round(list_sum(tk.a), 6) AS total FROM h JOIN tk ON tk.vec_id = h.vec_id AND tk.p = h.patch",
    "token_slice": f"WITH {masks.SAMPLES_SQL} SELECT vec_id, round(list_sum(x[1:4]), 6) AS cls, 12 AS n, round(list_sum(x[17:64]), 6) AS patches FROM s",
    "gram_image": f"{_PAIRS} SELECT vec_id, round(avg(pow(s - t, 2)), 6) AS loss FROM pr GROUP BY vec_id",
    "gram_remove_neg": f"{_PAIRS} SELECT vec_id, round(avg(pow(greatest(s, 0) - greatest(t, 0), 2)), 6) AS loss FROM pr GROUP BY vec_id",
    "gram_teacher_neg": f"{_PAIRS} SELECT vec_id, round(avg(pow(CASE WHEN t < 0 THEN greatest(s, 0) ELSE s END - greatest(t, 0), 2)), 6) AS loss FROM pr GROUP BY vec_id",
    "gram_batch": f"SELECT batch, n, round(loss, 6) AS loss FROM ({_GRAM_BATCH})",
    "log_softmax": f"WITH l AS (SELECT vec_id, {_log_softmax_sql('y', STUDENT_TEMPERATURE)} AS p FROM (SELECT vec_id, embedding::DOUBLE[] AS y FROM embeddings)) SELECT vec_id, round(list_sum(p), 6) AS total, round(list_max(p), 6) AS most FROM l",
    "center_update": f"WITH {masks.SAMPLES_SQL}, c AS (SELECT batch, CAST(k AS INTEGER) AS k, x[k + 1] AS v FROM s, range(64) r(k)) SELECT batch, k, round(avg(v) * 0.1::DOUBLE, 8) AS center FROM c GROUP BY batch, k",
    "total_loss": f"""SELECT batch, round({_GG / (_GG + _LG)}::DOUBLE * g.loss + {_LG / (_GG + _LG)}::DOUBLE * l.loss + i.loss + 0.1::DOUBLE * e.loss + m.loss, 5) AS loss
FROM ({_GLOBAL} SELECT batch, loss FROM dl) g JOIN ({_LOCAL} SELECT batch, loss FROM dl) l USING (batch) JOIN (WITH {_IBOT} SELECT batch, loss FROM ib) i USING (batch) JOIN ({similarity.ORACLES["koleo"]}) e USING (batch) JOIN ({_GRAM_BATCH}) m USING (batch)""",
}
