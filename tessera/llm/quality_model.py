"""Quality classifier with hierarchical empirical Bayes over sites.

A document's own evidence is the sum of log likelihood ratios of binned measures of its text,
learned from labelled documents (each judged without its own label) and put on the scale of log-odds by a logistic fit over the
binned sums.  A host's share of good documents is shrunk toward the share of all, a path's toward its
host's; the strengths of both come from the spread between hosts and between paths by the
method of moments, so a site with little evidence says little.  A labelled document counts in
full, one without a label by its own evidence and at a discount; nothing counts for itself.

All statistics are grouped sums over all documents.  The driver sees bins and strengths only, whose
number doesn't depend on the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, fresh, table, written
from .quality_rules import measure

BINS = 12
#: What a document without a label weighs in its site's share.
UNLABELLED = 0.25
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 10_000.0
#: A document is kept from this score on: losing a good one costs more than keeping a bad one.
KEPT_FROM = 0.3
#: Up to this many sites (some 100 bytes each) are sent to every executor; beyond, each site's rows meet it in SALTS parts.
BROADCAST_SITES, SALTS = 200_000, 32
PARTS = ("symbols", "capitals", "wide", "repeated", "lines", "common", "marks", "length", "words")


def site(url: Column) -> tuple[Column, Column]:
    """Host (without www.) and first part of the path of a URL; null where it has none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)
    return F.when(host != "", host), F.when(path != "", path)


def bins(name: dict[str, str]) -> Column:
    """An array with one bin number (0 to BINS - 1) for each of PARTS."""
    c = lambda x: F.col(name[x]).cast("double")
    each = lambda i: F.get(F.col(name["classes"]), F.lit(i)).cast("double")
    chars, n = F.greatest(c("word_chars"), F.lit(1.0)), F.greatest(c("n_words"), F.lit(1.0))
    common = F.aggregate(F.col(name["counts"]), F.lit(0).cast("long"), lambda a, s: a + s["c"]) / n
    small = lambda x: F.ceil(F.lit(BINS - 1.0) + F.log2(F.greatest(x, F.lit(1e-9))))  # noqa: E731  shares near 0 apart
    even = lambda x: F.floor(x * BINS)
    raw = [small(c("n_symbols") / chars), small(each(0) / chars), even(each(5) / chars * 2), even(c("n_repeat_words") / n), even(c("n_dup_lines") / n * 10), even(common * 1.5), small(each(3) / chars), F.floor(F.log2(n + 1)), even((chars / n - 2) / 10)]
    return F.array(*[F.least(F.lit(BINS - 1), F.greatest(F.lit(0), x)).cast("int") for x in raw])


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def _evidence(found: DataFrame, bin_: str, label: str) -> tuple[Column, float]:
    """The calibrated log likelihood ratio of a row's bins, and the share of label 1 among labelled rows.

    A labelled row is taken out of the counts that its own ratio comes from.
    """
    known = found.where(F.col(label).isNotNull())
    counts = {(r["part"], r["bin"]): (r["good"], r["bad"]) for r in known.select(label, F.posexplode(bin_).alias("part", "bin")).groupBy("part", "bin").agg(F.sum(label).alias("good"), F.sum(1 - F.col(label)).alias("bad")).collect()}
    good, bad = (sum(v[k] for (p, _), v in counts.items() if p == 0) for k in (0, 1))

    def ratio(p: int, b: int, own: int | None) -> float:
        g, w = counts.get((p, b), (0, 0))
        less = (own == 1, own == 0)
        return math.log((max(0, g - less[0]) + 0.5) / (max(0, good - less[0]) + 0.5 * BINS)) - math.log((max(0, w - less[1]) + 0.5) / (max(0, bad - less[1]) + 0.5 * BINS))

    def sums(own: int | None) -> Column:
        return sum((F.get(F.array(*[F.lit(ratio(p, b, own)) for b in range(BINS)]), F.get(F.col(bin_), F.lit(p))) for p in range(len(PARTS))), F.lit(0.0))

    total = F.when(F.col(label) == 1, sums(1)).when(F.col(label) == 0, sums(0)).otherwise(sums(None))
    share = (good + 1) / (good + bad + 2)
    # the sum overstates what parts that go together say: fit log-odds = prior + a * sum
    rows = known.groupBy(F.round(total, 1).alias("x")).agg(F.sum(label).alias("good"), F.count(F.lit(1)).alias("n")).collect()
    a, prior = 1.0, math.log(share / (1 - share))
    for _ in range(30):
        slope, bend = 0.0, 1e-3
        for r in sorted(rows, key=lambda r: r["x"]):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, prior + a * r["x"]))))
            slope += (r["good"] - r["n"] * p) * r["x"]
            bend += r["n"] * p * (1 - p) * r["x"] ** 2
        a = max(0.05, min(1.5, a + max(-0.5, min(0.5, slope / bend))))
    return F.lit(a) * total, share


def _strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo-counts of the prior: mean (1 - mean) over the spread of shares beyond what chance makes, minus 1."""
    p, n = F.col("good") / F.col("n"), F.col("n")
    r = groups.where(n > 0).agg(F.sum(n * (p - mean) ** 2).alias("spread"), F.sum(mean * (1 - mean)).alias("chance"), F.sum(n).alias("n"), F.avg(mean * (1 - mean)).alias("most")).first()
    if not r["n"] or not r["most"]:
        return MOST_STRENGTH
    beyond = max(0.0, (r["spread"] - r["chance"]) / r["n"])
    return MOST_STRENGTH if beyond <= 0 else min(MOST_STRENGTH, max(LEAST_STRENGTH, r["most"] / beyond - 1))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", key: str = "doc_id", text: str = "text", label: str = "quality", without: tuple[str, ...] = ()) -> DataFrame:
    """docs with doc_odds, host_share, path_share, quality_score (0 to 1) and kept (score >= KEPT_FROM).

    Columns of docs with these names are replaced; those in `without` are left out.  Null hosts
    and paths are sites of their own.  A key with several labels counts as good if one of
    them is; rows that repeat a key share its label.  Null and empty texts have bins like others.
    Without labels all scores are 0.5.  An empty table gives an empty result.
    """
    made = ("doc_odds", "host_share", "path_share", "quality_score", "kept")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    measured, name = measure(dealt(docs), text)
    bin_, mark, odds, w, v = (fresh(measured, x) for x in ("qm_bins", "qm_label", "qm_odds", "qm_weight", "qm_value"))
    h, p, n, good, hn, hgood, mean_, own, its, host_of, path_of = (fresh(measured, f"qm_{x}") for x in ("host", "path", "n", "good", "host_n", "host_good", "mean", "key", "own_key", "of_host", "of_path"))
    plain = lambda x: F.col(f"`{x}`")
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias(own)).agg(F.max(label).cast("int").alias(mark))
    stays = [plain(c) for c in docs.columns if c not in without]
    found = measured.withColumn(bin_, bins(name)).select(*stays, *[plain(c).alias(x) for c, x in ((host, h), (path, p))], plain(key).alias(its), bin_)
    found = written(found.join(known, F.col(its) == F.col(own), "left").drop(own, its), "bins")
    ratio, share = _evidence(found, bin_, mark)
    prior = math.log(share / (1 - share))
    found = found.withColumn(odds, ratio)
    weight = F.when(F.col(mark).isNotNull(), F.lit(1.0)).otherwise(F.lit(UNLABELLED))
    value = F.coalesce(F.col(mark).cast("double"), 1 / (1 + F.exp(-(F.col(odds) + prior))))
    found = found.withColumns({w: weight, v: weight * value})
    paths = written(found.groupBy(h, p).agg(F.sum(w).alias(n), F.sum(v).alias(good)), "paths")
    hosts = written(paths.groupBy(h).agg(F.sum(n).alias(n), F.sum(good).alias(good)), "hosts")
    total = hosts.agg(F.sum(good).alias("good"), F.sum(n).alias("n")).first()
    mean = (total["good"] / total["n"]) if total["n"] else 0.5
    at_host = _strength(hosts.select(F.col(n).alias("n"), F.col(good).alias("good")), F.lit(mean))
    shrunk = hosts.select(F.col(h).alias(host_of), F.col(n).alias(hn), F.col(good).alias(hgood))
    both = paths.join(shrunk, F.col(h).eqNullSafe(F.col(host_of))).drop(host_of).withColumn(mean_, (F.col(hgood) + at_host * mean) / (F.col(hn) + at_host))
    at_path = _strength(both.select(F.col(n).alias("n"), F.col(good).alias("good"), F.col(mean_).alias("mean")), F.col("mean"))
    both = written(both.withColumnsRenamed({h: host_of, p: path_of}), "sites")
    at = F.col(h).eqNullSafe(F.col(host_of)) & F.col(p).eqNullSafe(F.col(path_of))
    if both.count() <= BROADCAST_SITES:
        out = found.join(F.broadcast(both), at)
    else:  # rows of a site are split, so a hot one isn't one task's
        salt, part = fresh(measured, "qm_salt"), fresh(measured, "qm_part")
        both = both.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = found.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(both, at & (F.col(salt) == F.col(part)))
    # without the document's own part
    host_share = (F.col(hgood) - F.col(v) + at_host * mean) / (F.col(hn) - F.col(w) + at_host)
    out = out.withColumn("host_share", host_share).withColumn("path_share", (F.col(good) - F.col(v) + at_path * F.col("host_share")) / (F.col(n) - F.col(w) + at_path))
    out = out.withColumn("doc_odds", F.col(odds)).withColumn("quality_score", 1 / (1 + F.exp(-(F.col("doc_odds") + _logit(F.col("path_share"))))))
    return out.withColumn("kept", F.col("quality_score") >= KEPT_FROM).select(*stays, *made)


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, the verdict and what both come from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = classify(docs, table(spark, sf_dir, "labels"), without=("text",))
    return found.select("doc_id", "quality_score", "kept", "doc_odds", "host_share", "path_share")


QUERIES = {"op4_quality_model": op4_quality_model}
