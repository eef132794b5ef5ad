"""Toxicity by the nearest labelled examples.

Examples are TF-IDF vectors over all words and word beginnings that, in the labelled sample, go with
label 1 beyond chance; document frequencies are counted over all documents.  The vectors
lie in an inverted index whose postings are cut into blocks of examples; each term knows
its largest weight in every block.  A text's bound for a block is the sum of its weights times
these; blocks whose bound is below the k-th best cosine so far aren't read, so the k nearest
are exact.  Votes are weighted by cosine and by how many labelled rows an example stands for, and
then calibrated on the examples themselves, each judged without itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .arrays import Spans, joined, pieces, runs, split
from .common import dealt, named, plain_names, table, written
from .language import held_out

#: The documented bounds of the labelled sample, by label.
EXAMPLES = {1: 5000, 0: 7000}
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes
NEIGHBOURS, BLOCK, FIRST_BLOCKS, PRIOR_VOTES = 15, 64, 4, 0.5
#: A term goes with label 1 if its share there is so many times as large and the log-likelihood gain of knowing it, in nats,
#: is so large: by chance, about one term in ten billion reaches that.
MIN_GAIN, MIN_RATIO = 20.0, 2.0
_SEPARATES = np.array([not (chr(i).isalnum() if i < 128 else True) for i in range(256)])


def terms(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, term) of every word and word beginning, with repeats."""
    data, starts = joined([(t or "").lower().encode("utf-8", "replace") for t in texts])
    a, b = split(data, _SEPARATES)
    spans = Spans(data)
    doc = np.searchsorted(starts, a, "right") - 1
    docs, found = [doc], [spans.hash(a, b)]
    for k in BEGINNINGS:
        long = b - a > k
        docs.append(doc[long])
        found.append(spans.hash(a[long], a[long] + k) ^ np.uint64(k))
    return np.concatenate(docs), np.concatenate(found).astype(np.int64)


def _counted(docs: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) and how often."""
    order = np.lexsort((found, docs))
    docs, found = docs[order], found[order]
    if not len(docs):
        return docs, found, docs
    new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (found[1:] != found[:-1])])
    at = np.flatnonzero(new)
    return docs[at], found[at], np.diff(at, append=len(docs))


class Index:
    """Examples' vectors as block-max postings, and what turns votes into scores."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, ids: list, labels: np.ndarray, weights: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray):
        self.vocabulary, self.idf = vocabulary, idf
        self.known = np.zeros(1 << 16, bool)
        self.known[vocabulary & 0xFFFF] = True
        self.ids, self.labels, self.weights = ids, labels.astype(float), weights
        doc, term, value = self._weighted(doc, term, count)
        order = np.lexsort((doc, term))
        self.example, self.value, of = doc[order], value[order], term[order]
        self.blocks = -(-max(1, len(ids)) // BLOCK)
        #: where the postings of a term in a block begin; the last column is the term's end
        at = of * self.blocks + self.example // BLOCK
        edge = np.searchsorted(at, np.arange(len(vocabulary) * self.blocks + 1))
        self.begin = np.concatenate([edge[:-1].reshape(-1, self.blocks), edge[self.blocks :: self.blocks, None]], axis=1)
        self.largest = np.zeros((len(vocabulary), self.blocks))
        np.maximum.at(self.largest, (of, self.example // BLOCK), self.value)
        total = float(weights.sum())
        self.prior = float((weights * self.labels).sum() / total) if total else 0.0
        empty = np.ones(len(ids), bool)
        empty[doc] = False
        self.alone = float(((weights * self.labels)[empty].sum() + PRIOR_VOTES * self.prior) / (weights[empty].sum() + PRIOR_VOTES)) if total else 0.0
        self.a, self.b = 1.0, 0.0
        self._calibrate(doc, term, value, empty)

    def _weighted(self, doc, term, count):
        value = (1 + np.log(count)) * self.idf[term]
        norm = np.sqrt(np.bincount(doc, value**2, (int(doc[-1]) + 1) if len(doc) else 0))
        return doc, term, value / norm[doc] if len(doc) else value

    def vectors(self, texts: list):
        """(text, term of the vocabulary, weight) of texts, each of length 1."""
        return self._weighted(*self.counts(texts))

    def counts(self, texts: list):
        """(text, term of the vocabulary, how often) of texts."""
        doc, found = terms(texts)
        maybe = self.known[found & 0xFFFF]
        doc, found = doc[maybe], found[maybe]
        at = np.searchsorted(self.vocabulary, found)
        there = (at < len(self.vocabulary)) & (self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == found) if len(self.vocabulary) else np.zeros(len(found), bool)
        return _counted(doc[there], at[there])

    def nearest(self, term: np.ndarray, weight: np.ndarray, without: int = -1, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above 0 (ties: the first), and their cosines."""
        bound = weight @ self.largest[term]
        first = np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]
        first = first[bound[first] > 0]
        who, cosine = self._sums(term, weight, first, without)
        least = np.partition(cosine, -k)[-k] if len(cosine) >= k else 0.0
        more = (bound >= least - 1e-9) & (bound > 0)
        more[first] = False
        if more.any():
            others, theirs = self._sums(term, weight, np.flatnonzero(more), without)
            who, cosine = np.concatenate([who, others]), np.concatenate([cosine, theirs])
        best = np.lexsort((who, -np.round(cosine, 9)))[:k]
        return who[best], cosine[best]

    def _sums(self, term, weight, blocks, without):
        """The cosines of the examples of some blocks, from their postings alone."""
        a, n = self.begin[term[:, None], blocks], self.begin[term[:, None], blocks + 1] - self.begin[term[:, None], blocks]
        part, a, n = np.repeat(weight, n.sum(1)), a.ravel(), n.ravel()
        at = np.arange(len(part)) + np.repeat(a - (np.cumsum(n) - n), n)
        who, back = np.unique(self.example[at], return_inverse=True)
        cosine = np.bincount(back, part * self.value[at], len(who))
        return (who[who != without], cosine[who != without]) if without >= 0 else (who, cosine)

    def vote(self, term, weight, without: int = -1) -> tuple[float, np.ndarray]:
        who, cosine = self.nearest(term, weight, without)
        strength = self.weights[who] * cosine**2
        return float(((strength * self.labels[who]).sum() + PRIOR_VOTES * self.prior) / (strength.sum() + PRIOR_VOTES)), who

    def _calibrate(self, doc, term, value, empty) -> None:
        """Fit score = logistic(a * logit(vote) + b) on the examples' votes without themselves, by Newton's steps."""
        start, n = runs(doc)
        votes = np.full(len(self.ids), self.alone)
        for s, k in zip(start.tolist(), n.tolist(), strict=True):
            votes[doc[s]] = self.vote(term[s : s + k], value[s : s + k], int(doc[s]))[0]
        x = _logit(votes)
        if len(set(self.labels.tolist())) < 2:
            return
        design, theta = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0])
        w = self.weights / self.weights.sum() * len(x)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
            slope = design.T @ (w * (self.labels - p)) - 1e-2 * (theta - [1.0, 0.0])
            bend = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
            theta = theta + np.clip(np.linalg.solve(bend, slope), -2, 2)
        self.a, self.b = (float(max(theta[0], 1e-3)), float(theta[1]))

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * _logit(np.array(vote)) + self.b, -30, 30))))


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", bounds: dict[int, int] = EXAMPLES, min_gain: float = MIN_GAIN) -> Index:
    """An index of labelled documents: of each label, at most bounds[label] keys, the first by the md5 of their key.

    Rows without key or label are ignored; a key with several labels counts as 1 if one of them is; of several
    texts of a key the smallest stands for it.  Document frequencies are counted over all rows of docs.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    order = F.md5(F.col("key").cast("string"))
    chosen = [r for k, most in sorted(bounds.items()) for r in marks.where(F.col("label") == k).orderBy(order, "key").limit(most).collect()]
    spark = ship(docs.sparkSession)
    sample = spark.createDataFrame([(r["key"], r["label"]) for r in chosen], "key long, label int")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample), "key")  # at most sum(bounds) keys
    rows = written(rows.groupBy("key", "label").agg(F.min("text").alias("text")), "examples")

    def count(batches):
        parts = {0: [], 1: []}
        for b in pieces(batches):
            doc, found = terms(b.column(1).to_pylist())
            doc, found, _ = _counted(doc, found)
            of = np.array(b.column(2).to_pylist(), np.int64)[doc]
            for k, x in parts.items():
                x.append(found[of == k])
        for k, x in parts.items():
            own = np.sort(np.concatenate(x)) if x else np.zeros(0, np.int64)
            start, n = runs(own)
            for a in range(0, len(start), 200_000):
                at = start[a : a + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(np.full(len(at), k, np.int32)), pa.array(n[a : a + 200_000])], ["term", "label", "n"])

    rows = rows.select("key", "text", "label")
    found = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = found.get(1, 0), found.get(0, 0)
    df = rows.mapInArrow(count, "term long, label int, n long").groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    # the log-likelihood gain of knowing the term, where it speaks for label 1
    p1, p0, p = F.col("a") / float(max(n1, 1)), F.col("b") / float(max(n0, 1)), (F.col("a") + F.col("b")) / float(max(n1 + n0, 1))
    side = lambda k, n, q: F.when(k > 0, k * F.log(q / p)).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    gain = side(F.col("a"), n1, p1) + side(F.col("b"), n0, p0)
    best = df.where((p1 > MIN_RATIO * p0) & (gain >= min_gain)).select("term").collect()  # some of the sample's terms
    vocabulary = np.sort(np.array([r["term"] for r in best], np.int64))
    bare = Index(vocabulary, np.zeros(len(vocabulary)), [], np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    shared = spark.sparkContext.broadcast(bare)

    def frequencies(batches):
        n, total = 0, np.zeros(len(shared.value.vocabulary), np.int64)
        for b in pieces(batches):
            _, at, _ = shared.value.counts(b.column(0).to_pylist())
            n += b.num_rows
            total += np.bincount(at, minlength=len(total))
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1)), pa.array(np.append(total[own], n))], ["at", "n"])

    every = {r["at"]: r["n"] for r in dealt(docs.select(F.col(text).alias("text"))).mapInArrow(frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    idf = np.log((every.get(-1, 0) + 1) / np.array([every.get(i, 0) + 1 for i in range(len(vocabulary))])) if len(vocabulary) else np.zeros(0)

    def project(batches):
        for b in pieces(batches):
            doc, at, n = shared.value.counts(b.column(1).to_pylist())
            start, k = runs(doc)
            of = dict(zip(doc[start].tolist(), zip(start.tolist(), (start + k).tolist(), strict=True), strict=True))
            cut = [of.get(i, (0, 0)) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([at[s:e].tolist() for s, e in cut], pa.list_(pa.int64())), pa.array([n[s:e].tolist() for s, e in cut], pa.list_(pa.int64()))], ["key", "label", "terms", "counts"])

    examples = sorted(rows.mapInArrow(project, "key long, label int, terms array<long>, counts array<long>").collect(), key=lambda r: r["key"])
    sampled = {k: max(1, sum(r["label"] == k for r in examples)) for k in (0, 1)}
    weights = np.array([sizes.get(r["label"], 0) / sampled[r["label"]] for r in examples])
    weights = weights / weights.max() if len(weights) else weights
    return Index(vocabulary, idf, [r["key"] for r in examples], np.array([r["label"] for r in examples]), weights, np.repeat(np.arange(len(examples)), [len(r["terms"]) for r in examples]) if examples else np.zeros(0, np.int64), np.array([t for r in examples for t in r["terms"]], np.int64), np.array([t for r in examples for t in r["counts"]], np.int64))


def score(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """docs with score, predicted and evidence (the keys of the nearest examples, nearest first).

    A column of docs with one of these names is replaced.  A text without any term of the
    vocabulary, null and empty ones too, gets the share of label 1 among such examples, without
    evidence.  Without examples every score is 0.  Equal texts get equal scores.
    """
    docs, name = plain_names(docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted", "evidence")]))
    text = name[text]
    shared = ship(docs.sparkSession).sparkContext.broadcast(index)  # bounded by EXAMPLES
    kept = docs.columns

    def judge(batches):
        ix = shared.value
        alone = ix.score(ix.alone) if ix.ids else 0.0
        seen: dict = {}
        for b in pieces(batches, text):
            doc, term, weight = ix.vectors(b.column(kept.index(text)).to_pylist())
            scores, evidence = np.full(b.num_rows, alone), [[] for _ in range(b.num_rows)]
            for s, n in zip(*(x.tolist() for x in runs(doc)), strict=True):
                own = (term[s : s + n].tobytes(), weight[s : s + n].tobytes())
                if own not in seen:
                    if len(seen) > 20_000:
                        seen.clear()
                    vote, who = ix.vote(term[s : s + n], weight[s : s + n])
                    seen[own] = ix.score(vote), [ix.ids[i] for i in who[:5].tolist()]
                scores[doc[s]], evidence[doc[s]] = seen[own]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(evidence, pa.list_(pa.int64()))], [*kept, "score", "predicted", "evidence"])

    return named(dealt(docs).mapInArrow(judge, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int, evidence array<long>"), name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from the labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "toxic")
    index = learn(docs, labels)
    return score(docs.withColumn("held_out", held_out(F.col("doc_id"), 5, 0)).select("doc_id", "held_out", "text"), index).drop("text")


QUERIES = {"op1_toxicity": op1_toxicity}
