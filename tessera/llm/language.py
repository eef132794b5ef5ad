"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams of one to three letters, in order of
frequency.  A text's own list is compared with each profile: every n-gram adds how far out of
place it is there, or the profile's length if it is missing.  The nearest profile wins.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from .arrays import pieces, runs
from .common import dealt, named, plain_names, table

LENGTH = 300
BITS = 21  # of a code point
EDGE = 32  # stands for whatever is not a letter
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(key of every n-gram, alphabet, letters per text, bits a letter): keys are the text's number, n-1, and n letters."""
    lowered = [(t or "").lower() for t in texts]
    code = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) + 1 for t in lowered])
    doc = np.repeat(np.arange(len(texts)), sizes)
    doc = np.concatenate([doc[:1], doc])[: len(code)]
    letter = _letters()[code]
    code = np.where(letter, code, EDGE)
    alphabet = np.unique(np.append(code, EDGE))
    bits = max(1, int(len(alphabet) - 1).bit_length())
    small = np.zeros(int(alphabet[-1]) + 1, np.int64)
    small[alphabet] = np.arange(len(alphabet))
    c, base = small[code], doc.astype(np.int64) << (3 * bits + 2)
    one = np.flatnonzero(letter)
    two = np.flatnonzero(letter[:-1] | letter[1:])
    keys = [base[one] | c[one], base[two] | 1 << 3 * bits | c[two] << bits | c[two + 1], base[one] | 2 << 3 * bits | c[one - 1] << 2 * bits | c[one] << bits | c[one + 1]]
    # a pair that ends with a letter may begin with the edge before its text
    keys[1] = np.where(letter[two], keys[1], base[two + 1] | 1 << 3 * bits | c[two] << bits | c[two + 1])
    return np.concatenate(keys), alphabet, np.bincount(doc[one], minlength=len(texts)), bits


def _wide(gram: np.ndarray, alphabet: np.ndarray, bits: int) -> np.ndarray:
    """n-grams of a piece's alphabet as code points, BITS each."""
    n, mask = gram >> 3 * bits & 3, (1 << bits) - 1
    letters = [alphabet[gram >> k * bits & mask].astype(np.int64) << k * BITS for k in range(3)]
    return letters[0] | np.where(n > 0, letters[1], 0) | np.where(n > 1, letters[2], 0)


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", length: int = LENGTH) -> DataFrame:
    """lang, gram, rank (from 0) of the learned languages, from all rows with a language; ties by the gram's code.

    Counts are summed up in every task before the shuffle; a language's row number sees its
    distinct n-grams only.
    """

    def count(batches):
        known: list[str] = []
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in pieces(batches):
            langs = b.column(1).to_pylist()
            keys, alphabet, _, bits = _grams(b.column(0).to_pylist())
            number = {x: i for i, x in enumerate(sorted(set(langs)))}
            of = np.array([number[x] for x in langs], np.int64)
            low = (1 << (3 * bits + 2)) - 1
            keys = np.sort(of[keys >> (3 * bits + 2)] << (3 * bits + 2) | keys & low)
            start, n = runs(keys)
            keys = keys[start]
            for x, i in number.items():
                own = keys >> (3 * bits + 2) == i
                gram, k = _wide(keys[own] & low, alphabet, bits), n[own]
                if x in total:
                    gram, k = np.concatenate([total[x][0], gram]), np.concatenate([total[x][1], k])
                    order = np.argsort(gram, kind="stable")
                    gram, k = gram[order], k[order]
                    first, _ = runs(gram)
                    gram, k = gram[first], np.add.reduceat(k, first) if len(first) else k
                total[x] = gram, k
        for x, (gram, k) in total.items():
            for a in range(0, len(gram), 100_000):
                g = gram[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(g)), pa.array(g), pa.array(k[a : a + 100_000])], ["lang", "gram", "n"])

    ship(docs.sparkSession)
    rows = dealt(docs).where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "gram")) - 1
    return counts.withColumn("rank", place).where(F.col("rank") < length).select("lang", "gram", "rank")


def identify(docs: DataFrame, learned: list[tuple[str, int, int]], text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with lang_pred and score; learned: rows of profiles(), at most `length` for each language.

    A column of docs with one of these names is replaced.  A text that is null or has no letter is
    'und' with score 0; so is every text if nothing was learned.  The score is the runner-up's
    share of the two smallest distances: 0.5 for a tie (the first name wins), 1 for a perfect match
    or a single language.  Repeated rows are judged alike.
    """
    docs, name = plain_names(docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")]))
    text = name[text]
    ship(docs.sparkSession)
    names = sorted({x for x, _, _ in learned})
    grams = np.unique(np.array([g for _, g, _ in learned], np.int64))
    ranks = np.full((len(names), len(grams) + 1), -1, np.int32)
    for x, g, r in learned:
        ranks[names.index(x), np.searchsorted(grams, g)] = r
    schema = docs.schema
    kept = [f.name for f in schema]

    def judge(batches):
        for b in pieces(batches, text):
            texts = b.column(kept.index(text)).to_pylist()
            keys, alphabet, letters, bits = _grams(texts)
            keys = np.sort(keys)
            start, n = runs(keys)
            keys, low = keys[start], (1 << (3 * bits + 2)) - 1
            doc, wide = keys >> (3 * bits + 2), _wide(keys & low, alphabet, bits)
            order = np.lexsort((wide, -n, doc))
            doc, wide = doc[order], wide[order]
            first, count = runs(doc)
            rank = np.arange(len(doc)) - np.repeat(first, count)
            own = rank < length
            doc, wide, rank = doc[own], wide[own], rank[own]
            at = np.searchsorted(grams, wide)
            at = np.where((at < len(grams)) & (grams[np.minimum(at, len(grams) - 1)] == wide), at, len(grams)) if len(grams) else np.zeros(len(wide), np.int64)
            d = np.empty((max(1, len(names)), len(texts)))
            for i in range(len(names)):
                there = ranks[i][at]
                d[i] = np.bincount(doc, np.where(there < 0, length, np.abs(there - rank)), len(texts))
            best = np.argmin(d, 0)
            nearest = d[best, np.arange(len(texts))]
            second = np.partition(d, 1, 0)[1] if len(names) > 1 else np.ones(len(texts))
            score = np.divide(second, nearest + second, out=np.full(len(texts), 0.5), where=nearest + second > 0)
            if len(names) == 1:
                score = np.ones(len(texts))
            some = (letters > 0) & bool(names)
            found = [names[k] if s else UNKNOWN for k, s in zip(best.tolist(), some.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(np.where(some, score, 0.0))], [*kept, "lang_pred", "score"])

    return named(dealt(docs).mapInArrow(judge, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", lang_pred string, score double"), name)


def held_out(key: Column, of: int, rest: int) -> Column:
    """Whether crc32 of the key, as text, leaves this remainder; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % of == rest


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language and score, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    learned = [tuple(r) for r in profiles(docs.where("NOT held_out")).collect()]
    return identify(docs.select("doc_id", "held_out", "text"), learned).drop("text")


QUERIES = {"op6_language": op6_language}
