"""A training corpus in five stages: rules, near-duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents.

Every stage takes documents as they come: null or empty texts, null or repeated ids, repeated rows,
columns of any further name; and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, jaccard, mixing, quality_rules, token_store
from tessera.llm.common import named, plain_names, scratch, table, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a column of theirs that is named like a verdict stays as it is.

    Null and empty texts have no words and go; repeated rows share their verdict.
    """
    plain, name = plain_names(docs, every=True)
    judged = quality_rules.judge(plain, name["text"], name["lang"])
    return named(judged.where("kept").select(*name.values()), name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Texts without words are alike with nothing and stay; rows that repeat both id and text are one; of a
    group's rows without an id one stays too.
    """
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none, and repeated rows share their lot."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; a document may be taken twice, one without words never.

    A null source is one of its own; repeated rows are documents of their own.
    """
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids; a row per document as read back from them.

    A null or empty text is its end id alone; null ids come last; repeated rows are all written.
    """
    return token_store.read(token_store.write(docs)).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality rules", rules), ("near-duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("token ids", tokens)]

#: The last stage's ids come from a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote for itself is deleted once its result is written, and that result once the next one is."""
    docs, before = table(spark, sf_dir, "documents"), scratch()
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        made.discard(docs)
        before.discard()
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
