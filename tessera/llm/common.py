"""Helpers shared by the text operators: tables, shared scratch space, words."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import fresh, scratch, shared_dir, written  # noqa: F401  the operators take these from here

#: ASCII white space that separates words.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(scan: DataFrame) -> DataFrame:
    """A scan of fewer files than the session has cores, dealt to all of them; others stay as they are.

    For work that costs much per row: a table in one small file would otherwise be one task.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 0 < len(scan.inputFiles()) < cores else scan


def tasks_for(spark: SparkSession, size: int, each: int = 128 << 20) -> int:
    """How many partitions to deal work of `size` bytes to: about `each` in one, but all cores get some."""
    return max(spark.sparkContext.defaultParallelism, -(-size // each))


def words(text: Column) -> Column:
    """The words of a text in order; null counts as empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE))
    return F.array_remove(F.split(plain, " "), "")


def bind(value: Column, body) -> Column:
    """body(value) with value worked out once: used inside a lambda, a plain column may be worked out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_names(df: DataFrame, every: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """df with columns renamed that a plain reference wouldn't find (dots, spaces, quotes), or every one, and the new name of each column."""
    names: dict[str, str] = {}
    taken = {c.lower() for c in df.columns}
    for i, c in enumerate(df.columns):
        new = c
        if every or not re.fullmatch(r"[A-Za-z_]\w*", c):
            new = f"c{i}_{re.sub(r'[^A-Za-z0-9]', '_', c)}"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
        names[c] = new
    return df.toDF(*names.values()), names


def named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with the names back that plain_names took; other columns keep theirs."""
    given = {new: c for c, new in names.items()}
    return df.toDF(*(given.get(c, c) for c in df.columns))
