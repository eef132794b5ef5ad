"""Recipes as table functions of SQL: SELECT * FROM views(TABLE(images), 'marine')."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SelectedColumn

from ..config import RunConfig
from ..operators.pixels import MEAN
from ..session import ship
from . import render
from .views import RECIPES

_OPERATOR = re.compile(r"(?<![\w`])([*+/%-]|<=>|<=|>=|<>|!=|==|[<>=]|and|or|not|negative)\(")
_NUMBER = re.compile(r"(?<![\w.])(\d+\.\d+(?:E-?\d+)?)(?![\w.])")


def sql_text(column: Column) -> str:
    """A column of functions, operators and literals as text that SQL reads as the same column."""
    text = column._jc.node().sql()
    parts = re.split(r"('(?:[^'\\]|\\.)*')", text)
    for i in range(0, len(parts), 2):  # what isn't a string: operators come in front, and numbers with a point are doubles
        parts[i] = _NUMBER.sub(r"\1D", _OPERATOR.sub(r"`\1`(", parts[i]))
    return "".join(parts)


def register(spark: SparkSession, name: str = "views", key: str = "path", seed: int = 0, config: RunConfig | None = None, collection: str = "imagenet", local_side: int | None = None, orientation: bool = True) -> None:
    """Make a recipe's views a table function: name(TABLE(images), recipe) gives key, view, dims, dtype and data.

    images has key, height, width and pixels, of which null and undecodable images have no views; the settings are those of
    `render.rendered`, whose rows it gives.  The recipe's draws are worked out by Spark, which hands them to the function with each row.
    A recipe that isn't known, and a table without these columns, are errors when the query is analysed.
    """
    ship(spark)
    config = config or RunConfig("-")
    recipes = sorted({r[0] for r in RECIPES})
    plans = {r: sql_text(render.plan(r, F.col(key).cast("string"), F.col("height"), F.col("width"), seed, config.n_global, config.n_local, config.image_side, local_side, orientation)) for r in recipes}
    fill = [round(m * 255) for m in MEAN[collection]]

    class Views:
        @staticmethod
        def analyze(images: AnalyzeArgument, recipe: AnalyzeArgument) -> AnalyzeResult:
            if not images.isTable:
                raise ValueError(f"{name} takes a table of images first")
            columns = {f.name: f.dataType for f in images.dataType.fields}
            if missing := {key, "height", "width", "pixels"} - columns.keys():
                raise ValueError(f"the table of images has no {', '.join(sorted(missing))}")
            if recipe.value not in plans:
                raise ValueError(f"no recipe {recipe.value}; there are {', '.join(plans)}")
            schema = StructType([StructField(key, columns[key]), StructField("view", IntegerType()), StructField("dims", ArrayType(IntegerType())), StructField("dtype", StringType()), StructField("data", BinaryType())])
            return AnalyzeResult(schema, select=[SelectedColumn(f"`{key}`", "key"), SelectedColumn("height"), SelectedColumn("width"), SelectedColumn("pixels"), SelectedColumn(plans[recipe.value], "plan")])

        def eval(self, row, recipe: str):
            if row["pixels"] is None or row["height"] is None or row["height"] <= 0:
                return
            image = np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"], 3)
            for v, p in enumerate(row["plan"]):
                m = render.normalised(render.shown(image, p, fill)[1], "imagenet" if recipe == "marine" else collection)
                yield row["key"], v, list(m.shape), m.dtype.str, np.ascontiguousarray(m).tobytes()

    spark.udtf.register(name, F.udtf(Views))
