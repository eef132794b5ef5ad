"""Recipes as table functions of SQL."""

import pytest
from pyspark.sql import functions as F

from tessera.config import RunConfig
from tessera.plans import functions, render, views


def test_a_plan_is_the_same_as_text(spark):
    d = spark.range(60).select(F.col("id").cast("string").alias("path"), (F.col("id") * 7 % 90 + 3).cast("int").alias("height"), (F.col("id") * 11 % 80 + 3).cast("int").alias("width"))
    for recipe in sorted({r[0] for r in views.RECIPES}):
        plan = render.plan(recipe, F.col("path"), F.col("height"), F.col("width"), 3, 2, 2)
        assert d.where(~F.expr(functions.sql_text(plan)).eqNullSafe(plan)).count() == 0
    odd = F.concat(F.lit("it's 1.5 -(2)"), F.col("path"))
    assert d.where(F.expr(functions.sql_text(odd)).eqNullSafe(odd)).count() == 60


@pytest.mark.parametrize("recipe", ["marine", "official"])
def test_views_of_a_table(spark, sf, recipe):
    """The rows of SELECT * FROM views(TABLE(images), recipe) are those of the DataFrame."""
    images = render.synthetic(spark, sf).where("doc_id < 30").select(F.col("doc_id").cast("string").alias("path"), "height", "width", "pixels", F.lit(1).alias("more"))
    images = images.union(spark.createDataFrame([("none", -1, -1, None, 1), ("null", None, None, None, 1)], images.schema))
    images.createOrReplaceTempView("images")
    config = RunConfig("-", n_global=2, n_local=1, image_side=24)
    functions.register(spark, config=config, local_side=16)
    got = {(r["path"], r["view"]): (r["dims"], r["dtype"], bytes(r["data"])) for r in spark.sql(f"SELECT * FROM views(TABLE(images), '{recipe}')").collect()}
    want = {(r["path"], r["view"]): (r["dims"], r["dtype"], bytes(r["data"])) for r in render.rendered(images, recipe, config=config, local_side=16).collect()}
    assert len(got) == 90 and got == want


def test_errors_when_a_query_is_analysed(spark):
    functions.register(spark, "views2")
    spark.createDataFrame([("a", 1)], "path string, height int").createOrReplaceTempView("bare")
    for sql, why in (("SELECT * FROM views2(TABLE(bare), 'marine')", "no pixels, width"), ("SELECT * FROM views2(TABLE(images_), 'no')", "no recipe"), ("SELECT * FROM views2('x', 'marine')", "table")):
        spark.createDataFrame([], "path string, height int, width int, pixels binary").createOrReplaceTempView("images_")
        with pytest.raises(Exception, match=why):
            spark.sql(sql).collect()
