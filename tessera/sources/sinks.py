"""Where results go: history, checkpoint metadata, several trackers at once, and contact sheets."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import transforms
from ..plans import render, views

log = logging.getLogger("tessera")


def write_checkpoints(rows: DataFrame, path: str, extra: dict | None = None) -> None:
    """Append rows of checkpoint metadata (epoch, loss, is_best, ...); the best so far is also kept alone, in best/.

    extra (names and values) is added last and takes the place of columns with these names.
    """
    rows = rows.withColumns({k: F.lit(v) for k, v in (extra or {}).items()})
    rows.write.mode("append").parquet(f"{path}/all")
    best = rows.where("is_best").orderBy(F.col("epoch").desc()).limit(1)
    if best.take(1):
        best.write.mode("overwrite").parquet(f"{path}/best")


def to_all(writers):
    """A function for foreachBatch that gives each batch to every writer; one that fails is logged and the others go on."""

    def write(batch: DataFrame, number: int) -> None:
        for w in writers:
            try:
                w(batch, number)
            except Exception as e:  # noqa: BLE001  a tracker that is down must not stop the run
                log.warning("batch %d: %s", number, e)

    return write


def sheet(images: DataFrame, key: str, n_global: int = 2, n_local: int = 3, side: int = 224, local_side: int | None = None, seed: int = 0) -> DataFrame:
    """key, line, view, title, dims and bytes of a sheet for each image: its central square, then a line of views, as they are shown, for each mode."""
    config = RunConfig("-", n_global=n_global, n_local=n_local, image_side=side)
    lines = [transforms.transformed(images, lambda image: transforms.resized(image, side).astype("u1"), [key]).select(key, F.lit(0).alias("line"), F.lit(0).alias("view"), F.lit(f"reference ({side}px)").alias("title"), "dims", "data")]
    for line, (recipe, orientation) in enumerate(views.MODES, 1):
        planned = render.plan(recipe, F.col(key).cast("string"), F.col("height"), F.col("width"), seed, n_global, n_local, config.image_side, local_side, orientation)
        rows = images.where("height > 0").select(key, "height", "width", "pixels", planned.alias("plan"))
        fill = [round(m * 255) for m in render.MEAN["imagenet"]]
        made = transforms.fanned(rows, lambda image, plans: [(render.shown(image, p, fill)[1] * 255).astype("u1") for p in plans], [key], ("plan",))  # noqa: B023
        number = F.when(F.col("view") < n_global, F.col("view")).otherwise(F.col("view") - n_global)
        title = F.format_string("%s%d (%dpx)", F.when(F.col("view") < n_global, "G").otherwise("L"), number, F.get("dims", F.lit(0)))
        lines.append(made.select(key, F.lit(line).alias("line"), "view", title.alias("title"), "dims", "data"))
    out = lines[0]
    for x in lines[1:]:
        out = out.unionByName(x)
    return out


def contact_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets of four images (a report), with small views."""
    images = render.synthetic(spark, sf_dir).orderBy("doc_id").limit(4)
    return sheet(images, "doc_id", side=32, local_side=16)


QUERIES = {"contact_sheet": contact_sheet}
ORACLES: dict[str, str] = {}
