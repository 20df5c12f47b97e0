"""Decoding of per-step class scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def steps(items: DataFrame, scores: str, classes: int, keep: tuple[str, ...]) -> DataFrame:
    """A row for each step of a flat score array: t, the best class (the lowest of equals) and its score."""
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size(scores) / classes).cast("int") - 1), lambda t: F.slice(scores, t * classes + 1, classes))
    rows = items.where(F.size(scores) >= classes).select(*keep, F.posexplode(cut).alias("t", "row"))
    best = F.array_max("row")
    return rows.select(*keep, "t", (F.array_position("row", best) - 1).cast("int").alias("class"), best.cast("double").alias("score"))


def collapse(steps_: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of equal classes other than blank (0): class, first and last step, the first step's score, place."""
    by = Window.partitionBy(*keys).orderBy("t")
    new = (F.col("class") != F.coalesce(F.lag("class").over(by), F.lit(-1))).cast("int")
    islands = steps_.withColumn("island", F.sum(new).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("class <> 0")
    spans = islands.groupBy(*keys, "island", "class").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.min_by("score", "t").alias("score"))
    return spans.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("t0"))).drop("island")


def character_spans(spans: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """Each character's stretch of ``length`` steps: up to the middle between neighbours' centres, mirrored at the ends, all of it for one alone."""
    by = Window.partitionBy(*keys).orderBy("t0")
    centre = (F.col("t0") + F.col("t1") + 1) / 2
    spans = spans.withColumn("centre", centre).withColumns({"before": F.lag("centre").over(by), "after": F.lead("centre").over(by)})
    left = F.when(F.col("before").isNotNull(), (F.col("before") + F.col("centre")) / 2).when(F.col("after").isNotNull(), F.col("centre") - (F.col("after") - F.col("centre")) / 2).otherwise(0.0)
    right = F.when(F.col("after").isNotNull(), (F.col("after") + F.col("centre")) / 2).when(F.col("before").isNotNull(), F.col("centre") + (F.col("centre") - F.col("before")) / 2).otherwise(length)
    inside = lambda x: F.least(length, F.greatest(F.lit(0.0), x))
    return spans.withColumns({"x0": inside(left), "x1": inside(right)}).drop("centre", "before", "after")
