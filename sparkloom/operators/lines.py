"""Lines of characters: confidence, boxes, order, timings, and what is drawn for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import geometry as G


def confidence(probabilities: Column) -> Column:
    """The mean of an array, 0 if it is empty."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, p: a + p.cast("double"))
    return F.when(F.size(probabilities) > 0, total / F.size(probabilities)).otherwise(0.0)


def bounds(points: Column) -> Column:
    """The box around points."""
    of = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return F.struct(of(F.array_min, "x").alias("x0"), of(F.array_min, "y").alias("y0"), of(F.array_max, "x").alias("x1"), of(F.array_max, "y").alias("y1"))


def total_time(stages: list[str]) -> Column:
    return sum((F.coalesce(F.col(s), F.lit(0.0)) for s in stages), F.lit(0.0))


def in_reading_order(quads: Column) -> Column:
    """Whether the centres of quads (each from the start of the reading direction, clockwise) strictly advance along the first one's direction."""
    first = quads[0]
    ux, uy = first[1]["x"] - first[0]["x"], first[1]["y"] - first[0]["y"]
    along = F.transform(quads, lambda q: (q[0]["x"] + q[2]["x"]) * ux + (q[0]["y"] + q[2]["y"]) * uy)
    steps = F.zip_with(F.slice(along, 1, F.size(along) - 1), F.slice(along, 2, F.size(along) - 1), lambda a, b: a < b)
    return F.when(F.size(quads) < 2, True).otherwise(F.forall(steps, lambda ok: ok))


def hint_install(agent: Column, standalone: Column, hinted: Column) -> Column:
    """Whether a visitor's browser could keep the app on its home screen and has not been told so."""
    return agent.rlike("iPhone|iPad|iPod") & ~standalone & ~hinted


def draw_commands(labels: DataFrame, keys: list[str], scale, tx, ty) -> DataFrame:
    """Labels (text, font, width, x, y, halo) under a view as what is to be drawn: a strip and its text, or an outlined text; ``op``, its place and its size."""
    at = G.to_screen(scale, tx, ty, F.col("x"), F.col("y"))
    size = F.col("font") * scale
    text = F.struct(F.when(F.col("halo"), "outlined text").otherwise("text").alias("op"), at["x"].alias("x"), at["y"].alias("y"), size.alias("size"), F.col("text").alias("text"))
    strip = F.struct(F.lit("strip").alias("op"), at["x"].alias("x"), at["y"].alias("y"), (F.col("width") * scale).alias("size"), F.lit(None).cast("string").alias("text"))
    commands = F.when(F.col("halo"), F.array(text)).otherwise(F.array(strip, text))
    return labels.select(*keys, F.posexplode(commands).alias("layer", "c")).select(*keys, "layer", "c.*")
