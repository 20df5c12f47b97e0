"""From images to lines of text: detection, boxes, crops, recognition, characters. Models are given by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import geometry as G
from sparkloom.operators import lines, raster, sequence
from sparkloom.operators import text as words
from sparkloom.operators.recognition import Model, cropped, detected, recognised


def lines_of_text(read: DataFrame, frames: DataFrame, keys: list[str], charset: list[str]) -> DataFrame:
    """``read`` (as ``recognised`` gives it) as ``text``, ``score``, ``vertical``, ``quad`` and ``chars``, by the ``frame`` of each line.

    Classes are blank, the charset, and a space. A character's quad is its
    stretch of columns; a step is as wide as its share of the padded batch.
    """
    letters = F.array(*map(F.lit, ["", *charset, " "]))
    framed = read.join(frames.select(*keys, "frame"), keys)
    filled_steps = F.col("steps") * F.col("filled") / F.col("wide")
    chars = framed.select(*keys, "frame", filled_steps.alias("length"), F.explode("chars").alias("c")).select(*keys, "frame", "length", "c.*")
    spans = sequence.character_spans(chars, keys, F.col("length"))
    scale = F.col("frame.width") / F.col("length")
    char = F.struct(F.col("t0"), F.element_at(letters, F.col("class") + 1).alias("ch"), F.col("score").alias("prob"), G.frame_quad(F.col("frame"), F.col("x0") * scale, F.col("x1") * scale).alias("quad"))
    grouped = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(char)).alias("chars"), F.first("frame").alias("frame"))
    quad = G.frame_quad(F.col("frame"), F.lit(0.0), F.col("frame.width").cast("double"))
    figures = {"text": F.array_join(F.transform("chars", lambda c: c["ch"]), ""), "score": lines.confidence(F.transform("chars", lambda c: c["prob"])), "vertical": F.col("frame.vertical"), "quad": quad}
    return grouped.withColumns(figures).select(*keys, "text", "score", "vertical", "quad", F.transform("chars", lambda c: c.dropFields("t0")).alias("chars"))


def scan(images: DataFrame, image: str, detector: Model, recogniser: Model, charset: list[str], long_side: int = 960, threshold: float = 0.3, box_threshold: float = 0.6, ratio: float = 1.5, most: int = 1000, least_score: float = 0.5, grain: int = 64, batch: int = 16) -> DataFrame:
    """Lines (image, place, text, score, vertical, quad, chars) of RGBA images (width, height, data) of any sizes.

    The detector takes an image at its own size (long side scaled, sides
    multiples of 32) and gives a probability for each pixel; the recogniser
    takes upright crops in batches of a width class. An image crosses the
    network once, to meet its boxes; a pixel is never a row.
    """
    sized = images.withColumn("size", G.detector_size(F.col("width"), F.col("height"), long_side))
    maps = detected(sized, image, detector)
    sizes = images.select(image, F.col("width").alias("image width"), F.col("height").alias("image height"))
    boxes = raster.map_boxes(maps.join(sizes, image), "map", [image], threshold, box_threshold, ratio, most)
    quads = F.transform("quad", lambda p: G.point(p["x"].cast("double"), p["y"].cast("double")))
    frames = boxes.select(image, F.col("place").cast("int").alias("place"), G.crop_frame(quads).alias("frame"))
    read = recognised(cropped(images, frames, image), [image, "place"], recogniser, len(charset) + 2, grain, batch)
    return words.good_lines(lines_of_text(read, frames, [image, "place"], charset), least=least_score)
