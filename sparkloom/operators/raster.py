"""Grids: masks, connected components, hulls, rectangles, boxes, resizing.

A grid is a row with a flat array; a grid is bounded by its size, so what needs
a whole grid at once runs on rows in Arrow batches without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import geometry as G


def label_grid(values: np.ndarray, width: int, threshold: float) -> np.ndarray:
    """Component numbers (1 and up, in order of first pixel) of 8-connected cells above the threshold, 0 elsewhere."""
    height = len(values) // width
    mask = values[: height * width].reshape(height, width) > threshold
    label = np.where(mask, np.arange(height * width).reshape(height, width), height * width)
    while True:
        wide = np.pad(label, 1, constant_values=height * width)
        low = np.min([wide[dy : dy + height, dx : dx + width] for dy in range(3) for dx in range(3)], axis=0)
        low = np.where(mask, low, height * width)
        jumped = np.append(low.reshape(-1), height * width)[low]  # to the label of the label
        if (jumped == label).all():
            break
        label = jumped
    return np.where(mask, np.searchsorted(np.unique(label[mask]), label) + 1, 0).reshape(-1)


def components(grids: DataFrame, values: str, width: int, threshold: float, keep: tuple[str, ...]) -> DataFrame:
    """A row for each cell above the threshold: comp, pix, x, y, value. Values are compared as doubles."""

    @F.pandas_udf("array<int>")
    def labels(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in arrays:
            yield pd.Series([label_grid(np.asarray(a, np.float64), width, threshold).tolist() for a in batch])

    rows = grids.where(F.size(values) > 0).select(*keep, F.posexplode(F.arrays_zip(labels(values).alias("comp"), F.col(values).alias("value"))).alias("pix", "cell"))
    rows = rows.select(*keep, "cell.comp", "pix", F.col("cell.value").cast("double").alias("value")).where("comp > 0")
    return rows.withColumns({"x": F.col("pix") % width, "y": F.floor(F.col("pix") / width).cast("int")})


def row_extremes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The leftmost and rightmost cell of each row of a component."""
    ends = cells.groupBy(*keys, "y").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return ends.select(*keys, F.explode(F.array_distinct(F.array("low", "high"))).alias("x"), "y")


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull from the lowest (x, y) on, without repeated or collinear points."""
    pts = np.unique(points, axis=0).tolist()
    if len(pts) < 3:
        return np.array(pts, float).reshape(-1, 2)

    def half(order) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), float)


#: Sides and distances that differ by rounding alone count as equal.
NEAR = 1e-9
RECT = "cx double, cy double, ux double, uy double, vx double, vy double, half_u double, half_v double"


def least_rectangle(hull: np.ndarray) -> tuple[float, ...] | None:
    """The enclosing rectangle of least area with a side on the hull, the first of equals; none below three corners."""
    if len(hull) < 3:
        return None
    edges = np.roll(hull, -1, axis=0) - hull
    size = np.hypot(edges[:, 0], edges[:, 1])
    u = edges[size > 0] / size[size > 0, None]
    v = np.stack([-u[:, 1], u[:, 0]], axis=1)
    along, across = hull @ u.T, hull @ v.T
    area = np.ptp(along, axis=0) * np.ptp(across, axis=0)
    k = int(np.argmin(np.round(area, 9)))  # near equals count as equal
    cu, cv = (along[:, k].min() + along[:, k].max()) / 2, (across[:, k].min() + across[:, k].max()) / 2
    return (*(cu * u[k] + cv * v[k]), *u[k], *v[k], np.ptp(along[:, k]) / 2, np.ptp(across[:, k]) / 2)


def rectangles(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The least enclosing rectangle of each component that has one; only the ends of its rows are grouped."""

    @F.pandas_udf(f"struct<{RECT.replace(' double', ':double')}>")
    def rect(points: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in points:
            found = [least_rectangle(convex_hull(np.array([(p["x"], p["y"]) for p in ps], float))) or (None,) * 8 for ps in batch]
            yield pd.DataFrame(found, columns=[c.split()[0] for c in RECT.split(", ")], dtype="float64")

    points = row_extremes(cells, keys).groupBy(*keys).agg(F.collect_list(F.struct("x", "y")).alias("points"))
    return points.select(*keys, rect("points").alias("r")).select(*keys, "r.*").where("half_u is not null")


def region_mean(rects: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rectangles with ``mean``, of the cells of their grid within them (and half a cell), 0 without any; only cells of the bounding boxes are joined."""
    names = rects.columns
    numbered = rects.withColumn("rect no", F.xxhash64(*names))
    spread = lambda u, v: F.abs(F.col(u)) * (F.col("half_u") + 0.5) + F.abs(F.col(v)) * (F.col("half_v") + 0.5)
    around = lambda c, d: F.explode(F.sequence(F.ceil(F.col(c) - d - 1e-9), F.floor(F.col(c) + d + 1e-9)))
    box = numbered.withColumn("px", around("cx", spread("ux", "vx"))).withColumn("py", around("cy", spread("uy", "vy")))
    dx, dy = F.col("px") - F.col("cx"), F.col("py") - F.col("cy")
    inside = (F.abs(dx * F.col("ux") + dy * F.col("uy")) <= F.col("half_u") + 0.5 + NEAR) & (F.abs(dx * F.col("vx") + dy * F.col("vy")) <= F.col("half_v") + 0.5 + NEAR)
    c = cells.select(*keys, F.col("x").cast("long").alias("px"), F.col("y").cast("long").alias("py"), "value")
    means = box.where(inside).select(*keys, "rect no", "px", "py").join(c, [*keys, "px", "py"]).groupBy(*keys, "rect no").agg(F.avg("value").alias("mean"))
    return numbered.join(means, [*keys, "rect no"], "left").select(*names, F.coalesce("mean", F.lit(0.0)).alias("mean"))


def first_components(cells: DataFrame, grid: list[str], most: int) -> DataFrame:
    """Cells of the first ``most`` components of each grid, in order of their first cell; ``comp`` counts from 1."""
    return cells.where(F.col("comp") <= most)


def boxes(cells: DataFrame, all_cells: DataFrame, grid: list[str], box_threshold: float, ratio: float, least: float = 3.0) -> DataFrame:
    """Scored boxes of components: short sides below ``least`` and means below the threshold go, then each grows and must reach ``least + 2``."""
    rects = rectangles(cells, [*grid, "comp"]).where(G.short_side(F.col("half_u"), F.col("half_v")) >= least - NEAR)
    scored = region_mean(rects, all_cells, grid).where(F.col("mean") >= box_threshold)
    grow = G.grown_by(F.col("half_u"), F.col("half_v"), F.lit(ratio))
    grown = scored.withColumn("grow", grow).withColumns({"half_u": F.col("half_u") + F.col("grow"), "half_v": F.col("half_v") + F.col("grow")})
    names = [c.split()[0] for c in RECT.split(", ")]
    return grown.where(G.short_side(F.col("half_u"), F.col("half_v")) >= least + 2 - NEAR).withColumn("quad", G.corners(*map(F.col, names)))


def text_boxes(grids: DataFrame, values: str, width: int, grid: list[str], threshold: float, box_threshold: float, ratio: float, most: int, target: tuple[float, float]) -> DataFrame:
    """Boxes of text from maps of text probability: ``quad`` in pixels of the target image, ``score``, and ``place`` from top to bottom, then left to right.

    The first ``most`` components count, before any filter. Corners are ordered,
    scaled, rounded half up and kept on the target.
    """
    height = F.floor(F.size(values) / width)
    cells = first_components(components(grids, values, width, threshold, tuple(grid)), grid, most)
    every = grids.select(*grid, F.posexplode(values).alias("pix", "value")).select(*grid, (F.col("pix") % width).alias("x"), F.floor(F.col("pix") / width).alias("y"), F.col("value").cast("double").alias("value"))
    found = boxes(cells, every, grid, box_threshold, ratio).join(grids.select(*grid, height.alias("grid height")), grid)
    at = lambda v, factor, top: G.clamp(F.floor(F.round(v * factor, 9) + 0.5), 0, int(top)).cast("long")
    scaled = F.transform(G.ordered_quad(F.col("quad")), lambda p: F.struct(at(p["x"], F.lit(target[0] / width), target[0]).alias("x"), at(p["y"], F.lit(target[1]) / F.col("grid height"), target[1]).alias("y")))
    out = found.select(*grid, "comp", scaled.alias("quad"), F.col("mean").alias("score"))
    order = Window.partitionBy(*grid).orderBy(F.col("quad")[0]["y"], F.col("quad")[0]["x"], "comp")
    return out.withColumn("place", F.row_number().over(order))


def map_rectangles(values: np.ndarray, width: int, threshold: float, most: int) -> list[tuple]:
    """Of one map, the least rectangle of each of its first ``most`` components and the mean of its cells within it (and half a cell)."""
    grid, labels = values.reshape(-1, width), label_grid(values, width, threshold)
    cells = np.flatnonzero((labels > 0) & (labels <= most))
    cells = cells[np.argsort(labels[cells], kind="stable")]
    out = []
    for of in np.split(cells, np.flatnonzero(np.diff(labels[cells])) + 1) if len(cells) else []:
        y, x = np.divmod(of, width)
        first = np.flatnonzero(np.diff(y, prepend=-1))  # the leftmost and rightmost cell of each row
        ends = np.unique(np.concatenate([first, np.append(first[1:], len(y)) - 1]))
        rect = least_rectangle(convex_hull(np.stack([x[ends], y[ends]], axis=1).astype(float)))
        if rect is None:
            continue
        cx, cy, ux, uy, vx, vy, half_u, half_v = rect
        reach_x, reach_y = (abs(u) * (half_u + 0.5) + abs(v) * (half_v + 0.5) + 1e-9 for u, v in ((ux, vx), (uy, vy)))
        left, top = max(0, int(np.ceil(cx - reach_x))), max(0, int(np.ceil(cy - reach_y)))
        part = grid[top : int(np.floor(cy + reach_y)) + 1, left : int(np.floor(cx + reach_x)) + 1]
        dy, dx = np.mgrid[top : top + part.shape[0], left : left + part.shape[1]]
        dx, dy = dx - cx, dy - cy
        inside = (np.abs(dx * ux + dy * uy) <= half_u + 0.5 + NEAR) & (np.abs(dx * vx + dy * vy) <= half_v + 0.5 + NEAR)
        out.append((int(labels[of[0]]), *map(float, rect), float(part[inside].mean()) if inside.any() else 0.0))
    return out


def map_boxes(maps: DataFrame, values: str, grid: list[str], threshold: float, box_threshold: float, ratio: float, most: int, least: float = 3.0) -> DataFrame:
    """As ``text_boxes``, from maps of any sizes (``wide``, ``high``, ``image width``, ``image height``), each worked on whole in an Arrow batch; only rectangles become rows."""
    names = [c.split()[0] for c in RECT.split(", ")]
    kinds = f"array<struct<comp:int,{RECT.replace(' double', ':double')},mean:double>>"

    @F.pandas_udf(kinds)
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for arrays, widths in batches:
            yield pd.Series([[dict(zip(["comp", *names, "mean"], r)) for r in map_rectangles(np.asarray(a, np.float64), int(w), threshold, most)] for a, w in zip(arrays, widths)])

    rects = maps.where(F.size(values) > 0).select(*grid, "wide", "high", "image width", "image height", F.explode(found(values, "wide")).alias("r")).select(*grid, "wide", "high", "image width", "image height", "r.*")
    short = G.short_side(F.col("half_u"), F.col("half_v"))
    scored = rects.where((short >= least - NEAR) & (F.col("mean") >= box_threshold))
    grow = G.grown_by(F.col("half_u"), F.col("half_v"), F.lit(ratio))
    grown = scored.withColumn("grow", grow).withColumns({"half_u": F.col("half_u") + F.col("grow"), "half_v": F.col("half_v") + F.col("grow")}).where(short >= least + 2 - NEAR)
    at = lambda v, size, of: G.clamp(F.floor(F.round(v * size / of, 9) + 0.5), F.lit(0).cast("long"), size.cast("long")).cast("long")
    corners = G.ordered_quad(G.corners(*map(F.col, names)))
    scaled = F.transform(corners, lambda p: F.struct(at(p["x"], F.col("image width"), F.col("wide")).alias("x"), at(p["y"], F.col("image height"), F.col("high")).alias("y")))
    out = grown.select(*grid, "comp", scaled.alias("quad"), F.col("mean").alias("score"))
    order = Window.partitionBy(*grid).orderBy(F.col("quad")[0]["y"], F.col("quad")[0]["x"], "comp")
    return out.withColumn("place", F.row_number().over(order))


def warp(grids: DataFrame, values: str, width: int, frame: str, keep: tuple[str, ...]) -> DataFrame:
    """Upright crops by frames (``geometry.crop_frame``): a row for each pixel of a crop, sampled bilinearly at whole centres with edges repeated."""
    f, height = F.col(frame), F.floor(F.size(values) / width).cast("int")
    rows = grids.select(*keep, F.col(values).alias("v"), height.alias("h"), f.alias("f"), F.explode(F.sequence(F.lit(0), f["width"] * f["height"] - 1)).alias("pix"))
    f = F.col("f")
    cx, cy = F.col("pix") % f["width"], F.floor(F.col("pix") / f["width"])
    at = lambda c: f["origin"][c] + cx * f["r"][c] + cy * f["a"][c]
    rows = rows.withColumns({"x": G.clamp(at("x"), 0.0, float(width - 1)), "y": G.clamp(at("y"), F.lit(0.0), (F.col("h") - 1).cast("double"))})
    return rows.select(*keep, "pix", _blend(width).alias("value"))


def _blend(width: int):
    """The value of ``v``, a flat grid of ``h`` rows, between cells at (x, y)."""
    x0, y0 = F.floor("x").cast("int"), F.floor("y").cast("int")
    x1, y1 = F.least(x0 + 1, F.lit(width - 1)), F.least(y0 + 1, F.col("h") - 1)
    value = lambda xx, yy: F.element_at("v", (yy * width + xx + 1).cast("int")).cast("double")
    fx, fy = F.col("x") - x0, F.col("y") - y0
    top = value(x0, y0) * (1 - fx) + value(x1, y0) * fx
    low = value(x0, y1) * (1 - fx) + value(x1, y1) * fx
    return top * (1 - fy) + low * fy


def to_byte(value):
    """A pixel as stored: rounded half to even, 0 to 255."""
    return G.clamp(F.bround(value, 0), 0, 255).cast("int")


#: Fixed values of the detector: mean and deviation of the blue, green and red plane, in this order.
DETECTOR_MEAN, DETECTOR_DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def detector_planes(blue, green, red):
    """A pixel (0 to 255) as the detector takes it: blue, green, red, each less its mean and over its deviation."""
    return F.array(*((c / 255 - F.lit(m)) / F.lit(d) for c, m, d in zip((blue, green, red), DETECTOR_MEAN, DETECTOR_DEVIATION)))


def recogniser_planes(blue, green, red):
    """A pixel as the recogniser takes it, each plane from -1 to 1."""
    return F.array(*(c / 127.5 - 1 for c in (blue, green, red)))


def resize(grids: DataFrame, values: str, width: int, new_width: int, new_height: int, keep: tuple[str, ...]) -> DataFrame:
    """Bilinear resizing with half-pixel centres and clamped edges: a row for each new cell."""
    height = F.floor(F.size(values) / width).cast("int")
    cells = F.sequence(F.lit(0), F.lit(new_width * new_height - 1))
    rows = grids.select(*keep, F.col(values).alias("v"), height.alias("h"), F.explode(cells).alias("pix"))
    x = G.clamp((F.col("pix") % new_width + 0.5) * width / new_width - 0.5, 0.0, float(width - 1))
    y = G.clamp((F.floor(F.col("pix") / new_width) + 0.5) * F.col("h") / new_height - 0.5, F.lit(0.0), (F.col("h") - 1).cast("double"))
    return rows.withColumns({"x": x, "y": y}).select(*keep, "pix", _blend(width).alias("value"))
