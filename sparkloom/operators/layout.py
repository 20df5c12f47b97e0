"""Labels beside the characters of lines: layout and greedy placement.

A line is (line_no, vertical, chars); a character is (reading, quad), its quad
eight numbers: the corners from the start of the reading direction, clockwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import graph, spatial
from sparkloom.storage import materialized

#: Fixed values, in ems unless said otherwise: gap, strip padding, text height, least scale and its step.
GAP, PAD, HEIGHT, LEAST_SCALE, SCALE_STEP = 0.15, 0.15, 1.2, 0.5, 0.05
#: Font size per character height; widest label per character width, for horizontal and vertical lines.
FONT, WIDEST = 0.45, (0.9, 2.0)
#: How far labels reach from their line, in character sizes.
REACH = 2.5

Measure = Callable[[str, float], float]


def fixed_width(text: str, size: float) -> float:
    return 0.6 * len(text) * size


def layout(chars: list[tuple[str | None, list[float]]], vertical: bool, side: str, scale: float, measure: Measure = fixed_width) -> list[dict]:
    """The labels of one line: font, width, x, y (top centre, or top left for vertical lines)."""
    labels = []
    for reading, quad in chars:
        if not reading:
            continue
        q = np.asarray(quad, float).reshape(4, 2)
        along, across = np.hypot(*(q[1] - q[0])), np.hypot(*(q[3] - q[0]))
        wide, high = (across, along) if vertical else (along, across)
        font = FONT * high * scale
        font *= min(1.0, WIDEST[vertical] * wide / (measure(reading, font) or 1.0))
        width, gap = measure(reading, font), GAP * font
        near, far = q[[0, 1]], q[[3, 2]]  # the edges that reading begins and ends above, or right and left
        if vertical:
            x = near[:, 0].max() + gap if side == "after" else far[:, 0].min() - gap - width
            y = near[:, 1].mean() - font / 2
        else:
            edge = far if side == "after" else near
            x = edge[:, 0].mean()
            y = far[:, 1].max() + gap if side == "after" else near[:, 1].min() - gap - HEIGHT * font
        labels.append({"text": reading, "font": font, "width": width, "x": x, "y": y})
    return labels


def strips(labels: list[dict], vertical: bool) -> np.ndarray:
    """The boxes (x0, y0, x1, y1) that labels cover."""
    rows = []
    for a in labels:
        left, pad = a["x"] - (0 if vertical else a["width"] / 2), PAD * a["font"]
        rows.append((left - pad, a["y"] - pad, left + a["width"] + pad, a["y"] + HEIGHT * a["font"] + pad))
    return np.array(rows, float).reshape(-1, 4)


#: Sides and scales that are tried in order: after and before, ever smaller.
_SCALES = 1 - SCALE_STEP * np.arange(round((1 - LEAST_SCALE) / SCALE_STEP) + 1)
TRIES = [(side, float(scale)) for scale in _SCALES for side in ("after", "before")]


def all_strips(chars: list[tuple[str | None, list[float]]], vertical: bool, measure: Measure = fixed_width) -> np.ndarray:
    """The strips of a line's labels for each of ``TRIES``: tries by labels by box; a text's width must be in proportion to its size."""
    shown = [(measure(reading, 1.0), quad) for reading, quad in chars if reading]
    return _all_strips(np.array([u for u, _ in shown], float), np.array([quad for _, quad in shown], float), vertical)


def _all_strips(unit: np.ndarray, quads: np.ndarray, vertical: bool) -> np.ndarray:
    """The same for labels of so many ems beside these quads."""
    if not len(unit):
        return np.zeros((len(TRIES), 0, 4))
    q = quads.reshape(-1, 4, 2)
    along, across = np.hypot(*(q[:, 1] - q[:, 0]).T), np.hypot(*(q[:, 3] - q[:, 0]).T)
    wide, high = (across, along) if vertical else (along, across)
    font = FONT * high * _SCALES[:, None]
    font = font * np.minimum(1.0, WIDEST[vertical] * wide / np.where(unit > 0, unit * font, np.inf))
    width, gap, pad = unit * font, GAP * font, PAD * font
    if vertical:
        y = np.repeat((q[:, 0, 1] + q[:, 1, 1])[None] / 2, len(font), axis=0) - font / 2
        sides = (np.maximum(q[:, 0, 0], q[:, 1, 0]) + gap, y), (np.minimum(q[:, 2, 0], q[:, 3, 0]) - gap - width, y)
    else:
        middle = lambda a, b: np.repeat((q[:, a, 0] + q[:, b, 0])[None] / 2, len(font), axis=0) - width / 2
        sides = (middle(3, 2), np.maximum(q[:, 3, 1], q[:, 2, 1]) + gap), (middle(0, 1), np.minimum(q[:, 0, 1], q[:, 1, 1]) - gap - HEIGHT * font)
    both = [np.stack([x - pad, y - pad, x + width + pad, y + HEIGHT * font + pad], axis=2) for x, y in sides]
    return np.stack(both, axis=1).reshape(len(TRIES), -1, 4)


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which boxes of a meet which of b inside."""
    return (a[:, None, :2] < b[None, :, 2:]).all(axis=2) & (b[None, :, :2] < a[:, None, 2:]).all(axis=2)


def _box(quads: np.ndarray) -> np.ndarray:
    points = quads.reshape(len(quads), 4, 2)
    return np.concatenate([points.min(axis=1), points.max(axis=1)], axis=1)


def _line_boxes(lines: list[tuple[bool, list[tuple[str | None, list[float]]]]]) -> list[np.ndarray]:
    return [_box(np.array([q for _, q in chars], float).reshape(-1, 8)) for _, chars in lines]


def _lines_of(rows: pd.DataFrame) -> list[tuple[bool, list[tuple[str | None, list[float]]]]]:
    return [(bool(v), [(c["reading"], list(c["quad"])) for c in chars]) for v, chars in zip(rows["vertical"], rows["chars"])]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the lists of a column begin and end in its numbers, and these; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(int), column.flatten().to_numpy(zero_copy_only=False).astype(float)


def _lists(ends: np.ndarray, numbers: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers.reshape(-1), pa.float64()))


def _measured(lines: DataFrame, image: str, measure: Measure) -> DataFrame:
    """Each line with, for each character, its label's ``ems`` (negative: none), its corners (``quads``) and its box (``boxes``), all flat; the line's box and ``reach``."""
    kind = lines.schema[image].dataType.simpleString()
    plain = [image, "line_no", "vertical", "width", "height"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars = batch.column(5)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(chars), 0).to_numpy(zero_copy_only=False))]).astype(int)
            every = chars.flatten()
            ems = np.array([measure(r, 1.0) if r else -1.0 for r in pc.struct_field(every, "reading").to_pylist()], float)
            quads = pc.struct_field(every, "quad").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 8)
            boxes, some = _box(quads), np.flatnonzero(np.diff(ends))
            whole = np.zeros((5, batch.num_rows))
            if len(some):
                starts = ends[some]
                whole[:2, some], whole[2:4, some] = np.minimum.reduceat(boxes[:, :2], starts).T, np.maximum.reduceat(boxes[:, 2:], starts).T
                whole[4, some] = REACH * np.maximum.reduceat((boxes[:, 2:] - boxes[:, :2]).max(axis=1), starts)
            lists = [_lists(ends, ems), _lists(8 * ends, quads), _lists(4 * ends, boxes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *lists, *map(pa.array, whole)], [*plain, "ems", "quads", "boxes", "left", "top", "right", "bottom", "reach"])

    numbers = ", ".join([*(f"{c} array<double>" for c in ("ems", "quads", "boxes")), *(f"{c} double" for c in ("left", "top", "right", "bottom", "reach"))])
    ddl = f"`{image}` {kind}, line_no int, vertical boolean, width double, height double, {numbers}"
    typed = (F.col("line_no").cast("int"), F.col("vertical").cast("boolean"), F.col("width").cast("double"), F.col("height").cast("double"))
    quad = F.transform("chars", lambda c: F.struct(c["reading"].alias("reading"), c["quad"].cast("array<double>").alias("quad")))
    return lines.select(image, *typed, quad.alias("chars")).mapInArrow(run, ddl)


def _free(tried: np.ndarray, blocked: np.ndarray) -> np.ndarray:
    """Which tries meet none of the boxes."""
    step = max(1, (1 << 20) // max(1, tried.shape[1] * len(blocked)))
    found = [np.zeros(0, bool)]
    for at in range(0, len(tried), step):
        t = tried[at : at + step, :, None]
        found.append(~((t[..., :2] < blocked[:, 2:]).all(axis=-1) & (blocked[:, :2] < t[..., 2:]).all(axis=-1)).any(axis=(1, 2)))
    return np.concatenate(found)


def place_labels(lines: DataFrame, image: str, measure: Measure = fixed_width, cell: float = 256.0) -> DataFrame:
    """Placements of the lines (image, width, height, line_no, vertical, chars array of reading and quad).

    Lines are taken from the top; each takes the first of: after, before, then
    both ever smaller, at which its labels stay on the image and off all other
    characters and earlier labels. If none does, full size with a halo.

    Lines are near if their zones (with the reach of labels) meet, by a grid
    join. Which places are free of near lines' characters is found line by
    line; only lines that are linked by near ones are walked together, for the
    choice among what is left. All joins are by shuffles: what Spark guesses of
    the size of arrays is far too low, and a broadcast would go through the
    driver.
    """
    kind = lines.schema[image].dataType.simpleString()
    boxed = materialized(_measured(lines, image, measure))
    ends = [F.col("left") - F.col("reach"), F.col("top") - F.col("reach"), F.col("right") + F.col("reach"), F.col("bottom") + F.col("reach")]
    zone = boxed.select(image, "line_no", *(v.alias(n) for v, n in zip(ends, ("x0", "y0", "x1", "y1"))))
    near = materialized(spatial.overlapping(zone, [image], "line_no", cell))
    both = near.select(image, F.col("first").alias("line_no"), F.col("second").alias("other")).union(near.select(image, "second", "first"))
    others = boxed.select(image, F.col("line_no").alias("other"), "boxes")
    obstacles = both.join(others.hint("merge"), [image, "other"]).groupBy(image, "line_no").agg(F.flatten(F.collect_list("boxes")).alias("obstacles"))
    node = lambda c: F.struct(F.col(image).alias("image"), F.col(c).alias("line"))
    roots = graph.components(near.select(node("first").alias("a"), node("second").alias("b")))
    rooted = roots.select(F.col("node.image").alias(image), F.col("node.line").alias("line_no"), F.col("root.line").alias("part"))
    asked = boxed.join(obstacles.hint("merge"), [image, "line_no"], "left").join(rooted.hint("merge"), [image, "line_no"], "left").withColumn("part", F.coalesce("part", "line_no"))

    def free_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zones = _flat(batch.column("zone"))[1].reshape(-1, 4)
            (at, ems), (_, quads), (near_at, boxes) = (_flat(batch.column(c)) for c in ("ems", "quads", "obstacles"))
            quads, boxes, near_at = quads.reshape(-1, 8), boxes.reshape(-1, 4), near_at // 4
            vertical, width, height = (batch.column(c).to_pylist() for c in ("vertical", "width", "height"))
            free, halo = [], []
            for k in range(batch.num_rows):
                own, blocked = slice(at[k], at[k + 1]), boxes[near_at[k] : near_at[k + 1]]
                shown = ems[own] >= 0
                tried = _all_strips(ems[own][shown], quads[own][shown], bool(vertical[k]))
                inside = (tried[:, :, :2] >= 0).all(axis=(1, 2)) & (tried[:, :, 2] <= width[k]).all(axis=1) & (tried[:, :, 3] <= height[k]).all(axis=1)
                places = np.flatnonzero(inside)
                free.append(places[_free(tried[places], blocked[_meet(zones[k : k + 1], blocked)[0]])].astype(np.int32))
                halo.append(next((j for j in (0, 1) if inside[j]), 0))
            kept = [batch.column(c) for c in (image, "part", "top", "left", "line_no", "vertical", "zone", "ems", "quads")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(free, pa.list_(pa.int32())), pa.array(halo, pa.int32())], names)

    names = [image, "part", "top", "left", "line_no", "vertical", "zone", "ems", "quads", "free", "with_halo"]
    ddl = f"`{image}` {kind}, part int, top double, left double, line_no int, vertical boolean, zone array<double>, ems array<double>, quads array<double>, free array<int>, with_halo int"
    choices = asked.select(image, "part", "top", "left", "line_no", "vertical", F.array(*ends).alias("zone"), "ems", "quads", "width", "height", "obstacles").mapInArrow(free_places, ddl)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken, used = None, np.zeros((64, 4)), 0
        for batch in batches:
            zones = _flat(batch.column("zone"))[1].reshape(-1, 4)
            (at, ems), (_, quads) = (_flat(batch.column(c)) for c in ("ems", "quads"))
            quads = quads.reshape(-1, 8)
            images, parts, vertical, free, halo = (batch.column(c).to_pylist() for c in (image, "part", "vertical", "free", "with_halo"))
            chosen, plain = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                if (images[k], parts[k]) != group:
                    group, used = (images[k], parts[k]), 0
                own = slice(at[k], at[k + 1])
                shown = ems[own] >= 0
                tried = _all_strips(ems[own][shown], quads[own][shown], bool(vertical[k]))
                earlier = taken[:used]
                good = np.flatnonzero(_free(tried[free[k]], earlier[_meet(zones[k : k + 1], earlier)[0]]))
                plain[k] = len(good)
                chosen[k] = free[k][good[0]] if len(good) else halo[k]
                end = used + tried.shape[1]
                if end > len(taken):
                    taken = np.concatenate([taken, np.zeros((end, 4))])
                taken[used:end], used = tried[chosen[k]], end
            sides, scales = ([TRIES[c][n] for c in chosen] for n in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(image), batch.column("line_no"), pa.array(sides, pa.string()), pa.array(scales, pa.float64()), pa.array(~plain)], [image, "line_no", "side", "scale", "halo"])

    ordered = choices.repartition(image, "part").sortWithinPartitions(image, "part", "top", "left", "line_no")
    return ordered.mapInArrow(walk, f"`{image}` {kind}, line_no int, side string, scale double, halo boolean")


def violations(lines: DataFrame, placements: DataFrame, image: str, measure: Measure = fixed_width) -> DataFrame:
    """For each image how many characters have a reading, how many labels are laid out, and how many strips without a halo cover another line's characters (``covered``), meet another line's (``stacked``) or leave the image (``outside``)."""
    kind = lines.schema[image].dataType.simpleString()
    joined = lines.join(placements, [image, "line_no"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("line_no")
        own = _lines_of(rows)
        laid = [layout(chars, vertical, side, scale, measure) for (vertical, chars), side, scale in zip(own, rows["side"], rows["scale"])]
        boxes = [strips(labels, vertical) for labels, (vertical, _) in zip(laid, own)]
        plain = [k for k, halo in enumerate(rows["halo"]) if not halo]
        found = {"covered": 0, "stacked": 0, "outside": 0}
        chars = _line_boxes(own)
        for k in plain:
            hits = lambda parts: _meet(boxes[k], np.concatenate([np.zeros((0, 4)), *parts])).any(axis=1).sum()  # noqa: E731, B023
            found["covered"] += hits([b for j, b in enumerate(chars) if j != k])
            found["stacked"] += hits([boxes[j] for j in plain if j != k])
            b = boxes[k]
            found["outside"] += int(((b[:, :2] < 0).any(axis=1) | (b[:, 2] > rows["width"].iloc[0]) | (b[:, 3] > rows["height"].iloc[0])).sum())
        syllables = sum(bool(reading) for _, line in own for reading, _ in line)
        return pd.DataFrame([{image: rows[image].iloc[0], "syllables": syllables, "labels": sum(map(len, laid)), **found}])

    return joined.groupBy(image).applyInPandas(run, f"{image} {kind}, syllables long, labels long, covered long, stacked long, outside long")
