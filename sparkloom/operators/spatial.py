"""Joins of points, boxes and quads in the plane, by grid cells of several sizes.

A box lies in cells about as large as itself: cells double in size from level
to level, and a box's level is the first at which it spans two cells an axis at
most, so that a large box is in four cells and not in thousands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import geometry as G
from sparkloom.storage import materialized
from sparkloom.streaming import ranges


def _with_level(boxes: DataFrame, size: float) -> tuple[DataFrame, int]:
    """Boxes with ``level``, and the highest level there is."""
    widest = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(size))
    levelled = boxes.withColumn("level", F.ceil(F.log2(widest / size)).cast("int"))
    return levelled, levelled.agg(F.max("level")).first()[0] or 0


#: Rows of a table with one for each key that are broadcast at most.
BROADCAST_KEYS = 10_000


def _of_keys(table: DataFrame) -> DataFrame:
    """A table with a row for each key, for joins: broadcast if that is bounded, else by a shuffle."""
    table = materialized(table)
    return F.broadcast(table) if table.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else table.hint("merge")


def _cell(column: str | Column, size: float, level: Column) -> Column:
    return F.floor((F.col(column) if isinstance(column, str) else column) / (F.lit(size) * F.pow(F.lit(2.0), level)))


def _in_cells(boxes: DataFrame, size: float) -> DataFrame:
    """Each box (x0, y0, x1, y1, level) in the cells of its level that it touches."""
    level = F.col("level")
    wide = boxes.withColumn("gx", F.explode(F.sequence(_cell("x0", size, level), _cell("x1", size, level))))
    return wide.withColumn("gy", F.explode(F.sequence(_cell("y0", size, level), _cell("y1", size, level))))


def overlapping(boxes: DataFrame, keys: list[str], id_column: str, size: float) -> DataFrame:
    """Pairs of boxes of a key whose open interiors meet, each once; the smaller of two is looked up at the larger one's level."""
    levelled, top = _with_level(boxes, size)
    homes = _in_cells(levelled, size).alias("b")
    probes = levelled.withColumnRenamed("level", "own").withColumn("level", F.explode(F.sequence(F.col("own"), F.lit(top))))
    a = _in_cells(probes, size).alias("a")
    cond = (F.col("a.level") == F.col("b.level")) & (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy"))
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    for lo, hi in (("x0", "x1"), ("y0", "y1")):
        cond = cond & (F.col(f"a.{lo}") < F.col(f"b.{hi}")) & (F.col(f"b.{lo}") < F.col(f"a.{hi}"))
    # Boxes of one level find each other twice, and two boxes may share several cells.
    cond = cond & ((F.col("a.own") < F.col("b.level")) | (F.col(f"a.{id_column}") < F.col(f"b.{id_column}")))
    for lo, g in (("x0", "gx"), ("y0", "gy")):
        cond = cond & (_cell(F.greatest(f"a.{lo}", f"b.{lo}"), size, F.col("b.level")) == F.col(f"a.{g}"))
    pair = [f(f"a.{id_column}", f"b.{id_column}") for f in (F.least, F.greatest)]
    return a.join(homes.hint("merge"), cond).select(*(F.col(f"a.{k}") for k in keys), pair[0].alias("first"), pair[1].alias("second"))


def _meets(a: str, b: str) -> Column:
    out = F.lit(True)
    for lo, hi in (("x0", "x1"), ("y0", "y1")):
        out = out & (F.col(f"{a}{lo}") < F.col(f"{b}{hi}")) & (F.col(f"{b}{lo}") < F.col(f"{a}{hi}"))
    return out


def _met_by_plain(plain: DataFrame, keys: list[str]) -> DataFrame:
    """For each class of boxes with an inside how many boxes it meets, itself included.

    Of all that begin before its end, those are taken off that end before it
    begins, in x and in y. Each of the four terms counts corners below a place:
    x is replaced by its rank, corners are summed in dyadic ranges of ranks, and
    a place asks those ranges that make up all ranks before it for a running
    sum over y. So rows grow with boxes times the logarithm of the ranks.
    """
    values = plain.select(*keys, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    ranks = materialized(ranges.running(values, keys, ["x"], sums={"rank": F.lit(1)}).select(*keys, "x", "rank"))
    bits = int(ranks.agg(F.max("rank")).first()[0] or 0).bit_length()
    if not bits:
        return plain.select("class", F.lit(0).cast("long").alias("met"))
    ranked = plain
    for end in ("x0", "x1"):
        ranked = ranked.join(ranks.withColumnsRenamed({"x": end, "rank": f"rank {end}"}).hint("merge"), [*keys, end])
    ranked = materialized(ranked)
    data, places = [], []
    for term, (x, y) in enumerate((x, y) for y in "01" for x in "01"):
        # By x0 and y0: what begins before the other's end. By x1 and y1: what has ended where the other begins, equal ends included.
        first = F.col(f"rank x{x}") - 1
        upto = F.col("rank x1") - 1 if x == "0" else F.col("rank x0")
        sign = 1 if x == y else -1
        data.append(F.struct(F.lit(term).alias("term"), first.alias("r"), F.col(f"y{y}").alias("y"), F.lit(1 if y == "0" else -1).alias("kind")))
        places.append(F.struct(F.lit(term).alias("term"), upto.alias("r"), F.col("y1" if y == "0" else "y0").alias("y"), F.lit(sign).alias("sign")))
    levels = lambda bit: F.explode(F.expr(f"filter(sequence(0, {bits - 1}), j -> (shiftright(r, j) & 1) = {bit})"))
    node = [*keys, "term", "level", "node"]
    below = ranked.select(*keys, "n", F.inline(F.array(*data))).withColumn("level", levels(0)).withColumn("node", F.expr("shiftright(r, level)"))
    below = below.groupBy(*node, "y", "kind").agg(F.sum("n").alias("n")).select(*node, "y", "kind", F.lit(None).cast(plain.schema["class"].dataType).alias("class"), "n", F.lit(0).alias("sign"))
    asked = ranked.select(*keys, "class", F.inline(F.array(*places))).withColumn("level", levels(1)).withColumn("node", F.expr("shiftright(r, level) - 1"))
    asked = asked.select(*node, "y", F.lit(0).alias("kind"), "class", F.lit(0).cast("long").alias("n"), "sign")
    summed = ranges.running(materialized(below.unionByName(asked)), node, ["y", "kind", "class"], sums={"sum": F.col("n")})
    return summed.where("kind = 0").groupBy("class").agg(F.sum(F.col("sign") * F.col("sum")).alias("met"))


def overlap_counts(boxes: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """For each box (a row of keys, id, x0, x1, y0, y1) the least id of the boxes of its key that equal it (``class_id``), and how many other boxes of its key its open interior meets (``n_links``), copies included.

    No pairs are made: equal boxes are one class, and classes are counted by
    sums. Boxes without an inside (an end not after its beginning), if there are
    any, are compared with all classes of their key one by one. A null key or
    coordinate meets nothing.
    """
    sides = ["x0", "x1", "y0", "y1"]
    own = boxes.select(*keys, id_column, *((F.col(c).cast("double") + 0.0).alias(c) for c in sides))
    classes = own.groupBy(*keys, *sides).agg(F.min(id_column).alias("class_id"), F.count("*").alias("n"))
    classes = materialized(classes.withColumn("class", F.struct(*keys, *sides)))
    known = F.lit(True)
    for c in [*keys, *sides]:
        known = known & F.col(c).isNotNull()
    inside = (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    counted = _met_by_plain(classes.where(known & inside), keys)
    odd = classes.where(known & ~inside)
    if not odd.isEmpty():
        side = lambda df, name: df.select(*keys, *(F.col(c).alias(f"{name}{c}") for c in [*sides, "n", "class", "plain"]))
        a, b = side(odd.withColumn("plain", F.lit(False)), "a "), side(classes.where(known).withColumn("plain", inside), "b ")
        met = a.join(b, keys).where(_meets("a ", "b "))
        # Odd ones count all they meet; plain ones have counted one another, and count the odd ones here.
        ends = F.array(F.struct(F.col("a class").alias("class"), F.col("b n").alias("met")), F.when(F.col("b plain"), F.struct(F.col("b class").alias("class"), F.col("a n").alias("met"))))
        counted = counted.unionByName(met.select(F.inline(F.array_compact(ends)))).groupBy("class").agg(F.sum("met").alias("met"))
    itself = F.when(known & inside, 1).otherwise(0)
    links = classes.join(counted.hint("merge"), "class", "left").withColumn("n_links", (F.coalesce("met", F.lit(0)) - itself).cast("long"))
    same = [own[c].eqNullSafe(links[c]) for c in [*keys, *sides]]
    return own.join(links.hint("merge"), same).select(*(own[k] for k in keys), own[id_column], "class_id", "n_links")


def _in_fine_cells(shapes: DataFrame, size: float) -> DataFrame:
    """Shapes in the cells that their own box touches, of a size for each axis: two to four to a box's side, unless the least size is larger."""
    out = shapes
    for c, level in (("x", "lx"), ("y", "ly")):
        side = F.greatest(F.col(f"own {c}1") - F.col(f"own {c}0"), F.lit(4 * size))
        out = out.withColumn(level, F.ceil(F.log2(side / (4 * size))).cast("int"))
    for c, level, g in (("x", "lx", "gx"), ("y", "ly", "gy")):
        ends = [_cell(f"own {c}{n}", size, F.col(level)) for n in (0, 1)]
        out = out.withColumn(g, F.explode(F.sequence(*ends)))
    return out


def _first_inside(places: DataFrame, shapes: DataFrame, keys: list[str], shape_id: str, inside: Column, size: float) -> DataFrame:
    """For each place (keys, x, y) the first shape that holds it, if any.

    A shape that covers a cell whole holds all places there, so of such shapes
    only the cell's first counts, and of those that cover it in part only
    earlier ones: what meets the places doesn't grow with the shapes of a cell.
    """
    place, cell = [*keys, "x", "y"], [*keys, "lx", "ly", "gx", "gy"]
    fine = _in_fine_cells(shapes, size)
    # A cell's ends, with some room for the rounding of places' cells.
    for c, g, level in (("x", "gx", "lx"), ("y", "gy", "ly")):
        wide = F.lit(size) * F.pow(F.lit(2.0), F.col(level))
        room = F.abs(F.col(g) * wide) * 1e-12
        fine = fine.withColumns({f"cell {c}0": F.col(g) * wide - room, f"cell {c}1": F.col(g) * wide + wide + room})
    within = lambda x, y: (x >= F.col("own x0")) & (x <= F.col("own x1")) & (y >= F.col("own y0")) & (y <= F.col("own y1"))
    covers = F.lit(True)
    for n in (0, 1):
        for m in (0, 1):
            x, y = F.col(f"cell x{n}"), F.col(f"cell y{m}")
            covers = covers & within(x, y) & inside(x, y)
    cells = fine.select(*cell, "ord", covers.alias("whole"))
    first = cells.where("whole").groupBy(*cell).agg(F.min("ord").alias("first"))
    parts = cells.where("not whole").select(*cell, "ord").join(first.hint("merge"), cell, "left").where("first is null or ord < first").select(*cell, "ord", F.lit(False).alias("whole"))
    rivals = parts.unionByName(first.select(*cell, F.col("first").alias("ord"), F.lit(True).alias("whole")))
    levels = _of_keys(fine.groupBy(*keys).agg(F.collect_set(F.struct("lx", "ly")).alias("levels")))
    asked = places.join(levels, keys).withColumn("l", F.explode("levels")).select(*place, "l.lx", "l.ly")
    asked = asked.withColumns({"gx": _cell("x", size, F.col("lx")), "gy": _cell("y", size, F.col("ly"))})
    pairs = asked.join(rivals.hint("merge"), cell).select(*place, "ord", "whole")
    judged = pairs.join(shapes.hint("merge"), [*keys, "ord"]).where(F.col("whole") | (within(F.col("x"), F.col("y")) & inside(F.col("x"), F.col("y"))))
    return judged.groupBy(*place).agg(F.min_by(shape_id, "ord").alias(shape_id))


def _nearest(places: DataFrame, shapes: DataFrame, keys: list[str], shape_id: str, size: float) -> DataFrame:
    """For each place the shape with the nearest centre within its ``far``, the first of equals."""
    place = [*keys, "x", "y"]
    zones = shapes.select(*keys, shape_id, "ord", "cx", "cy", "far", *((F.col(f"c{c}") + sign * F.col("far")).alias(f"{c}{n}") for c in "xy" for n, sign in ((0, -1), (1, 1))))
    levelled, top = _with_level(zones, size)
    cells = _in_cells(levelled, size).drop("x0", "x1", "y0", "y1")
    p = places.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    p = p.withColumns({"gx": _cell("x", size, F.col("level")), "gy": _cell("y", size, F.col("level"))})
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    joined = p.join(cells.hint("merge"), [*keys, "level", "gx", "gy"]).select(*place, shape_id, "ord", "far", F.sqrt(dx * dx + dy * dy).alias("away")).where("away <= far")
    # The least distance first, by itself: that needs no sorting of all pairs.
    least = joined.groupBy(*place).agg(F.min("away").alias("least"))
    return joined.join(least.hint("merge"), place).where("away = least").groupBy(*place).agg(F.min_by(shape_id, "ord").alias(shape_id))


def _first_or_nearest(points: DataFrame, shapes: DataFrame, keys: list[str], point_id: str, shape_id: str, inside: Callable[[Column, Column], Column], size: float) -> DataFrame:
    """For each point the first shape (own x0 to own y1, cx, cy, far, ord) that holds it, by ``inside`` within its box, else the nearest centre within ``far``.

    Points at one place are looked up once, and only places in no shape look for centres.
    What grows with points or shapes is joined by shuffles: Spark's estimates, which go by
    the files' compressed size, would send it whole through the driver.
    """
    shapes = materialized(shapes.repartition(*keys, "ord"))
    # The box around all shapes of a key with what they reach.
    low, high = (lambda c: F.min(F.least(f"own {c}0", F.col(f"c{c}") - F.col("far")))), (lambda c: F.max(F.greatest(f"own {c}1", F.col(f"c{c}") + F.col("far"))))
    bounds = _of_keys(shapes.groupBy(*keys).agg(*(f(c).alias(f"{name} {c}") for c in "xy" for name, f in (("low", low), ("high", high)))))
    places = points.select(*keys, "x", "y").distinct().join(bounds, keys).where(F.col("x").between(F.col("low x"), F.col("high x")) & F.col("y").between(F.col("low y"), F.col("high y")))
    places = materialized(places.select(*keys, "x", "y"))
    held = materialized(_first_inside(places, shapes, keys, shape_id, inside, size / 16).withColumn("inside", F.lit(True)))
    left = places.join(held.hint("merge"), [*keys, "x", "y"], "left_anti")
    found = held.unionByName(_nearest(left, shapes, keys, shape_id, size).withColumn("inside", F.lit(False)))
    return points.select(*keys, point_id, "x", "y").join(found.hint("merge"), [*keys, "x", "y"]).select(*keys, point_id, shape_id, "inside")


def quad_hits(points: DataFrame, quads: DataFrame, keys: list[str], point_id: str, quad_id: str, reach: float, size: float) -> DataFrame:
    """For each point (x, y) the first quad (by ``ord``) that holds it, edges included, else the nearest centre within reach.

    Reach is the longer of the quad's first and last edge, ``reach`` at least.
    Points that hit nothing have no row. Sides are only looked at for points in
    a quad's box. Distances are roots of sums of squares, which are the same
    in every engine, so that equal ones stay equal.
    """
    q = F.col("quad")
    corners = {f"{c}{k} of quad": q[k][c] for k in range(4) for c in "xy"}
    flat = quads.select(*keys, quad_id, "ord", *(v.cast("double").alias(n) for n, v in corners.items()))
    at = lambda k, c: F.col(f"{c}{k} of quad")
    edge = lambda k, m: F.sqrt(sum(d * d for d in (at(m, c) - at(k, c) for c in "xy")))
    ends = {f"own {c}{n}": f(*(at(k, c) for k in range(4))) for c in "xy" for n, f in ((0, F.least), (1, F.greatest))}
    shapes = flat.withColumns({"far": F.greatest(F.lit(reach), edge(0, 1), edge(0, 3)), "cx": (at(0, "x") + at(2, "x")) / 2, "cy": (at(0, "y") + at(2, "y")) / 2} | ends)
    inside = lambda x, y: G.inside_quad([(at(k, "x"), at(k, "y")) for k in range(4)], x, y)
    return _first_or_nearest(points, shapes, keys, point_id, quad_id, inside, size)


def hits(points: DataFrame, boxes: DataFrame, keys: list[str], point_id: str, box_id: str, reach: float, size: float) -> DataFrame:
    """The same for boxes (x0, y0, x1, y1), by comparisons alone."""
    slim = boxes.select(*keys, box_id, "ord", *(F.col(c).cast("double").alias(f"own {c}") for c in ("x0", "y0", "x1", "y1")))
    far = F.greatest(F.lit(reach), F.col("own x1") - F.col("own x0"), F.col("own y1") - F.col("own y0"))
    shapes = slim.withColumns({"far": far, "cx": (F.col("own x0") + F.col("own x1")) / 2, "cy": (F.col("own y0") + F.col("own y1")) / 2})
    return _first_or_nearest(points, shapes, keys, point_id, box_id, lambda x, y: F.lit(True), size)
