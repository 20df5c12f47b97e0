"""Connected components of grids that are too large for a row: a grid is rows of tiles.

A tile is (keys, tx, ty, values): its own cells, row by row, of a grid that is
cut every ``tile`` cells from the top left; tiles at the right and bottom edge
may be smaller. Each tile is labelled alone. Cells at the edges of tiles that
touch cells of other tiles, diagonals included, are links between the labels;
only these cells and a row for each label are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import graph
from sparkloom.operators.raster import label_grid
from sparkloom.storage import materialized
from sparkloom.streaming import ranges


def tile_width(tx: int, width: int, tile: int) -> int:
    return min(tile, width - tx * tile)


def labelled_tiles(tiles: DataFrame, keys: list[str], width: int, tile: int, threshold: float) -> DataFrame:
    """Each tile with ``labels``, an array with 0 for cells up to the threshold, else the first cell (of the grid, row by row, plus 1) of the cell's component within the tile."""

    @F.pandas_udf("array<long>")
    def labels(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for tx, ty, values in batches:
            rows = []
            for x, y, v in zip(tx, ty, values):
                wide = tile_width(int(x), width, tile)
                found = label_grid(np.asarray(v, np.float64), wide, threshold)
                at_y, at_x = np.divmod(np.arange(len(found)), wide)
                cell = (int(y) * tile + at_y).astype(np.int64) * width + int(x) * tile + at_x + 1
                first = np.full(found.max(initial=0) + 1, np.iinfo(np.int64).max)
                np.minimum.at(first, found, cell)
                rows.append(np.where(found > 0, first[found], 0).tolist())
            yield pd.Series(rows)

    return tiles.where(F.size("values") > 0).select(*keys, "tx", "ty", "values", labels("tx", "ty", "values").alias("labels"))


def components(tiles: DataFrame, keys: list[str], width: int, tile: int, threshold: float, bound: int | None = None) -> DataFrame:
    """Each tile with ``components``: of each cell the number of its component in the grid, in order of first cells, or 0."""
    labelled = materialized(labelled_tiles(tiles, keys, width, tile, threshold))
    wide = F.least(F.lit(tile), width - F.col("tx") * tile)
    cells = labelled.select(*keys, "tx", "ty", wide.alias("wide"), F.size("labels").alias("size"), F.posexplode("labels").alias("at", "label"))
    x, y = F.col("at") % F.col("wide"), F.floor(F.col("at") / F.col("wide"))
    edge = (x == 0) | (x == F.col("wide") - 1) | (y == 0) | (y == F.floor(F.col("size") / F.col("wide")) - 1)
    at_edge = cells.where((F.col("label") > 0) & edge).select(*keys, "tx", "ty", "label", (F.col("tx") * tile + x).cast("long").alias("x"), (F.col("ty") * tile + y).cast("long").alias("y"))
    beside = F.explode(F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1)))))
    ahead = at_edge.select(*keys, F.col("tx").alias("of tx"), F.col("ty").alias("of ty"), F.col("label").alias("of"), beside.alias("p")).select(*keys, "of tx", "of ty", "of", "p.x", "p.y")
    met = ahead.join(at_edge, [*keys, "x", "y"]).where((F.col("tx") != F.col("of tx")) | (F.col("ty") != F.col("of ty")))
    node = lambda c: F.struct(*(F.col(k) for k in keys), F.col(c).alias("label"))
    roots = graph.components(met.select(node("of").alias("a"), node("label").alias("b")).distinct())
    rooted = roots.select(*(F.col(f"node.{k}").alias(k) for k in keys), F.col("node.label").alias("label"), F.col("root.label").alias("root"))
    own = labelled.select(*keys, "tx", "ty", F.explode(F.array_distinct("labels")).alias("label")).where("label > 0")
    named = materialized(own.join(rooted, [*keys, "label"], "left").withColumn("root", F.coalesce("root", "label")))
    numbers = ranges.running(named.select(*keys, "root").distinct(), keys, ["root"], sums={"comp": F.lit(1).cast("long")}, bound=bound)
    of_tile = named.join(numbers, [*keys, "root"]).groupBy(*keys, "tx", "ty").agg(F.map_from_entries(F.collect_list(F.struct("label", "comp"))).alias("numbers"))
    joined = labelled.join(of_tile, [*keys, "tx", "ty"], "left")
    number = lambda v: F.when(v > 0, F.element_at("numbers", v)).otherwise(F.lit(0).cast("long"))
    return joined.select(*keys, "tx", "ty", "values", F.transform("labels", number).alias("components"))
