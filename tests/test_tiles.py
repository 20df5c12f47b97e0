import numpy as np
import pytest

from sparkloom.operators import tiles
from sparkloom.operators.raster import label_grid


def cut(key, grid, tile):
    high, wide = grid.shape
    return [(key, x, y, grid[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile].reshape(-1).tolist()) for y in range(-(-high // tile)) for x in range(-(-wide // tile))]


@pytest.mark.parametrize("tile", [2, 3, 8, 64])
def test_components_do_not_depend_on_tiles(spark, tile):
    draw = np.random.default_rng(tile)
    spiral = np.zeros((21, 26))
    for k in range(0, 10, 2):
        spiral[k : 21 - k, 25 - k] = spiral[20 - k, k : 26 - k] = spiral[k, k + 1 : 26 - k] = 1
        spiral[k + 2 : 21 - k, k] = spiral[k + 2, max(0, k - 1) : k + 1] = 1
    grids = {"spiral": spiral, "noise": (draw.random((21, 26)) > 0.6).astype(float), "checks": np.indices((21, 26)).sum(axis=0) % 2.0, "none": np.zeros((21, 26))}
    rows = [r for key, grid in grids.items() for r in cut(key, grid, tile)]
    frame = spark.createDataFrame(rows, "g string, tx int, ty int, values array<double>").repartition(5)
    found = {key: np.zeros((21, 26), int) for key in grids}
    for r in tiles.components(frame, ["g"], 26, tile, 0.5, bound=10).collect():
        wide = tiles.tile_width(r.tx, 26, tile)
        part = np.array(r.components).reshape(-1, wide)
        found[r.g][r.ty * tile : r.ty * tile + part.shape[0], r.tx * tile : r.tx * tile + wide] = part
    for key, grid in grids.items():
        assert (found[key].reshape(-1) == label_grid(grid.reshape(-1), 26, 0.5)).all()
