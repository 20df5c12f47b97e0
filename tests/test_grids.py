import math

import numpy as np
from pyspark.sql import functions as F

from sparkloom.functions import geometry as G
from sparkloom.operators import assets, raster, sequence, spatial


def test_components():
    mask = np.array([[c == "#" for c in row] for row in ("#.##..", "##....", "....#.", "#..#..")], float).reshape(-1)
    found = raster.label_grid(mask, 6, 0.5)
    assert [set(np.flatnonzero(found == k)) for k in (1, 2, 3)] == [{0, 2, 3, 6, 7}, {16, 21}, {18}]
    spiral = np.zeros((9, 9))
    spiral[0, :] = spiral[:, 8] = spiral[8, :] = spiral[2:, 0] = spiral[2, :7] = 1
    assert raster.label_grid(spiral.reshape(-1), 9, 0.5).max() == 1


def test_hull_and_rectangle():
    assert raster.convex_hull(np.array([(1, 1), (3, 1), (6, 1), (6, 5), (1, 5), (3, 3)])).tolist() == [[1, 1], [6, 1], [6, 5], [1, 5]]
    r = raster.least_rectangle(raster.convex_hull(np.array([(12, 8), (52, 8), (52, 20), (12, 20)])))
    assert r[:2] == (32, 14) and sorted(r[6:]) == [6, 20]
    turn = math.radians(30)
    box = [(50 + x * math.cos(turn) - y * math.sin(turn), 50 + x * math.sin(turn) + y * math.cos(turn)) for x in (-10, 10) for y in (-2, 2)]
    r = raster.least_rectangle(raster.convex_hull(np.array(box)))
    assert np.allclose(sorted(r[6:]), [2, 10])
    assert raster.least_rectangle(raster.convex_hull(np.array([(0, 0), (1, 1)]))) is None


def test_box_of_a_block(spark):
    grid = np.zeros((32, 64))
    grid[10:20, 10:40] = 0.9
    for high, ratio, n in ((0.9, 1.5, 1), (0.5, 1.5, 0)):
        grids = spark.createDataFrame([(1, (grid / 0.9 * high).reshape(-1).tolist())], "id int, p array<double>")
        cells = raster.components(grids, "p", 64, 0.3, ("id",))
        every = grids.select("id", F.posexplode("p").alias("pix", "value")).select("id", (F.col("pix") % 64).alias("x"), F.floor(F.col("pix") / 64).alias("y"), "value")
        found = raster.boxes(cells, every, ["id"], 0.6, ratio).collect()
        assert len(found) == n
    thin = np.zeros((8, 8))
    thin[2:4, 1:7] = 0.9
    grids = spark.createDataFrame([(1, thin.reshape(-1).tolist())], "id int, p array<double>")
    assert raster.boxes(raster.components(grids, "p", 8, 0.3, ("id",)), grids.select("id", F.posexplode("p").alias("pix", "value")).select("id", (F.col("pix") % 8).alias("x"), F.floor(F.col("pix") / 8).alias("y"), "value"), ["id"], 0.1, 1.5).count() == 0


def test_resize_row(spark):
    rows = raster.resize(spark.createDataFrame([([10.0, 30.0, 50.0, 90.0],)], "p array<double>"), "p", 4, 2, 1, ()).orderBy("pix").collect()
    assert [r.value for r in rows] == [20, 70]


def test_detector_sizes(spark):
    sizes = spark.createDataFrame([(1500.0, 900.0), (1000.0, 2000.0), (500.0, 8.0)], "w double, h double").select(G.detector_size(F.col("w"), F.col("h"), 960).alias("s"))
    assert [(r.s.width, r.s.height) for r in sizes.collect()] == [(960, 576), (480, 960), (960, 32)]


def test_grown_rect(spark):
    assert spark.range(1).select(G.grown_by(F.lit(12.0), F.lit(4.0), F.lit(2.0))).first()[0] == 6.0


def test_views(spark):
    one = lambda c: tuple(spark.range(1).select(c.alias("v")).first().v)
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert one(G.clamp_view(*lit(0.1, 50, 0), *lit(300, 600, 300, 150), F.lit(8.0))) == (1, 0, 225)
    assert one(G.clamp_view(*lit(4, 100, -5000), *lit(300, 600, 300, 150), F.lit(8.0)))[:2] == (4, 0)
    assert one(G.clamp_view(*lit(50, 0, 0), *lit(300, 600, 300, 150), F.lit(8.0)))[0] == 8
    s, tx, ty = one(G.zoom_at(*lit(1, 10, 20), F.lit(3.0), *lit(110, 220)))
    assert s == 3 and (110 - tx) / s == (110 - 10) / 1 and (220 - ty) / s == 220 - 20
    assert one(G.visible_region(*lit(2, -300, -100), *lit(400, 400), *lit(500, 500))) == (150, 50, 200, 200)


def decoded(spark, classes):
    rows = [(t, c, 0.9) for t, c in enumerate(classes)]
    steps = spark.createDataFrame([(1, *r) for r in rows], "id int, t int, class int, score double")
    return sequence.collapse(steps, ["id"])


def test_collapse(spark):
    rows = decoded(spark, [2, 2, 0, 1, 0, 1, 3, 4]).orderBy("t0").collect()
    assert [(r["class"], r.t0, r.t1) for r in rows] == [(2, 0, 1), (1, 3, 3), (1, 5, 5), (3, 6, 6), (4, 7, 7)]
    assert decoded(spark, [0, 0, 0]).count() == 0


def test_best_class_of_equals(spark):
    steps = sequence.steps(spark.createDataFrame([(1, [0.2, 0.5, 0.5, 0.9, 0.1, 0.0])], "id int, p array<double>"), "p", 3, ("id",)).orderBy("t").collect()
    assert [(r["class"], r.score) for r in steps] == [(1, 0.5), (0, 0.9)]


def test_character_spans(spark):
    spans = spark.createDataFrame([(1, 0, 9), (1, 20, 29), (1, 40, 49), (2, 3, 4)], "id int, t0 int, t1 int")
    rows = sequence.character_spans(spans, ["id"], F.lit(60.0)).orderBy("id", "t0").collect()
    assert [(r.x0, r.x1) for r in rows] == [(0, 15), (15, 35), (35, 55), (0, 60)]


def test_hits(spark):
    boxes = spark.createDataFrame([("i", k, k, 100.0 + 40 * k, 0.0, 140.0 + 40 * k, 40.0) for k in range(3)], "img string, box int, ord int, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([("i", 1, 150.0, 20.0), ("i", 2, 225.0, 50.0), ("i", 3, 400.0, 300.0), ("i", 4, 140.0, 10.0)], "img string, tap int, x double, y double")
    rows = spatial.hits(points, boxes, ["img"], "tap", "box", 22.0, 64.0).collect()
    assert {r.tap: r.box for r in rows} == {1: 1, 2: 2, 4: 0}


def test_overlaps(spark):
    boxes = spark.createDataFrame([("i", 1, 0.0, 0.0, 10.0, 10.0), ("i", 2, 10.0, 0.0, 20.0, 10.0), ("i", 3, 5.0, 5.0, 95.0, 6.0), ("j", 4, 0.0, 0.0, 10.0, 10.0)], "img string, b int, x0 double, y0 double, x1 double, y1 double")
    assert {(r.first, r.second) for r in spatial.overlapping(boxes, ["img"], "b", 8.0).collect()} == {(1, 3), (2, 3)}


def test_models(spark):
    shipped = spark.createDataFrame([("det", "v6-tiny"), ("rec", "v6-tiny"), ("rec", "v6-small")], "kind string, id string")
    row = assets.choose_models(spark.createDataFrame([("v9", "v6-small")], "det string, rec string"), shipped, {"det": "v6-tiny", "rec": "v6-tiny"}).first()
    assert (row.chosen_det, row.chosen_rec, row.rejected) == ("v6-tiny", "v6-small", ["det=v9"])


def test_first_source(spark):
    wanted = assets.manifest(spark.createDataFrame([("a", b"alpha"), ("b", b"bravo!"), ("c", b"c")], "file string, body binary"), ["file"], "body")
    broken = wanted.where("file = 'a'").withColumn("sha256", F.lit("0"))
    rows = assets.first_source(wanted, [("current", broken), ("older", wanted.where("file <> 'c'"))], "file").collect()
    assert {r.file: r.source for r in rows} == {"a": "older", "b": "older", "c": None}


def test_cells_on_the_edge_of_a_leaning_rectangle_count(spark):
    # Of exact distances 2.5 to the rectangle's middle line, some are a little more when rounded.
    cells, rects, want = [], [], {}
    for k in range(12):
        cells += [(k, x, y, float(x + 20 * y)) for x in range(16) for y in range(16)]
        cx, cy = 5 + k / 10, 7.3
        rects.append((k, 1, cx, cy, 0.6, 0.8, -0.8, 0.6, 2.0, 1.0))
        inside = [x + 20 * y for x in range(16) for y in range(16) if abs(30 * (2 * x - 10) - 6 * k + 40 * (2 * y) - 584) <= 250 and abs(-40 * (2 * x - 10) + 8 * k + 30 * (2 * y) - 438) <= 150]
        want[k] = sum(inside) / len(inside)
    names = "g int, comp int, cx double, cy double, ux double, uy double, vx double, vy double, half_u double, half_v double"
    found = raster.region_mean(spark.createDataFrame(rects, names), spark.createDataFrame(cells, "g int, x int, y int, value double"), ["g"]).collect()
    assert {r.g: round(r["mean"], 9) for r in found} == {k: round(v, 9) for k, v in want.items()}
