import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import geometry as G
from sparkloom.functions import pixels
from sparkloom.operators import raster, recognition, scan


def rgba(grey):
    grey = np.rint(np.asarray(grey, float) * 255).astype(np.uint8)
    return np.stack([grey, grey, grey, np.full_like(grey, 255)], axis=-1)


def images(spark, pictures):
    rows = [(k, p.shape[1], p.shape[0], p.tobytes()) for k, p in enumerate(pictures)]
    return spark.createDataFrame(rows, "img int, width int, height int, data binary").repartition(3)


def page(height, width, bars):
    out = np.zeros((height, width))
    for top, left, high, wide, value in bars:
        out[top : top + high, left : left + wide] = value
    return rgba(out)


def models():
    """Made inside a function, so that workers need not import this file."""

    def bright(tensor):
        """Where the blue plane is bright, as the detector gets it."""
        return (tensor[:, 0] * 0.229 + 0.485 > 0.3) * 0.95

    def brightness(tensor):
        """Steps of 8 columns: dark or padded is blank, then two classes, then a space."""
        middle = (tensor[:, 0, 24, 4::8] + 1) / 2
        kinds = np.where((tensor[:, :, :, 4::8] == 0).all(axis=(1, 2)) | (middle < 0.55), 0, np.where(middle > 0.85, 1, np.where(middle < 0.75, 2, 3)))
        return np.eye(4)[kinds] * 0.9

    return recognition.Model("bright", lambda: bright, (1, 3, 32, 32)), recognition.Model("brightness", lambda: brightness, (1, 3, 48, 320))


DETECTOR, READER = models()


def test_scan_of_images_of_several_sizes(spark):
    one = page(64, 96, [(10, 10, 16, 32, 0.95), (10, 42, 16, 32, 0.7), (40, 10, 16, 40, 0.8)])
    tall = page(128, 64, [(20, 20, 80, 16, 0.95)])
    blank = page(30, 200, [])
    found = scan.scan(images(spark, [one, tall, blank]), "img", DETECTOR, READER, ["a", "b"], long_side=96, ratio=0.3).orderBy("img", "place").collect()
    assert [(r.img, r.place, r.text, r.vertical) for r in found] == [(0, 1, "ab", False), (1, 1, "a", True)]
    assert found[0].score == pytest.approx(0.9)
    a, b = (c.quad for c in found[0].chars)
    assert a[0].x < 12 and 38 < a[1].x < 46 and a[1].x == b[0].x and b[1].x > 70
    down = found[1].quad
    assert down[0].y < down[1].y and down[0].x == down[1].x > down[3].x


def test_batches_change_nothing(spark):
    draw = np.random.default_rng(3)
    pictures = [page(int(h), int(w), [(0, int(w) * k // 7, int(h), int(w) // 7, draw.choice([0.0, 0.7, 0.95])) for k in range(7)]) for h, w in zip(draw.integers(5, 90, 40), draw.integers(8, 1500, 40))]
    crops = images(spark, pictures)
    by = {}
    for batch, parts in ((1, 1), (16, 3), (4, 7)):
        rows = recognition.recognised(crops.repartition(parts), ["img"], READER, 4, batch=batch).collect()
        by[batch] = {r.img: r for r in rows}
    assert by[1] == by[16] == by[4] and len(by[1]) == 40
    for k, r in by[1].items():
        h, w = pictures[k].shape[:2]
        own = min(3200, max(320, -(-48 * w // h // 8) * 8 if 48 * w % h == 0 else -(-(48 * w / h) // 8) * 8))
        assert r.wide == min(3200, -(-own // 64) * 64) and r.filled == max(1, min(r.wide, -(-48 * w // h))) and r.steps == r.wide // 8
        assert all(c.t0 * 8 < r.filled for c in r.chars)


def test_no_pixel_crosses_the_network(spark, monkeypatch):
    crops = images(spark, [page(20, 30 * (k + 1), [(0, 0, 20, 30, 0.9)]) for k in range(12)]).coalesce(1)
    read = recognition.recognised(crops, ["img"], READER, 4, batch=5)
    assert "rangepartitioning" not in read._jdf.queryExecution().executedPlan().toString()
    plain = sorted(tuple(r) for r in read.collect())
    monkeypatch.setattr(recognition, "HELD", 1)
    assert plain == sorted(tuple(r) for r in recognition.recognised(crops, ["img"], READER, 4, batch=5).collect()) and len(plain) == 12


def test_models_are_made_once(spark, tmp_path):
    log = str(tmp_path / "made")

    def make():
        def run(tensor):
            with open(log, "a") as out:
                out.write(f"{tensor.shape[0]} {tensor.any()}\n")
            return np.zeros((len(tensor), tensor.shape[3] // 8, 2))

        return run

    model = recognition.Model("counted", make, (1, 3, 48, 320))
    crops = images(spark, [page(48, 100, [(0, 0, 48, 100, 0.9)]) for _ in range(9)]).coalesce(1)
    for _ in range(2):
        recognition.recognised(crops, ["img"], model, 2, batch=4).collect()
    lines = open(log).read().split("\n")[:-1]
    made = [x for x in lines if x.endswith("False")]
    assert sum(int(x.split()[0]) for x in lines if x.endswith("True")) == 18 and len(made) <= 4  # no more than workers


def test_scores_that_do_not_fit(spark):
    crops = images(spark, [page(48, 100, [])])
    wrong = recognition.Model("wrong", lambda: lambda t: np.zeros((len(t), 5, 3)), (1, 3, 48, 320))
    with pytest.raises(Exception, match="no steps of 2 classes"):
        recognition.recognised(crops, ["img"], wrong, 2).collect()
    sized = crops.withColumn("size", G.detector_size(F.col("width"), F.col("height"), 64))
    with pytest.raises(Exception, match="9 scores for 64 by 32"):
        recognition.detected(sized, "img", recognition.Model("nine", lambda: lambda t: np.zeros(9), (1, 3, 32, 32))).collect()
    assert recognition.recognised(crops.limit(0), ["img"], READER, 4).count() == 0


def test_boxes_of_maps_equal_those_of_rows(spark):
    draw = np.random.default_rng(4)
    rows = []
    for k in range(14):
        grid = np.zeros((40, 60))
        for _ in range(6):
            top, left, high, wide = draw.integers(0, 34), draw.integers(0, 50), draw.integers(2, 9), draw.integers(2, 20)
            grid[top : top + high, left : left + wide] = draw.choice([0.5, 0.625, 0.875])
        rows.append((k, grid.reshape(-1).tolist(), 60, 40, 120, 90))
    maps = spark.createDataFrame(rows, "k int, v array<double>, wide int, high int, `image width` int, `image height` int")
    plain = raster.text_boxes(maps.select("k", "v"), "v", 60, ["k"], 0.3, 0.6, 1.5, 5, (120.0, 90.0))
    whole = raster.map_boxes(maps, "v", ["k"], 0.3, 0.6, 1.5, 5)
    shape = lambda df: sorted((r.k, r.place, r.comp, round(r.score, 9), [(p.x, p.y) for p in r.quad]) for r in df.collect())
    assert shape(whole) == shape(plain) and whole.count() > 5


def test_pixels_between_pixels():
    ramp = np.zeros((2, 4, 4), np.uint8)
    ramp[:, :, 0] = [0, 10, 20, 30]
    assert pixels.resized(ramp, 8, 2)[0, :, 0].tolist() == [0, 2, 8, 12, 18, 22, 28, 30]  # 2.5, 7.5, ... to the even one
    frame = {"origin": {"x": 3.0, "y": 0.0}, "r": {"x": -1.0, "y": 0.0}, "a": {"x": 0.0, "y": 1.0}, "width": 4, "height": 2}
    assert pixels.warped(ramp, frame)[1, :, 0].tolist() == [30, 20, 10, 0]
    assert pixels.detector_tensor(ramp).shape == (3, 2, 4) and pixels.recogniser_tensor(ramp)[2, 0, 0] == -1
