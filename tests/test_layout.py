import random

import numpy as np
import pytest

from sparkloom.operators import layout
from sparkloom.sources import models


def row(x, y, *readings):
    return False, [(r, [x + 40 * k, y, x + 40 * k + 40, y, x + 40 * k + 40, y + 40, x + 40 * k, y + 40]) for k, r in enumerate(readings)]


def place(lines: list[tuple[bool, list[tuple[str | None, list[float]]]]], width: float, height: float) -> list[tuple[str, float, bool]]:
    """Side, scale and halo for each line of an image, by one pass over all of them."""
    boxes = layout._line_boxes(lines)
    owner = np.repeat(np.arange(len(lines)), [len(b) for b in boxes])
    chars_boxes = np.concatenate([np.zeros((0, 4)), *boxes])
    whole = [np.concatenate([b[:, :2].min(axis=0), b[:, 2:].max(axis=0)]) if len(b) else np.zeros(4) for b in boxes]
    taken, used = np.zeros((sum(len(b) for b in boxes), 4)), 0
    out: list[tuple[str, float, bool]] = [("after", 1.0, False)] * len(lines)
    for n in sorted(range(len(lines)), key=lambda k: (whole[k][1], whole[k][0])):
        vertical, chars = lines[n]
        reach = layout.REACH * (boxes[n][:, 2:] - boxes[n][:, :2]).max() if len(boxes[n]) else 0.0
        zone = (whole[n] + np.array([-reach, -reach, reach, reach]))[None]
        near, earlier = layout._meet(zone, chars_boxes)[0] & (owner != n), layout._meet(zone, taken[:used])[0]
        others = np.concatenate([chars_boxes[near], taken[:used][earlier]])
        tried = layout.all_strips(chars, vertical)
        inside = (tried[:, :, :2] >= 0).all(axis=(1, 2)) & (tried[:, :, 2] <= width).all(axis=1) & (tried[:, :, 3] <= height).all(axis=1)
        free = next((k for k in np.flatnonzero(inside) if not len(others) or not layout._meet(tried[k], others).any()), None)
        if free is not None:
            chosen, halo = int(free), False
        else:
            chosen, halo = next((k for k in (0, 1) if inside[k]), 0), True
        out[n] = (*layout.TRIES[chosen], halo)
        taken[used : used + tried.shape[1]] = tried[chosen]
        used += tried.shape[1]
    return out


def test_layout():
    (one,) = layout.layout(row(100, 50, "ā")[1], False, "after", 1.0)
    assert (one["font"], one["x"], round(one["y"], 6)) == (18, 120, 92.7)
    (wide,) = layout.layout([("zhuāng", [0, 0, 20, 0, 20, 40, 0, 40])], False, "after", 1.0)
    assert (round(wide["font"], 6), round(wide["width"], 6)) == (5, 18)
    assert layout.layout([(None, [0] * 8)], False, "after", 1.0) == []


@pytest.mark.parametrize(
    ("ys", "line", "expected"),
    [((0, 100), 0, ("after", 1, False)), ((0, 100), 1, ("after", 1, False)), ((50, 100), 0, ("before", 1, False)), ((8, 50, 115), 1, ("after", 0.9, False)), ((8, 50, 92), 1, ("after", 1, True))],
)
def test_place(ys, line, expected):
    side, scale, halo = place([row(0, y, "ā") for y in ys], 1e9, 1e9)[line]
    assert (side, halo) == (expected[0], expected[2]) and abs(scale - expected[1]) < 1e-9


def test_place_on_frames(spark):
    rows = [(img, 500.0, 500.0, k, False, [{"reading": r, "quad": [float(v) for v in q]} for r, q in row(0, y, "ā")[1]]) for img in (1, 2) for k, y in enumerate((50, 100))]
    lines = spark.createDataFrame(rows, "img int, width double, height double, line_no int, vertical boolean, chars array<struct<reading:string,quad:array<double>>>")
    found = {(r.img, r.line_no): (r.side, r.scale, r.halo) for r in layout.place_labels(lines, "img").collect()}
    assert found == {(i, k): (s, 1.0, False) for i in (1, 2) for k, s in ((0, "before"), (1, "after"))}


def entry(key, value):
    inner = b"\x0a" + bytes([len(key)]) + key + b"\x12" + bytes([len(value)]) + value
    return b"\x72" + bytes([len(inner)]) + inner


def test_model_metadata(spark, tmp_path):
    data = b"\x08\x07" + b"\x3a\xac\x02" + bytes(300) + entry(b"character", "　\n一\n乙\n".encode()) + entry(b"shape", b"48")
    assert models.model_metadata(data) == {"character": "　\n一\n乙\n", "shape": "48"}
    assert models.character_list("　\n一\n乙\n") == ["　", "一", "乙"]
    (tmp_path / "m.onnx").write_bytes(data)
    assert {(r.key, r.value) for r in models.read_model_metadata(spark, str(tmp_path / "m.onnx")).collect()} == {("character", "　\n一\n乙\n"), ("shape", "48")}
    with pytest.raises(ValueError):
        list(models.fields(b"\x0b"))


def test_yaml_list():
    pytest.importorskip("yaml")
    assert models.yaml_character_list("PostProcess:\n  character_dict: ['!', 1, true, '~', 中]\n") == ["!", "1", "true", "~", "中"]
    with pytest.raises(ValueError):
        models.yaml_character_list("a: 1")


def test_placement_in_parts_equals_one_pass(spark):
    draw = random.Random(12)
    rows, want = [], {}
    for img in range(25):
        lines = []
        for k in range(draw.randrange(0, 22)):
            x, y, high = draw.randrange(0, 500), draw.randrange(0, 400), draw.choice([12, 30])
            vertical = draw.random() < 0.3
            quads = [[x + dx, y + dy, x + dx + high, y + dy, x + dx + high, y + dy + high, x + dx, y + dy + high] for dx, dy in ((0, high * j) if vertical else (high * j, 0) for j in range(draw.randrange(0, 6)))]
            quads = [q[2:] + q[:2] for q in quads] if vertical else quads
            lines.append((vertical, [(draw.choice(["ab", "zhuang", None, "c"]), [float(v) for v in q]) for q in quads]))
        rows += [(img, 1000.0, 950.0, k, v, [{"reading": r, "quad": q} for r, q in chars]) for k, (v, chars) in enumerate(lines)]
        want |= {(img, k): found for k, found in enumerate(place(lines, 1000.0, 950.0))}
    frame = spark.createDataFrame(rows, "img int, width double, height double, line_no int, vertical boolean, chars array<struct<reading:string,quad:array<double>>>").repartition(3)
    found = {(r.img, r.line_no): (r.side, r.scale, r.halo) for r in layout.place_labels(frame, "img", cell=64.0).collect()}
    assert found == want and any(h for *_, h in want.values()) and any(s < 1 for _, s, _ in want.values())
    assert layout.place_labels(frame.limit(0), "img").count() == 0


def test_nothing_of_an_image_goes_through_the_driver(spark):
    """Spark takes arrays of characters for far smaller than they are, so joins must not leave the choice to it."""
    rows = [(img, 500.0, 500.0, k, False, [{"reading": r, "quad": [float(v) for v in q]} for r, q in row(0, y, "ā")[1]]) for img in (1, 2) for k, y in enumerate((50, 100))]
    lines = spark.createDataFrame([*rows, (3, 500.0, 500.0, 0, False, None), (None, 500.0, 500.0, 1, False, rows[0][5])], "img int, width double, height double, line_no int, vertical boolean, chars array<struct<reading:string,quad:array<double>>>")
    placed = layout.place_labels(lines, "img")
    assert "Broadcast" not in placed._jdf.queryExecution().executedPlan().toString()
    assert {(r.img, r.line_no): r.side for r in placed.collect()} == {(1, 0): "before", (1, 1): "after", (2, 0): "before", (2, 1): "after", (3, 0): "after", (None, 1): "after"}
    zones = spark.createDataFrame([(1, 1, 0.0, 0.0, 9.0, 9.0), (1, 2, 5.0, 5.0, 12.0, 12.0)], "img int, line_no int, x0 double, y0 double, x1 double, y1 double")
    assert "Broadcast" not in layout.spatial.overlapping(zones, ["img"], "line_no", 8.0)._jdf.queryExecution().executedPlan().toString()


def test_violations(spark):
    schema = "img int, width double, height double, line_no int, vertical boolean, chars array<struct<reading:string,quad:array<double>>>"
    rows = [(1, 300.0, 200.0, k, False, [{"reading": r, "quad": [float(v) for v in q]} for r, q in row(20, y, "ā", "b")[1]]) for k, y in enumerate((40, 100))]
    lines = spark.createDataFrame(rows, schema)
    given = lambda *ps: spark.createDataFrame([(1, k, s, z, h) for k, (s, z, h) in enumerate(ps)], "img int, line_no int, side string, scale double, halo boolean")
    figures = lambda *ps: tuple(layout.violations(lines, given(*ps), "img").first())[1:]
    assert figures(("before", 1.0, False), ("after", 1.0, False)) == (4, 4, 0, 0, 0)
    assert figures(("after", 1.0, False), ("before", 1.0, False)) == (4, 4, 4, 4, 0)
    assert figures(("after", 1.0, True), ("before", 1.0, False)) == (4, 4, 2, 0, 0)
    assert tuple(layout.violations(lines, layout.place_labels(lines, "img"), "img").first())[3:] == (0, 0, 0)
