import gzip
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import geometry as G
from sparkloom.operators import assets, lines, views
from sparkloom.sources import catalogue, files

STATE = "screen string, engine string, progress double, notice string, pinyin_visible boolean, error struct<kind:string,message:string>, about boolean"


def test_screens(spark):
    states = [
        ("live", "loading", 0.25, None, True, None, False),
        ("live", "ready", 1.0, "Hold still", True, None, None),
        ("scanning", "ready", 1.0, None, True, None, False),
        ("frozen", "ready", None, None, False, None, True),
        ("error", "failed", 0.0, None, True, ("engine", "no memory"), False),
        ("error", "failed", 0.0, None, True, ("unsupported", ""), False),
        ("error", "failed", 0.0, None, True, ("other", None), False),
    ]
    shown = views.screen_views(spark.createDataFrame(states, STATE), {"engine": "Start again", "unsupported": "Use another"}).collect()
    assert [r["mode"] for r in shown] == ["loading", "freeze", "busy", "resume", "loading", "loading", "loading"]
    assert [r.shutter_shown for r in shown] == [True] * 4 + [False] * 3
    assert [r.shutter_enabled for r in shown] == [False, True, False, True] + [False] * 3
    assert shown[0].ring_offset == pytest.approx(0.75 * views.RING) and shown[3].ring_offset == pytest.approx(views.RING)
    assert [r.notice_text for r in shown[:2]] == ["", "Hold still"]
    assert [(r.toggle_shown, r.toggle_off, r.back_shown) for r in shown[:4]] == [(False, False, True), (False, False, True), (False, False, False), (True, True, True)]
    assert [r.error_text for r in shown[3:]] == [None, "Start again (no memory)", "Use another", ""]
    assert [(r.retry_shown, r.reset_shown) for r in shown[3:]] == [(False, False), (True, True), (False, False), (True, False)]
    assert [r.about_shown for r in shown[:4]] == [False, False, False, True]


def test_debug_lines(spark):
    schema = "v string, s double, r struct<width:int,height:int>, t struct<total:double,det:double,rec:double,post:double>, e string"
    rows = spark.createDataFrame([("a1", 12.5, (640, 480), (100.4, 50.0, None, 2.0), ""), (None, None, None, None, "lost")], schema)
    found = [r[0] for r in rows.select(views.debug_lines(F.col("v"), F.col("s"), F.col("r"), F.col("t"), F.col("e"))).collect()]
    assert found[0] == ["version a1", "start 13 ms", "scan 640×480: 100 ms (det 50 ms, rec –, post 2 ms)", "error –"]
    assert found[1] == ["version –", "start –", "scan –: – (det –, rec –, post –)", "error lost"]


def test_catalogue(spark):
    found, read = catalogue.detectors(spark).collect(), catalogue.recognisers(spark).collect()
    assert all(re.fullmatch("[0-9a-f]{64}", r.sha256) and r.size > 0 for r in found + read)
    assert {(r.charset_from == "yaml") == (r.charset_url is not None) for r in read} == {True}
    asked = spark.createDataFrame([("v6-small", None), ("v4", "v6-tiny")], "det string, rec string")
    chosen = assets.choose_models(asked, catalogue.shipped(spark), catalogue.DEFAULTS).collect()
    assert [(r.chosen_det, r.chosen_rec, r.rejected) for r in chosen] == [("v6-small", "v6-tiny", []), ("v6-tiny", "v6-tiny", ["det=v4"])]
    sides = spark.createDataFrame([(catalogue.LONG_SIDE,)], "long_side int")
    names = [catalogue.detectors(spark).select(F.col("id").alias("det")), catalogue.recognisers(spark).select(F.col("id").alias("rec"))]
    assert assets.configurations(*names, sides).count() == len(found) * len(read)


def test_install_hints(spark):
    agents = [("Mozilla/5.0 (iPhone; CPU)", False, False), ("Mozilla/5.0 (iPad; CPU)", True, False), ("Mozilla/5.0 (iPod)", False, True), ("Mozilla/5.0 (X11; Linux)", False, False), (None, False, False)]
    rows = spark.createDataFrame(agents, "agent string, standalone boolean, hinted boolean")
    assert [r[0] for r in rows.select(lines.hint_install(F.col("agent"), F.col("standalone"), F.col("hinted"))).collect()] == [True, False, False, False, None]


def test_css_matrix(spark):
    rows = spark.createDataFrame([(2.0, -1.5, 0.25)], "s double, x double, y double")
    assert rows.select(G.css_transform(F.col("s"), F.col("x"), F.col("y"))).first()[0] == "matrix(2.0, 0, 0, 2.0, -1.5, 0.25)"


def test_gzip_lines(spark, tmp_path):
    with gzip.open(tmp_path / "words.txt.gz", "wt", encoding="utf-8") as out:
        out.write("# notes\n茶 茶 [cha2] /tea/\n\n水 水 [shui3] /water/\n")
    found = files.read_lines(spark, str(tmp_path / "words.txt.gz")).orderBy("line_no").collect()
    assert [r.line for r in found] == ["# notes", "茶 茶 [cha2] /tea/", "", "水 水 [shui3] /water/"]
