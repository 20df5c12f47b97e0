import random

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import events as E


def test_guards():
    step = E.transition
    assert step(("live", "loading"), "freeze") == ("live", "loading") and step(("live", "ready"), "freeze") == ("scanning", "ready")
    assert step(("live", "ready"), "scan-done") == ("live", "ready") and step(("scanning", "ready"), "scan-done") == ("frozen", "ready")
    assert step(("frozen", "ready"), "fatal-engine") == ("error", "failed") and step(("live", "ready"), "fatal-camera") == ("error", "ready")
    assert all(step((s, "ready"), "back") == (s, "ready") for s in ("scanning", "intro", "error")) and step(("live", "ready"), "unknown") == ("live", "ready")


def brute(rows):
    out = {}
    for key, _, kind in sorted(rows, key=lambda r: r[1]):
        out[key] = E.transition(out.get(key, E.STATES[0]), kind)
    return out


@pytest.fixture(scope="module")
def moves():
    draw = random.Random(4)
    return [(draw.choice("aaab"), k, draw.choice([*E.EVENTS, "unknown", "freeze", "scan-done"])) for k in range(300)]


def test_states_by_composition(spark, moves, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 7)
    found = E.final_states(spark.createDataFrame(moves, "k string, seq long, kind string").repartition(5), "k", "seq", "kind").collect()
    assert {r.k: (r.screen, r.engine) for r in found} == brute(moves)


def test_states_over_a_stream(spark, moves, tmp_path):
    half = len(moves) // 2
    schema = "k string, seq long, kind string"
    for n, part in enumerate((moves[:half], moves[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = E.streamed_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", "seq", "kind")
        query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _, n=n: df.write.mode("overwrite").parquet(str(tmp_path / f"out{n}"))).trigger(availableNow=True).start()
        query.awaitTermination(120)
    last = {r.k: (r.screen, r.engine) for r in spark.read.parquet(str(tmp_path / "out1")).collect()}
    assert last == brute(moves)


def test_taps(spark):
    rows = [(1, 0.0, 0.0, 0.0), (1, 0.1, 3.0, 4.0), (2, 0.0, 0.0, 0.0), (2, 0.1, 30.0, 0.0), (3, 0.0, 0.0, 0.0), (3, 0.5, 0.0, 0.0)]
    moves = spark.createDataFrame(rows, "s int, t double, x double, y double").withColumn("ts", F.timestamp_seconds("t"))
    assert [r.s for r in E.taps(moves, "s", "ts", "x", "y").collect()] == [1]


def test_replies(spark):
    asked = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.0)], "id int, t double").select("id", F.timestamp_seconds("t").alias("sent"))
    given = spark.createDataFrame([(1, 5.0), (2, 20.0)], "id int, t double").select("id", F.timestamp_seconds("t").alias("came"))
    assert {r.id: r.timed_out for r in E.replies(asked, given, "id", "sent", "came", "15 seconds").collect()} == {1: False, 2: True, 3: True}


def test_sessions_and_throttle(spark):
    rows = spark.createDataFrame([("a", t) for t in (0.0, 3.0, 6.5, 20.0)], "k string, t double").select("k", F.timestamp_seconds("t").alias("ts"))
    assert sorted(r.n for r in E.sessions(rows, "k", "ts", "4 seconds").collect()) == [1, 3]
    assert sorted(r.n for r in E.throttled(rows, "k", "ts", "5 seconds").collect()) == [1, 1, 2]


def test_running_total(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 1)], "f string, n int, size int")
    assert [r.loaded for r in E.running_total(rows, ["f"], ["n"], "size").orderBy("f", "n").collect()] == [5, 11, 1]


def test_frame_after(spark):
    at = lambda rows, names: spark.createDataFrame(rows, names).withColumn("ts", F.timestamp_seconds("t")).drop("t")
    taps = at([("a", 1, 5.0), ("a", 2, 9.0), ("b", 3, 0.0)], "k string, tap int, t double")
    frames = at([("a", 5.0), ("a", 8.0), ("b", 1.0)], "k string, t double")
    found = {r.tap: r.frame_ts for r in E.frame_after(taps, frames, "k", "tap", "ts").collect()}
    assert found[1].second == 5 and found[2] is None and found[3].second == 1


def test_swipes(spark):
    rows = [(1, 1, "down", 0.0), (1, 2, "up", 50.0), (2, 1, "down", 0.0), (2, 2, "cancel", 50.0), (2, 3, "up", 90.0), (3, 1, "down", 0.0), (3, 2, "up", 30.0)]
    found = E.swipes(spark.createDataFrame(rows, "p int, n int, kind string, y double"), ["p"], "n", "kind", "y").collect()
    assert [(r.p, r.fall) for r in found] == [(1, 50.0)]


def test_stretches_give_the_same(spark):
    draw = random.Random(7)
    rows = [(draw.choice("aab"), k * 3, draw.choice([None, 0.0, float(draw.randrange(9))])) for k in range(120)]
    events = spark.createDataFrame(rows, "k string, n long, v double")
    plain = lambda df: sorted(map(tuple, df.collect()), key=lambda r: r[1])
    assert plain(E.deltas(events, "k", ["n"], "v", 20)) == plain(E.deltas(events, "k", ["n"], "v"))
    assert plain(E.running_total(events, ["k"], ["n"], "v", width=20)) == plain(E.running_total(events, ["k"], ["n"], "v"))


def test_taps_by_one_pointer_alone(spark):
    moves = spark.createDataFrame([("one", 0.0, 1, 5.0, 5.0), ("one", 0.1, 1, 6.0, 5.0), ("two", 0.0, 1, 5.0, 5.0), ("two", 0.1, 2, 6.0, 5.0), ("far", 0.0, 1, 0.0, 0.0), ("far", 0.2, 1, 30.0, 0.0), ("slow", 0.0, 1, 0.0, 0.0), ("slow", 0.4, 1, 0.0, 0.0)], "s string, t double, p int, x double, y double")
    assert sorted(r.s for r in E.taps(moves, "s", "t", "x", "y").collect()) == ["one", "two"]
    assert [r.s for r in E.taps(moves, "s", "t", "x", "y", pointer="p").collect()] == ["one"]
