import os
from datetime import UTC, datetime

import pytest

from sparkloom.streaming import engine
from sparkloom.streaming.engine import BUSY, CRASHED, LATE

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "session string, ts timestamp, n long, kind string, request string, post long, reply string, message string"


def replayed(events):
    """Actions of one session's events (second, kind, request, post, reply, message)."""
    now, out = engine.Engine(), []
    for at, *event in events:
        now, actions = engine.step(now, int(at * 1000), *event)
        out += actions
    return now, out


def settled(actions):
    return [(a["request"], a["ok"], a["message"]) for a in actions if a["action"] == "settle"]


def test_one_request_at_a_time():
    events = [(0, "scan", "a"), (1, "scan", "b"), (2, "reply", None, 1, "ready"), (3, "scan", "c"), (4, "reply", None, 9, "result"), (5, "reply", None, 2, "result"), (6, "scan", "d"), (7, "reply", None, 3, "error", "too dark"), (8, "scan", "e")]
    now, actions = replayed(events)
    assert settled(actions) == [("b", False, BUSY), ("c", False, BUSY), ("a", True, None), ("d", False, "too dark")]
    assert [(a["post"], a["message"]) for a in actions if a["action"] == "post"] == [(1, "init"), (2, "scan"), (3, "scan"), (4, "scan")]
    assert now.worker == 1 and now.request == "e" and now.deadline == 23_000


def test_a_worker_that_fails_to_start():
    _, actions = replayed([(0, "scan", "a"), (1, "scan", "b"), (2, "reply", None, 1, "error", "no model"), (3, "scan", "c"), (4, "crash")])
    assert settled(actions) == [("a", False, "no model"), ("b", False, "no model"), ("c", False, CRASHED)]
    assert [a["worker"] for a in actions if a["action"] == "spawn"] == [1, 2]
    _, actions = replayed([(0, "scan", "a"), (59.999, "scan", "b"), (60, "scan", "c")])
    assert settled(actions) == [("a", False, LATE), ("b", False, LATE)] and actions[-1]["worker"] == 2
    assert replayed([(0, "crash"), (1, "reply", None, 1, "ready")])[1] == []


def stream_of(spark, tmp_path, files):
    for n, rows in enumerate(files):
        data = [("s", datetime.fromtimestamp(1_000_000 + at, UTC), k, *(list(e) + [None] * (5 - len(e)))) for k, (at, *e) in enumerate(rows)]
        spark.createDataFrame(data, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for name in os.listdir(tmp_path / "in"):
            if name.endswith(".parquet") and not os.path.exists(mark := tmp_path / f"seen-{name}"):
                os.utime(tmp_path / "in" / name, (1_000_000 + n * 10, 1_000_000 + n * 10))
                mark.touch()
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = engine.run_engine(stream, "session", "ts", "n").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert not query.isActive
    return sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: (r.at, r.action != "end", r.action == "post"))


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_a_reply_that_never_comes(spark, tmp_path, rocks):
    """The timer fires without any event of the session's own; the next request starts a new worker, and a late reply is ignored."""
    first = [(0, "scan", "a"), (1, "reply", None, 1, "ready")]
    files = [first, [(2, "noise")], [(40, "noise")], [(41, "noise")], [(50, "reply", None, 2, "result"), (51, "scan", "b")], [(52, "reply", None, 3, "ready"), (53, "reply", None, 2, "result"), (54, "reply", None, 4, "result", "text")]]
    found = stream_of(spark, tmp_path, files)
    assert [(r.at - 1_000_000_000, r.action, r.worker, r.post, r.request, r.ok, r.message) for r in found] == [
        (0, "spawn", 1, None, None, None, None),
        (0, "post", 1, 1, None, None, "init"),
        (1000, "post", 1, 2, "a", None, "scan"),
        (16_000, "end", 1, None, None, None, LATE),
        (16_000, "settle", 1, None, "a", False, LATE),
        (51_000, "spawn", 2, None, None, None, None),
        (51_000, "post", 2, 3, None, None, "init"),
        (52_000, "post", 2, 4, "b", None, "scan"),
        (54_000, "settle", 2, 4, "b", True, "text"),
    ]
