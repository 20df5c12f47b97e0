import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.streaming import events, messages, ranges


def rows(n=3000):
    draw = random.Random(7)
    keys = ["hot"] * 5 + [None] * 3 + ["b", "c", "d"]
    return [(draw.choice(keys), draw.randrange(n), k, draw.choice([None, draw.randrange(100)])) for k in range(n)]


@pytest.mark.parametrize("bound", [100_000, 50, 7])
def test_running_figures_are_those_of_one_window(spark, bound):
    events = spark.createDataFrame(rows(), "k string, at int, n int, v int").repartition(5)
    by = Window.partitionBy("k").orderBy("at", "n")
    upto, onward = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    v = F.col("v")
    plain = {"total": F.sum(F.coalesce(v, F.lit(0))).over(upto), "last": F.last(v, ignorenulls=True).over(upto), "lag": F.lag(v).over(by), "first": F.first(v, ignorenulls=True).over(onward), "next": F.lead(v).over(by)}
    want = sorted(map(str, events.withColumns(plain).collect()))
    found = ranges.running(events, ["k"], ["at", "n"], sums={"total": v}, lasts={"last": v}, befores={"lag": v}, firsts={"first": v}, nexts={"next": v}, bound=bound)
    assert sorted(map(str, found.select(*events.columns, *plain).collect())) == want


def test_a_key_with_most_events_is_cut(spark):
    """A million events of one user: no range, so no task of a window, holds more than the bound and what the quantiles miss it by."""
    events = spark.range(1_000_000).select(F.when(F.col("id") % 10 > 0, "one").otherwise(F.concat(F.lit("u"), F.col("id"))).alias("k"), (F.col("id") * 7919 % 1_000_003).alias("at"))
    sizes = ranges.with_ranges(events, ["k"], "at", 50_000).groupBy("k", ranges.NAME).count()
    top = sizes.groupBy("k").agg(F.max("count").alias("most"), F.count("*").alias("ranges"), F.sum("count").alias("n")).orderBy(F.desc("n")).first()
    assert top.k == "one" and top.n == 900_000 and top.ranges >= 18 and top.most <= 55_000
    out = ranges.running(events, ["k"], ["at"], sums={"n": F.lit(1)}, bound=50_000).where("k = 'one'").agg(F.max("n"), F.countDistinct("n")).first()
    assert tuple(out) == (900_000, 900_000)


def test_equal_times_and_empty_tables(spark):
    events = spark.createDataFrame([("a", 1, n) for n in range(40)] + [("a", 2, n) for n in range(40)], "k string, at int, n int")
    found = ranges.running(events, ["k"], ["at", "n"], sums={"s": F.lit(1)}, bound=10).orderBy("at", "n").collect()
    assert [r.s for r in found] == list(range(1, 81))
    assert ranges.running(events.limit(0), ["k"], ["at"], sums={"s": F.lit(1)}).count() == 0


def flights(requests):
    """Accepted and flight of (session, start, end, id), walked in order."""
    until, flight, out = {}, {}, set()
    for session, start, end, id_ in sorted(requests, key=lambda r: (str(r[0]), r[1], r[3])):
        free = until.get(session) is None or start >= until[session]
        if free:
            until[session], flight[session] = end, id_
        out.add((session, id_, free, flight[session]))
    return out


@pytest.mark.parametrize("bound", [100_000, 40, 3])
def test_one_flight_at_a_time(spark, bound):
    draw = random.Random(bound)
    asked = []
    for k in range(900):
        start = draw.randrange(3000)
        asked.append((draw.choice(["a"] * 5 + [None, None, "b", "c"]), start, draw.choice([start, start + 1, start + 40, start + 400, None]), k))
    frame = spark.createDataFrame(asked, "s string, t int, u int, k int").repartition(4)
    found = messages.one_at_a_time(frame, "s", "t", "u", "k", bound=bound).collect()
    assert len(found) == 900 and {(r.s, r.k, r.accepted, r.flight) for r in found} == flights(asked)


def test_one_session_of_many_requests(spark):
    n = 300_000
    frame = spark.range(n).select(F.lit("s").alias("s"), F.col("id").alias("t"), (F.col("id") + 1 + F.col("id") * 48271 % 11).alias("u"), F.col("id").alias("k"))
    found = messages.one_at_a_time(frame, "s", "t", "u", "k", bound=20_000)
    taken, at = 0, 0
    while at < n:
        taken, at = taken + 1, at + 1 + at * 48271 % 11
    row = found.agg(F.count_if("accepted"), F.countDistinct("flight"), F.count("*")).first()
    assert tuple(row) == (taken, taken, n)


def test_operators_with_keys_in_ranges(spark, monkeypatch):
    """The same results whether keys are cut or not."""
    draw = random.Random(11)
    kinds = ["init", "scan", "load", "lookup", "ping", None]
    calls = spark.createDataFrame([(draw.choice("aaab"), k, draw.choice(kinds), draw.random() < 0.3, float(draw.randrange(9))) for k in range(200)], "s string, k int, type string, ok boolean, size double").repartition(3)
    answers = spark.createDataFrame([(draw.choice("ab"), k, k + draw.random() * 4) for k in range(200)], "s string, k int, came double")
    state, pointers = {}, []
    for k in range(300):
        s, p = draw.choice("aaab"), draw.randrange(2)
        down = state.get((s, p), False)
        kind = draw.choice(["move", "move", "up"]) if down else "down"
        state[s, p] = down if kind == "move" else not down
        pointers.append((s, k, p, kind, draw.random(), draw.random()))
    touched = spark.createDataFrame(pointers, "s string, k int, p int, kind string, x double, y double")
    taps = spark.createDataFrame([("a", k, float(draw.randrange(100))) for k in range(60)], "s string, tap int, ts double")
    frames = spark.createDataFrame([("a", float(draw.randrange(90))) for _ in range(40)], "s string, ts double")

    def results():
        out = [messages.dispatched(calls, ["s"], "k"), messages.watched(calls.withColumn("sent", F.col("k").cast("double")), answers, ["s"], "k", "sent", "came", F.lit(2.0)), messages.backoff(calls, ["s"], "k", "ok", most=50)]
        out += [messages.progress(calls, calls, ["s"], "k", "k", "size", "size"), messages.pointer_moves(touched, "s", "k", "p", "kind", "x", "y"), events.frame_after(taps, frames, "s", "tap", "ts"), events.swipes(touched, ["s"], "k", "kind", "y", least=0.1)]
        return [sorted(str({c: r[c] if not isinstance(r[c], float) else round(r[c], 9) for c in sorted(r.asDict())}) for r in f.collect()) for f in out]

    plain = results()
    monkeypatch.setattr(ranges, "RANGE", 7)
    assert results() == plain and all(len(x) > 5 for x in plain)
