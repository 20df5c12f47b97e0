"""State, sessions and replies over keyed events.

Sequential state machines are run by composing transition maps: a map says
where each state goes, composition is associative, so events are folded in
chunks of bounded size whatever the size of a key. The same reducer runs on
streams with one state row for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.streaming import ranges

SCREENS = ("intro", "live", "scanning", "frozen", "error")
ENGINES = ("loading", "ready", "failed")
STATES = tuple((s, e) for s in SCREENS for e in ENGINES)
CHUNK = 1000


def transition(state: tuple[str, str], event: str) -> tuple[str, str]:
    """Where an event takes (screen, engine); guarded and unknown events change nothing."""
    screen, engine = state
    moves = {("start", "intro"): "live", ("scan-done", "scanning"): "frozen", ("scan-failed", "scanning"): "live", ("resume", "frozen"): "live", ("back", "live"): "intro", ("back", "frozen"): "intro"}
    if event == "engine-ready":
        return screen, "ready"
    if event in ("fatal-camera", "fatal-engine"):
        return "error", "failed" if event == "fatal-engine" else engine
    if event == "freeze":
        return ("scanning" if state == ("live", "ready") else screen), engine
    return moves.get((event, screen), screen), engine


EVENTS = ("start", "engine-ready", "fatal-camera", "fatal-engine", "freeze", "scan-done", "scan-failed", "resume", "back")


def _maps():
    rows = []
    for event in EVENTS:
        rows += [F.lit(event), F.array(*(F.lit(STATES.index(transition(s, event))) for s in STATES))]
    return F.create_map(*rows)


def final_states(events: DataFrame, key: str, seq: str, kind: str) -> DataFrame:
    """The screen and engine of each key after all its events in order of ``seq``, a non-negative integer."""
    top = events.agg(F.max(seq)).first()[0] or 0
    identity = F.array(*map(F.lit, range(len(STATES))))
    maps = events.select(key, F.col(seq).alias("at"), F.coalesce(F.try_element_at(_maps(), kind), identity).alias("map"))
    while True:
        top //= CHUNK
        parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "map"))), lambda p: p["map"])
        whole = F.aggregate(parts, identity, lambda a, m: F.transform(a, lambda s: F.element_at(m, s + 1)))
        maps = maps.groupBy(key, F.floor(F.col("at") / CHUNK).alias("chunk")).agg(whole.alias("map")).withColumnRenamed("chunk", "at")
        if top == 0:
            break
    state = F.element_at(F.array(*(F.struct(F.lit(s).alias("screen"), F.lit(e).alias("engine")) for s, e in STATES)), F.element_at("map", 1) + 1)
    return maps.select(key, state.alias("s")).select(key, "s.*")


def streamed_states(events: DataFrame, key: str, seq: str, kind: str) -> DataFrame:
    """The same over a stream: an updated row for each key with new events.

    Events are applied in order within a trigger; one that comes in a later
    trigger is applied after those of earlier ones, whatever its ``seq``.
    """

    def step(name, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else STATES[0]
        rows = pd.concat(batches).sort_values(seq)
        for event in rows[kind]:
            now = transition(now, event)
        state.update(now)
        yield pd.DataFrame([(name[0], *now)], columns=[key, "screen", "engine"])

    ddl = f"{key} {events.schema[key].dataType.simpleString()}, screen string, engine string"
    return events.groupBy(key).applyInPandasWithState(step, ddl, "screen string, engine string", "update", "NoTimeout")


def latest_only(events: DataFrame, key: str, seq: str) -> DataFrame:
    """The last event of each key, aggregated before the shuffle; earlier ones are stale."""
    columns = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("last")).select(key, "last.*")


def throttled(events: DataFrame, key: str, ts: str, frame: str) -> DataFrame:
    """One row for each key and frame with events: the first time in it and how many were coalesced."""
    return events.groupBy(key, F.window(ts, frame).alias("frame")).agg(F.min(ts).alias("first_ts"), F.count("*").alias("n")).select(key, "first_ts", "n")


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Stretches in which each event follows within the gap; a stretch ends a gap after its last event."""
    grouped = events.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("s.start").alias("start_ts"), F.col("s.end").alias("end_ts"), "n")


def deltas(events: DataFrame, key: str, order: list[str], value: str, width: int | None = None) -> DataFrame:
    """Each event with its difference to and ratio over the previous one of its key.

    With a ``width`` the first of ``order``, a number, is cut in stretches of
    it, and what was last before a stretch comes from a table of stretches: no
    task then holds all events of a key.
    """
    if width is None:
        before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
        return events.withColumns({"difference": F.col(value) - before, "ratio": F.when(before != 0, F.col(value) / before)})
    names = events.columns
    cut = events.withColumn("stretch", F.floor(F.col(order[0]) / width))
    last = cut.groupBy(key, "stretch").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("last"))
    earlier = last.select(key, "stretch", F.lag("last").over(Window.partitionBy(key).orderBy("stretch")).alias("earlier"))
    own = Window.partitionBy(key, "stretch").orderBy(*order)
    joined = cut.join(earlier, [key, "stretch"])
    before = F.when(F.row_number().over(own) == 1, F.col("earlier.v")).otherwise(F.lag(value).over(own))
    rows = joined.withColumn("value before", before)
    return rows.select(*names, (F.col(value) - F.col("value before")).alias("difference"), F.when(F.col("value before") != 0, F.col(value) / F.col("value before")).alias("ratio"))


def running_total(events: DataFrame, keys: list[str], order: list[str], value: str, name: str = "loaded", width: int | None = None) -> DataFrame:
    """Each event with the sum of its key up to it; ``width`` as in ``deltas``."""
    upto = lambda by: by.rowsBetween(Window.unboundedPreceding, 0)
    if width is None:
        return events.withColumn(name, F.sum(value).over(upto(Window.partitionBy(*keys).orderBy(*order))))
    names = events.columns
    cut = events.withColumn("stretch", F.floor(F.col(order[0]) / width))
    whole = cut.groupBy(*keys, "stretch").agg(F.sum(value).alias("sum"))
    before = F.sum("sum").over(Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    joined = cut.join(whole.select(*keys, "stretch", before.alias("sum before")), [*keys, "stretch"])
    own = F.sum(value).over(upto(Window.partitionBy(*keys, "stretch").orderBy(*order)))
    # Null only where neither part has a value.
    return joined.withColumn(name, F.when(F.col("sum before").isNull(), own).otherwise(F.col("sum before") + F.coalesce(own, F.lit(0)))).select(*names, name)


def taps(moves: DataFrame, session: str, ts: str, x: str, y: str, most_px: float = 10.0, most_seconds: float = 0.3, pointer: str | None = None) -> DataFrame:
    """Pointer sessions that are taps: never ``most_px`` from where they began and shorter than ``most_seconds``; if ``pointer`` is named, by one pointer alone."""
    alone = (F.min(pointer).eqNullSafe(F.max(pointer)) if pointer else F.lit(True)).alias("alone")
    start = moves.groupBy(session).agg(F.min_by(F.struct(x, y), ts).alias("from"), F.min(ts).alias("t0"), F.max(ts).alias("t1"), alone).where("alone").drop("alone")
    far = moves.join(start, session).groupBy(session, "t0", "t1").agg(F.max(F.hypot(F.col(x) - F.col(f"from.{x}"), F.col(y) - F.col(f"from.{y}"))).alias("far"))
    quick = F.col("t1").cast("double") - F.col("t0").cast("double") < most_seconds
    return far.where((F.col("far") < most_px) & quick).select(session, "t0", "far")


def replies(requests: DataFrame, answers: DataFrame, id_column: str, sent: str, came: str, limit: str) -> DataFrame:
    """Each request with its reply, null if none came within the limit; on streams both sides need watermarks."""
    r, a = requests.alias("r"), answers.alias("a")
    within = (F.col(f"r.{id_column}") == F.col(f"a.{id_column}")) & (F.col(f"a.{came}") >= F.col(f"r.{sent}")) & (F.col(f"a.{came}") <= F.col(f"r.{sent}") + F.expr(f"INTERVAL {limit}"))
    return r.join(a, within, "left").select(F.col(f"r.{id_column}"), sent, came, F.col(came).isNull().alias("timed_out"))


def frame_after(taps_: DataFrame, frames: DataFrame, key: str, tap_id: str, ts: str) -> DataFrame:
    """Each tap with the time of the first frame of its key at or after it, null if none came."""
    both = taps_.select(key, ts, tap_id, F.lit(None).cast(frames.schema[ts].dataType).alias("frame_ts"))
    both = both.unionByName(frames.select(key, ts, F.lit(None).cast(taps_.schema[tap_id].dataType).alias(tap_id), F.col(ts).alias("frame_ts")))
    placed = both.withColumn("is frame", F.col("frame_ts").isNotNull())
    found = ranges.running(placed, [key], [ts, "is frame"], firsts={"frame_ts": F.col("frame_ts")})
    return found.where(F.col(tap_id).isNotNull()).select(key, tap_id, ts, "frame_ts")


def swipes(pointer: DataFrame, keys: list[str], order: str, kind: str, y: str, least: float = 40.0) -> DataFrame:
    """Pointers that go down and whose next event is a release more than ``least`` lower; a cancel in between resets."""
    ahead = ranges.running(pointer, keys, [order], nexts={"next_kind": F.col(kind), "next_y": F.col(y)}).withColumn("fall", F.col("next_y") - F.col(y))
    return ahead.where((F.col(kind) == "down") & (F.col("next_kind") == "up") & (F.col("fall") > least)).select(*keys, order, "fall")
