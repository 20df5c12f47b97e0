"""The app's whole state from its events: screen, engine, progress, error, notice, card, about, dictionary, readings shown.

What an event does may depend on the screen and the engine, which have few
values. So events are first mapped to transitions between these and composed,
chunk by chunk and level by level, which gives the screen and engine before
each event. All other fields are then overwritten by single events that are
known to count, and the last one wins: a grouping with a maximum.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.streaming.events import CHUNK, STATES, transition

#: Notices that the reducer itself gives; parameters of a caller who wants others.
NOTHING_FOUND, SCAN_FAILED = "No text found.", "Scan failed."
#: Kinds of events with a fixed effect on screen and engine; ``fatal`` depends on its payload.
MOVES = ("start", "engine-ready", "freeze", "scan-done", "scan-failed", "resume", "back")
FIELDS = "screen string, engine string, progress double, error_kind string, error_message string, notice string, card string, about boolean, dictionary string, readings_shown boolean"
START = {"screen": "intro", "engine": "loading", "progress": 0.0, "error_kind": None, "error_message": None, "notice": None, "card": None, "about": False, "dictionary": "loading", "readings_shown": True}


def reduced(state: dict, event: dict) -> dict:
    """The state after an event (kind, value, message, card, line_count, source); guarded and unknown events change nothing."""
    kind, now = event["kind"], (state["screen"], state["engine"])
    move = f"fatal-{'engine' if event.get('source') == 'engine' else 'camera'}" if kind == "fatal" else kind
    screen, engine = transition(now, move)
    new = {**state, "screen": screen, "engine": engine}
    if kind == "progress":
        new["progress"] = event["value"]
    elif kind == "engine-ready":
        new["progress"] = 1.0
    elif kind == "fatal":
        new.update(error_kind=event.get("source"), error_message=event.get("message"))
    elif kind in ("freeze", "scan-done", "scan-failed", "resume", "back") and now != (screen, engine):
        new["notice"] = SCAN_FAILED if kind == "scan-failed" else NOTHING_FOUND if kind == "scan-done" and not event.get("line_count") else None
        if kind in ("resume", "back"):
            new["card"] = None
    elif kind == "show-card" and state["screen"] == "frozen":
        new["card"] = event.get("card")
    elif kind == "close-card":
        new["card"] = None
    elif kind == "toggle-readings":
        new["readings_shown"] = not state["readings_shown"]
    elif kind in ("open-about", "close-about"):
        new["about"] = kind == "open-about"
    elif kind in ("dict-ready", "dict-failed"):
        new["dictionary"] = kind.removeprefix("dict-")
    elif kind in ("notice", "dismiss-notice"):
        new["notice"] = event.get("message") if kind == "notice" else None
    return new


def _moves() -> Column:
    """The transition map of an event's kind: for each state the number of the next one."""
    rows = []
    for name in (*MOVES, "fatal-camera", "fatal-engine"):
        rows += [F.lit(name), F.array(*(F.lit(STATES.index(transition(s, name))) for s in STATES))]
    return F.create_map(*rows)


def states_before(events: DataFrame, key: str, seq: str) -> DataFrame:
    """Each event with ``state``, the number of the screen and engine before it; ``seq`` is a non-negative integer, unique in a key.

    Up a tree the maps of ``CHUNK`` elements are composed to one; down it, the
    state before each is found. No group holds more than ``CHUNK`` elements.
    """
    move = F.when(F.col("kind") == "fatal", F.concat(F.lit("fatal-"), F.when(F.col("source") == "engine", "engine").otherwise("camera"))).otherwise(F.col("kind"))
    same = F.array(*map(F.lit, range(len(STATES))))
    level = events.select(key, F.col(seq).alias("at"), F.coalesce(F.try_element_at(_moves(), move), same).alias("map"))
    top, levels = events.agg(F.max(seq)).first()[0] or 0, [level]
    ordered = F.array_sort(F.collect_list(F.struct("at", "map")))
    while top > 0:
        whole = F.aggregate(F.col("own"), same, lambda a, m: F.transform(a, lambda s: F.element_at(m["map"], s + 1)))
        grouped = levels[-1].groupBy(key, F.floor(F.col("at") / CHUNK).alias("chunk")).agg(ordered.alias("own"))
        levels.append(grouped.select(key, F.col("chunk").alias("at"), whole.alias("map")))
        top //= CHUNK
    known = levels[-1].select(key, "at", F.lit(0).alias("state"))
    for below in reversed(levels[:-1]):
        grouped = below.groupBy(key, F.floor(F.col("at") / CHUNK).alias("chunk")).agg(ordered.alias("own"))
        start = known.select(key, F.col("at").alias("chunk"), "state")
        step = lambda a, m: F.struct(F.element_at(m["map"], a["state"] + 1).alias("state"), F.array_append(a["all"], F.struct(m["at"].alias("at"), a["state"].alias("state"))).alias("all"))
        empty = F.struct(F.col("state").alias("state"), F.array().cast("array<struct<at:bigint,state:int>>").alias("all"))
        walked = F.aggregate(F.transform("own", lambda m: F.struct(m["at"].cast("long").alias("at"), m["map"].alias("map"))), empty, step)
        known = grouped.join(start, [key, "chunk"]).select(key, F.explode(walked["all"]).alias("s")).select(key, "s.*")
    return events.join(known.withColumnRenamed("at", seq), [key, seq])


def reduce_events(events: DataFrame, key: str, seq: str) -> DataFrame:
    """The state of each key after all its events (kind, value, message, card, line_count, source): the fields of ``FIELDS``."""
    before = states_before(events, key, seq)
    screen = F.element_at(F.array(*(F.lit(s) for s, _ in STATES)), F.col("state") + 1)
    engine = F.element_at(F.array(*(F.lit(e) for _, e in STATES)), F.col("state") + 1)
    rows = before.withColumns({"screen": screen, "engine": engine})
    kind = F.col("kind")
    moves = ((kind == "freeze") & (F.col("screen") == "live") & (F.col("engine") == "ready")) | (kind.isin("scan-done", "scan-failed") & (F.col("screen") == "scanning"))
    leaves = ((kind == "resume") & (F.col("screen") == "frozen")) | ((kind == "back") & F.col("screen").isin("live", "frozen"))
    notice = F.when(kind == "notice", F.col("message")).when(kind == "scan-failed", F.lit(SCAN_FAILED)).when((kind == "scan-done") & (F.coalesce("line_count", F.lit(0)) == 0), F.lit(NOTHING_FOUND))
    last = lambda value, counts: F.max_by(F.when(counts, F.struct(value.alias("v"))), F.when(counts, F.col(seq)))["v"]
    move = F.when(kind == "fatal", F.concat(F.lit("fatal-"), F.when(F.col("source") == "engine", "engine").otherwise("camera"))).otherwise(kind)
    after = F.coalesce(F.element_at(F.try_element_at(_moves(), move), F.col("state") + 1), F.col("state"))
    out = rows.groupBy(key).agg(
        F.max_by(after, seq).alias("state"),
        last(F.when(kind == "engine-ready", 1.0).otherwise(F.col("value")), kind.isin("progress", "engine-ready")).alias("progress"),
        last(F.col("source"), kind == "fatal").alias("error_kind"),
        last(F.col("message"), kind == "fatal").alias("error_message"),
        last(notice, moves | leaves | kind.isin("notice", "dismiss-notice")).alias("notice"),
        last(F.when(kind == "show-card", F.col("card")), leaves | (kind == "close-card") | ((kind == "show-card") & (F.col("screen") == "frozen"))).alias("card"),
        last(kind == "open-about", kind.isin("open-about", "close-about")).alias("about"),
        last(F.substring(kind, 6, 10), kind.isin("dict-ready", "dict-failed")).alias("dictionary"),
        (F.count_if(kind == "toggle-readings") % 2 == 0).alias("readings_shown"),
    )
    whole = out.withColumns({"screen": screen, "engine": engine, "progress": F.coalesce("progress", F.lit(0.0)), "about": F.coalesce("about", F.lit(False)), "dictionary": F.coalesce("dictionary", F.lit("loading"))})
    return whole.select(key, *(f.split()[0] for f in FIELDS.split(", ")))


def streamed_reducer(events: DataFrame, key: str, seq: str) -> DataFrame:
    """The same over a stream: an updated row for each key with new events.

    Events are applied in order within a trigger; one that comes in a later
    trigger is applied after those of earlier ones, whatever its ``seq``.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def step(name, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = dict(zip(names, state.get)) if state.exists else dict(START)
        for event in pd.concat(batches).sort_values(seq).astype(object).to_dict("records"):
            now = reduced(now, {k: None if pd.isna(v) else v for k, v in event.items()})
        state.update(tuple(now[n] for n in names))
        yield pd.DataFrame([(name[0], *(now[n] for n in names))], columns=[key, *names])

    ddl = f"{key} {events.schema[key].dataType.simpleString()}, {FIELDS}"
    return events.groupBy(key).applyInPandasWithState(step, ddl, FIELDS, "update", "NoTimeout")
