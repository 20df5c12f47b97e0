"""Messages and their replies: dispatch by type, one request at a time, watchdogs, retries, verified stores, pointers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import materialized
from sparkloom.streaming import ranges

#: What a message needs before it: its type, the type that must have come, and what its reply is called.
WORKER = {"init": (None, "ready"), "scan": ("init", "result"), "load": (None, "ready"), "lookup": ("load", "result")}


def dispatched(messages: DataFrame, keys: list[str], order: str, kind: str = "type") -> DataFrame:
    """Exactly one reply for each message: ``reply`` (its type, ``error`` if it cannot be served), ``message`` of the error, and ``engine``, how often its engine had been started."""
    came = {name: f"came {name}" for name in WORKER}
    counted = ranges.running(messages, keys, [order], sums={c: (F.col(kind) == name).cast("int") for name, c in came.items()})
    known, needs, gives = F.lit(False), F.lit(None).cast("int"), F.lit(None).cast("string")
    for name, (first, reply) in WORKER.items():
        is_it = F.col(kind) == name
        known = known | is_it
        needs = F.when(is_it, F.col(came[first or name])).otherwise(needs)
        gives = F.when(is_it, reply).otherwise(gives)
    rows = counted.withColumns({"engine": needs.cast("int"), "gives": gives, "known": F.coalesce(known, F.lit(False))})
    error = F.when(~F.col("known"), F.concat(F.lit("unknown type: "), F.coalesce(kind, F.lit("")))).when(F.col("engine") == 0, F.lit("not started"))
    return rows.withColumn("message", error).withColumn("reply", F.when(error.isNotNull(), "error").otherwise(F.col("gives"))).drop("gives", "known", *came.values())


def replied(rows: DataFrame, ok: Column, value: Column, message: Column) -> DataFrame:
    """Rows with ``reply``, a struct of the value or of an error: what fails is told and never thrown."""
    return rows.withColumn("reply", F.struct(ok.alias("ok"), F.when(ok, value).alias("value"), F.when(~ok, message).alias("error")))


def one_at_a_time(requests: DataFrame, key: str, start: str, end: str, id_column: str, bound: int | None = None) -> DataFrame:
    """Requests with ``accepted`` and ``flight``, the id of the one that runs: one that begins while another runs is not accepted.

    Each request points at the first that begins when it has ended: if it runs,
    that one runs next. The chain of pointers from a session's first request is
    walked range by range (``ranges``). Where a session has several, each
    request first gets the pointer that leaves its range, and the few requests
    that such pointers lead to are ranked by pointer jumping.
    """
    name = ranges.NAME
    slim = requests.select(F.col(key).alias("session"), F.col(start).alias("start"), F.col(end).alias("end"), F.col(id_column).alias("id"))
    cuts = ranges.key_cuts(slim, ["session"], "start", bound)
    cut = ranges.placed(slim, ["session"], "start", cuts)
    numbered = ranges.running(cut, ["session"], ["start", "id"], sums={"pos": F.lit(1)}, one=cuts is None)
    asked = numbered.withColumns({"time": F.col("end"), "asks": F.lit(0), "to": F.lit(None).cast("long")})
    have = numbered.withColumns({"time": F.col("start"), "asks": F.lit(1), "to": F.col("pos").cast("long")})
    both = asked.unionByName(have).withColumnRenamed(name, "own range")
    ahead = ranges.running(both, ["session"], ["time", "asks", "pos"], firsts={"ahead": F.col("to")}, one=cuts is None, bound=bound).where("asks = 0")
    after = F.col("pos") + 1
    succ = F.when(F.col("end").isNull(), after).otherwise(F.when(F.col("ahead").isNotNull(), F.greatest(after, F.col("ahead"))))
    linked = ahead.select("session", F.col("own range").alias(name), F.col("pos").cast("long").alias("pos"), succ.cast("long").alias("next"), "id")
    if cuts is None:
        walked = _walked(linked.withColumn("entry", F.lit(1).cast("long")))
    else:
        linked = materialized(linked)
        entries = _entries(linked).withColumnsRenamed({"session": "entered session", name: "entered range"})
        same = linked["session"].eqNullSafe(entries["entered session"]) & (linked[name] == entries["entered range"])
        first = F.when(F.col(name) == 0, F.coalesce("entry", F.lit(1).cast("long"))).otherwise(F.col("entry"))
        walked = _walked(linked.join(F.broadcast(entries), same, "left").withColumn("entry", first).select(*linked.columns, "entry"))
        walked = ranges.running(walked, ["session"], ["pos"], lasts={"flight": F.col("flight")})
    return walked.select(F.col("session").alias(key), F.col("id").alias(id_column), "accepted", "flight")


def _grouped(rows: DataFrame, order: Column) -> DataFrame:
    """Each range of a session in one stretch of a partition, in order."""
    return rows.repartition("session", ranges.NAME).sortWithinPartitions("session", ranges.NAME, order)


def _walked(linked: DataFrame) -> DataFrame:
    """Which requests of each range the chain from its ``entry`` runs through, and the last of them up to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, due, flight = None, None, None
        for batch in batches:
            accepted, flights = [], []
            for session, part, pos, following, id_, entry in zip(*(c.to_pylist() for c in batch.columns)):
                if (session, part) != group:
                    group, due, flight = (session, part), entry, None
                if taken := pos == due:
                    due, flight = following, id_
                accepted.append(taken)
                flights.append(flight)
            columns = [batch.column(0), batch.column(2), batch.column(4), pa.array(accepted, pa.bool_()), pa.array(flights, batch.column(4).type)]
            yield pa.RecordBatch.from_arrays(columns, ["session", "pos", "id", "accepted", "flight"])

    kinds = {c: linked.schema[c].dataType.simpleString() for c in ("session", "id")}
    rows = _grouped(linked, F.col("pos")).select("session", ranges.NAME, "pos", "next", "id", "entry")
    return rows.mapInArrow(run, f"session {kinds['session']}, pos long, id {kinds['id']}, accepted boolean, flight {kinds['id']}")


def _entries(linked: DataFrame) -> DataFrame:
    """``entry``, the first request of each range that the chain from its session's first reaches; a row a range at most, of sessions with several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, exits, last = None, {}, 0
        for batch in batches:
            out = []
            for session, part, pos, following in zip(*(c.to_pylist() for c in batch.columns)):  # from the last of a range to its first
                if (session, part) != group:
                    group, exits, last = (session, part), {}, pos
                exits[pos] = following if following is None or following > last else exits[following]
                out.append(exits[pos])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], ["session", ranges.NAME, "pos", "exit"])

    several = linked.where(F.col(ranges.NAME) > 0).select(F.col("session").alias("of")).distinct()
    mine = linked.join(several, F.col("session").eqNullSafe(F.col("of")), "left_semi")
    kind = linked.schema["session"].dataType.simpleString()
    rows = _grouped(mine, F.desc("pos")).select("session", ranges.NAME, "pos", "next")
    exits = materialized(rows.mapInArrow(run, f"session {kind}, `{ranges.NAME}` int, pos long, exit long"))
    # Of a range's requests only those that a pointer from an earlier range leads to matter, and the first of all.
    targets = exits.select(F.col("session").alias("of"), F.col("exit").alias("at")).where("at is not null").distinct()
    jump = materialized(exits.join(targets, F.col("session").eqNullSafe(F.col("of")) & (F.col("pos") == F.col("at")), "left_semi").unionByName(exits.where("pos = 1")).distinct())
    places = jump.select("session", ranges.NAME, "pos")
    jump = jump.select(F.col("session").alias("of"), F.col("pos").alias("at"), "exit")
    reached = places.where("pos = 1").select("session", "pos")
    while True:
        met = lambda left: left.join(jump, F.col("session").eqNullSafe(F.col("of")) & (F.col("pos") == F.col("at"))).where("exit is not null")
        more = materialized(reached.union(met(reached).select("session", F.col("exit").alias("pos"))).distinct())
        if more.count() == reached.count():
            break
        reached = more
        onward = jump.select(F.col("of").alias("session"), F.col("at").alias("from"), F.col("exit").alias("pos")).where("pos is not null")
        jump = materialized(met(onward).select(F.col("session").alias("of"), F.col("from").alias("at"), "exit"))
    r = reached.select(F.col("session").alias("of"), F.col("pos").alias("at"))
    return places.join(r, F.col("session").eqNullSafe(F.col("of")) & (F.col("pos") == F.col("at")), "left_semi").groupBy("session", ranges.NAME).agg(F.min("pos").alias("entry"))


def watched(requests: DataFrame, answers: DataFrame, keys: list[str], order: str, sent: str, came: str, limit: Column) -> DataFrame:
    """Requests with ``came`` if their answer came in time, ``timed_out``, and ``worker``: each one that timed out ends its worker, so the next request has a new one."""
    joined = requests.join(answers, [*keys, order], "left")
    late = F.col(came).isNull() | (F.col(came) > F.col(sent) + limit)
    rows = joined.withColumn("timed_out", late).withColumn(came, F.when(~late, F.col(came)))
    ended = F.col("timed_out").cast("int")
    return ranges.running(rows, keys, [order], sums={"worker": ended}).withColumn("worker", (F.col("worker") - ended).cast("int"))


def backoff(attempts: DataFrame, keys: list[str], order: str, ok: str, most: int = 3, first_ms: float = 500.0) -> DataFrame:
    """Attempts up to the first that is ok, ``most`` at most, with the wait before each: none, then ``first_ms`` doubled each time."""
    good = F.coalesce(F.col(ok), F.lit(False)).cast("int")
    counted = ranges.running(attempts, keys, [order], sums={"attempt": F.lit(1), "good so far": good})
    rows = counted.where((F.col("good so far") - good == 0) & (F.col("attempt") <= most)).drop("good so far")
    return rows.withColumn("wait_ms", F.when(F.col("attempt") == 1, 0.0).otherwise(first_ms * F.pow(F.lit(2.0), F.col("attempt") - 2)))


def progress(chunks: DataFrame, files: DataFrame, keys: list[str], file: str, order: str, size: str, total: str = "size") -> DataFrame:
    """Each chunk of a file with ``fraction``, what is loaded of all ``files`` of the key when it has come."""
    whole = files.groupBy(*keys).agg(F.sum(total).alias("all bytes"))
    loaded = ranges.running(chunks, keys, [order, file], sums={"loaded": F.col(size)})
    return loaded.join(whole, keys).withColumn("fraction", F.col("loaded") / F.col("all bytes")).drop("all bytes")


def reassembled(chunks: DataFrame, keys: list[str], order: str, data: str) -> DataFrame:
    """Files from their chunks (binary), in order: ``content`` and its size."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, data))), lambda c: F.hex(c[data])), "")
    return chunks.groupBy(*keys).agg(F.unhex(joined).alias("content")).withColumn("size", F.octet_length("content").cast("long"))


def verified(wanted: DataFrame, fetched: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Fetched files with ``sound``: whether size and SHA-256 are those wanted; only sound ones may be kept."""
    joined = wanted.select(F.col(key), F.col("size").alias("wanted size"), F.col("sha256").alias("wanted hash")).join(fetched, key)
    sound = (F.octet_length(content) == F.col("wanted size")) & (F.sha2(content, 256) == F.col("wanted hash"))
    return joined.withColumn("sound", F.coalesce(sound, F.lit(False))).drop("wanted size", "wanted hash")


def pointer_moves(events: DataFrame, session: str, order: str, pointer: str, kind: str, x: str, y: str) -> DataFrame:
    """Moves with what they do: ``dx`` and ``dy``, and ``ratio`` while two pointers are down (of sessions with two at most).

    A pointer that comes or goes resets the baseline: the first move after it
    only sets it. With two pointers the midpoint moves and their distance gives
    the ratio.
    """
    change = F.when(F.col(kind) == "down", 1).when(F.col(kind).isin("up", "cancel"), -1).otherwise(0)
    cuts = ranges.key_cuts(events, [session], order)
    run = partial(ranges.running, keys=[session], order=[order], one=cuts is None)
    rows = run(ranges.placed(events, [session], order, cuts), leasts={"first": F.col(pointer)})
    own, other = F.col(pointer) == F.col("first"), F.col(pointer) != F.col("first")
    held = {f"{name}{c}": F.when(which, F.col(c)) for name, which in (("a", own), ("b", other)) for c in (x, y)}
    rows = run(rows, sums={"active": change, "island": F.abs(change)}, lasts=held)
    two = F.col("active") == 2
    mid = lambda c: F.when(two, (F.col(f"a{c}") + F.col(f"b{c}")) / 2).otherwise(F.col(c))
    far = F.when(two, F.hypot(F.col(f"a{x}") - F.col(f"b{x}"), F.col(f"a{y}") - F.col(f"b{y}")))
    moves = rows.where((F.col(kind) == "move") & (F.col("active") > 0)).withColumns({"mid x": mid(x), "mid y": mid(y), "far": far})
    moves = run(moves, befores={"before": F.struct("island", "mid x", "mid y", "far")})
    same = F.col("before.island") == F.col("island")
    ratio = F.when(same & (F.col("before.far") != 0), F.col("far") / F.col("before.far"))
    return moves.select(session, order, "active", F.when(same, F.col("mid x") - F.col("before.mid x")).alias("dx"), F.when(same, F.col("mid y") - F.col("before.mid y")).alias("dy"), ratio.alias("ratio"))
