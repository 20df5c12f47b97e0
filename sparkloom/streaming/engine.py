"""A worker for each session, on a stream: started when needed, one request at a time, ended by a watchdog.

Events of a session are requests (``scan`` with an id of their own), replies of
the worker (``reply`` with the number of the post they answer, ``ready``,
``result`` or ``error``) and its ``crash``. Rows that come out are what is done
about them: ``spawn`` a worker, ``post`` a message to it, ``end`` it, and
``settle`` a request, well or with an error.

A request waits until its worker is ready. One that comes while another runs,
or a second one that has waited, is refused as busy. A post that is not
answered within its limit ends the worker and fails what waits for it; the next
request starts a new one, and what the old one still says is ignored.

``step`` is the whole rule, for one event; ``run_engine`` keeps its state on a
stream, with a timer on event time for the limit of the post in flight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: How long a worker may take to get ready, and for a request, and what is said when it does not.
READY_MS, REQUEST_MS = 60_000, 15_000
BUSY, LATE, CRASHED = "OCR engine is busy", "OCR timed out", "OCR worker crashed"

STATE = "worker int, alive boolean, ready boolean, post long, request string, deadline long, waiting array<string>, posts long"
ACTION = "at long, action string, worker int, post long, request string, ok boolean, message string"


@dataclass(frozen=True)
class Engine:
    """``worker`` counts workers; ``post`` is the one in flight, for ``request`` (none while the worker gets ready), until ``deadline``; ``posts`` counts posts."""

    worker: int = 0
    alive: bool = False
    ready: bool = False
    post: int | None = None
    request: str | None = None
    deadline: int | None = None
    waiting: list[str] = field(default_factory=list)
    posts: int = 0


def _action(now: Engine, at: int, action: str, post=None, request=None, ok=None, message=None) -> dict:
    return {"at": at, "action": action, "worker": now.worker, "post": post, "request": request, "ok": ok, "message": message}


def _posted(now: Engine, at: int, request: str | None, limit: int) -> tuple[Engine, list[dict]]:
    now = replace(now, post=now.posts + 1, posts=now.posts + 1, request=request, deadline=at + limit)
    return now, [_action(now, at, "post", now.post, request, message="init" if request is None else "scan")]


def _ended(now: Engine, at: int, message: str) -> tuple[Engine, list[dict]]:
    """The worker is of no more use: it ends, and all that waits for it fails."""
    failed = ([now.request] if now.request is not None else []) + now.waiting
    out = [_action(now, at, "end", message=message)] if now.alive else []
    out += [_action(now, at, "settle", request=r, ok=False, message=message) for r in failed]
    return Engine(worker=now.worker, posts=now.posts), out


def expired(now: Engine, at: int) -> tuple[Engine, list[dict]]:
    """What the watchdog does up to a time."""
    return _ended(now, now.deadline, LATE) if now.deadline is not None and now.deadline <= at else (now, [])


def step(now: Engine, at: int, kind: str, request: str | None = None, post: int | None = None, reply: str | None = None, message: str | None = None) -> tuple[Engine, list[dict]]:
    """The engine after one event, and what is done about it; the watchdog first does what was due before."""
    now, out = expired(now, at)
    more: list[dict] = []
    if kind == "scan" and not now.alive:
        now = Engine(now.worker + 1, True, waiting=[request], posts=now.posts)
        spawned = _action(now, at, "spawn")
        now, more = _posted(now, at, None, READY_MS)
        more = [spawned, *more]
    elif kind == "scan" and not now.ready:
        now = replace(now, waiting=[*now.waiting, request])
    elif kind == "scan" and now.post is not None:
        more = [_action(now, at, "settle", request=request, ok=False, message=BUSY)]
    elif kind == "scan":
        now, more = _posted(now, at, request, REQUEST_MS)
    elif kind == "crash" and now.alive:
        now, more = _ended(now, at, message or CRASHED)
    elif kind == "reply" and now.post is not None and post == now.post:
        if now.request is None and reply == "error":
            now, more = _ended(now, at, message or "")
        elif now.request is None:
            first, *others = now.waiting
            now, more = _posted(replace(now, ready=True, waiting=[]), at, first, REQUEST_MS)
            more += [_action(now, at, "settle", request=r, ok=False, message=BUSY) for r in others]
        else:
            more = [_action(now, at, "settle", now.post, now.request, reply != "error", message)]
            now = replace(now, post=None, request=None, deadline=None)
    return now, out + more


class _Watched(StatefulProcessor):
    def __init__(self, key: str, names: list[str]):
        self.key, self.names = key, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("engine", STATE)

    def _load(self) -> Engine:
        held = self.state.get()
        return Engine() if held is None else Engine(*held[:6], list(held[6] or []), held[7])

    def _store(self, before: Engine, now: Engine) -> None:
        self.state.update(tuple(asdict(now).values()))
        if before.deadline != now.deadline:
            if before.deadline is not None and before.deadline in self.handle.listTimers():
                self.handle.deleteTimer(before.deadline)
            if now.deadline is not None:
                self.handle.registerTimer(now.deadline)

    def _rows(self, key, actions: list[dict]) -> Iterator[Row]:
        for a in actions:
            yield Row(**{self.key: key[0]}, **a)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = now = self._load()
        for row in sorted(rows, key=lambda r: (r["at ms"], r["order of the event"])):
            now, actions = step(now, row["at ms"], *(row[n] for n in self.names))
            yield from self._rows(key, actions)
        self._store(before, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        before = self._load()
        now, actions = expired(before, expiredTimerInfo.getExpiryTimeInMs())
        yield from self._rows(key, actions)
        self._store(before, now)

    def close(self) -> None:
        pass


def run_engine(events: DataFrame, key: str, ts: str, order: str, late: str = "0 seconds") -> DataFrame:
    """What is done about a stream of events (``kind``, ``request``, ``post``, ``reply``, ``message``), in order of ``ts`` and ``order``.

    Events more than ``late`` behind the latest are not waited for: the watchdog
    acts once the watermark has passed a deadline. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    names = ["kind", "request", "post", "reply", "message"]
    rows = events.withWatermark(ts, late).select(F.col(key), F.col(ts), F.expr(f"unix_millis(`{ts}`)").alias("at ms"), F.col(order).alias("order of the event"), *names)
    schema = StructType([events.schema[key], *events.sparkSession.createDataFrame([], ACTION).schema])
    return rows.groupBy(key).transformWithState(_Watched(key, names), schema, "Append", "EventTime")
