"""Running figures over keyed events of which one key may hold most.

A key with more than ``RANGE`` events is cut, by approximate quantiles of the
first order column, in ranges of about that size. Each figure is an associative
summary (a sum, the last or first value): windows run inside the ranges, and
what earlier or later ranges hold comes from a table with a row for each range
of such keys. No task then holds all events of a key; keys below the bound are
one range, and without larger ones the plan is a plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Events in a range, about; rows of a table of ranges that are broadcast at most.
RANGE, BROADCAST = 100_000, 1_000_000
#: The range of an event within its key.
NAME = "range of the key"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def _same(left: DataFrame, right: DataFrame, names: dict[str, str]) -> Column:
    """Null keys are keys, too."""
    out = F.lit(True)
    for a, b in names.items():
        out = out & left[a].eqNullSafe(right[b])
    return out


def key_cuts(events: DataFrame, keys: list[str], first: str, bound: int | None = None) -> DataFrame | None:
    """Where each key with more than ``bound`` events is cut (columns ``hot`` key and ``cuts of the key``); None if there is no such key."""
    bound = bound or RANGE
    counted = events.groupBy(*keys).agg(F.count("*").alias("events of the key")).where(F.col("events of the key") > bound)
    most = counted.agg(F.max("events of the key")).first()[0]
    if most is None:
        return None
    renamed = {k: f"hot {k}" for k in keys}
    hot = _small(counted.select(*(F.col(k).alias(v) for k, v in renamed.items())))
    mine = events.join(hot, _same(events, hot, renamed), "left_semi")
    pieces = -(-int(most) // bound)
    cuts = F.percentile_approx(first, [k / pieces for k in range(1, pieces)], 20 * pieces).alias("cuts")
    table = mine.groupBy(*keys).agg(cuts, F.count("*").alias("n"))
    # A smaller key takes each so many of the cuts.
    step = F.greatest(F.lit(1), F.floor(F.lit(float(bound)) * pieces / F.col("n")).cast("int"))
    thinned = F.filter("cuts", lambda _, k: (k + 1) % step == 0)
    return _small(table.select(*(F.col(k).alias(v) for k, v in renamed.items()), thinned.alias("cuts of the key")))


def placed(events: DataFrame, keys: list[str], first: str, cuts: DataFrame | None) -> DataFrame:
    if cuts is None:
        return events.withColumn(NAME, F.lit(0))
    renamed = {k: f"hot {k}" for k in keys}
    joined = events.join(cuts, _same(events, cuts, renamed), "left").drop(*renamed.values())
    at = F.size(F.filter("cuts of the key", lambda c: c < F.col(first)))
    return joined.withColumn(NAME, F.when(F.col("cuts of the key").isNull(), 0).otherwise(at)).drop("cuts of the key")


def with_ranges(events: DataFrame, keys: list[str], first: str, bound: int | None = None) -> DataFrame:
    """``events`` with the range of each; events that are equal in ``first`` (a number or a time) are in one range."""
    return placed(events, keys, first, key_cuts(events, keys, first, bound))


def running(events: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, befores: dict[str, Column] | None = None, firsts: dict[str, Column] | None = None, nexts: dict[str, Column] | None = None, leasts: dict[str, Column] | None = None, bound: int | None = None, one: bool = False) -> DataFrame:
    """``events`` with figures of their key, in order of ``order`` (which tells events apart).

    ``sums`` are of all events up to each, itself included (null counts as 0);
    ``lasts`` the last value that is not null up to it, ``firsts`` the first
    from it on; ``befores`` the value of the event before, ``nexts`` of that
    after; ``leasts`` the least value of the whole key. Events that have ranges
    (``with_ranges`` on these keys) keep them; ``one`` says that each key is one.
    """
    sums, lasts, befores, firsts, nexts, leasts = (dict(d or {}) for d in (sums, lasts, befores, firsts, nexts, leasts))
    given = NAME in events.columns
    cuts = None if given or one else key_cuts(events, keys, order[0], bound)
    ranged = events if given else placed(events, keys, order[0], cuts)
    by = Window.partitionBy(*keys, NAME).orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    # What comes on is what has been, backwards: a frame that ends with the last row would be summed anew for each.
    onward = Window.partitionBy(*keys, NAME).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    zero = {k: F.coalesce(v, F.lit(0)) for k, v in sums.items()}
    own = {k: F.sum(v).over(upto) for k, v in zero.items()}
    own |= {k: F.last(v, ignorenulls=True).over(upto) for k, v in lasts.items()}
    own |= {k: F.lag(v).over(by) for k, v in befores.items()}
    own |= {k: F.last(v, ignorenulls=True).over(onward) for k, v in firsts.items()}
    own |= {k: F.lead(v).over(by) for k, v in nexts.items()}
    own |= {k: F.min(v).over(Window.partitionBy(*keys, NAME)) for k, v in leasts.items()}
    if one or (not given and cuts is None):
        return ranged.withColumns(own).drop(*([] if given else [NAME]))
    place = F.struct(*order)
    held = lambda v, best: best(F.struct(v.alias("v")), F.when(v.isNotNull(), place))
    table = {k: F.sum(v) for k, v in zero.items()} | {k: held(v, F.max_by) for k, v in lasts.items()} | {k: held(v, F.min_by) for k, v in firsts.items()}
    table |= {k: F.max_by(F.struct(v.alias("v")), place) for k, v in befores.items()} | {k: F.min_by(F.struct(v.alias("v")), place) for k, v in nexts.items()}
    table |= {k: F.min(v) for k, v in leasts.items()}
    ranges = ranged.groupBy(*keys, NAME).agg(*(v.alias(k) for k, v in table.items()))
    along = Window.partitionBy(*keys).orderBy(NAME)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc(NAME)).rowsBetween(Window.unboundedPreceding, -1)
    full = lambda k: F.when(F.col(k)["v"].isNotNull(), F.col(k))
    carry = {k: F.sum(k).over(earlier) for k in sums} | {k: F.last(full(k), ignorenulls=True).over(earlier)["v"] for k in lasts}
    carry |= {k: F.lag(k).over(along)["v"] for k in befores} | {k: F.last(full(k), ignorenulls=True).over(later)["v"] for k in firsts} | {k: F.lead(k).over(along)["v"] for k in nexts}
    carry |= {k: F.min(k).over(Window.partitionBy(*keys)) for k in leasts}
    names = {k: f"carried {n}" for n, k in enumerate(carry)}
    sides = {k: f"range key {n}" for n, k in enumerate([*keys, NAME])}
    count = F.count("*").over(Window.partitionBy(*keys))
    only = ranges.withColumn("ranges of the key", count).select("ranges of the key", *(F.col(k).alias(v) for k, v in sides.items()), *(carry[k].alias(v) for k, v in names.items())).where("`ranges of the key` > 1").drop("ranges of the key")
    only = _small(only)
    first_of, last_of = F.row_number().over(by) == 1, F.lead(F.lit(1)).over(by).isNull()
    rows = ranged.withColumns(own | {"first of the range": first_of, "last of the range": last_of})
    joined = rows.join(only, _same(rows, only, sides), "left")
    final = {k: F.col(k) + F.coalesce(names[k], F.lit(0)) for k in sums} | {k: F.coalesce(k, names[k]) for k in [*lasts, *firsts]}
    final |= {k: F.when(F.col("first of the range"), F.col(names[k])).otherwise(F.col(k)) for k in befores}
    final |= {k: F.when(F.col("last of the range"), F.col(names[k])).otherwise(F.col(k)) for k in nexts}
    final |= {k: F.least(F.col(k), F.col(names[k])) for k in leasts}
    return joined.withColumns(final).drop("first of the range", "last of the range", *names.values(), *sides.values(), *([] if given else [NAME]))

