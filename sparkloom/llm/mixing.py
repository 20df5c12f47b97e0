"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources get targets in words from their weights, none above twice its size.
Each source's documents are dealt over shards of bounded size by a seeded hash
of id and text; a shard's words, in seeded order, are cut into blocks of equal
length (within a word). The blocks of the whole mix are apportioned to the sources, and each
source's blocks to its shards, by highest quotients votes / (2 seats + 1). A
shard with quota q over n blocks takes every block q // n times and q % n
blocks, drawn by a seeded permutation, once more.

Apportionment goes down a tree in which no node has more than ``FANOUT``
children, so no task sees more than that many rows of even the largest source.

Null texts have no words; their rows are taken 0 times. The null source comes
last. Rows without words or sources without words have target and quota 0. An
empty table gives no rows. A very long text may fill a shard alone.
Repeated rows are drawn separately: where rows with one id and one text have
more words than a shard, their copies are numbered and dealt by number too. So
results depend on the rows and the seed alone, not on how they are partitioned;
rows that agree in id, text and source are interchangeable. Columns may have
any names: those that come along are renamed inside.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, cut, map_batches

BLOCK_WORDS, SHARD_WORDS, FANOUT = 32, 16_384, 1024
#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 10_000


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients; no one gets more than its cap; ties go to the first."""
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    caps = np.where(votes > 0, caps, 0)
    seats = min(int(seats), int(caps.sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    give = lambda divisor: np.minimum(caps, np.floor(votes / divisor + 0.5)).astype(np.int64)
    few, many = votes.sum() * 4, votes.sum() / seats  # divisors that give too little and enough
    while give(many).sum() < seats:
        many /= 2
    for _ in range(60):
        middle = (few + many) / 2
        few, many = (middle, many) if give(middle).sum() <= seats else (few, middle)
    got = give(few)
    queue = [(-votes[i] / (2 * got[i] + 1), i) for i in range(len(votes)) if got[i] < caps[i]]
    heapq.heapify(queue)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(queue, (-votes[i] / (2 * got[i] + 1), i))
    return got


def apportion(leaves: DataFrame, seats: DataFrame, n_leaves: int) -> DataFrame:
    """The leaves (grp, leaf, votes, cap) with their seats; ``seats`` has (grp, seats)."""
    levels = 1
    while FANOUT**levels < n_leaves:
        levels += 1

    def share(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        rows["seats"] = sainte_lague(rows["votes"].to_numpy(), rows["seats"].iloc[0], rows["cap"].to_numpy())
        return rows[["grp", "node", "seats"]]

    held = seats.select("grp", F.lit(0).cast("long").alias("parent"), "seats")
    for level in reversed(range(levels)):
        node = F.floor(F.col("leaf") / F.lit(FANOUT**level)).cast("long")
        nodes = leaves.groupBy("grp", node.alias("node")).agg(F.sum("votes").alias("votes"), F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("long"))
        held = nodes.join(held, ["grp", "parent"]).groupBy("grp", "parent").applyInPandas(share, "grp long, node long, seats long")
        held = held.withColumnRenamed("node", "parent")
    return leaves.join(held.withColumnRenamed("parent", "leaf"), ["grp", "leaf"])


def ranked(sources: DataFrame) -> DataFrame:
    """``rank`` of each source by code point, null last, without sorting all in one task."""
    order = F.col("source").asc_nulls_last()
    parts = cut(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("within", within).join(F.broadcast(base), "part").select("source", "source_size", (F.col("base") + F.col("within")).alias("rank"))


def fill_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Sources with ``target``: ``share`` of all sizes by weight, none above ``most`` times its size, the excess reshared."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = cut(sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * most))
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level = full = None
    while True:  # each round either fills another source or ends
        over = F.lit(False) if level is None else F.col("weight") * level >= F.col("most")
        now, used, rest = sources.agg(F.count_if(over), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))).first()
        if now == full or not rest:
            break
        full, level = now, (total - (used or 0)) / rest
    return sources.withColumn("target", F.least(F.col("most"), F.col("weight") * F.lit(float(level or 0))).cast("double"))


def numbered_copies(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with ``copy``: a number from 0 for each row of a group in ``groups`` (id, mark, source), 0 for others.

    Numbers are counted within partitions, and the counts of partitions are
    added up, so that no task sees all rows of a group.
    """
    named = groups.select(F.col("id").alias("group id"), F.col("mark").alias("group mark"), F.col("source").alias("group source"))
    same = rows["id"].eqNullSafe(named["group id"]) & (rows["mark"] == named["group mark"]) & rows["source"].eqNullSafe(named["group source"])
    rest = rows.join(named, same, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    own = cut(rows.join(named, same, "left_semi").withColumn("part", F.spark_partition_id()))
    key = ("id", "mark", "source")
    parts = own.groupBy(*key, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*(F.col(c).alias(f"of {c}") for c in (*key, "part")), F.coalesce(before, F.lit(0)).alias("before"))
    inside = own.withColumn("at", F.row_number().over(Window.partitionBy(*key, "part").orderBy("size")))
    joined = inside.join(parts, inside["id"].eqNullSafe(parts["of id"]) & (inside["mark"] == parts["of mark"]) & inside["source"].eqNullSafe(parts["of source"]) & (inside["part"] == parts["of part"]))
    return rest.unionByName(joined.select(*rows.columns, (F.col("before") + F.col("at") - 1).alias("copy")))


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", id_column: str = "doc_id", keep: tuple[str, ...] = (), weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7) -> DataFrame:
    """For each row: id, source, ``size``, ``source_size``, ``target``, and what the mix takes of it.

    ``first_word`` is its place in its ``shard`` of ``shard_words`` words and
    ``times`` how often each of the shard's blocks is taken; ``taken`` counts
    the row's words that are taken, at most ``most`` times its size (a whole
    number, as blocks are taken whole). The columns ``keep`` come along.
    """
    if most != int(most) or most < 1:
        raise ValueError("most must be a whole number")
    most = int(most)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.regexp_count(body, F.lit(WORD)).cast("long")
    kept = [F.col(f"`{c}`").alias(f"kept {k}") for k, c in enumerate(keep)]
    sized = docs.select(F.col(id_column).alias("id"), F.col(source).cast("string").alias("source"), words.alias("size"), F.xxhash64(body).alias("mark"), *kept)
    small = cut(sized.select("id", "source", "size", "mark"))
    if not keep:
        sized = small
    many = small.groupBy("id", "mark", "source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("words") > SHARD_WORDS))
    many = cut(many.select("id", "mark", "source"))
    if many.isEmpty():
        small, sized = (rows.withColumn("copy", F.lit(0).cast("long")) for rows in (small, sized))
    else:
        small, sized = (numbered_copies(rows, many) for rows in (small, sized))
    sources = fill_targets(ranked(small.groupBy("source").agg(F.sum("size").alias("source_size"))), weights, share, most)
    sources = sources.withColumn("shards", F.ceil(F.col("source_size") / SHARD_WORDS))
    sources = cut(sources.select(F.col("source").alias("name"), "rank", "source_size", "target", F.greatest("shards", F.lit(1)).alias("shards")))
    n_sources, most_shards = sources.agg(F.count("*"), F.max("shards")).first()
    side = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    order = F.xxhash64(F.lit(seed), "id", "mark", "copy")

    def placed(rows: DataFrame) -> DataFrame:
        joined = rows.join(side, rows["source"].eqNullSafe(sources["name"]))
        return joined.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "id", "mark", "copy"), F.col("shards")))

    counted = placed(small).groupBy("rank", "shard").agg(F.sum("size").alias("shard_words"))
    counted = cut(counted.withColumn("blocks", F.when(F.col("shard_words") > 0, F.greatest(F.round(F.col("shard_words") / BLOCK_WORDS), F.lit(1))).otherwise(0).cast("long")))
    stock = counted.groupBy("rank").agg(F.sum("blocks").alias("blocks")).join(side, "rank")
    stock = cut(stock.select(F.lit(0).cast("long").alias("grp"), F.col("rank").cast("long").alias("leaf"), F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0).alias("votes"), (F.col("blocks") * most).alias("cap")))
    quotas = apportion(stock, stock.groupBy("grp").agg(F.round(F.sum("votes")).cast("long").alias("seats")), n_sources or 1)
    quotas = quotas.select(F.col("leaf").alias("grp"), "seats")
    leaves = counted.select(F.col("rank").cast("long").alias("grp"), F.col("shard").cast("long").alias("leaf"), F.col("shard_words").cast("double").alias("votes"), (F.col("blocks") * most).alias("cap"))
    # Cut: else tasks of the draw hold two Python workers each, one for the apportionment.
    shares = cut(apportion(leaves, quotas, most_shards or 1).select(F.col("grp").alias("rank"), F.col("leaf").alias("shard"), "seats"))

    def draw(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for rank, shard, n, seats in zip(*(c.to_pylist() for c in batch.columns[:4])):
            every, more = divmod(seats, n) if n else (0, 0)
            times = np.full(n, every, np.int32)
            times[np.random.default_rng([seed, rank, shard]).permutation(n)[:more]] += 1
            rows.append(times)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(4), pa.array(rows, pa.list_(pa.int32()))], ["rank", "shard", "shard_words", "times"])

    drawn = counted.join(shares, ["rank", "shard"]).select(F.col("rank").cast("long"), F.col("shard").cast("long"), "blocks", "seats", "shard_words")
    drawn = map_batches(drawn, draw, "rank long, shard long, shard_words long, times array<int>")
    sums = Window.partitionBy("rank", "shard").orderBy(order, "id", "mark", "copy")
    rows = placed(sized).withColumn("first_word", F.sum("size").over(sums.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    rows = rows.join(drawn, ["rank", "shard"])
    n, w = F.size("times"), F.col("shard_words")
    block = lambda word: F.floor(((word + 1) * n - 1) / w).cast("long")
    low, high = block(F.col("first_word")), block(F.col("first_word") + F.col("size") - 1)
    starts = lambda b: F.floor(b * w / n).cast("long")
    overlap = lambda b: F.least(starts(b + 1), F.col("first_word") + F.col("size")) - F.greatest(starts(b), F.col("first_word"))
    taken = F.aggregate(F.sequence(low, high), F.lit(0).cast("long"), lambda sum_, b: sum_ + overlap(b) * F.element_at("times", (b + 1).cast("int")))
    rows = rows.withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(0))
    return rows.select(F.col("id").alias(id_column), *(F.col(f"kept {k}") for k in range(len(keep))), "source", "size", "source_size", "target", "taken", "rank", "shard", "first_word", "shard_words", "times")


_WORD = re.compile(WORD.encode())


def taken_texts(text: bytes, first_word: int, shard_words: int, times: np.ndarray) -> list[bytes]:
    """What each pass over the mix takes of a text: the k-th holds the blocks taken k times or more, in order."""
    spans = [m.start() for m in _WORD.finditer(text)]
    n, out = len(times), []
    if not spans:
        return out
    edges = np.arange(n + 1, dtype=np.int64) * shard_words // n - first_word
    for k in range(1, int(times.max(initial=0)) + 1):
        parts, open_at = [], None
        for b in range(max(0, int(np.searchsorted(edges, 0, "right")) - 1), n):
            if edges[b] >= len(spans):
                break
            low = max(0, int(edges[b]))
            if times[b] >= k:
                open_at = low if open_at is None else open_at
            elif open_at is not None:
                parts.append(text[spans[open_at] if open_at else 0 : spans[low]] if low > open_at else b"")
                open_at = None
        if open_at is not None:
            parts.append(text[spans[open_at] if open_at else 0 :])
        if whole := b"\n".join(p.rstrip(b" \t\n\v\f\r") if len(parts) > 1 else p for p in parts if p):
            out.append(whole)
    return out


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", id_column: str = "doc_id", **options) -> DataFrame:
    """The mix as rows with the columns of ``docs``: for each pass that takes words of a row, the row with those words."""
    names = docs.columns
    plan = mix_plan(docs, text, source, id_column, keep=tuple(names), **options)
    at = names.index(text)
    plan = plan.where("taken > 0").select(*(F.col(f"kept {k}").alias(f"kept {k}") for k in range(len(names))), "first_word", "shard_words", "times")

    def take(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, texts = [], []
        for k in range(batch.num_rows):
            first, size, times = (batch.column(len(names) + j)[k].as_py() for j in range(3))
            found = taken_texts(batch.column(at)[k].as_py().encode(), first, size, np.array(times, np.int32))
            rows += [k] * len(found)
            texts += found
        picked = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[: len(names)]]
        picked[at] = pa.array([t.decode() for t in texts], pa.string())
        yield pa.RecordBatch.from_arrays(picked, names)

    return map_batches(plan, take, docs.schema)
