"""SimHash near-duplicate groups by a segment-popcount grid.

A fingerprint is cut into two-bit segments and mapped to the number of set bits
in each. One differing bit moves one coordinate by one at most, so the
Manhattan distance of two such vectors is a lower bound of the Hamming
distance. Of two vectors within distance 3, one half (16 coordinates) agrees up
to distance 1. The join therefore looks each half up in a grid of unit cells:
one side sends a fingerprint to its own cell, the other to its own cell and to
the cells one step up, at most 17 in a half; pairs that meet are verified on
the fingerprints themselves. Nothing is missed and the rows sent grow in
proportion to the distinct fingerprints.

Copies with equal fingerprints are one node: links exist between different
fingerprints only, and groups are found by large-star and small-star rounds
whose tables are checkpointed in the shared folder.

Null and empty texts have fingerprint zero, which links like any other. Long
texts are fingerprinted whole, some shingles at a time. An empty table gives no
rows; only the id and the text are read, whatever else the table has.
Rows without an id take part; their group is named by the smallest id in it,
null if it has none. Repeated rows and ids each keep a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, map_batches, utf8

MOST_BITS = 3
HALF_SEGMENTS = 16
_STEP = 1 << 15  # shingles that are counted at once


def fingerprint(text: bytes, shingle_words: int = 3, seed: int = 42) -> int:
    """64 bits; bit i is set if it is set in over half of the shingles' XXH64, repeats included."""
    words = text.lower().split()  # only ASCII letters and ASCII white space count here
    if not words:
        return 0
    shingles = max(1, len(words) - shingle_words + 1)
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, shingles, _STEP):
        hashes = [digest(b" ".join(words[k : k + shingle_words]), seed) for k in range(at, min(at + _STEP, shingles))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > shingles, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle_words: int = 3) -> DataFrame:
    """The columns ``keep`` and ``fingerprint`` (long, the 64 bits) of each row."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = np.array([fingerprint(v.as_py(), shingle_words) for v in batch.column(batch.num_columns - 1)], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], [*keep, "fingerprint"])

    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(docs.select(*keep, utf8(text).alias("body of the row")), run, f"{ddl}, fingerprint long")


def half_cell(column: str, half: int):
    """The set bits of each two-bit segment of a half, in place of the segment."""
    bits = F.shiftrightunsigned(F.col(column), 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
    return bits - F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(0x55555555))


def links(distinct: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Pairs (a, b) of the different values of ``fingerprint`` that differ in at most ``most_bits`` (up to 3) bits."""
    if most_bits > 3:
        raise ValueError("half of the segments may then be further apart than one step")
    halves = F.array(*(F.struct(F.lit(h).alias("half"), half_cell("fingerprint", h).alias("cell")) for h in (0, 1)))
    own = distinct.select("fingerprint", F.inline(halves))
    coordinate = lambda i: F.shiftrightunsigned("cell", 2 * i).bitwiseAND(F.lit(3))
    steps = F.array(F.lit(0), *(F.when(coordinate(i) < 2, F.lit(1 << 2 * i)) for i in range(HALF_SEGMENTS)))
    reached = own.select(F.col("fingerprint").alias("b"), "half", "cell", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("step"))
    reached = reached.select("b", "half", (F.col("cell") + F.col("step")).alias("cell"), (F.col("step") == 0).alias("same"))
    near = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("b"))) <= most_bits
    once = F.when(F.col("same"), F.col("fingerprint") < F.col("b")).otherwise(True)
    met = own.join(reached.hint("merge"), (own["half"] == reached["half"]) & (own["cell"] == reached["cell"]) & near & once)
    return met.select(F.col("fingerprint").alias("a"), "b")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked to, for every node of the edges (a, b)."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    mark = None
    while True:
        both = edges.union(edges.select("b", "a"))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("e"))
        edges = cut(small.select(F.col("e.b").alias("a"), F.col("e.low").alias("b")).where("a > b").distinct())
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38)"))).first()
        if seen == mark:
            roots = edges.select("b").distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
        mark = seen


def label_groups(marked: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``fingerprint`` and ``component_id`` for each fingerprint of ``marked``, which is read twice."""
    distinct = cut(marked.groupBy("fingerprint").agg(F.min(id_column).alias("least")))
    nodes = cut(components(links(distinct)))
    linked = nodes.join(distinct, nodes["node"] == distinct["fingerprint"]).select("fingerprint", "root", "least")
    names = linked.groupBy("root").agg(F.min("least").alias("name"))
    named = linked.join(names, "root").select("fingerprint", "name")
    labels = distinct.join(named, "fingerprint", "left")
    return labels.select("fingerprint", F.coalesce("name", "least").alias("component_id"))


def near_duplicate_groups(docs: DataFrame, text: str = "text", id_column: str = "doc_id", shingle_words: int = 3) -> DataFrame:
    """The id, ``fingerprint`` (long) and ``component_id`` of each row."""
    marked = cut(fingerprints(docs, text, (id_column,), shingle_words))
    labels = cut(label_groups(marked, id_column))
    return marked.join(labels, "fingerprint").select(id_column, "fingerprint", "component_id")


def keep_one_of_each_group(docs: DataFrame, text: str = "text", id_column: str = "doc_id", shingle_words: int = 3) -> DataFrame:
    """The rows of ``docs`` with the smallest id (then text hash) of each group; of repeated rows one."""
    keyed = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("hash"), F.col(text).alias("text"))
    marked = cut(fingerprints(keyed, "text", ("id", "hash"), shingle_words))
    labels = cut(label_groups(marked, "id"))
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "hash")
    # A group without any id is named by its own fingerprint.
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("own"))
    winners = marked.join(labels, "fingerprint").groupBy(group.alias("group")).agg(F.min(rank).alias("first"))
    kept = winners.select(F.col("first.id").alias("kept id"), F.col("first.hash").alias("kept hash")).distinct()
    named = docs.withColumn("hash of the row", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    same = named[id_column].eqNullSafe(F.col("kept id")) & (F.col("hash of the row") == F.col("kept hash"))
    return named.join(kept, same, "left_semi").dropDuplicates([id_column, "hash of the row"]).select(*(F.col(f"`{c}`") for c in docs.columns))
