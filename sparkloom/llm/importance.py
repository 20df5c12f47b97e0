"""Importance resampling towards a target by hashed n-grams, with CRCs from a position table.

The features of a text are its words and its pairs of consecutive words, and a
feature's bucket is the CRC-32 of its bytes modulo the number of buckets. A CRC
is linear but for a constant of the length: that of a span is the XOR of what
each byte adds at its distance from the end, and of the constant. So the CRCs
of all spans of a buffer come from one look-up per byte in ``AT_DISTANCE`` and
one ``bitwise_xor.reduceat`` over the spans. Bytes more than ``BLOCK`` from the
end are folded by blocks: each block's XOR is moved on by the bytes behind it
with tables of powers of two of ``BLOCK``.

Every row of both tables is counted (one dense array per task, summed by
Spark), a row's weight is the floored mean of its features' gains, and rows are
drawn by weight plus seeded Gumbel noise. The cut-off comes from the counts of
scores, of which there are at most some 300,000 whatever the input; only the
rows above it are sorted, by range, and ranked by partition offsets.

Null and empty texts have no features and weight 0. Long texts are cut into
pieces that overlap by a word. A null id draws by the noise of the text
``null`` and comes after other ids in a tie; rows with equal score and id are
ranked by their text's hash (identical rows in any order, which gives the same
result). Empty tables give no rows; without target rows the gains only measure
rarity. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, utf8

BUCKETS = 10_000
#: Distances that the table holds, bytes of text that are worked on together, and blocks that are folded together.
BLOCK, STEP, BLOCKS_AT_ONCE = 64, 1 << 18, 1 << 13

SPACE = 0x20
#: Each byte lower-cased if it belongs to a word, else a space.
WORD_BYTE = np.full(256, SPACE, np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    WORD_BYTE[_low : _high + 1] = np.arange(_low, _high + 1)
WORD_BYTE[0x41:0x5B] = WORD_BYTE[0x61:0x7B]


def _zero_byte(register: np.ndarray) -> np.ndarray:
    """CRC registers after one more zero byte."""
    return (register >> np.uint32(8)) ^ _OF_BYTE[register & np.uint32(0xFF)]


_OF_BYTE = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
#: [distance * 256 + byte]: what a byte adds with so many bytes behind it.
AT_DISTANCE = [_OF_BYTE]
#: [length]: the CRC of so many zero bytes, before its final inversion.
OF_LENGTH = [np.array([0xFFFFFFFF], np.uint32)]
for _ in range(BLOCK):
    AT_DISTANCE.append(_zero_byte(AT_DISTANCE[-1]))
    OF_LENGTH.append(_zero_byte(OF_LENGTH[-1]))
#: [j][256 * k + byte]: byte k of a register after BLOCK * 2^j zero bytes.
MOVED = [np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
for _ in range(BLOCK):
    MOVED[0] = _zero_byte(MOVED[0])
AT_DISTANCE, OF_LENGTH = np.concatenate(AT_DISTANCE[:BLOCK]), np.concatenate(OF_LENGTH)


def _move(table: np.ndarray, register: np.ndarray) -> np.ndarray:
    parts = [table[256 * k + ((register >> np.uint32(8 * k)) & np.uint32(0xFF))] for k in range(4)]
    return parts[0] ^ parts[1] ^ parts[2] ^ parts[3]


for _ in range(25):
    MOVED.append(_move(MOVED[-1], MOVED[-1]))


def moved(register: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Registers after as many blocks of zero bytes."""
    register = register.copy()
    for j in range(int(blocks.max(initial=0)).bit_length()):
        chosen = np.flatnonzero((blocks >> j) & 1)
        register[chosen] = _move(MOVED[j], register[chosen])
    return register


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each data[start:end]; the spans follow each other without overlap, and none is empty."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    sizes = ends - starts
    blocks = (sizes + BLOCK - 1) // BLOCK
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    behind = np.repeat(blocks, blocks) - 1 - (np.arange(blocks.sum()) - np.repeat(first, blocks))
    block_ends = np.repeat(ends, blocks) - BLOCK * behind
    block_sizes = np.minimum(block_ends - np.repeat(starts, blocks), BLOCK)
    folded = np.empty(len(block_ends), np.uint32)
    for at in range(0, len(block_ends), BLOCKS_AT_ONCE):
        part = slice(at, at + BLOCKS_AT_ONCE)
        n, low, high = block_sizes[part], block_ends[part][0] - block_sizes[part][0], block_ends[part][-1]
        # Bytes between two spans count as before the second, further from its end than it is long, and add nothing.
        lengths = np.diff(block_ends[part], prepend=low)
        distance = np.repeat(block_ends[part], lengths) - 1 - np.arange(low, high)
        added = AT_DISTANCE[np.minimum(distance, BLOCK - 1) * 256 + data[low:high]]
        added[distance >= np.repeat(n, lengths)] = 0
        folded[part] = np.bitwise_xor.reduceat(added, block_ends[part] - n - low)
    folded = moved(folded, behind) if len(folded) > len(starts) else folded
    whole = np.bitwise_xor.reduceat(folded, first)
    return whole ^ moved(OF_LENGTH[sizes % BLOCK], sizes // BLOCK) ^ np.uint32(0xFFFFFFFF)


@dataclass
class Pieces:
    """Words of several rows: ``data`` holds each with one space behind it, word k at [starts[k], ends[k]) of row ``rows[k]``; the first word of a piece that carries on is ``repeated``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    repeated: np.ndarray

    def crcs(self) -> tuple[np.ndarray, np.ndarray]:
        """The CRCs of all features and their rows."""
        n = len(self.starts)
        fresh = ~self.repeated
        found, rows = [span_crcs(self.data, self.starts, self.ends)[fresh]], [self.rows[fresh]]
        for shift in (0, 1):  # pairs that start at each second word don't overlap
            head = np.arange(shift, n - 1, 2)
            head = head[(self.rows[head] == self.rows[head + 1]) & ~self.repeated[head + 1]]
            found.append(span_crcs(self.data, self.starts[head], self.ends[head + 1]))
            rows.append(self.rows[head])
        return np.concatenate(found), np.concatenate(rows)


def pieces(texts: list[bytes]) -> Iterator[Pieces]:
    """The words of all texts, about ``STEP`` bytes at a time."""
    held: list[tuple[int, np.ndarray, bool]] = []
    size = 0
    for row, text in enumerate(texts):
        words = WORD_BYTE[np.frombuffer(text, np.uint8)]
        at, carry = 0, np.zeros(0, np.uint8)
        while at < len(words):
            end = min(at + STEP, len(words))
            while end < len(words) and words[end] != SPACE:
                gap = np.flatnonzero(words[end : end + STEP] == SPACE)
                end = end + int(gap[0]) if len(gap) else min(end + STEP, len(words))
            body = words[at:end]
            held.append((row, np.concatenate([carry, body]) if len(carry) else body, bool(len(carry))))
            size += len(held[-1][1])
            at = end
            if at < len(words):
                last = np.flatnonzero(body != SPACE)
                if len(last):
                    stop = int(last[-1]) + 1
                    before = np.flatnonzero(body[:stop] == SPACE)
                    carry = np.concatenate([body[int(before[-1]) + 1 if len(before) else 0 : stop], [np.uint8(SPACE)]])
            if size >= STEP:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, np.ndarray, bool]]) -> Pieces:
    space = np.array([SPACE], np.uint8)
    data = np.concatenate([x for _, part, _ in held for x in (space, part, space)])
    offsets = np.cumsum([0] + [len(part) + 2 for _, part, _ in held])
    inside = data != SPACE
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    part = np.searchsorted(offsets, first, "right") - 1
    repeated = np.zeros(len(first), bool)
    carried = np.array([c for *_, c in held])
    heads = np.flatnonzero(np.diff(part, prepend=-1))
    repeated[heads] = carried[part[heads]]
    data = data[kept]
    ends = np.flatnonzero(data == SPACE)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    return Pieces(data, starts, ends, np.array([r for r, *_ in held])[part], repeated)


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and how many features of all rows fall in it, ``n``; buckets without any are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in pieces([v.as_py() for v in batch.column(0)]):
                total += np.bincount(piece.crcs()[0] % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "part"])

    return df.select(utf8(text)).mapInArrow(count, "bucket int, part long").groupBy("bucket").agg(F.sum("part").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the raw rows, from two tables of ``bucket_counts``."""
    s, t = (np.zeros(buckets, np.int64) for _ in range(2))
    for counts, table in ((s, raw), (t, target)):
        for row in table.collect():  # at most one row a bucket
            counts[row.bucket] = row.n
    of_raw, of_target = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log(float(b + 1) * of_raw / (float(a + 1) * of_target))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The id, ``n_words``, ``n_features``, ``weight`` and the ``text hash`` of each row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            words, features, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
            for piece in pieces([v.as_py() for v in batch.column(2)]):
                crcs, at = piece.crcs()
                words += np.bincount(piece.rows[~piece.repeated], minlength=rows)
                features += np.bincount(at, minlength=rows)
                total += np.bincount(at, gains[crcs % np.uint32(len(gains))], rows)  # whole numbers far below 2^53
            weight = total.astype(np.int64) // np.maximum(features, 1)
            columns = [batch.column(0), batch.column(1), *(pa.array(x) for x in (words, features, weight))]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "text hash", "n_words", "n_features", "weight"])

    kind = docs.schema[id_column].dataType.simpleString()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    asked = docs.select(F.col(id_column), F.xxhash64(body).alias("text hash"), utf8(text).alias("body"))
    return asked.mapInArrow(weigh, f"`{id_column}` {kind}, `text hash` long, n_words long, n_features long, weight long")


def noisy_score(id_column: str, seed: int):
    """The weight plus 1000 times Gumbel noise, which a hash of the seed and the id gives, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.col("weight") + F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, share: int, least_words: int, id_column: str = "doc_id") -> DataFrame:
    """``scored``, a stored frame, with the ``rank`` of rows that are drawn: ``share`` % of those with ``least_words`` or more, the highest scores."""
    may = F.col("n_words") >= least_words
    held = sorted(((r.score, r.n) for r in scored.where(may).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = sum(n for _, n in held) * share // 100
    cutoff, reached = None, 0
    for score, n in held:
        if reached >= wanted:
            break
        cutoff, reached = score, reached + n
    none = F.lit(None).cast("long").alias("rank")
    columns = scored.columns
    if cutoff is None:
        return scored.select("*", none)
    above = may & (F.col("score") >= cutoff)
    order = [F.desc("score"), F.asc_nulls_last(id_column), F.asc("text hash")]
    # The id of a row in sorted partitions is its partition's number and its place there.
    place = F.monotonically_increasing_id()
    inside = cut(scored.where(above).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place))
    part = F.shiftright("place", 33)
    sizes, offsets = inside.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect(), []  # a row a partition
    before = 0
    for row in sorted(sizes, key=lambda r: r.part):
        offsets.append((row.part, before))
        before += row.n
    table = F.broadcast(scored.sparkSession.createDataFrame(offsets, "part long, before long"))
    at = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    drawn = inside.join(table, part == table["part"]).select(*columns, F.when(at <= wanted, at).alias("rank"))
    return drawn.unionByName(scored.where(~above).select("*", none))


def importance_draw(docs: DataFrame, target: DataFrame, share: int = 25, seed: int = 7, least_words: int = 20, text: str = "text", target_text: str = "text", id_column: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """The id, ``text hash``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn) of each row of ``docs``."""
    gains = bucket_gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets), buckets)
    scored = weighted(docs, gains, text, id_column).withColumn("score", noisy_score(id_column, seed))
    return ranked(cut(scored), share, least_words, id_column)


def resample(docs: DataFrame, target: DataFrame, share: int = 25, seed: int = 7, least_words: int = 20, text: str = "text", target_text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; of rows that share id and text all or none."""
    chosen = importance_draw(docs, target, share, seed, least_words, text, target_text, id_column).where("rank is not null")
    names = chosen.select(F.col(id_column).alias("drawn id"), F.col("text hash").alias("drawn hash")).distinct()
    own = [F.col(f"`{c}`").alias(f"column {k}") for k, c in enumerate(docs.columns)]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    named = docs.select(*own, F.xxhash64(body).alias("hash of the row"))
    same = named[f"column {docs.columns.index(id_column)}"].eqNullSafe(names["drawn id"]) & (named["hash of the row"] == names["drawn hash"])
    return named.join(names, same, "left_semi").select(*(F.col(f"column {k}").alias(c) for k, c in enumerate(docs.columns)))
