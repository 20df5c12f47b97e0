"""Token files with Re-Pair grammars.

Texts are encoded with a ``tokenizers`` model, an end id is appended to each
document, and the ids go to shards in ascending order of the document id. In a
shard, frequent id pairs are replaced by nonterminals again and again; the
shard stores the rules, the length that each nonterminal expands to, and the
remaining symbols. Pairs never reach over the end of a document, so that a
document, or a stretch of it, is decoded from its own symbols alone: the
lengths tell which symbols to skip.

Each round replaces all pairs that can be used ``LEAST_USES`` times together
(the textbook form takes one pair a round). Where two of them overlap the one
with more uses wins; the others are counted again in the next round, with the
pairs next to new symbols, until no pair is left.

Layout: one Parquet row for each shard, its ``payload`` little-endian:
``RPG1``, four uint32 (documents, rules, symbols, first nonterminal), then
uint32 arrays: rule pairs, expansion lengths, symbols of each document, tokens
of each document; then the symbols' lower 16 bits and, unless ``first + rules``
fits in these, a byte each with the upper ones (uint32 if that isn't enough).

Null texts count as empty and hold the end id alone. A null document id sorts
last; rows with equal ids are ordered by their first 64 bytes and a hash, and
may fall into several shards. Repeated rows are stored each. An empty table
makes no shard. A text longer than a shard is a shard of its own. Other columns
are not read, so their names cannot clash.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.chunk_table import ChunkTable
from sparkloom.llm.chunks import IRREGULAR, whole_chunks
from sparkloom.llm.common import fresh_path, map_batches, utf8

#: Chunks that a worker keeps at most, about 80 bytes each.
CACHE_CHUNKS = 1_000_000
#: Bytes of text that are encoded together.
TOGETHER = 1 << 19
#: A shard is closed once it holds so many ids.
SHARD_TOKENS = 1_000_000
#: The least uses of a pair that is replaced.
LEAST_USES = 8
_BUCKETS = 1 << 19


@dataclass
class Shard:
    rules: np.ndarray  # (n, 2)
    lengths: np.ndarray  # of what each nonterminal expands to
    symbols: np.ndarray
    doc_symbols: np.ndarray
    doc_tokens: np.ndarray
    first: int  # the first nonterminal


def _bucket(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left * np.uint32(2654435761)) ^ (right * np.uint32(2246822519))) >> np.uint32(13)


def _chosen(joined: np.ndarray) -> np.ndarray:
    """Of places in order, the mask of a maximal set without neighbours, the left one first; ``joined`` tells which begin where the one before ends."""
    n = len(joined) + 1
    start = np.maximum.accumulate(np.where(np.r_[True, ~joined], np.arange(n), 0)) if n > 1 else np.zeros(n, np.int64)
    return (np.arange(n) - start) % 2 == 0


def _sorted_order(left: np.ndarray, right: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """What sorts the codes; where codes and places fit in 64 bits they are sorted together, which is faster."""
    bits, place = int(max(left.max(), right.max())).bit_length(), len(codes).bit_length()
    if 2 * bits + place > 64:
        return np.argsort(codes, kind="stable")
    keys = (left.astype(np.uint64) << np.uint64(bits + place)) | (right.astype(np.uint64) << np.uint64(place)) | np.arange(len(codes), dtype=np.uint64)
    keys.sort()
    return (keys & np.uint64((1 << place) - 1)).astype(np.int64)


def frequent_pairs(symbols: np.ndarray, follower: np.ndarray, live: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs at the sorted places ``live`` that can be replaced ``least`` times: their codes by ascending uses, and each such place with the number of its pair."""
    left, right = symbols[live], symbols[follower[live]]
    if len(live) > _BUCKETS // 8:
        bucket = _bucket(left, right)
        likely = (np.bincount(bucket, minlength=_BUCKETS) >= least)[bucket]
        live, left, right = live[likely], left[likely], right[likely]
    codes = (left.astype(np.uint64) << np.uint64(32)) | right
    if not len(codes):
        return codes, live, live
    once = np.ones(len(live), np.int64)  # of a symbol that repeats, every other pair can be replaced
    double = np.flatnonzero(left == right)
    if len(double):
        places = live[double]
        once[double[~_chosen(follower[places[:-1]] == places[1:])]] = 0
    order = _sorted_order(left, right, codes)
    codes, once = codes[order], once[order]
    begins = np.r_[True, codes[1:] != codes[:-1]]
    starts = np.flatnonzero(begins)
    n = np.add.reduceat(once, starts)
    keep = np.flatnonzero(n >= least)
    keep = keep[np.argsort(n[keep], kind="stable")]
    number = np.full(len(starts), -1, np.int64)
    number[keep] = np.arange(len(keep))
    pair = np.empty(len(live), np.int64)
    pair[order] = number[np.cumsum(begins) - 1]
    found = pair >= 0
    return codes[starts[keep]], live[found], pair[found]


def compress(tokens: np.ndarray, doc_tokens: np.ndarray, first: int, least: int = LEAST_USES) -> Shard:
    """Re-Pair over one shard of ids, all below ``first``, until no pair can be replaced ``least`` times.

    Symbols keep their places and are linked, so a round only touches pairs
    beside new symbols and frequent pairs that stayed.
    """
    n = len(tokens)
    symbols = np.append(tokens, 0).astype(np.uint32)
    last, gone, marked = np.zeros(n + 1, bool), np.zeros(n, bool), np.zeros(n + 1, bool)
    last[np.cumsum(doc_tokens) - 1] = True
    follower, leader = np.arange(1, n + 2), np.arange(-1, n)
    rules, sizes, known = [np.zeros((0, 2), np.uint32)], [np.zeros(0, np.uint32)], first
    size = np.ones(first, np.uint32)
    live = np.flatnonzero(~last[:n])
    while len(live):
        codes, at, rule = frequent_pairs(symbols, follower, live, least)
        if not len(codes):
            break
        # Of places that overlap, the pair with more uses wins; so the first pair is always replaced wherever it can be.
        beside = follower[at[:-1]] == at[1:]
        wins = np.ones(len(at), bool)
        wins[1:] &= ~(beside & (rule[1:] < rule[:-1]))
        wins[:-1] &= ~(beside & (rule[:-1] < rule[1:]))
        pick = np.flatnonzero(wins)
        pick = pick[_chosen(follower[at[pick[:-1]]] == at[pick[1:]])]
        uses = np.bincount(rule[pick], minlength=len(codes))
        pick = pick[(uses >= least)[rule[pick]]]
        used = np.flatnonzero(uses >= least)
        number = np.zeros(len(codes), np.uint32)
        number[used] = known + np.arange(len(used))
        known += len(used)
        new = np.stack([codes[used] >> np.uint64(32), codes[used] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        rules.append(new)
        sizes.append(size[new[:, 0]] + size[new[:, 1]])
        size = np.concatenate([size, sizes[-1]])
        marked[at] = True
        places = at[pick]
        symbols[places] = number[rule[pick]]
        after = follower[places]
        last[places] = last[after]
        gone[after] = True
        beyond = follower[after]
        follower[places] = beyond
        inside = beyond <= n - 1
        leader[beyond[inside]] = places[inside]
        before = leader[places]
        marked[before[before >= 0]] = True
        live = np.flatnonzero(marked)
        marked[live] = False
        live = live[~last[live] & ~gone[live]]
    kept = np.flatnonzero(~gone)
    ends = np.flatnonzero(last[kept])
    return Shard(np.concatenate(rules), np.concatenate(sizes), symbols[kept], np.diff(np.r_[-1, ends]).astype(np.uint32), doc_tokens.astype(np.uint32), first)


def _width(top: int) -> tuple[str, ...]:
    """The arrays that hold symbols below ``top``: the lower bits and, if need be, the bits above."""
    return ("<u2",) if top <= 1 << 16 else ("<u2", "<u1") if top <= 1 << 24 else ("<u4",)


def pack(shard: Shard) -> bytes:
    top = shard.first + len(shard.rules)
    head = struct.pack("<4s4I", b"RPG1", len(shard.doc_tokens), len(shard.rules), len(shard.symbols), shard.first)
    arrays = [shard.rules, shard.lengths, shard.doc_symbols, shard.doc_tokens]
    body = [(shard.symbols >> np.uint32(16 * k)).astype(kind).tobytes() for k, kind in enumerate(_width(top))]
    return b"".join([head, *(a.astype("<u4").tobytes() for a in arrays), *body])


def unpack(payload: bytes) -> Shard:
    mark, docs, rules, symbols, first = struct.unpack_from("<4s4I", payload)
    if mark != b"RPG1":
        raise ValueError("not a token shard")
    at, parts = 20, []
    for n in (2 * rules, rules, docs, docs):
        parts.append(np.frombuffer(payload, "<u4", n, at))
        at += 4 * n
    body = np.zeros(symbols, np.uint32)
    for k, kind in enumerate(_width(first + rules)):
        body |= np.frombuffer(payload, kind, symbols, at).astype(np.uint32) << np.uint32(16 * k)
        at += symbols * np.dtype(kind).itemsize
    return Shard(parts[0].reshape(-1, 2), parts[1], body, parts[2], parts[3], first)


class Expander:
    """Expands symbols of one shard."""

    def __init__(self, shard: Shard):
        self.first = shard.first
        self.length = np.concatenate([np.ones(shard.first, np.int64), shard.lengths.astype(np.int64)])
        self.start = np.concatenate([np.arange(shard.first), shard.first + np.cumsum(shard.lengths, dtype=np.int64) - shard.lengths])
        self.flat = np.zeros(shard.first + int(shard.lengths.sum()), np.uint32)
        self.flat[: shard.first] = np.arange(shard.first)
        rules = shard.rules.astype(np.int64)
        # A nonterminal's level is above those of its parts; all of one level are expanded together.
        level = np.zeros(shard.first + len(rules), np.int64)
        level[shard.first :] = 1
        while len(rules):
            above = level[rules].max(axis=1) + 1
            if (above == level[shard.first :]).all():
                break
            level[shard.first :] = above
        order = np.argsort(level[shard.first :], kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(level[shard.first + order])) + 1):
            parts = rules[own].reshape(-1)
            n = self.length[parts]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            to = np.repeat(np.stack([self.start[shard.first + own], self.start[shard.first + own] + n[::2]], axis=1).reshape(-1), n) + inside
            self.flat[to] = self.flat[np.repeat(self.start[parts], n) + inside]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.length[symbols]
        ends = np.cumsum(n)
        offset = np.repeat(self.start[symbols] - (ends - n), n)
        return self.flat[offset + np.arange(len(offset))]

    def between(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop`` of what the symbols expand to, expanding no others."""
        ends = np.cumsum(self.length[symbols])
        low, high = np.searchsorted(ends, [start, stop - 1], "right")
        before = int(ends[low - 1]) if low else 0
        return self.expand(symbols[low : high + 1])[start - before : stop - before]


class Encoder:
    """A worker's tokenizer with its table of chunks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # what gets here is in no cache, so its own would only be filled in vain
        self.first_free = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = ChunkTable(self.fresh_chunks, CACHE_CHUNKS)
        space, line = (self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in " \n")
        self.opening = np.zeros(self.first_free, bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.opening[number] = token.startswith(space) or token == line

    def fresh_together(self, keys: list[bytes]) -> list[bytes]:
        """The ids of each chunk, from one text: only the first token of a chunk begins with a space or is a line end."""
        text = whole_chunks(keys).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        starts = np.flatnonzero(self.opening[ids])
        if len(starts) != len(keys):
            return self.fresh([whole_chunks([k]).decode() for k in keys])
        raw, cuts = ids.tobytes(), (4 * np.r_[starts, len(ids)]).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def fresh_chunks(self, keys: list[bytes]) -> list[bytes]:
        """The ids of each chunk; those that begin a text have no space or line end before them."""
        opens = [key[:1] not in (b" ", b"\n") for key in keys]
        first = iter(self.fresh([key.decode() for key, own in zip(keys, opens) if own]))
        rest = [key.removeprefix(b" ") for key, own in zip(keys, opens) if not own]
        later = iter(self.fresh_together(rest) if rest else [])
        return [next(first) if own else next(later) for own in opens]

    def fresh(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as 4-byte integers; what no cache holds is encoded together."""
        odd = [any(s in text for s in self.special) or IRREGULAR.search(text) is not None for text in texts]
        plain = iter(self.table.encode([text for text, own in zip(texts, odd) if not own]))
        return [self.fresh([text.decode()])[0] if own else next(plain) for text, own in zip(texts, odd)]


#: Of this worker process: it outlives tasks.
_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


FILE_SCHEMA = "part int, seq int, first_token long, n_tokens long, doc_ids array<long>, payload binary"


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str, end_id: int, text: str = "text", id_column: str = "doc_id", shard_tokens: int = SHARD_TOKENS) -> None:
    """Write all texts as shards under ``out``; part and seq give the shards' order, first_token counts within a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = worker_encoder(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        ids, found, sizes, seq, done, held = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            shard = compress(np.frombuffer(b"".join(found), "<u4"), np.array(sizes, np.int64), encoder.first_free)
            values = ([part], [seq], [done], [held], [ids], [pack(shard)])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], [x.split()[0] for x in FILE_SCHEMA.split(", ")])

        def groups() -> Iterator[tuple[list[int | None], list[bytes]]]:
            """Documents that are encoded together."""
            names, bodies, size = [], [], 0
            for batch in batches:
                for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                    names.append(doc_id)
                    bodies.append(body.as_py())
                    size += len(bodies[-1])
                    if size >= TOGETHER:
                        yield names, bodies
                        names, bodies, size = [], [], 0
            yield names, bodies

        for names, bodies in groups():
            for doc_id, raw in zip(names, encoder.encode(bodies)):
                ids.append(doc_id)
                found.append(raw + end)
                sizes.append(len(raw) // 4 + 1)
                held += sizes[-1]
                if held >= shard_tokens:
                    yield close()
                    ids, found, sizes, seq, done, held = [], [], [], seq + 1, done + held, 0
        if ids:
            yield close()

    ordered = docs.select(F.col(id_column).cast("long").alias("id"), utf8(text).alias("body"))
    # By more than the id, so that many rows without one, or with one id, are not one range.
    order = (F.col("id").asc_nulls_last(), F.substring("body", 1, 64), F.xxhash64("body"))
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, FILE_SCHEMA).write.parquet(out)


def with_starts(files: DataFrame) -> DataFrame:
    """Shards with ``start``, the ids in all shards before.

    The offsets of the parts are broadcast: a row for each partition that was
    written, however many documents and shards it holds.
    """
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = files.join(F.broadcast(base), "part")
    return joined.select("doc_ids", (F.col("base") + F.col("first_token")).cast("long").alias("start"), "payload")


def shard_documents(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """The id, start and token ids of each document of the shards of ``with_starts``."""
    for ids, start, payload in zip(*batch.columns):
        shard = unpack(payload.as_py())
        tokens = Expander(shard).expand(shard.symbols)
        ends = np.cumsum(shard.doc_tokens.astype(np.int64))
        for doc_id, size, end in zip(ids.as_py(), shard.doc_tokens.tolist(), ends.tolist()):
            yield doc_id, start.as_py() + end - size, tokens[end - size : end]


def read_token_files(files: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The id, ``start`` (ids of all documents before) and ``ids`` of each document of the shards."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(batch.num_rows):
            ids, starts, tokens = zip(*shard_documents(batch.slice(k, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array([t.astype(np.int32) for t in tokens], pa.list_(pa.int32()))], [id_column, "start", "ids"])

    return map_batches(with_starts(files), run, f"`{id_column}` long, start long, ids array<int>")


def token_file_digests(files: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The id, start, n_tokens and ids_crc32 of each document, from what the shards hold."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(batch.num_rows):
            rows = [(i, at, len(t), zlib.crc32(t.astype("<u4").tobytes())) for i, at, t in shard_documents(batch.slice(k, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [id_column, "start", "n_tokens", "ids_crc32"])

    return map_batches(with_starts(files), run, f"`{id_column}` long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Write the shards to the shared folder and return them as read back."""
    path = fresh_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id, text, id_column)
    return docs.sparkSession.read.schema(FILE_SCHEMA).parquet(path)
