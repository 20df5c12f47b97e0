"""Byte-level BPE as a finite-state transducer.

The merge ranks are compiled into a transducer that reads one byte at a time.
After any prefix of a pre-token, exactly one token can end there in the
encoding of that prefix; the transducer outputs it with each byte. A *thread*
follows each earlier boundary from which a longer token may still be running
(no thread outlives the longest token, so lookahead is bounded). Once a single
thread is left, the tokens before it can no longer change: they are read off
backwards from the outputs and emitted. A set of threads is a state of the
determinised transducer; states and transitions are made when they are first
needed and then looked up.

Decoding is a stream too: token bytes go through an incremental UTF-8 state
machine that holds back an unfinished character until its last byte arrives.

Nulls count as empty and give no tokens. Repeated rows give equal results; an
empty table gives no rows. Very long words run through the transducer like any
other, in linear time, and its tables stay bounded while they do. Only the text
and the id are read, whatever else the table has.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.chunks import LONGEST, WorkerCache, split_chunks, whole_chunks
from sparkloom.llm.common import kept_by, map_batches, utf8

#: Entries that a worker keeps at most.
CACHE_CHUNKS, CACHE_PIECES = 400_000, 200_000
#: Rows that are given back at once.
ROWS_OUT = 256
#: States, transitions and checked pairs kept at most; beyond that the tables start anew, also in the middle of a piece.
MOST_STATES, MOST_STEPS, MOST_PAIRS = 150_000, 600_000, 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of a short piece by repeated merging of the lowest rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], len(ranks) + 1))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class MergeTransducer:
    """Encodes pre-tokens byte by byte.

    A state is a tuple of threads; a thread is (bytes since its boundary, the
    token that ends at the boundary or -1 at the start).
    """

    def __init__(self, ranks: dict[bytes, int], scale: float = 1.0):
        self.ranks = ranks
        self.most_states, self.most_steps, self.most_pairs = int(MOST_STATES * scale), int(MOST_STEPS * scale), int(MOST_PAIRS * scale)
        self.text = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        #: By itself, so that all states share one copy.
        self.open = {start: start for token in ranks for start in (token[:n] for n in range(1, len(token)))}
        #: By left + 1 in the upper bits and right in the lower 32.
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((b"", -1),)
        self.states, self.ids = [start], {start: 0}
        #: By 256 * state + byte: 256 * next state, the token that ends here, whether all before is settled.
        self.steps: dict[int, tuple[int, int, bool]] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens may stand next to each other in an encoding; left may be the start, -1."""
        key = (left + 1) << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            pair = [right] if left < 0 else [left, right]
            found = merge_by_rank(b"".join(self.text[t] for t in pair), self.ranks) == pair
            self.pairs[key] = found
        return found

    def follow(self, at: int) -> tuple[int, int, bool]:
        """Make the transition for 256 * state + byte."""
        live, ended = [], -1
        byte = bytes((at & 255,))
        for tail, last in self.states[at >> 8]:
            longer = tail + byte
            token = self.ranks.get(longer)
            if token is not None and ended < 0 and self.fits(last, token):
                ended = token
            if (shared := self.open.get(longer)) is not None:
                live.append((shared, last))
        self.steps[at] = made = (self.numbered((*live, (b"", ended))) << 8, ended, not live)
        return made

    def numbered(self, key: tuple) -> int:
        state = self.ids.setdefault(key, len(self.states))
        if state == len(self.states):
            self.states.append(key)
        return state

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        find, state, ends, tokens = self.steps.get, 0, [], []
        for byte in piece:
            step = find(state | byte)
            if step is None:
                if len(self.states) >= self.most_states or len(self.steps) >= self.most_steps:
                    held = self.states[state >> 8]
                    self.reset()
                    find, state = self.steps.get, self.numbered(held) << 8
                step = self.follow(state | byte)
            state, token, settled = step
            ends.append(token)
            if settled and len(ends) >= 64:
                tokens += self.settle(ends)
                ends = []
        return tokens + self.settle(ends) if tokens else self.settle(ends)

    def settle(self, ends: list[int]) -> list[int]:
        """The tokens of the bytes since the last settled boundary."""
        at, tokens = len(ends), []
        while at > 0:
            tokens.append(ends[at - 1])
            at -= self.size[tokens[-1]]
        return tokens[::-1]


class Utf8Machine:
    """Turns bytes that arrive in any pieces into whole characters.

    The state is the unfinished character so far: how many bytes it needs is
    known from its first one.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character without ending it."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                need = 1 + (byte >= 0xC0) + (byte >= 0xE0) + (byte >= 0xF0)
                return back if back < need else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """A worker's transducer, its chunk caches and its decoder; ``scale`` is applied to all that is kept."""

    def __init__(self, path: str, pattern: str, scale: float = 1.0):
        import regex

        self.find = regex.compile(pattern).findall
        self.transducer = MergeTransducer(read_ranks(path), scale)
        top = max(self.transducer.text) + 1
        self.bytes_of = [self.transducer.text.get(i, b"") for i in range(top)]
        self.decimal = [b"%d" % i for i in range(top)]
        self.first = WorkerCache(lambda keys: [self.fresh(k) for k in keys], int(CACHE_CHUNKS * scale) // 16)
        self.later = WorkerCache(lambda keys: [self.fresh(whole_chunks([k])) for k in keys], int(CACHE_CHUNKS * scale))
        self.pieces: dict[str, bytes] = {}
        self.most_pieces = int(CACHE_PIECES * scale)

    def piece(self, piece: str) -> bytes:
        """The ids as 4-byte integers, which take a third of a list's memory."""
        found = self.pieces.get(piece)
        if found is None:
            found = array("I", self.transducer.encode(piece.encode())).tobytes()
            if len(self.pieces) < self.most_pieces and len(piece) < LONGEST:
                self.pieces[piece] = found
        return found

    def fresh(self, text: bytes) -> bytes:
        """The ids as 4-byte integers."""
        return b"".join(map(self.piece, self.find(text.decode())))

    def encode(self, text: bytes) -> np.ndarray:
        chunks = split_chunks(text) if text else []
        if chunks is None:
            return np.frombuffer(self.fresh(text), "<u4")
        return np.frombuffer(b"".join(self.first.lookup(chunks[:1]) + self.later.lookup(chunks[1:])), "<u4")

    def decimals(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray, block: int = 8192) -> Iterator[str]:
        machine = Utf8Machine()
        for at in range(0, len(ids), block):
            yield machine.feed(b"".join(map(self.bytes_of.__getitem__, ids[at : at + block].tolist())))
        yield machine.finish()


#: The name by which workers keep codecs: they outlive tasks, but not this step.
KEPT = "byte bpe"


def worker_codec(path: str, pattern: str, scale: float = 1.0) -> Codec:
    codecs = kept_by(KEPT)
    if (path, pattern, scale) not in codecs:
        codecs[path, pattern, scale] = Codec(path, pattern, scale)
    return codecs[path, pattern, scale]


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The id and ``ids`` (array of int) of each row."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path, pattern)
        ids = pa.array([codec.encode(v.as_py()).astype(np.int32) for v in batch.column(1)], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(docs.select(id_column, utf8(text)), run, f"`{id_column}` {kind}, ids array<int>", KEPT)


def decode_ids(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", id_column: str = "doc_id") -> DataFrame:
    """The id and ``text`` of each row of token ids; null counts as none."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path, pattern)
        texts = pa.array(["".join(codec.decode(np.array(v.as_py() or [], np.int64))) for v in batch.column(1)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], [id_column, "text"])

    kind = tokens.schema[id_column].dataType.simpleString()
    return map_batches(tokens.select(id_column, F.col(ids).cast("array<int>")), run, f"`{id_column}` {kind}, text string", KEPT)


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def encoding_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", id_column: str = "doc_id", with_ids: bool = False, cache_scale: float = 1.0) -> DataFrame:
    """The id and, for each row, digests of its ids and of what they decode to; the ids too if asked for."""

    names = [id_column, *(x.split()[0] for x in DIGESTS.split(", ")), *(["ids"] if with_ids else [])]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path, pattern, cache_scale)
        for at in range(0, batch.num_rows, ROWS_OUT):  # so that few rows' ids are held at once
            part, rows, tokens = batch.slice(at, ROWS_OUT), [], []
            for value in part.column(1):
                body = value.as_py()
                ids = codec.encode(body)
                decoded = hashlib.sha256()
                for piece in codec.decode(ids):
                    decoded.update(piece.encode())
                digest = decoded.hexdigest()
                rows.append((len(ids), hashlib.sha256(codec.decimals(ids)).hexdigest(), digest, digest == hashlib.sha256(body).hexdigest()))
                if with_ids:
                    tokens.append(ids)
            columns = [part.column(0), *map(pa.array, zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.bool_()))]
            if with_ids:
                ends = np.cumsum([0, *map(len, tokens)])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(docs.select(id_column, utf8(text)), run, f"`{id_column}` {kind}, {DIGESTS}" + ", ids array<int>" * with_ids, KEPT)
