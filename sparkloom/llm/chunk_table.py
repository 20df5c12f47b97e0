"""A worker's table of token ids by chunk, looked up for many texts at once.

Chunks are those of ``chunks``, each with the space before it. They are hashed
from running sums over the bytes of all texts, found in an open table, and
compared byte by byte with the keys found, so equal hashes only cost time.
Everything is in flat arrays: a few passes over a batch instead of a dictionary
access for each word, and less memory for each key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from sparkloom.llm.chunks import LONGEST

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all stretches, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Flat:
    """Stretches of one growing array."""

    def __init__(self, kind):
        self.data, self.starts, self.lengths = np.zeros(1 << 16, kind), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = self.n = 0

    def add(self, data: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(data) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while self.n + len(lengths) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lengths))
        self.data[self.used : self.used + len(data)] = data
        self.starts[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.n : self.n + len(lengths)] = lengths
        self.used, self.n = self.used + len(data), self.n + len(lengths)

    def cut(self, n: int) -> None:
        self.used, self.n = int(self.starts[n]) if n < self.n else self.used, n


class ChunkTable:
    """The ids that ``encode_many`` gives for a chunk, kept for up to ``limit`` chunks; then the later half is forgotten."""

    def __init__(self, encode_many: Callable[[list[bytes]], list[bytes]], limit: int):
        self.encode_many, self.limit = encode_many, limit
        self.bits = max(4, (4 * limit).bit_length())
        self.keys, self.ids, self.hashes = _Flat(np.uint8), _Flat(np.uint32), np.zeros(1 << 12, np.uint64)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.up, self.down = _powers(_FACTOR, 1 << 12), _powers(_INVERSE, 1 << 12)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) > len(self.up):
            self.up, self.down = (_powers(base, 2 * len(data)) for base in (_FACTOR, _INVERSE))
        sums = np.zeros(len(data) + 1, np.uint64)
        # A byte counts one more than it is, so that lengths matter.
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        found = (sums[ends] - sums[starts]) * self.down[starts]
        return (found ^ (found >> np.uint64(32))) * np.uint64(_FACTOR)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def _found(self, hashes: np.ndarray) -> np.ndarray:
        """The first entry with each hash, or -1."""
        out, at, left = np.full(len(hashes), -1, np.int64), self._slot(hashes), np.arange(len(hashes))
        while len(left):
            entry = self.slots[at]
            same = (entry >= 0) & (self.hashes[entry] == hashes[left])
            out[left[same]] = entry[same]
            on = (entry >= 0) & ~same
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _place(self, first: int, last: int) -> None:
        entries = np.arange(first, last, dtype=np.int32)
        at = self._slot(self.hashes[first:last])
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]
            on = self.slots[at] != entries
            entries, at = entries[on], (at[on] + 1) & ((1 << self.bits) - 1)

    def _keep(self, hashes: np.ndarray) -> None:
        """Put the last entries of the flat arrays, whose hashes these are, into the table."""
        last = self.keys.n
        first = last - len(hashes)
        while last > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[first:last] = hashes
        self._place(first, last)

    def _forget(self) -> None:
        for flat in (self.keys, self.ids):
            flat.cut(self.limit // 2)
        self.slots[:] = -1
        self._place(0, self.keys.n)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as 4-byte integers."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = b"".join(texts)
        if not raw:
            return [b""] * len(texts)
        data = np.frombuffer(raw, np.uint8)
        begins = (data == 32) | (data == 10)
        offsets = np.cumsum(sizes) - sizes
        begins[offsets[sizes > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        hashes = self._hashes(data, starts, ends)
        entries = self._found(hashes)
        held = np.flatnonzero(entries >= 0)
        same = self.keys.lengths[entries[held]] == ends[held] - starts[held]
        entries[held[~same]] = -1
        held = held[same]
        lengths = ends[held] - starts[held]
        differ = self.keys.data[_stretches(self.keys.starts[entries[held]], lengths)] != data[_stretches(starts[held], lengths)]
        if differ.any():
            entries[held[np.unique(np.searchsorted(np.cumsum(lengths), np.flatnonzero(differ), "right"))]] = -1
        kept = self.keys.n
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            number: dict[bytes, int] = {}
            own = [number.setdefault(raw[a:b], len(number)) for a, b in zip(starts[missing].tolist(), ends[missing].tolist())]
            new = list(number)
            answers = self.encode_many(new)
            size = np.fromiter(map(len, new), np.int64, len(new))
            # What is not kept comes last and is only used now: long chunks, and those beyond the limit.
            brief = size <= LONGEST
            stays = brief & (np.cumsum(brief) <= self.limit - kept)
            order = np.argsort(~stays, kind="stable")
            place = np.empty(len(new), np.int64)
            place[order] = kept + np.arange(len(new))
            own = np.array(own)
            entries[missing] = place[own]
            first = np.empty(len(new), np.int64)
            first[own[::-1]] = missing[::-1]
            short = order[: int(stays.sum())]
            chosen, made = (new, answers) if stays.all() else ([new[k] for k in short], [answers[k] for k in order])
            self.keys.add(np.frombuffer(b"".join(chosen), np.uint8), size[short])
            self.ids.add(np.frombuffer(b"".join(made), "<u4"), np.fromiter(map(len, made), np.int64, len(made)) // 4)
            self._keep(hashes[first[short]])
        n = self.ids.lengths[entries]
        flat = self.ids.data[_stretches(self.ids.starts[entries], n)].astype("<u4").tobytes()
        before = np.r_[0, np.cumsum(n)]
        cuts = (4 * before[np.searchsorted(starts, np.append(offsets, len(data)))]).tolist()
        self.ids.cut(self.keys.n)
        if self.keys.n == self.limit:
            self._forget()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]
