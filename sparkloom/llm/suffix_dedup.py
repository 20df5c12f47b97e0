"""Removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. Sorting all suffixes would move every position, so
positions enter in buckets that get finer only where they are still shared:

1. Texts that are equal are one text, owned by their smallest id.
2. Every window of 50 bytes is represented by the smallest hash of its 24-byte
   grams (its anchor; equal windows have equal anchors). Anchors are dealt into
   buckets by hash, and an anchor that occurs in one text only is resolved.
3. For the anchors left, the stretch of text whose windows share the anchor
   meets the other stretches of that anchor. Equal stretches are one class, so
   all but the one with the smallest id are resolved at once.
4. Where classes differ, their suffixes are put in buckets by their first 8
   bytes, and each bucket is sorted by the bucket numbers at the offset up to
   which its suffixes are known to agree. New numbers are used at once by the
   buckets that follow, and buckets are refined again until they agree in 50
   bytes or have one member. Neighbours are then compared byte by byte.

Mappers work in blocks: whatever occurs often in a block is settled there and
sent on once, so a passage that a third of all documents share reaches its
bucket once for each block of text, not once for each document. Where such a
passage begins and ends the stretches differ in each document. An anchor that
is frequent in some block, or in its bucket, is therefore *hot*: its stretches
are not sent to one bucket, but their windows to buckets by their digests,
again once for each block.

Null texts count as empty. A null id counts as larger than any other. Rows with
equal ids do not remove each other's bytes; repeated rows get equal results.
Texts below 50 bytes are kept whole, very long ones are hashed in pieces. An
empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, map_batches, utf8

LENGTH, GRAM = 50, 24
#: Bytes that are hashed at once, anchors that a block holds, anchors in a bucket, contexts (bytes) refined at once.
PIECE, BLOCK_ANCHORS, BUCKET_ANCHORS, REFINED = 1 << 18, 1_500_000, 1_600_000, 1 << 21
LEAST_BUCKETS = 40
#: Texts that may share an anchor in its bucket before it is hot; in a block it is between the other two, less where
#: there are many blocks to come from.
HOT_IN_BUCKET, LEAST_HOT, MOST_HOT = 20_000, 16, 256
#: Level at which zstandard packs what is shuffled.
PACKING = 3
NO_ID = (1 << 63) - 1


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A mixed 64-bit hash of the bytes from each position; by doubling, from polynomial hashes of 1, 2, 4 and more bytes."""
    base = 6364136223846793005
    part, length, done, out = data.astype(np.uint64) + np.uint64(1), 1, 0, None
    n = len(data) - size + 1
    while True:
        if size & length:
            piece = part[done : done + n]
            out = piece.copy() if out is None else out * np.uint64(pow(base, length, 1 << 64)) + piece
            done += length
        if done == size:
            break
        part = part[:-length] * np.uint64(pow(base, length, 1 << 64)) + part[length:]
        length *= 2
    return mix(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchor_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the text's number, first window, windows in the run, anchor.

    Texts are hashed together in pieces of about ``PIECE`` bytes; long ones are
    cut into overlapping pieces, at which a run may be cut as well.
    """
    found: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        sizes = np.array([len(p) for _, _, p in held])
        data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        anchors = sliding_minimum(gram_hashes(data), LENGTH - GRAM + 1)
        ends = np.cumsum(sizes)
        which = np.repeat(np.arange(len(held)), sizes)[: len(anchors)]
        inside = np.flatnonzero(np.arange(len(anchors)) + LENGTH <= ends[which])
        which, anchors = which[inside], anchors[inside]
        first = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (anchors[1:] != anchors[:-1])])
        number, offset = np.array([n for n, _, _ in held]), np.array([o for _, o, _ in held])
        at = inside[first] - (ends - sizes)[which[first]] + offset[which[first]]
        found.append((number[which[first]], at, np.diff(np.r_[first, len(which)]), mix(anchors[first])))
        held.clear()

    waiting = 0
    for number, text in enumerate(texts):
        for start in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
            piece = text[start : start + PIECE + LENGTH - 1]
            held.append((number, start, piece))
            waiting += len(piece)
            if waiting >= PIECE:
                flush()
                waiting = 0
    if held:
        flush()
    if not found:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*found))


def _spread(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket << 32 | hash within it."""
    return ((anchors >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (anchors & np.uint64(0xFFFFFFFF))


def _rows(columns: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _groups(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    begins = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, np.int64)
    return begins, np.r_[begins[1:], len(sorted_values)]


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def _table(texts: np.ndarray, owners: np.ndarray) -> tuple[bytes, bytes]:
    """The texts that own something, and the owners as numbers in that table."""
    used, local = np.unique(owners, return_inverse=True)
    return texts[used].tobytes(), local.astype("<u2" if len(used) <= 1 << 16 else "<u4").tobytes()


def _owners(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


def deal_anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """From (text key, text): a row for each bucket and block, with the block's texts and (hash, text) entries.

    A hash that is hot in the block has one entry and is listed under ``many``;
    all its texts are told so by a row of a negative bucket, with whole keys.
    """
    texts: dict[int, int] = {}
    keys, owners, held = [], [], 0
    hot_in_block = max(LEAST_HOT, min(MOST_HOT, 16 * HOT_IN_BUCKET // buckets))

    def close() -> pa.RecordBatch:
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        begins, ends = _groups(key)
        often = np.repeat(ends - begins > hot_in_block, ends - begins)
        first = np.zeros(len(key), bool)
        first[begins] = True
        table = np.array(list(texts), np.int64)
        rows = []
        if often.any():
            names, local = _table(table, owner[often])
            rows.append((-1 - int(table[0]) % buckets, names, key[often].tobytes(), local, None))
        many = key[often & first]
        key, owner = key[first | ~often], owner[first | ~often]
        bucket, many_bucket = (key >> np.uint64(32)).astype(np.int64), (many >> np.uint64(32)).astype(np.int64)
        for a, b in zip(*_groups(bucket)):
            names, local = _table(table, owner[a:b])
            low, high = np.searchsorted(many_bucket, [bucket[a], bucket[a] + 1])
            rows.append((bucket[a], names, key[a:b].astype("<u4").tobytes(), local, many[low:high].astype("<u4").tobytes()))
        return _rows(list(zip(*rows)), [pa.int64(), *[pa.binary()] * 4], ["bucket", "texts", "hashes", "owners", "many"])

    for batch in batches:
        names, bodies = [], []
        for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            if key not in texts:
                texts[key] = len(texts)
                names.append(texts[key])
                bodies.append(body.as_py())
        number, _, _, anchors = anchor_runs(bodies)
        if len(number):
            pairs = np.unique(np.stack([_spread(anchors, buckets), np.array(names, np.uint64)[number]], axis=1), axis=0)
            keys.append(pairs[:, 0])
            owners.append(pairs[:, 1].astype(np.int64))
            held += len(pairs)
        if held >= BLOCK_ANCHORS:
            yield close()
            texts, keys, owners, held = {}, [], [], 0
    if held:
        yield close()


def shared_anchors(rows: pd.DataFrame) -> pd.DataFrame:
    """For each text of a bucket, the hashes in it that another text has too, and the keys of those that are hot."""
    bucket = int(rows["bucket"].iloc[0])
    kind = "<u4" if bucket >= 0 else "<u8"
    table, all_hashes, all_owners, n = [], [], [], 0
    for texts, hashes, owners in zip(rows["texts"], rows["hashes"], rows["owners"]):
        all_hashes.append(np.frombuffer(hashes, kind))
        table.append(np.frombuffer(texts, np.int64))
        all_owners.append(_owners(owners, len(all_hashes[-1])) + n)
        n += len(table[-1])
    names, same = np.unique(np.concatenate(table), return_inverse=True)
    owner, h = same[np.concatenate(all_owners)], np.concatenate(all_hashes)
    if bucket < 0:
        order = np.argsort(owner, kind="stable")
        owner, h = owner[order], h[order]
        begins, ends = _groups(owner)
        found = [(names[owner[a]], -1, b"", h[a:b].tobytes()) for a, b in zip(begins, ends)]
        return pd.DataFrame(found, columns=["tid", "bucket", "hashes", "hot"])
    code = np.unique(h.astype(np.uint64) << np.uint64(32) | owner.astype(np.uint64))
    h = code >> np.uint64(32)
    begins, ends = _groups(h)
    many = np.unique(np.frombuffer(b"".join(rows["many"]), "<u4")).astype(np.uint64)
    hot = (ends - begins > HOT_IN_BUCKET) | _among(h[begins], many)
    keep = np.repeat(hot | (ends - begins > 1), ends - begins)
    code, hot = code[keep], np.repeat(hot, ends - begins)[keep]
    owner = (code & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    owner, h, hot = owner[order], code[order] >> np.uint64(32), hot[order]
    plain, whole = h.astype("<u4"), h | np.uint64(bucket << 32)
    begins, ends = _groups(owner)
    mixed = np.add.reduceat(hot, begins, dtype=np.int64) > 0 if len(begins) else np.zeros(0, bool)
    found = []
    for tid, a, b, some_hot in zip(names[owner[begins]].tolist(), begins.tolist(), ends.tolist(), mixed.tolist()):
        if some_hot:
            found.append((tid, bucket, plain[a:b][~hot[a:b]].tobytes(), whole[a:b][hot[a:b]].tobytes()))
        else:
            found.append((tid, bucket, plain[a:b].tobytes(), b""))
    return pd.DataFrame(found, columns=["tid", "bucket", "hashes", "hot"])


def _shared_keys(parts: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys of a text that others share, and those of them that are hot."""
    hot = np.sort(np.frombuffer(b"".join(p["hot"] for p in parts), "<u8"))
    plain = [np.uint64(p["bucket"] << 32) | np.frombuffer(p["hashes"], "<u4").astype(np.uint64) for p in parts if p["hashes"]]
    return np.sort(np.concatenate([*plain, hot])), hot


FIGURES = np.dtype([("key", "<u4"), ("size", "<u4"), ("start", "<i8"), ("tid", "<i8"), ("doc", "<i8")])
WINDOWS = np.dtype([("high", "<u8"), ("low", "<u8"), ("start", "<i8"), ("tid", "<i8"), ("doc", "<i8")])
#: Windows of hot anchors have buckets below this one, settled ranges those from it to -1.
_WINDOW_BUCKETS = -(1 << 40)


def _by_column(figures: np.ndarray) -> bytes:
    return b"".join(figures[name].tobytes() for name in figures.dtype.names)


def _columns(raw: bytes, kind: np.dtype) -> list[np.ndarray]:
    n, at, columns = len(raw) // kind.itemsize, 0, []
    for name in kind.names:
        columns.append(np.frombuffer(raw, kind[name], n, at))
        at += n * kind[name].itemsize
    return columns


def deal_contexts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """From (owner id, text key, packed text, shared anchors): stretches and windows to be compared, by bucket; settled ranges under negative buckets."""
    unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=PACKING)
    block: dict[tuple[bytes, int | None], list] = {}
    settled: dict[tuple[int, int], list[int]] = {}
    held = 0

    def windows() -> dict[int, list]:
        """Of the windows of hot stretches, those that no smaller id of the block has, by bucket; others are settled."""
        least: dict[bytes, list] = {}
        for (context, _), (doc, tid, starts, _, hot) in block.items():
            if hot:
                for k in range(len(context) - LENGTH + 1):
                    window = context[k : k + LENGTH]
                    entry = least.get(window)
                    if entry is None or doc < entry[0]:
                        for d, t, at in entry[1] if entry else ():
                            settled.setdefault((t, d), []).extend((at, at + LENGTH))
                        least[window] = entry = [doc, []]
                    for start in starts:
                        if doc == entry[0]:
                            entry[1].append((doc, tid, start + k))
                        else:
                            settled.setdefault((tid, doc), []).extend((start + k, start + k + LENGTH))
        out: dict[int, list] = {}
        for window, (_, entries) in least.items():
            digest = hashlib.blake2b(window, digest_size=16).digest()
            high, low = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
            out.setdefault(high % buckets, []).extend((high, low, start, tid, doc) for doc, tid, start in entries)
        return out

    def close() -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list] = {}
        rows = []
        for bucket, entries in windows().items():
            rows.append((_WINDOW_BUCKETS - 1 - bucket, None, None, pack.compress(_by_column(np.array(entries, WINDOWS))), None))
        for (context, _), (doc, tid, starts, key, hot) in block.items():
            if not hot:
                by_bucket.setdefault(key >> 32, []).extend((key & 0xFFFFFFFF, len(context), start, tid, doc, context) for start in starts)
        for bucket, entries in by_bucket.items():
            figures = np.array([e[:5] for e in entries], FIGURES)
            rows.append((bucket, None, None, pack.compress(_by_column(figures)), pack.compress(b"".join(e[5] for e in entries))))
        for (tid, doc), ranges in settled.items():
            rows.append((-1 - tid % buckets, tid, doc, np.array(ranges, np.int64).tobytes(), None))
        if rows:
            yield _rows(list(zip(*rows)), [pa.int64()] * 3 + [pa.binary()] * 2, ["bucket", "tid", "doc", "figures", "contexts"])

    def texts() -> Iterator[list[tuple[int, int, bytes, list]]]:
        """Texts that are hashed together."""
        group, size = [], 0
        for batch in batches:
            for doc, tid, packed, parts in zip(*(c.to_pylist() for c in batch.columns)):
                group.append((doc, tid, unpack.decompress(packed), parts))
                size += len(group[-1][2])
                if size >= PIECE:
                    yield group
                    group, size = [], 0
        yield group

    for group in texts():
        number, at, counts, anchors = anchor_runs([text for _, _, text, _ in group])
        keys = _spread(anchors, buckets)
        for a, b in zip(*_groups(number)):
            doc, tid, text, parts = group[number[a]]
            shared, hot = _shared_keys(parts)
            hit = np.flatnonzero(_among(keys[a:b], shared)) + a
            for start, n, k, is_hot in zip(at[hit].tolist(), counts[hit].tolist(), keys[hit].tolist(), _among(keys[hit], hot).tolist()):
                context = text[start : start + n + LENGTH - 1]
                entry = block.get((context, None))
                if entry is None:
                    block[context, None] = [doc, tid, [start], k, is_hot]
                    held += len(context) + 200
                elif doc > entry[0]:
                    settled.setdefault((tid, doc), []).extend((start, start + len(context)))
                elif doc < entry[0]:
                    for s in entry[2]:
                        settled.setdefault((entry[1], entry[0]), []).extend((s, s + len(context)))
                    block[context, None] = [doc, tid, [start], k, is_hot]
                elif tid == entry[1]:
                    entry[2].append(start)
                else:  # another text with the same id: neither is smaller
                    block.setdefault((context, tid), [doc, tid, [], k, is_hot])[2].append(start)
        if held >= 48 << 20:
            yield from close()
            block, settled, held = {}, {}, 0
    yield from close()


def refine(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bucket numbers of the ``LENGTH`` bytes from each start; equal numbers mean equal bytes.

    ``order`` holds the suffixes bucket by bucket; a bucket's number is the
    place where it begins, and ``depth`` of it the bytes in which its suffixes
    are known to agree.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    first = np.zeros(n, np.uint64)
    for k in range(8):
        first = first << np.uint64(8) | padded[k : k + n]
    order = np.argsort(first, kind="stable")
    begins, ends = _groups(first[order])
    number = np.full(n + 1, -1, np.int64)  # of the suffix at each place; -1 beyond the end
    number[order] = np.repeat(begins, ends - begins)
    depth = np.full(n, 8, np.int64)
    live = ends - begins > 1
    begins, ends = begins[live], ends[live]
    while len(begins):
        later = []
        # What one part of the buckets finds out is used by the next one.
        for part in np.array_split(np.arange(len(begins)), min(4, len(begins))):
            b, size = begins[part], (ends - begins)[part]
            places = np.repeat(b - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            suffix, known = order[places], np.repeat(depth[b], size)
            pointer = number[np.minimum(suffix + known, n)]
            reach = np.where(pointer < 0, LENGTH, known + depth[pointer])
            code = np.repeat(np.arange(len(b)), size) * np.int64(n + 1) + pointer + 1
            sort = np.argsort(code, kind="stable")
            suffix = suffix[sort]
            order[places] = suffix
            new, end = _groups(code[sort])
            fresh = places[new]
            number[suffix] = np.repeat(fresh, end - new)
            depth[fresh] = np.minimum(reach[sort[new]], LENGTH)
            again = (end - new > 1) & (depth[fresh] < LENGTH)
            later.append((fresh[again], fresh[again] + (end - new)[again]))
        begins, ends = (np.concatenate(x) for x in zip(*later))
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    ordered = order[wanted[order]]
    same = np.ones(max(len(ordered) - 1, 0), bool)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        word = first[ordered + k]
        same &= word[1:] == word[:-1]
    number[ordered] = np.cumsum(np.r_[0, ~same]) if len(ordered) else 0
    return number[starts]


def _ranges(owner: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """For each owner, start and end of the bytes that windows at the starts cover; sorted by owner and start."""
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (starts[1:] > starts[:-1] + LENGTH)])
    bounds = np.stack([starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]] + LENGTH], axis=1)
    for a, b in zip(*_groups(owner[new])):
        yield owner[new[a]], bounds[a:b].reshape(-1).tolist()


def _found(out: dict[tuple[int, int], list[int]]) -> pd.DataFrame:
    found = {"tid": [t for t, _ in out], "doc": [d for _, d in out], "ranges": [np.array(r, np.int64).tobytes() for r in out.values()]}
    return pd.DataFrame(found, columns=["tid", "doc", "ranges"])


def repeated_windows(rows: pd.DataFrame) -> pd.DataFrame:
    """For each text with windows in the bucket, those that a document with a smaller id has."""
    unpack = zstandard.ZstdDecompressor()
    high, low, start, tid, doc = (np.concatenate(c) for c in zip(*(_columns(unpack.decompress(f), WINDOWS) for f in rows["figures"])))
    order = np.lexsort((doc, low, high))
    high, low, start, tid, doc = (x[order] for x in (high, low, start, tid, doc))
    begins = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
    least = np.repeat(doc[begins], np.diff(np.r_[begins, len(doc)]))
    out: dict[tuple[int, int], list[int]] = {}
    for k in np.flatnonzero(doc > least).tolist():
        out.setdefault((int(tid[k]), int(doc[k])), []).extend((start[k], start[k] + LENGTH))
    return _found(out)


def repeated_ranges(rows: pd.DataFrame) -> pd.DataFrame:
    """For each text of a bucket, byte ranges that also start in a document with a smaller id."""
    if rows["bucket"].iloc[0] < _WINDOW_BUCKETS:
        return repeated_windows(rows)
    if rows["bucket"].iloc[0] < 0:
        return rows[["tid", "doc", "figures"]].astype({"tid": "int64", "doc": "int64"}).rename(columns={"figures": "ranges"})
    unpack = zstandard.ZstdDecompressor()
    stretches: dict[int, dict[bytes, list]] = {}
    for figures, packed in zip(rows["figures"], rows["contexts"]):
        body, at = unpack.decompress(packed), 0
        for key, size, start, tid, doc in zip(*(c.tolist() for c in _columns(unpack.decompress(figures), FIGURES))):
            stretches.setdefault(key, {}).setdefault(body[at : at + size], []).append((doc, start, tid))
            at += size
    out: dict[tuple[int, int], list[int]] = {}
    waiting: list[tuple[bytes, int, list]] = []
    size = 0

    def compare() -> None:
        data = np.frombuffer(b"".join(c for c, _, _ in waiting), np.uint8)
        sizes = np.array([len(c) for c, _, _ in waiting])
        offsets = np.cumsum(sizes) - sizes
        n = sizes - LENGTH + 1
        which = np.repeat(np.arange(len(waiting)), n)
        starts = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + offsets[which]
        bucket = refine(data, starts)
        doc = np.array([d for _, d, _ in waiting], np.int64)[which]
        least = np.full(bucket.max() + 1, NO_ID)
        np.minimum.at(least, bucket, doc)
        later = np.flatnonzero(least[bucket] < doc)
        if len(later):
            for k, local in _ranges(which[later], starts[later] - offsets[which[later]]):
                for doc_, start, tid in waiting[k][2]:
                    out.setdefault((tid, doc_), []).extend([start + x for x in local])
        waiting.clear()

    for classes in stretches.values():
        for context, entries in classes.items():
            least = min(entries)[0] if len(entries) > 1 else entries[0][0]
            for doc, start, tid in entries:
                if doc > least:
                    out.setdefault((tid, doc), []).extend((start, start + len(context)))
            if len(classes) > 1:
                waiting.append((context, least, [e for e in entries if e[0] == least]))
                size += len(context)
        if size >= REFINED:
            compare()
            size = 0
    if waiting:
        compare()
    return _found(out)


def cut_out(text: bytes, ranges: list[bytes]) -> tuple[int, int, bytes]:
    """How many bytes go, in how many runs, and what is left."""
    gone = np.frombuffer(b"".join(ranges), np.int64).reshape(-1, 2)
    gone = gone[np.argsort(gone[:, 0], kind="stable")]
    ends = np.maximum.accumulate(gone[:, 1])
    new = np.flatnonzero(np.r_[True, gone[1:, 0] > ends[:-1]])
    starts, ends = gone[new, 0].tolist(), ends[np.r_[new[1:] - 1, len(ends) - 1]].tolist()
    left = b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)]))
    return len(text) - len(left), len(starts), left


def _packed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=PACKING)
    yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([pack.compress(v.as_py()) for v in batch.column(2)], pa.binary())], ["doc", "tid", "packed"])


def _finished(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    unpack, out = zstandard.ZstdDecompressor(), []
    for body, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
        removed, spans, left = cut_out(unpack.decompress(body), parts)
        out.append((removed, spans, hashlib.sha256(left).hexdigest()))
    yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string())))], ["doc", "tid", "removed", "spans", "left"])


def _key(level: int):
    """A 64-bit key of a text, from its SHA-256."""
    return F.xxhash64(F.lit(level), "sha")


def text_keys(small: DataFrame, level: int = 0):
    """An expression for a key that is different for different ``sha`` in ``small``.

    Texts whose 64-bit keys collide get the key of the next level, until none
    do. Of n texts about n^2 / 2^65 are expected to collide; beyond 10,000 all
    texts go to the next level, so the list in the plan is bounded.
    """
    key = _key(level)
    while True:
        named = small.select("sha").distinct().withColumn("key", key)
        clash = cut(named.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
        level, n = level + 1, clash.count()
        if n == 0:
            return key
        if n > 10_000:
            key = _key(level)
        else:
            key = F.when(key.isin([r[0] for r in clash.collect()]), _key(level)).otherwise(key)


def removed_strings(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The id, n_bytes, n_removed, n_spans and kept_sha256 of each row.

    Equal texts are told by SHA-256; ``tid`` stands for it in what is shuffled.
    """
    owner = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))
    rows = docs.select(F.col(id_column).alias("id"), owner.alias("doc"), utf8(text).alias("body"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("body", 256)))
    small = cut(rows.select("id", "doc", "sha", F.octet_length("body").cast("long").alias("n_bytes")))
    tid = text_keys(small)
    rows = rows.withColumn("tid", tid)
    owners = small.groupBy("sha").agg(F.min("doc").alias("owner")).withColumn("tid", tid)
    total = small.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 2 * total // (LENGTH - GRAM + 2) // BUCKET_ANCHORS + 1)
    long_ = rows.where(F.octet_length("body") >= LENGTH)
    packed = map_batches(long_.select("doc", "tid", "body"), _packed, "doc long, tid long, packed binary")

    dealt = long_.select("tid", "body").mapInArrow(lambda b: deal_anchors(b, buckets), "bucket long, texts binary, hashes binary, owners binary, many binary")
    shared = dealt.groupBy("bucket").applyInPandas(shared_anchors, "tid long, bucket int, hashes binary, hot binary")
    wanted = shared.groupBy("tid").agg(F.collect_list(F.struct("bucket", "hashes", "hot")).alias("anchors")).join(owners.select("tid", "owner"), "tid").withColumnRenamed("tid", "key")
    met = packed.join(wanted, (packed["tid"] == wanted["key"]) & (packed["doc"] == wanted["owner"])).select("doc", "tid", "packed", "anchors")
    contexts = met.mapInArrow(lambda b: deal_contexts(b, buckets), "bucket long, tid long, doc long, figures binary, contexts binary")
    ranges = contexts.groupBy("bucket").applyInPandas(repeated_ranges, "tid long, doc long, ranges binary")
    ranges = cut(ranges.groupBy("tid", "doc").agg(F.collect_list("ranges").alias("ranges")))
    hit = packed.join(ranges, ["doc", "tid"]).select("doc", "tid", "packed", "ranges")
    # Rows with one id and one text are equal.
    results = map_batches(hit, _finished, "doc long, tid long, removed long, spans long, left string").dropDuplicates(["doc", "tid"])
    known = cut(owners.join(results, (owners["tid"] == results["tid"]) & (owners["owner"] == results["doc"]), "left").select("sha", "owner", "removed", "spans", "left"))
    every = small.join(known, "sha")
    copy = (F.col("doc") > F.col("owner")) & (F.col("n_bytes") >= LENGTH)
    return every.select(
        F.col("id").alias(id_column),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
