import random

import numpy as np
import pytest

from sparkloom.llm.chunk_table import ChunkTable
from sparkloom.llm.chunks import LONGEST


def _answer(key):
    return np.arange(len(key) % 5, dtype="<u4").tobytes() + key.rjust(4 * (len(key) // 4 + 1), b"\0")


def _chunks(text):
    parts = text.replace(b"\n", b" \n").split(b" ")
    return parts[:1] + [p if p.startswith(b"\n") else b" " + p for p in parts[1:]]


@pytest.mark.parametrize("limit, same_hash", [(1000, False), (12, False), (1000, True), (12, True)])
def test_chunks_are_looked_up_as_they_stand(monkeypatch, limit, same_hash):
    """Also with forgetting, with long and empty chunks, and where all hashes of one length are equal."""
    draw = random.Random(3)
    words = [bytes(draw.choice(b"ab\0\xff\n") for _ in range(draw.choice([0, 1, 2, 3, 5, LONGEST, LONGEST + 9]))) for _ in range(60)]
    table = ChunkTable(lambda keys: [_answer(k) for k in keys], limit)
    if same_hash:
        monkeypatch.setattr(table, "_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    for _ in range(30):
        texts = [b" ".join(draw.choices(words, k=draw.randint(0, 12))) for _ in range(draw.randint(0, 9))]
        want = [b"".join(_answer(c) for c in _chunks(t) if c) for t in texts]
        assert table.encode(texts) == want
        assert table.keys.n <= limit


def test_each_chunk_is_encoded_once():
    asked = []
    table = ChunkTable(lambda keys: asked.extend(keys) or [_answer(k) for k in keys], 100)
    for _ in range(3):
        table.encode([b"one two two", b"", b"\none two"])
    assert sorted(asked) == [b"\none", b" two", b"one"]


def test_tables_grow():
    table = ChunkTable(lambda keys: [_answer(k) for k in keys], 50_000)
    text = b" ".join(str(k).encode() for k in range(30_000))
    want = b"".join(_answer(c) for c in _chunks(text))
    assert table.encode([text]) == [want] and table.encode([text, text]) == [want, want] and table.keys.n == 30_000
