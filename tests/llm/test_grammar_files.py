import random
from collections import Counter

import numpy as np
import public_tokenizers

from sparkloom.llm import grammar_files


def uses_left(shard):
    """How often each pair that is left could still be replaced."""
    uses, at = Counter(), 0
    for size in shard.doc_symbols.tolist():
        own, open_until = shard.symbols[at : at + size].tolist(), {}
        for k, pair in enumerate(zip(own, own[1:])):
            if open_until.get(pair, 0) <= k:
                uses[pair] += 1
                open_until[pair] = k + 2
        at += size
    return uses


def test_pairs_are_replaced_until_none_is_frequent():
    draw = np.random.default_rng(8)
    passage = draw.integers(0, 50_000, 64)
    parts, sizes = [], []
    for k in range(300):
        parts += [draw.integers(0, 40, draw.integers(0, 60)), passage if k % 3 else passage[:0], np.full(k % 40, 7), [50_000]]
        sizes.append(sum(map(len, parts[-4:])))
    tokens = np.concatenate(parts).astype(np.uint32)
    shard = grammar_files.unpack(grammar_files.pack(grammar_files.compress(tokens, np.array(sizes), 50_001)))
    assert max(uses_left(shard).values()) < grammar_files.LEAST_USES
    assert shard.lengths.max() >= 64  # the passage is one symbol
    assert grammar_files.Expander(shard).expand(shard.symbols).tolist() == tokens.tolist()


def test_symbols_beyond_16_bits():
    draw = np.random.default_rng(9)
    tokens = np.tile(draw.integers(0, 70_000, 50), 20).astype(np.uint32)
    for first in (70_000, 1 << 24):
        shard = grammar_files.unpack(grammar_files.pack(grammar_files.compress(tokens, np.array([len(tokens)]), first)))
        assert grammar_files.Expander(shard).expand(shard.symbols).tolist() == tokens.tolist() if first < 1 << 20 else shard.first == first


def test_chunks_encode_like_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = grammar_files.worker_encoder(path)
    draw = random.Random(11)
    texts = ["", "\n", "\n\n", "a\n\nb", "a\n\n\nb", "a\n b", "a \nb", "\n\na\n", "a\n\n", " 　a\n b \x85"]
    texts += ["".join(draw.choice("ab  \n\n\t,.'sé  9") for _ in range(draw.randrange(40))) for _ in range(3000)]
    expected = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    found = encoder.encode([t.encode() for t in texts])
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [e.ids for e in expected]


def test_small_alphabets_with_many_overlaps():
    draw = np.random.default_rng(12)
    for trial in range(20):
        n = int(draw.integers(2, 600))
        tokens = draw.integers(0, draw.integers(1, 6), n).astype(np.uint32)
        sizes = np.diff(np.r_[0, np.sort(draw.choice(np.arange(1, n), min(n - 1, int(draw.integers(0, 9))), replace=False)), n])
        shard = grammar_files.compress(tokens, sizes, 6, least=3)
        assert grammar_files.Expander(shard).expand(shard.symbols).tolist() == tokens.tolist()
        assert max(uses_left(shard).values(), default=0) < 3 and shard.doc_symbols.sum() == len(shard.symbols)


def test_files_read_back(spark):
    long_ = " ".join(f"w{k * 31 % 997}" for k in range(3000))
    rows = [(k % 7 if k % 3 else None, long_ if k == 4 else None if k == 5 else f"text {k % 5} of many", "x", k) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, payload string, start int").repartition(5)
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = f"{spark.conf.get('spark.checkpoint.dir')}/small-shards"
    grammar_files.write_token_files(docs, out, path, 2, shard_tokens=50)
    files = spark.read.schema(grammar_files.FILE_SCHEMA).parquet(out)
    assert files.count() > 5
    found = sorted(((r.start, r.doc_id, list(r.ids)) for r in grammar_files.read_token_files(files).collect()), key=lambda r: r[0])
    tokenizer = grammar_files.worker_encoder(path).tokenizer
    expected = Counter((r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + (2,)) for r in rows)
    assert Counter((i, tuple(ids)) for _, i, ids in found) == expected
    assert [i for _, i, _ in found] == sorted((r[0] for r in rows), key=lambda i: (i is None, i))
    at = 0
    for start, _, ids in found:
        assert start == at
        at += len(ids)
    empty = f"{spark.conf.get('spark.checkpoint.dir')}/no-shards"
    grammar_files.write_token_files(docs.limit(0), empty, path, 2)
    assert grammar_files.read_token_files(spark.read.schema(grammar_files.FILE_SCHEMA).parquet(empty)).count() == 0
