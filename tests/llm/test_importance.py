import hashlib
import math
import random
import re
import zlib

import numpy as np

from sparkloom.llm import importance, registry
from sparkloom.llm.common import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_force(rows, targets, share=25, seed=7, least=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, targets)):
        for text in texts:
            for f in features(text)[1]:
                counts[bucket(f)] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (big_s + buckets) / ((a + 1) * (big_t + buckets)))) for a, b in zip(s, t)]
    out, may = {}, []
    for i, text in rows:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(found), weight, score, None]
        if len(words) >= least:
            may.append((-score, i))
    for k, (_, i) in enumerate(sorted(may)[: share * len(may) // 100]):
        out[i][3] = k + 1
    return {i: tuple(v) for i, v in out.items()}


def test_span_crcs_of_any_length():
    draw = np.random.default_rng(1)
    data = draw.integers(0, 256, 40_000).astype(np.uint8)
    edges = np.unique(draw.integers(0, 30_000, 300))
    starts, ends = edges[:-1:2], edges[1::2]
    starts, ends = np.append(starts, 30_010), np.append(ends, 40_000)
    n = min(len(starts), len(ends))
    assert importance.span_crcs(data, starts[:n], ends[:n]).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts[:n], ends[:n])]
    one = np.arange(1, 400)
    at = np.concatenate([[0], np.cumsum(one)])
    data = np.resize(data, at[-1])
    assert importance.span_crcs(data, at[:-1], at[1:]).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]


def test_pieces_cut_anywhere(monkeypatch):
    draw = random.Random(3)
    texts = ["".join(draw.choice("abC9é \n,日") for _ in range(draw.randrange(0, 400))) for _ in range(60)] + ["", "   ", "x" * 5000, " a" * 700]
    want = [[] for _ in texts]
    for k, text in enumerate(texts):
        want[k] = sorted(zlib.crc32(f.encode()) for f in features(text)[1])
    for step in (1, 7, 64, 1 << 18):
        monkeypatch.setattr(importance, "STEP", step)
        monkeypatch.setattr(importance, "BLOCKS_AT_ONCE", max(2, step // 16))
        found = [[] for _ in texts]
        for piece in importance.pieces([t.encode() for t in texts]):
            for crc, row in zip(*piece.crcs()):
                found[row].append(int(crc))
        assert [sorted(f) for f in found] == want


def test_op11(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    targets = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = registry.op11_importance_draw(spark, sf_dir)
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == brute_force(rows, targets)


def test_odd_rows(spark):
    draw = random.Random(5)
    prose = lambda n: " ".join(draw.choice(["ab", "cd", "Ef", "9", "ü"]) for _ in range(n))
    long_ = prose(200_000)
    rows = [(1, None, 0), (2, "", 1), (3, long_, 2), (4, "z" * 300_000, 3), (7, prose(20), 9), (6, prose(25), 9), (5, prose(19), 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `text hash` int").withColumnRenamed("text hash", "score").repartition(3)
    target = spark.createDataFrame([("ab cd",), (None,)], "text string")
    found = importance.importance_draw(docs, target, share=50)
    assert {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in found.collect()} == brute_force([r[:2] for r in rows], ["ab cd", None], share=50)
    assert sorted(r.doc_id for r in importance.resample(docs, target, share=100).collect()) == [3, 6, 7]
    assert importance.resample(docs, target).columns == docs.columns
    assert importance.importance_draw(docs.limit(0), target).count() == 0
    assert importance.importance_draw(docs, target.limit(0)).count() == 7
    # Equal rows and null ids: as many ranks as are due, each once.
    same = spark.createDataFrame([(None, prose(30))] * 4 + [(8, "one two " * 20)] * 4, "doc_id long, text string")
    ranks = sorted(r.rank for r in importance.importance_draw(same, target, share=75).collect() if r.rank)
    assert ranks == list(range(1, 7))
