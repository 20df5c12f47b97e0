"""The mix recomputed word by word, and shards of bounded size whatever ids and texts repeat."""

from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm import mixing


def plain_sainte_lague(votes, seats, caps):
    got = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if got[i] < caps[i] and votes[i] > 0]
        if not open_:
            break
        got[max(open_, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
    return got


def check(rows, seed=7):
    """That the rows of a plan with few shards take what the method says."""
    shards = defaultdict(list)
    for r in rows:
        shards[r["rank"], r["shard"]].append(r)
    blocks = {}
    for key, own in shards.items():
        at = 0
        for r in sorted(own, key=lambda r: (r.first_word, r["size"])):
            assert r.first_word == at
            at += r["size"]
        assert {r.shard_words for r in own} == {at}
        blocks[key] = max(1, int(at / mixing.BLOCK_WORDS + 0.5)) if at else 0
        assert {len(r.times) for r in own} == {blocks[key]}
    ranks = sorted({rank for rank, _ in shards})
    size = {r["rank"]: r.source_size for r in rows}
    target = {r["rank"]: r.target for r in rows}
    stock = [sum(b for (k, _), b in blocks.items() if k == rank) for rank in ranks]
    votes = [target[rank] * n / size[rank] if size[rank] else 0.0 for rank, n in zip(ranks, stock)]
    seats = plain_sainte_lague(votes, int(sum(votes) + 0.5), [2 * n for n in stock])
    for rank, quota in zip(ranks, seats):
        own = sorted(s for k, s in shards if k == rank)
        shares = plain_sainte_lague([shards[rank, s][0].shard_words for s in own], quota, [2 * blocks[rank, s] for s in own])
        for shard, got in zip(own, shares):
            n = blocks[rank, shard]
            times = np.full(n, got // n if n else 0)
            times[np.random.default_rng([seed, rank, shard]).permutation(n)[: got % n if n else 0]] += 1
            for r in shards[rank, shard]:
                assert list(r.times) == times.tolist()
                inside = np.searchsorted(np.arange(1, n + 1) * r.shard_words // n if n else [], np.arange(r.first_word, r.first_word + r["size"]), "right")
                assert r.taken == (times[inside].sum() if r["size"] else 0)


@pytest.mark.parametrize("shard_words", [100, 16_384])
def test_taken_words_by_brute_force(spark, monkeypatch, shard_words):
    monkeypatch.setattr(mixing, "SHARD_WORDS", shard_words)
    draw = np.random.default_rng(3)
    rows = [(int(k), " ".join(f"w{j}" for j in range(int(draw.integers(0, 90)))), "abcd"[int(draw.integers(0, 4))]) for k in range(150)]
    rows += [(200, None, "a"), (201, "", None), (202, "one two", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    check(mixing.mix_plan(docs).collect())


@pytest.mark.parametrize("keep", [(), ("text", "copy", "mark")])
def test_many_rows_with_one_id(spark, monkeypatch, keep):
    """No shard holds more than some times its share, though a third of the rows have no id and a third are one row."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 200)
    rows = [(None, " ".join(f"n{k} w{j}" for j in range(6)), "s") for k in range(300)] + [(7, "the same row " * 4, "s")] * 300 + [(k, f"text {k} " * 6, "s") for k in range(300)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, mark string, copy int")
    found, again = (mixing.mix_plan(docs.repartition(n), keep=keep).collect() for n in (3, 5))
    check(found)
    shards = {(r["rank"], r["shard"]): r.shard_words for r in found}
    assert len(shards) == 54 and max(shards.values()) < 3 * 200
    order = lambda plan: sorted((r.doc_id or -1, r["shard"], r.first_word, r.taken) for r in plan)
    assert order(found) == order(again)
    if keep:
        mixed = mixing.mix_documents(docs)
        assert mixed.columns == docs.columns
        assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in found)


def test_limits(spark):
    docs = spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        mixing.mix_plan(docs, most=1.5)
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix_plan(docs, share=9.0, most=3).collect()] == [9]
