"""What the stages' Python workers hold: one copy of a text, one worker for each task, small tables."""

import os

import public_tokenizers
import pyarrow as pa

from sparkloom.llm import bpe_fst, common, mixing, quality
from sparkloom.llm.common import documents


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quality_rules_send_a_text_once(spark, sf_dir, monkeypatch):
    docs = documents(spark, sf_dir).limit(300).cache()
    kept = quality.reject_low_quality(docs)
    assert "body" not in plan_of(kept)
    figures = {r.doc_id for r in quality.quality_figures(docs).where("kept").collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(figures) and figures
    # A text that is no string is sent as bytes beside it; nulls fail the base rule either way.
    raw = docs.selectExpr("doc_id", "cast(text as binary) text")
    assert {r.doc_id for r in quality.reject_low_quality(raw).collect()} == figures
    assert quality.reject_low_quality(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == []
    docs.unpersist()


def test_quality_rules_over_slices(spark, sf_dir):
    passing = lambda text: quality.verdicts(pa.array([text.encode()]), quality.Bands())[-1][0].as_py()
    text = next(r.text for r in documents(spark, sf_dir).select("text").limit(300).collect() if r.text and passing(r.text))
    rows = [(k, text if k % 3 else "too short") for k in range(2 * quality.ROWS_OUT + 5)]
    kept = quality.reject_low_quality(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert sorted(r.doc_id for r in kept.collect()) == [k for k, t in rows if t == text]


def test_a_draw_has_no_second_worker(spark, sf_dir):
    mixed = mixing.mix_documents(documents(spark, sf_dir))
    assert "MapInArrow" in plan_of(mixed) and "FlatMapGroupsInPandas" not in plan_of(mixed)


def test_codec_tables():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = bpe_fst.Codec(path, public_tokenizers.PATTERN, 0.01)
    text = " ".join(f"unheard{k}of WORD{k % 7}" for k in range(2000)).encode()
    ids = codec.encode(text)
    assert "".join(codec.decode(ids)).encode() == text
    assert all(type(x) is bytes for x in codec.pieces.values()) and len(codec.pieces) <= codec.most_pieces
    assert all(type(x) is int for x in codec.transducer.pairs) and len(codec.transducer.pairs) <= codec.transducer.most_pairs
    tails = [tail for state in codec.transducer.states for tail, _ in state if tail]
    assert tails and all(tail is codec.transducer.open[tail] for tail in tails)


def anonymous_mb():
    lines = open("/proc/self/smaps_rollup").read().splitlines()
    return sum(int(x.split()[1]) for x in lines if x.startswith(("Pss_Anon", "Pss_Shmem"))) / 1024


def test_freed_memory_goes_back():
    if not os.path.exists("/proc/self/smaps_rollup"):
        return
    held = [os.urandom(4000) for _ in range(40_000)]  # below the size that is mapped on its own
    pins = held[::1000]
    full = anonymous_mb()
    del held
    common.give_back()
    assert len(pins) == 40 and anonymous_mb() < full - 120
