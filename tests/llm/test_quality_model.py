import random
import zlib

import numpy as np

from sparkloom.llm import quality_model, registry


def test_op12_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = registry.op12_quality_scores(spark, sf_dir)
    assert dict(found.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    seen = [(rows[i].score, q) for i, q in labels.items() if rows[i].held_out]
    good, bad = (np.array([s for s, q in seen if q == k]) for k in (1, 0))
    assert (good >= 0.5).mean() > 0.97 and (bad < 0.5).mean() > 0.9
    assert np.mean([(good > s).mean() + 0.5 * (good == s).mean() for s in bad]) > 0.97


def table(spark, draw, n, bad_share):
    good = lambda: " ".join(draw.choice(["lorem", "ipsum", "dolor", "sit.", "Amet,"]) + draw.choice("abcdef") for _ in range(60))
    bad = lambda: "$$ ".join(draw.choice(["lorem", "ipsum", "DOLOR"]) for _ in range(60))
    rows = [(k, bad() if draw.random() < bad_share else good()) for k in range(n)]
    labels = [(k, 1, 0) for k, t in rows if "$" not in t and draw.random() < 0.3]
    return rows, labels


def test_prior_from_positives_alone(spark):
    draw = random.Random(1)
    rows, labels = table(spark, draw, 900, 0.4)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marked = quality_model.featured(docs).select("*", quality_model.held_out("doc_id").alias("held_out")).cache()
    training = quality_model.training_rows(marked, marks).cache()
    model, prior = quality_model.fit(training)
    share = np.mean(["$" not in t for k, t in rows if zlib.crc32(str(k).encode()) % 3 != 1])
    assert abs(prior - share) < 0.03
    # The same model however the rows are dealt.
    again, _ = quality_model.fit(training.repartition(7))
    assert (again.weights == model.weights).all() and again.shift == model.shift
    scored = quality_model.quality_scores(docs, marks).collect()
    assert all(r.predicted == ("$" not in rows[r.doc_id][1]) for r in scored)


def test_the_fit_turns_back_where_the_risk_falls_below_zero(spark):
    """Three trusted rows, far fewer than the features: without the turn the second term would go on falling."""
    draw = random.Random(2)
    rows, _ = table(spark, draw, 120, 0.3)
    good = [k for k, t in rows if "$" not in t and zlib.crc32(str(k).encode()) % 3 != 1][:3]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, 1) for k in good], "doc_id long, quality int")
    scored = {r.doc_id: r.score for r in quality_model.quality_scores(docs, marks).collect()}
    assert np.mean([scored[k] for k, t in rows if "$" not in t]) > np.mean([scored[k] for k, t in rows if "$" in t])


def test_features_of_pieces(monkeypatch):
    text = ("Ab1 é|x\n\n" * 50 + "!").encode()
    whole = quality_model.text_features(text)
    for step in (1, 2, 13, len(text) - 1):
        monkeypatch.setattr(quality_model, "STEP", step)
        assert (quality_model.text_features(text) == whole).all()


def test_odd_rows(spark):
    draw = random.Random(3)
    rows, labels = table(spark, draw, 60, 0.3)
    twice = labels[0][0]
    texts = [(k, t, "x", 1) for k, t in rows] + [(None, None, "x", 1), (None, "", None, 2), (61, "word " * 200_000, "x", 3), rows[5] + ("x", 9), rows[5] + ("x", 9)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, features string, held_out int").repartition(3)
    marks = spark.createDataFrame(labels + [(twice, 0, 0), (None, 1, 0), labels[1]], "doc_id long, quality int, toxic int")
    found = quality_model.quality_scores(docs, marks)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == len(texts)
    assert all(0 <= r.score <= 1 and (r.doc_id is not None or not r.held_out) for r in found.collect())
    assert quality_model.quality_scores(docs.limit(0), marks).count() == 0
    assert {r.score for r in quality_model.quality_scores(docs, marks.limit(0)).collect()} == {0.5}
