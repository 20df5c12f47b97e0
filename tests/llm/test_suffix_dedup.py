"""Removal of repeated strings where keys collide, where anchors are hot, and against SQL."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import oracles, registry, suffix_dedup


def key(value):
    return (value is None, value)


def same(found, expected):
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: [key(x) for x in r])
    assert order(found) == order(expected)


def brute_removed(rows, length=50):
    seen = {}
    for row in rows:
        b, at = (row[1] or "").encode(), key(row[0])
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            seen[s] = min(seen.get(s, at), at, key=lambda x: (x[0], x[1] or 0))
    out = []
    for row in rows:
        b, at = (row[1] or "").encode(), key(row[0])
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            low = seen[b[k : k + length]]
            if (low[0], low[1] or 0) < (at[0], at[1] or 0):
                gone[k : k + length] = b"\1" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((row[0], len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def mixed_rows(n=120, seed=9):
    """Texts of passages that many share, with own words around them, exact copies and repeated ids."""
    draw = random.Random(seed)
    letters = "abcdefghij klé"
    passages = ["".join(draw.choice(letters) for _ in range(draw.randrange(40, 200))) for _ in range(3)]
    rows = []
    for k in range(n):
        own = lambda: "".join(draw.choice(letters) for _ in range(draw.randrange(80)))
        rows.append((draw.randrange(n), own() + draw.choice(passages) + own() + draw.choice(passages)[draw.randrange(9) :] + own()))
    rows += [(k, rows[5][1]) for k in (3, 700, None)] + [(None, None), (9, ""), (9, rows[7][1])]
    return rows


@pytest.mark.parametrize("in_block, in_bucket", [(2, 20_000), (10_000, 5), (3, 8)])
def test_hot_anchors(spark, monkeypatch, in_block, in_bucket):
    """Some blocks and buckets see an anchor as hot, others do not."""
    monkeypatch.setattr(suffix_dedup, "LEAST_HOT", in_block)
    monkeypatch.setattr(suffix_dedup, "MOST_HOT", in_block)
    monkeypatch.setattr(suffix_dedup, "HOT_IN_BUCKET", in_bucket)
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(suffix_dedup.removed_strings(docs).collect(), brute_removed(rows))


@pytest.mark.parametrize("values", [1, 4])
def test_colliding_keys_lose_nothing(spark, monkeypatch, values):
    real = suffix_dedup._key
    monkeypatch.setattr(suffix_dedup, "_key", lambda level: F.pmod(real(level), F.lit(values)) if level == 0 else real(level))
    rows = mixed_rows(60, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(suffix_dedup.removed_strings(docs).collect(), brute_removed(rows))


def test_by_sql(spark, sf_dir):
    own = registry.queries()["op6_repeated_strings"](spark, sf_dir)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    found = connection.execute(oracles.REPEATED_STRINGS)
    names = [c[0] for c in found.description]
    same([tuple(r) for r in own.select(*names).collect()], found.fetchall())


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "x" * 200, "a", 1), (2, "x" * 200, "b", 2), (None, None, None, None)], "doc_id long, text string, tid string, doc int")
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.removed_strings(docs).collect()}
    assert rows == {1: (200, 0, 0), 2: (200, 200, 1), None: (0, 0, 0)}
