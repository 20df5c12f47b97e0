import hashlib
import os

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import models
from sparkloom.streaming.store import COLUMNS, VerifiedStore

digest = lambda b: hashlib.sha256(b).hexdigest()


def rows(spark, files, lie=()):
    return spark.createDataFrame([(f, len(c) + (f in lie), digest(c), bytearray(c)) for f, c in files.items()], COLUMNS)


def contents(df):
    return {r.file: bytes(r.content) for r in df.collect()}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    store = VerifiedStore(spark, str(tmp_path / "s"), "v1")
    keep = store.sink()
    keep(rows(spark, {"a": b"one", "b": b"two", "c": b"bad"}, lie={"c"}), 0)
    keep(rows(spark, {"b": b"newer"}), 1)
    assert contents(store.held()) == {"a": b"one", "b": b"newer"}
    before = sorted(os.listdir(tmp_path / "s" / "assets-v1" / "batches"))
    keep(rows(spark, {"a": b"again", "d": b"more"}), 0)
    assert contents(store.held()) == {"a": b"one", "b": b"newer"} and sorted(os.listdir(tmp_path / "s" / "assets-v1" / "batches")) == before
    # A run that ended after the rename and before the marker: its batch does not count, and is written again.
    os.remove(tmp_path / "s" / "assets-v1" / "markers" / "stream-1")
    assert contents(store.held()) == {"a": b"one", "b": b"two"}
    keep(rows(spark, {"b": b"newer"}), 1)
    assert contents(store.held()) == {"a": b"one", "b": b"newer"} and not store.failures


def test_a_stream_into_the_store(spark, tmp_path):
    for n, files in enumerate(({"a": b"x" * 50}, {"b": b"y", "a": b"z"})):
        rows(spark, files).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(COLUMNS).parquet(str(tmp_path / "in"))
        store = VerifiedStore(spark, str(tmp_path / "s"), "v1")
        stream.writeStream.foreachBatch(store.sink()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
        assert set(store.batches()) == {f"stream-{k}" for k in range(n + 1)}
    assert contents(store.held()) == {"a": b"z", "b": b"y"}


def test_sources_in_order_and_cleaning(spark, tmp_path):
    files = {"here": b"1", "damaged": b"22", "older": b"333", "old bad": b"4444", "new": b"55555"}
    store, before = (VerifiedStore(spark, str(tmp_path / "s"), v) for v in ("v2", "v1"))
    store.put(rows(spark, {"here": b"1", "damaged": b"xx", "other": b"stays"}), "first")
    before.put(rows(spark, {"here": b"1", "older": b"333", "old bad": b"oooo"}), "first")
    (tmp_path / "s" / "unrelated").mkdir()
    asked = []

    def download(missing):
        asked.extend(sorted(r.file for r in missing.collect()))
        return missing.select("file", F.col("file").alias("f")).select("file", F.when(F.col("f") == "new", F.lit(b"55555")).when(F.col("f") == "old bad", F.lit(b"4444")).otherwise(F.lit(b"22")).alias("content"))

    manifest = rows(spark, files).drop("content")
    assert contents(store.load(manifest, download, "load")) == files
    assert asked == ["damaged", "new", "old bad"] and store.versions() == ["v2"] and (tmp_path / "s" / "unrelated").exists()
    assert contents(store.held()) == files | {"other": b"stays"}
    asked.clear()
    assert contents(store.load(manifest, download, "load")) == files and asked == []
    store.clear()
    assert store.versions() == []


def test_a_broken_put_loses_nothing(spark, tmp_path, monkeypatch):
    store = VerifiedStore(spark, str(tmp_path / "s"), "v2")
    VerifiedStore(spark, str(tmp_path / "s"), "v1").put(rows(spark, {"a": b"1"}), "first")
    manifest = rows(spark, {"a": b"1", "b": b"2"}).drop("content")
    gone = lambda missing: missing.select("file", F.lit(b"no").alias("content"))
    with pytest.raises(OSError, match="no sound copy of b"):
        store.load(manifest, gone, "load")
    assert store.versions() == ["v1"]  # nothing was deleted
    given = lambda missing: missing.select("file", F.lit(b"2").alias("content"))

    def full(rows_, name):
        raise OSError("no space left")

    monkeypatch.setattr(store, "_commit", full)
    assert contents(store.load(manifest, given, "load")) == {"a": b"1", "b": b"2"} and store.failures == ["load: no space left"]


def test_copies_and_waits(spark, tmp_path):
    log = str(tmp_path / "waits")

    def wait(seconds):
        with open(log, "a") as out:
            out.write(f"{seconds} ")

    def fetch(url):
        with open(log, "a") as out:
            out.write(f"{url} ")
        raise OSError("gone")

    calls = spark.createDataFrame([("held", digest(b"x"), bytearray(b"x"))], "url string, sha256 string, copy binary").union(spark.createDataFrame([("stale", digest(b"y"), bytearray(b"x"))], "u string, s string, c binary")).coalesce(1)
    found = {r.url: (r.tried, r.content and bytes(r.content), r.error) for r in models.fetch_verified(calls, fetch, wait=wait, local="copy").collect()}
    assert found == {"held": (0, b"x", None), "stale": (3, None, "gone")} and open(log).read().split() == ["stale", "0.5", "stale", "1.0", "stale"]
