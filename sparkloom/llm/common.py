"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only on one
    machine (tests) a temporary folder is made and set where that is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage at ``df`` with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, frame: DataFrame) -> None:
    """Delete the files that ``frame``, as given by ``stored``, is read from; nothing may read it any more."""
    root = shared_dir(spark).rstrip("/")
    for name in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        if path.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath() + "/"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: What a worker process keeps from task to task, by the name of the step that uses it.
_KEPT: dict[str, dict] = {}


def kept_by(step: str) -> dict:
    return _KEPT.setdefault(step, {})


def give_back() -> None:
    """Return to the system what this worker process has freed; Arrow and the C library would hold it for later."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def release(keeps: str | None = None) -> None:
    """Let go of what other steps have kept in this worker process."""
    others = [held for step, held in _KEPT.items() if step != keeps and held]
    for held in others:
        held.clear()
    if others:
        gc.collect()
        give_back()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema, keeps: str | None = None) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; an executor that is lost only repeats its own tasks. What other steps than ``keeps`` have kept in the worker goes first, what a task has freed at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keeps)
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
        give_back()

    return df.mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Arrow batches of about this size for what is run inside, as each is held by Spark and by Python at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def utf8(column: str = "text"):
    """The column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")
