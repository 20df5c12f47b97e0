"""A verified store of files by version, as a sink for streams and as a cache before downloads.

A version's files are rows (file, size, sha256, content) in batches. A batch is
written to a staging folder, renamed, and counts once its marker is there; the
marker's name is the batch's, so a batch that is replayed changes nothing, and
one that broke off is written again. Batches are numbered in order of commit:
the last row of a file counts, and a row without content takes the file away.
One writer at a time is assumed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.storage import materialized

COLUMNS = "file string, size long, sha256 string, content binary"


def sound() -> F.Column:
    """Whether ``content`` has the size and the hash that its row says."""
    return F.coalesce((F.octet_length("content") == F.col("size")) & (F.sha2("content", 256) == F.col("sha256")), F.lit(False))


class Folder:
    """A folder in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.make = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.make(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.make(self.at(name)))

    def names(self, name: str = "") -> list[str]:
        place = self.make(self.at(name))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(place)) if self.fs.exists(place) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.make(self.at(name)), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.make(self.at(old)), self.make(self.at(new))):
            raise OSError(f"cannot rename {self.at(old)}")

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.make(self.at(name)), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(self.at(name)).collect())


@dataclass
class VerifiedStore:
    """The files of one ``version`` under ``root``; other versions' folders begin with ``prefix``, too.

    Keeping a copy is best effort: what goes wrong is noted in ``failures``, and
    whoever needs the files has them all the same.
    """

    spark: SparkSession
    root: str
    version: str
    prefix: str = "assets-"
    failures: list[str] = field(default_factory=list)

    def _folder(self, version: str | None = None) -> Folder:
        return Folder(self.spark, f"{self.root}/{self.prefix}{version or self.version}")

    def versions(self) -> list[str]:
        return [n.removeprefix(self.prefix) for n in Folder(self.spark, self.root).names() if n.startswith(self.prefix)]

    def batches(self, version: str | None = None) -> dict[str, int]:
        """Committed batches and their numbers."""
        folder = self._folder(version)
        return {n: json.loads(folder.read(f"markers/{n}"))["number"] for n in folder.names("markers")}

    def held(self, version: str | None = None) -> DataFrame:
        """The version's files as the last batch that names each has them, sound or not."""
        folder, empty = self._folder(version), self.spark.createDataFrame([], COLUMNS)
        parts = [self.spark.read.schema(COLUMNS).parquet(folder.at(f"batches/{name}")).withColumn("number", F.lit(number)) for name, number in self.batches(version).items()]
        if not parts:
            return empty
        rows = reduce(DataFrame.unionByName, parts)
        last = rows.groupBy("file").agg(F.max("number").alias("last")).withColumnRenamed("file", "named")
        return rows.join(last, (F.col("file") == F.col("named")) & (F.col("number") == F.col("last"))).where("content is not null").select(*empty.columns).dropDuplicates(["file"])

    def _commit(self, rows: DataFrame, name: str) -> None:
        done, folder = self.batches(), self._folder()
        if name in done:
            return
        folder.delete(f"staged/{name}")
        rows.select("file", "size", "sha256", "content").write.parquet(folder.at(f"staged/{name}"))
        folder.delete(f"batches/{name}")  # left by a run that ended before its marker
        folder.fs.mkdirs(folder.make(folder.at("batches")))
        folder.rename(f"staged/{name}", f"batches/{name}")
        folder.write(f"markers/{name}", json.dumps({"number": max(done.values(), default=0) + 1}))

    def put(self, rows: DataFrame, name: str) -> bool:
        """Keep the sound ones of ``rows`` (and take away files without content) as the batch ``name``; whether that went well."""
        try:
            self._commit(rows.where(F.col("content").isNull() | sound()), name)
        except (PySparkException, OSError) as problem:
            self.failures.append(f"{name}: {str(problem).splitlines()[0]}")
            return False
        return True

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each batch of a stream is kept under its number."""

        def keep(rows: DataFrame, batch: int) -> None:
            self.put(rows, f"stream-{batch}")

        return keep

    def load(self, manifest: DataFrame, download: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
        """All files of ``manifest`` (file, size, sha256) with their content.

        A sound copy of this version comes first, then one of another version,
        then what ``download`` gives (file, content) for the rest. Copies of this
        version that are not as the manifest says are taken away, other
        versions' bad copies are passed over. What is new is kept as the batch
        ``name``; then other versions are deleted. If a file cannot be had, an
        error names it, and nothing is deleted.
        """
        wanted = manifest.select("file", "size", "sha256")

        def copies(of: DataFrame) -> DataFrame:
            named = wanted.join(of.select("file", "content"), "file")
            return named.where(sound())

        mine = self.held()
        here = materialized(copies(mine))
        rest = wanted.join(here.select("file"), "file", "left_anti")
        bad = mine.select("file").join(rest, "file")
        others = [self.held(v) for v in self.versions() if v != self.version]
        older = copies(reduce(DataFrame.unionByName, others)).dropDuplicates(["file"]).join(rest.select("file"), "file", "left_semi") if others else here.limit(0)
        older = materialized(older)
        missing = rest.join(older.select("file"), "file", "left_anti")
        fetched = materialized(copies(download(missing)).join(missing.select("file"), "file", "left_semi"))
        lost = [r.file for r in missing.join(fetched.select("file"), "file", "left_anti").orderBy("file").limit(10).collect()]
        if lost:
            raise OSError(f"no sound copy of {', '.join(lost)}")
        fresh = older.unionByName(fetched)
        gone = bad.join(fresh.select("file"), "file", "left_anti").withColumn("content", F.lit(None).cast("binary"))
        if not fresh.isEmpty() or not gone.isEmpty():
            self.put(fresh.unionByName(gone.select(*fresh.columns)), name)
        root = Folder(self.spark, self.root)
        for version in self.versions():
            if version != self.version:
                root.delete(f"{self.prefix}{version}")
        return here.unionByName(fresh)

    def clear(self) -> None:
        """Delete all versions."""
        for version in self.versions():
            Folder(self.spark, self.root).delete(f"{self.prefix}{version}")
