"""Data sources for image and model files: ``spark.read.format("png")`` and ``"model_metadata"`` after ``register``.

Files are planned into partitions by size, tests on ``path`` are pushed down
before any file is opened, and only what the schema asks for is read: sizes of
images need a file's first bytes, metadata of a model skips its weights. The
option ``path`` is a file, a folder or a pattern in any file system that
pyarrow opens; where only Spark reads the store, use ``images.read_png`` and
``models.read_model_metadata``.
"""

from __future__ import annotations

import fnmatch
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from sparkloom.sources import images, models

#: Bytes of files in a partition, unless the option ``partitionBytes`` says otherwise; bytes of a PNG file up to the end of its header.
PARTITION_BYTES, PNG_HEADER = 64 << 20, 33


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)


def listed(path: str) -> list[tuple[str, int]]:
    """Path and size of the files at a path, in a folder, or that fit a pattern."""
    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    folder, _, last = place.rpartition("/")
    pattern = last if any(c in last for c in "*?[") else None
    info = system.get_file_info(folder if pattern else place)
    if info.type == fs.FileType.File:
        return [(place, info.size)]
    found = system.get_file_info(fs.FileSelector(folder if pattern else place))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and (pattern is None or fnmatch.fnmatch(f.base_name, pattern)))


class FileReader(DataSourceReader):
    """Reads a row, or several, from each file; subclasses give ``rows`` of an open file."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options = schema.names, dict(options)
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        kinds = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends"}
        for f in filters:
            if type(f) in kinds and f.attribute == ("path",):
                self.tests.append((kinds[type(f)], f.value))
            else:
                yield f

    def wanted(self, path: str) -> bool:
        told = {"is": path.__eq__, "in": lambda v: path in v, "starts": path.startswith, "ends": path.endswith}
        return all(told[kind](value) for kind, value in self.tests)

    def partitions(self) -> list[Files]:
        most = int(self.options.get("partitionbytes", self.options.get("partitionBytes", PARTITION_BYTES)))
        out, held = [Files()], 0
        for path, size in listed(self.options["path"]):
            if self.wanted(path):
                if out[-1].paths and held + size > most:
                    out, held = [*out, Files()], 0
                out[-1].paths.append(path)
                held += size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        root = self.options["path"]
        system = fs.FileSystem.from_uri(root)[0] if "://" in root else fs.LocalFileSystem()
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for row in self.rows(path, file):
                    yield tuple(row.get(n) for n in self.names)

    def rows(self, path: str, file) -> Iterator[dict]:
        raise NotImplementedError


class PngReader(FileReader):
    def rows(self, path: str, file) -> Iterator[dict]:
        try:
            if "data" in self.names or "error" in self.names:
                image = images.decode_png(file.read())
                yield {"path": path, "width": image.shape[1], "height": image.shape[0], "data": image.tobytes()}
            elif {"width", "height"} & set(self.names):
                width, height = images.png_size(file.read(PNG_HEADER))
                yield {"path": path, "width": width, "height": height}
            else:
                yield {"path": path}
        except (ValueError, KeyError, struct.error, zlib.error) as problem:
            yield {"path": path, "error": str(problem)}


class PngSource(DataSource):
    """Images as path, width, height, data (RGBA) and error; with a schema of fewer columns only what it needs is read."""

    @classmethod
    def name(cls) -> str:
        return "png"

    def schema(self) -> str:
        return "path string, width int, height int, data binary, error string"

    def reader(self, schema: StructType) -> PngReader:
        return PngReader(schema, self.options)


class MetadataReader(FileReader):
    def rows(self, path: str, file) -> Iterator[dict]:
        try:
            for key, value in models.metadata_of_file(file):
                yield {"path": path, "key": key, "value": value}
        except (ValueError, IndexError) as problem:
            yield {"path": path, "error": str(problem)}


class MetadataSource(DataSource):
    """Metadata of models as path, key, value and error."""

    @classmethod
    def name(cls) -> str:
        return "model_metadata"

    def schema(self) -> str:
        return "path string, key string, value string, error string"

    def reader(self, schema: StructType) -> MetadataReader:
        return MetadataReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let it push tests down to sources in Python (they refuse to read otherwise)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PngSource, MetadataSource):
        spark.dataSource.register(source)
