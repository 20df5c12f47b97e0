"""Character lists from model files."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats: the metadata entries of a model message, key and value of an entry.
METADATA, KEY, VALUE = 14, 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    number = shift = 0
    while True:
        byte = data[at]
        number |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return number, at


def fields(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Number and bytes of each length-delimited field of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 2:
            size, at = _varint(data, at)
            yield tag >> 3, data[at : at + size]
            at += size
        elif wire == 0:
            _, at = _varint(data, at)
        elif wire in (1, 5):
            at += 8 if wire == 1 else 4
        else:
            raise ValueError(f"unknown wire type {wire}")


def model_metadata(data: bytes) -> dict[str, str]:
    entries = (dict(fields(body)) for number, body in fields(data) if number == METADATA)
    return {e.get(KEY, b"").decode(): e.get(VALUE, b"").decode() for e in entries}


def metadata_of_file(file) -> Iterator[tuple[str, str]]:
    """The metadata entries of a model in an open file; other fields, weights among them, are skipped unread."""

    def number() -> int:
        value = shift = 0
        while True:
            byte = file.read(1)
            if not byte:
                raise ValueError("the file ends within a field")
            value |= (byte[0] & 0x7F) << shift
            shift += 7
            if byte[0] < 0x80:
                return value

    size = file.size()
    while file.tell() < size:
        tag = number()
        wire = tag & 7
        if wire == 2:
            length = number()
            if file.tell() + length > size:
                raise ValueError("the file ends within a field")
            if tag >> 3 == METADATA:
                entry = dict(fields(file.read(length)))
                yield entry.get(KEY, b"").decode(), entry.get(VALUE, b"").decode()
            else:
                file.seek(length, 1)
        elif wire == 0:
            number()
        elif wire in (1, 5):
            file.seek(8 if wire == 1 else 4, 1)
        else:
            raise ValueError(f"unknown wire type {wire}")


def read_model_metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, key and value of each metadata entry of the model files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                found = model_metadata(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.string())], ["path", "key", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, key string, value string")


def character_list(metadata: str) -> list[str]:
    """Characters, one a line; an empty last line is none."""
    lines = metadata.split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def yaml_character_list(text: str) -> list[str]:
    """``PostProcess.character_dict`` of a YAML text, every entry a string."""
    import yaml

    found = (yaml.load(text, yaml.BaseLoader) or {}).get("PostProcess", {}).get("character_dict")
    if not isinstance(found, list):
        raise ValueError("no PostProcess.character_dict list")
    return [str(x) for x in found]


def read_character_lists(files: DataFrame, readers: DataFrame) -> DataFrame:
    """The characters of model files (id, content): ``readers`` (id, source, count) says whether ``metadata`` or ``yaml`` holds them and how many there must be.

    ``error`` tells why a list is missing or has another number of characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content, source, count in zip(*(c.to_pylist() for c in batch.columns)):
                found, error = None, None
                try:
                    if source == "metadata":
                        found = character_list(model_metadata(content)["character"])
                    elif source == "yaml":
                        found = yaml_character_list(content.decode())
                    else:
                        error = f"unknown source {source}"
                    if found is not None and count is not None and len(found) != count:
                        error, found = f"{len(found)} characters instead of {count}", None
                except (KeyError, ValueError, IndexError) as problem:
                    error = str(problem)
                rows.append((name, found, error))
            kinds = (pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["id", "characters", "error"])

    joined = files.select("id", "content").join(readers, "id").select(F.col("id").cast("string"), "content", "source", "count")
    return joined.mapInArrow(run, "id string, characters array<string>, error string")


def load_models(spark: SparkSession, path: str, catalogue: DataFrame) -> DataFrame:
    """The catalogue's models (file, and any parameters) with their bytes; ``missing`` where there is no such file under ``path``."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return catalogue.join(files, "file", "left").withColumn("missing", F.col("content").isNull())


def fetch_verified(wanted: DataFrame, fetch: Callable[[str], bytes], attempts: int = 3, wait: Callable[[float], None] = time.sleep, first_wait: float = 0.5, local: str | None = None) -> DataFrame:
    """Each wanted (url, sha256) with its content, tried up to ``attempts`` times until the hash is right; else with the last ``error``.

    A copy in the column ``local`` with the right hash is taken without any try.
    Between two tries there is a wait, ``first_wait`` seconds and then doubled.
    """

    def had(url: str, digest: str, copy: bytes | None) -> tuple:
        if copy is not None and hashlib.sha256(copy).hexdigest() == digest:
            return url, copy, 0, None
        error = None
        for tried in range(1, attempts + 1):
            if tried > 1:
                wait(first_wait * 2 ** (tried - 2))
            try:
                got = fetch(url)
            except OSError as problem:
                error = str(problem)
                continue
            if hashlib.sha256(got).hexdigest() == digest:
                return url, got, tried, None
            error = "another hash"
        return url, None, attempts, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                kinds = (pa.string(), pa.binary(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(had(*row), kinds)], ["url", "content", "tried", "error"])

    copy = F.col(local) if local else F.lit(None).cast("binary")
    return wanted.select("url", "sha256", copy.alias("copy")).mapInArrow(run, "url string, content binary, tried int, error string")
