"""Images: PNG files as rows of RGBA bytes, regions of them, and grey planes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import geometry as G

#: Fixed values of the format: its signature, and samples a pixel for each colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    """Scan lines without their filters; ``step`` bytes make a pixel."""
    lines = np.frombuffer(raw, np.uint8).reshape(rows, stride + 1)
    out = np.zeros((rows, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for n, line in enumerate(lines):
        kind, data = line[0], line[1:]
        if kind == 0:
            out[n] = data
        elif kind == 1:
            out[n] = np.cumsum(data.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            out[n] = data + above
        elif kind in (3, 4):
            row, up = bytearray(data), above.tolist()
            for k in range(stride):
                a, b = (row[k - step] if k >= step else 0), up[k]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = up[k - step] if k >= step else 0
                    near = (abs(b - c), abs(a - c), abs(a + b - 2 * c))
                    guess = (a, b, c)[near.index(min(near))]
                row[k] = (row[k] + guess) & 255
            out[n] = np.frombuffer(bytes(row), np.uint8)
        else:
            raise ValueError(f"unknown PNG filter {kind}")
        above = out[n]
    return out


def png_size(head: bytes) -> tuple[int, int]:
    """Width and height, from the first bytes of a file."""
    if not head.startswith(SIGNATURE) or head[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    return struct.unpack_from(">II", head, 16)


def decode_png(data: bytes) -> np.ndarray:
    """Height by width by RGBA; of 8 bits a sample and not interlaced, with any colour type."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    at, chunks = len(SIGNATURE), {}
    while at < len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        chunks[name] = chunks.get(name, b"") + data[at + 8 : at + 8 + size]
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    if depth != 8 or interlaced or colour not in SAMPLES:
        raise ValueError("only PNG files of 8 bits a sample that are not interlaced")
    step = SAMPLES[colour]
    pixels = _unfiltered(zlib.decompress(chunks[b"IDAT"]), height, width * step, step).reshape(height, width, step)
    out = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        out[..., :3] = np.frombuffer(chunks[b"PLTE"], np.uint8).reshape(-1, 3)[pixels[..., 0]]
        alpha = np.frombuffer(chunks.get(b"tRNS", b""), np.uint8)
        out[..., 3] = np.append(alpha, np.full(256 - len(alpha), 255, np.uint8))[pixels[..., 0]]
    else:
        out[..., :3] = pixels[..., :3] if step > 2 else pixels[..., :1]
        if colour in (4, 6):
            out[..., 3] = pixels[..., -1]
    return out


def read_png(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height and data (RGBA, row by row) of PNG files; ``error`` tells why one cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    image = decode_png(content.as_py())
                    row = (name, image.shape[1], image.shape[0], image.tobytes(), None)
                except (ValueError, KeyError, struct.error, zlib.error) as problem:
                    row = (name, None, None, None, str(problem))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["path", "width", "height", "data", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, width int, height int, data binary, error string")


def blank(width: int, height: int) -> Column:
    """A transparent image of a size."""
    return F.unhex(F.repeat(F.lit("00"), width * height * 4))


def region(images: DataFrame, x, y, width, height) -> DataFrame:
    """Images cut to a region, kept on the image: their new width, height and data."""
    x, y = G.clamp(x, 0, F.col("width")), G.clamp(y, 0, F.col("height"))
    w, h = F.least(width, F.col("width") - x), F.least(height, F.col("height") - y)
    named = images.withColumns({"from x": x.cast("int"), "from y": y.cast("int"), "new width": w.cast("int"), "new height": h.cast("int")})
    line = lambda n: F.hex(F.substr("data", ((F.col("from y") + n) * F.col("width") + F.col("from x")) * 4 + 1, F.col("new width") * 4))
    rows = F.array_join(F.transform(F.sequence(F.lit(0), F.col("new height") - 1), line), "")
    cut = F.when(F.col("new height") > 0, F.unhex(rows))
    return named.withColumn("data", cut).withColumns({"width": F.col("new width"), "height": F.col("new height")}).drop("from x", "from y", "new width", "new height")


def painted(images: DataFrame) -> DataFrame:
    """Images with ``painted``, how many of their pixels are not fully transparent."""
    alpha = F.transform(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), lambda k: F.hex(F.substr("data", k * 4 + 4, F.lit(1))) != "00")
    return images.withColumn("painted", F.when(F.col("width") * F.col("height") > 0, F.size(F.filter(alpha, lambda a: a))).otherwise(0))
