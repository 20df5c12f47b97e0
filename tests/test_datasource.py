import gzip
import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.sources import datasource, images, models


def png(pixels):
    height, width = pixels.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def field(number, body):
    size, out = len(body), bytes([number << 3 | 2])
    while size >= 0x80:
        out, size = out + bytes([size & 0x7F | 0x80]), size >> 7
    return out + bytes([size]) + body


def model(entries, weights):
    entry = lambda k, v: field(models.METADATA, field(models.KEY, k.encode()) + field(models.VALUE, v.encode()))
    return b"\x08\x07" + field(7, bytes(weights)) + b"".join(entry(k, v) for k, v in entries.items()) + b"\x0d1234"


class Counted(io.BytesIO):
    """An open file that counts the bytes read."""

    got = 0

    def read(self, n=-1):
        data = super().read(n)
        self.got += len(data)
        return data

    def size(self):
        return len(self.getvalue())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("images")
    draw = np.random.default_rng(2)
    for k in range(9):
        (base / f"{'ab'[k % 2]}{k}.png").write_bytes(png(draw.integers(0, 256, (20 + k, 30, 4)).astype(np.uint8)))
    (base / "broken.png").write_bytes(b"no image")
    return str(base)


def test_images_as_a_source(spark, folder):
    datasource.register(spark)
    every = spark.read.format("png").option("partitionBytes", 6000).load(folder)
    assert every.rdd.getNumPartitions() > 3
    found = {r.path.rsplit("/", 1)[1]: r for r in every.collect()}
    plain = {r.path.rsplit("/", 1)[1]: r for r in images.read_png(spark, folder).collect()}
    assert len(found) == 10 and found["broken.png"].error == "not a PNG file"
    assert all((r.width, r.height, r.data) == (plain[n].width, plain[n].height, plain[n].data) for n, r in found.items())
    sizes = spark.read.format("png").schema("height int, path string").load(f"{folder}/a*.png")
    assert sorted(r.height for r in sizes.collect()) == [20, 22, 24, 26, 28]


def test_paths_are_tested_before_files_are_opened(spark, folder):
    datasource.register(spark)
    one = spark.read.format("png").load(folder).where(F.col("path").endswith("b1.png") & F.col("path").startswith(folder) & (F.col("height") > 3))
    assert [(r.height, r.error) for r in one.collect()] == [(21, None)] and one.rdd.getNumPartitions() == 1
    some = spark.read.format("png").load(folder).where(F.col("path").isin(f"{folder}/a0.png", f"{folder}/a2.png"))
    assert sorted(r.height for r in some.collect()) == [20, 22]


def test_bytes_that_are_read():
    data = png(np.random.default_rng(3).integers(0, 256, (200, 300, 4)).astype(np.uint8))
    from pyspark.sql.types import StructType

    options = {"path": "-"}
    for names, most in ((["path"], 0), (["width", "path"], datasource.PNG_HEADER), (["data"], len(data))):
        schema = StructType()
        for n in names:
            schema.add(n, "string")
        file = Counted(data)
        assert len(list(datasource.PngReader(schema, options).rows("-", file))) == 1 and file.got == most
    file = Counted(model({"character": "x\ny"}, 5_000_000))
    assert list(models.metadata_of_file(file)) == [("character", "x\ny")] and file.got < 60


def test_metadata_as_a_source(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "a.onnx").write_bytes(model({"character": "x\ny", "kind": "r"}, 100_000))
    (tmp_path / "b.onnx").write_bytes(model({"character": "z"}, 10)[:-9])
    (tmp_path / "c.onnx").write_bytes(field(7, b"12345")[:-2])
    found = spark.read.format("model_metadata").load(str(tmp_path)).collect()
    assert {(r.path[-6], r.key, r.value) for r in found if r.key} >= {("a", "character", "x\ny"), ("a", "kind", "r")}
    assert {r.path[-6] for r in found if r.error} == {"b", "c"}


def test_a_packed_dictionary(spark, tmp_path):
    from sparkloom.sources import files

    with gzip.open(tmp_path / "words.u8.gz", "wt") as out:
        out.write("# note\n好 好 [hao3] /good/\n")
    assert [r.line for r in files.read_lines(spark, str(tmp_path / "words.u8.gz")).collect()] == ["# note", "好 好 [hao3] /good/"]


def test_views_and_visitors(spark):
    from sparkloom.functions import geometry as G
    from sparkloom.operators import lines

    row = spark.range(1).select(G.css_transform(F.lit(1.5), F.lit(-20.25), F.lit(3.0)).alias("css"))
    assert row.first().css == "matrix(1.5, 0, 0, 1.5, -20.25, 3.0)"
    visits = spark.createDataFrame([("Mozilla/5.0 (iPhone; CPU)", False, False), ("Mozilla/5.0 (iPad)", True, False), ("iPod", False, True), ("Android", False, False)], "agent string, standalone boolean, hinted boolean")
    assert [r[0] for r in visits.select(lines.hint_install(F.col("agent"), F.col("standalone"), F.col("hinted"))).collect()] == [True, False, False, False]
