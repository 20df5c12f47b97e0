"""Lookup, crops, taps, boxes, states, messages, images and files on rows of our own."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import geometry as G
from sparkloom.operators import assets, evaluation, layout, lines, raster, spatial
from sparkloom.operators import text as words
from sparkloom.plans import queries
from sparkloom.sources import files, images, models
from sparkloom.streaming import messages, reducer

LEXICON = [("绿茶", 1, "lǜ chá", ["green tea"]), ("茶", 2, "chá", ["tea"]), ("行", 3, "háng", ["row"]), ("行", 4, "xíng", ["to go"]), ("王", 5, "Wáng", ["a name"]), ("王", 6, "wáng", ["king"])]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "word string, ord int, pinyin string, glosses array<string>")


def test_taps_find_words(spark, lexicon):
    taps = [(1, "绿茶行王", 1, ["lǜ", "chá", "xíng", "wáng"]), (2, "绿茶行王", 2, ["lǜ", "chá", "xíng", "wáng"]), (3, "绿茶行王", 3, ["lǜ", "chá", "xíng", "wáng"]), (4, "山", 0, ["shān"]), (5, "山", 1, ["shān"]), (6, None, 0, None)]
    rows = {r.tap: r for r in words.lookup_taps(spark.createDataFrame(taps, "tap int, run string, index int, readings array<string>"), lexicon).collect()}
    assert (rows[1].word, rows[1].start, rows[1].end, [e.glosses for e in rows[1].entries]) == ("绿茶", 0, 2, [["green tea"]])
    assert [e.pinyin for e in rows[2].entries] == ["xíng", "háng"] and [e.pinyin for e in rows[3].entries] == ["wáng", "Wáng"]
    assert (rows[4].word, rows[4].entries, rows[4].error) == ("山", [], None)
    assert rows[5].word is None and rows[5].entries is None and rows[5].error and rows[6].error


def test_annotated_lines(spark, lexicon):
    text = spark.createDataFrame([(1, "绿茶 Tea 山"), (2, "only letters"), (3, None), (4, "行")], "id int, text string")
    own = words.runs(text.where("text is not null"), "text").where("in_class").select("run").distinct()
    rows = {r.id: r.tokens for r in words.annotate_lines(text, words.first_readings(own, lexicon), ["id"]).collect()}
    assert set(rows) == {1, 4}
    assert [(t.text, t.in_class, [c.reading for c in t.chars]) for t in rows[1]] == [("绿茶", True, ["lǜ", "chá"]), (" Tea ", False, [None] * 5), ("山", True, [None])]
    assert [c.reading for c in rows[4][0].chars] == ["háng"]


def test_both_ways_to_segment_agree(spark, monkeypatch):
    draw = random.Random(2)
    own = ["".join(draw.choice("abc") for _ in range(draw.randrange(0, 30))) for _ in range(60)] + ["ab" * 1500]
    known = {"".join(draw.choice("abc") for _ in range(draw.randrange(1, 9))) for _ in range(60)} | {"abababababab"}
    run, lexicon = spark.createDataFrame([(r,) for r in own], "run string"), spark.createDataFrame([(w,) for w in known], "word string")
    spans = lambda: sorted(map(tuple, words.segment(run, lexicon).collect()))
    first = spans()
    monkeypatch.setattr(words, "BROADCAST_WORDS", 0)
    assert spans() == first
    expected = []
    for r in set(own):
        at = 0
        while at < len(r):
            end = next((e for e in range(min(len(r), at + 8), at + 1, -1) if r[at:e] in known), at + 1)
            expected.append((r, at, end, r[at:end]))
            at = end
    assert first == sorted(expected)


def test_gloss_steps_come_in_order(spark):
    glosses = ["at A|B|C[xi1] now", "see 山[shan1]", "one (CL:個|个[ge4]) two", "also pr. [shan4] here", "X|Y only", "variant of 山[shan1]", "CL:個|个[ge4]", ""]
    rows = spark.createDataFrame([(g,) for g in glosses], "g string").select(words.clean_gloss(F.col("g"))).collect()
    assert [r[0] for r in rows] == ["at C (xī) now", "", "one two", "also pr. [shàn] here", "Y only", "", "", ""]


def test_covered_entries_by_brute_force(spark):
    draw = random.Random(3)
    rows = [(draw.choice("xy"), k, [draw.choice("abcde") for _ in range(draw.randrange(0, 4))]) for k in range(80)]
    rows = [(w, k, sorted(set(g))) for w, k, g in rows]
    found = words.drop_covered(spark.createDataFrame(rows, "w string, k int, g array<string>"), ["w"], "k", "g")
    expected = [(w, k) for w, k, g in rows if not any(w == v and j != k and set(g) <= set(h) and (len(h) > len(g) or j < k) for v, j, h in rows)]
    assert sorted((r.w, r.k) for r in found.collect()) == sorted(expected) and found.columns == ["w", "k", "g"]


def test_covered_entries_of_which_most_are_copies(spark):
    # 60,000 equal entries: as pairs they would be 3.6e9 rows.
    copies = spark.range(60_000).selectExpr("'x' AS w", "cast(id + 5 AS int) AS k", "array('a', 'b') AS g")
    few = spark.createDataFrame([("x", 1, ["a"]), ("x", 2, ["c"]), ("x", 3, ["c"]), ("x", 4, []), ("y", 1, []), ("y", 2, None), (None, 3, ["a"]), (None, 4, ["a"])], "w string, k int, g array<string>")
    found = words.drop_covered(copies.union(few), ["w"], "k", "g").collect()
    assert sorted((str(r.w), r.k) for r in found) == [("None", 3), ("None", 4), ("x", 2), ("x", 5), ("y", 1), ("y", 2)]


def quads(rows):
    return [(*head, [tuple(map(float, p)) for p in quad]) for *head, quad in rows]


QUAD = "quad array<struct<x:double,y:double>>"


def test_crop_frames(spark):
    rows = quads([(1, [(10, 5), (50, 5), (50, 25), (10, 25)]), (2, [(10, 5), (20, 5), (20, 45), (10, 45)]), (3, [(1, 1), (1, 1), (1, 1), (1, 1)])])
    frame = spark.createDataFrame(rows, f"id int, {QUAD}").withColumn("f", G.crop_frame(F.col("quad")))
    found = {r.id: r for r in frame.withColumn("q", G.frame_quad(F.col("f"), F.lit(0.0), F.lit(10.0))).collect()}
    assert (found[1].f.width, found[1].f.height, found[1].f.vertical) == (40, 20, False) and [tuple(p) for p in found[1].q] == [(10, 5), (20, 5), (20, 25), (10, 25)]
    assert (found[2].f.width, found[2].f.height, found[2].f.vertical) == (40, 10, True) and [tuple(p) for p in found[2].q] == [(20, 5), (20, 15), (10, 15), (10, 5)]
    assert (found[3].f.width, found[3].f.height) == (1, 1)
    shuffled = spark.createDataFrame(quads([(1, [(50, 26), (10, 24), (50, 6), (10, 5)])]), f"id int, {QUAD}").select(G.ordered_quad(F.col("quad")).alias("q")).first().q
    assert [tuple(p) for p in shuffled] == [(10, 5), (50, 6), (50, 26), (10, 24)]


def test_warped_crop_is_the_cells_it_covers(spark):
    grid = [float(v) for v in range(30)]  # 5 wide, 6 high
    rows = quads([(grid, [(1, 1), (4, 1), (4, 3), (1, 3)])])
    out = raster.warp(spark.createDataFrame(rows, f"v array<double>, {QUAD}").withColumn("f", G.crop_frame(F.col("quad"))).withColumn("id", F.lit(1)), "v", 5, "f", ("id",))
    assert [r.value for r in out.orderBy("pix").collect()] == [6.0, 7.0, 8.0, 11.0, 12.0, 13.0]


def test_overlaps_and_taps_of_any_size_by_brute_force(spark):
    draw = random.Random(5)
    boxes = []
    for k in range(120):
        x, y, size = draw.uniform(0, 900), draw.uniform(0, 900), draw.choice([2, 10, 60, 4000])
        boxes.append((draw.choice("ab"), k, x, y, x + draw.uniform(1, size), y + draw.uniform(1, size)))
    frame = spark.createDataFrame(boxes, "g string, id int, x0 double, y0 double, x1 double, y1 double")
    found = sorted((r.first, r.second) for r in spatial.overlapping(frame, ["g"], "id", 16.0).collect())
    meet = lambda a, b: a[0] == b[0] and a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5]
    assert found == sorted((a[1], b[1]) for a in boxes for b in boxes if a[1] < b[1] and meet(a, b))
    points = [(k, draw.choice("ab"), draw.uniform(-50, 1500), draw.uniform(-50, 1500)) for k in range(80)]
    taps = spark.createDataFrame(points, "p int, g string, x double, y double")
    hits = {r.p: (r.id, r.inside) for r in spatial.hits(taps, frame.withColumn("ord", F.col("id")), ["g"], "p", "id", 22.0, 16.0).collect()}
    expected = {}
    for p, g, x, y in points:
        best = []
        for _, k, x0, y0, x1, y1 in (b for b in boxes if b[0] == g):
            inside, away = x0 <= x <= x1 and y0 <= y <= y1, float(np.hypot(x - (x0 + x1) / 2, y - (y0 + y1) / 2))
            if inside or away <= max(22.0, x1 - x0, y1 - y0):
                best.append((not inside, 0.0 if inside else away, k))
        if best:
            expected[p] = (min(best)[2], not min(best)[0])
    assert hits == expected


def test_region_mean_reads_only_its_cells(spark):
    cells = spark.createDataFrame([(1, x, y, float(x + 10 * y)) for x in range(20) for y in range(20)], "g int, x int, y int, value double")
    rects = spark.createDataFrame([(1, 1, 5.0, 5.0, 0.6, 0.8, -0.8, 0.6, 3.0, 2.0), (1, 2, 100.0, 5.0, 1.0, 0.0, 0.0, 1.0, 3.0, 2.0)], f"g int, comp int, {raster.RECT}")
    found = {r.comp: r["mean"] for r in raster.region_mean(rects, cells, ["g"]).collect()}
    inside = [x + 10 * y for x in range(20) for y in range(20) if abs((x - 5) * 0.6 + (y - 5) * 0.8) <= 3.5 and abs(-(x - 5) * 0.8 + (y - 5) * 0.6) <= 2.5]
    assert found[1] == pytest.approx(sum(inside) / len(inside)) and found[2] == 0.0


def test_strips_of_all_tries_are_those_of_the_layout():
    draw = random.Random(6)
    for vertical in (False, True):
        chars = []
        for k in range(5):
            x, y, w, h = draw.uniform(0, 50), draw.uniform(0, 50), draw.uniform(5, 30), draw.uniform(5, 30)
            chars.append((draw.choice(["shuāng", "a", None, ""]), [x, y, x + w, y + k, x + w, y + h, x, y + h]))
        every = layout.all_strips(chars, vertical)
        for n, (side, scale) in enumerate(layout.TRIES):
            assert every[n] == pytest.approx(layout.strips(layout.layout(chars, vertical, side, scale), vertical))


EVENTS = ("start", "progress", "engine-ready", "fatal", "freeze", "freeze", "scan-done", "scan-done", "scan-failed", "resume", "back", "show-card", "close-card", "toggle-readings", "open-about", "close-about", "dict-ready", "dict-failed", "notice", "dismiss-notice", "unknown")
SCHEMA = "k string, seq long, kind string, value double, message string, card string, line_count int, source string"


def app_events(n=400):
    draw = random.Random(8)
    pick = lambda: draw.choice(EVENTS) if draw.random() > 0.02 else "fatal"
    kinds = [k if k != "fatal" or draw.random() < 0.1 else "start" for k in (pick() for _ in range(n))]
    return [(draw.choice("aaab"), s, kind, draw.random(), draw.choice([None, f"m{s}"]), f"c{s}", draw.choice([None, 0, 3]), draw.choice(["camera", "engine", None])) for s, kind in enumerate(kinds)]


def expected_states(rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out = {}
    for row in sorted(rows, key=lambda r: r[1]):
        event = dict(zip(names, row))
        out[event["k"]] = reducer.reduced(out.get(event["k"], reducer.START), event)
    return out


def test_reducer_by_composition(spark, monkeypatch):
    monkeypatch.setattr(reducer, "CHUNK", 7)
    rows = app_events()
    found = {r.k: {f: r[f] for f in reducer.START} for r in reducer.reduce_events(spark.createDataFrame(rows, SCHEMA).repartition(5), "k", "seq").collect()}
    assert found == expected_states(rows)


def test_reducer_over_a_stream(spark, tmp_path):
    rows = app_events(120)
    for n, part in enumerate((rows[:60], rows[60:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = reducer.streamed_reducer(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "k", "seq")
        query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _, n=n: df.write.mode("overwrite").parquet(str(tmp_path / f"out{n}"))).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert {r.k: {f: r[f] for f in reducer.START} for r in spark.read.parquet(str(tmp_path / "out1")).collect()} == expected_states(rows)


def test_messages(spark):
    rows = spark.createDataFrame([("s", k, t) for k, t in enumerate(["scan", "init", "scan", "init", "lookup", "load", "lookup", "ping", None])], "s string, k int, type string")
    found = [(r.reply, r.engine) for r in messages.dispatched(rows, ["s"], "k").orderBy("k").collect()]
    assert found == [("error", 0), ("ready", 1), ("result", 1), ("ready", 2), ("error", 0), ("ready", 1), ("result", 1), ("error", None), ("error", None)]
    asked = spark.createDataFrame([("s", k, float(a), float(b)) for k, (a, b) in enumerate([(0, 10), (5, 6), (10, 12), (11, 30), (40, 41)])], "s string, k int, a double, b double")
    assert [(r.accepted, r.flight) for r in messages.one_at_a_time(asked, "s", "a", "b", "k").orderBy("k").collect()] == [(True, 0), (False, 0), (True, 2), (False, 2), (True, 4)]
    answers = spark.createDataFrame([("s", 0, 9.0), ("s", 2, 100.0)], "s string, k int, came double")
    out = messages.watched(asked.select("s", "k", "a"), answers, ["s"], "k", "a", "came", F.lit(15.0)).orderBy("k").collect()
    assert [(r.timed_out, r.worker) for r in out] == [(False, 0), (True, 0), (True, 1), (True, 2), (True, 3)]
    replies = messages.replied(asked, F.col("k") < 2, F.col("a"), F.lit("failed")).orderBy("k").collect()
    assert replies[0].reply.ok and replies[0].reply.error is None and replies[4].reply.error == "failed" and replies[4].reply.value is None


def test_loading(spark):
    tries = spark.createDataFrame([("f", k, k == 2) for k in range(4)] + [("g", k, False) for k in range(5)], "f string, k int, ok boolean")
    assert [(r.f, r.attempt, r.wait_ms) for r in messages.backoff(tries, ["f"], "k", "ok").orderBy("f", "k").collect()] == [("f", 1, 0.0), ("f", 2, 500.0), ("f", 3, 1000.0), ("g", 1, 0.0), ("g", 2, 500.0), ("g", 3, 1000.0)]
    chunks = spark.createDataFrame([("v", "a", 2, b"world"), ("v", "a", 1, b"hello "), ("v", "b", 3, b"\x00\xff")], "v string, f string, n int, data binary").withColumn("bytes", F.octet_length("data"))
    whole = {r.f: bytes(r.content) for r in messages.reassembled(chunks, ["v", "f"], "n", "data").collect()}
    assert whole == {"a": b"hello world", "b": b"\x00\xff"}
    sizes = spark.createDataFrame([("v", "a", 11), ("v", "b", 2)], "v string, f string, size int")
    assert [r.fraction for r in messages.progress(chunks, sizes, ["v"], "f", "n", "bytes").orderBy("n").collect()] == [pytest.approx(6 / 13), pytest.approx(11 / 13), 1.0]
    wanted = spark.createDataFrame([("a", 11, hashlib.sha256(b"hello world").hexdigest()), ("b", 3, "0")], "f string, size int, sha256 string")
    assert {r.f: r.sound for r in messages.verified(wanted, messages.reassembled(chunks, ["f"], "n", "data"), "f").collect()} == {"a": True, "b": False}
    calls = spark.createDataFrame([("good", hashlib.sha256(b"x").hexdigest()), ("bad", "0"), ("gone", "0")], "url string, sha256 string")

    def fetch(url):
        if url == "gone":
            raise OSError("no such file")
        return b"x"

    assert {r.url: (r.tried, r.content is not None, r.error) for r in models.fetch_verified(calls, fetch).collect()} == {"good": (1, True, None), "bad": (3, False, "another hash"), "gone": (3, False, "no such file")}


def png(pixels, filters, colour):
    height, width, step = pixels.shape
    above, raw = np.zeros((width, step), np.int64), b""
    for y in range(height):
        row = pixels[y].astype(np.int64)
        left = np.vstack([np.zeros((1, step), np.int64), row[:-1]])
        corner = np.vstack([np.zeros((1, step), np.int64), above[:-1]])
        p = left + above - corner
        far = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
        paeth = np.choose(far.argmin(axis=0), [left, above, corner])
        kind = filters[y % len(filters)]
        raw += bytes([kind]) + ((row - [0 * row, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_files(spark, tmp_path):
    draw = np.random.default_rng(1)
    for step, colour in ((1, 0), (3, 2), (2, 4), (4, 6)):
        pixels = draw.integers(0, 256, (10, 7, step)).astype(np.uint8)
        found = images.decode_png(png(pixels, (0, 1, 2, 3, 4), colour))
        assert (found[..., :3] == (pixels[..., :3] if step > 2 else pixels[..., :1])).all() and (found[..., 3] == (pixels[..., -1] if colour in (4, 6) else 255)).all()
    pixels[..., 3] = 0
    pixels[2, 3, 3] = 9
    (tmp_path / "a.png").write_bytes(png(pixels, (4,), 6))
    (tmp_path / "b.png").write_bytes(b"no image")
    rows = images.read_png(spark, str(tmp_path))
    assert sorted((r.width, r.height, r.error is None) for r in rows.where("error is null or width is null").collect() if r.width) == [(7, 10, True)]
    good = rows.where("error is null")
    cut = images.region(good, F.lit(2), F.lit(1), F.lit(3), F.lit(100)).first()
    assert (cut.width, cut.height) == (3, 9) and bytes(cut.data) == pixels[1:, 2:5].tobytes()
    assert images.painted(good).first().painted == 1
    assert spark.range(1).select(images.blank(2, 3).alias("b")).first().b == bytes(24)


def test_model_files(spark, tmp_path):
    field = lambda n, body: bytes([n << 3 | 2, len(body)]) + body
    onnx = field(14, field(1, b"character") + field(2, "山\n水\n".encode()))
    (tmp_path / "m.onnx").write_bytes(onnx)
    loaded = models.load_models(spark, str(tmp_path), spark.createDataFrame([("d", "m.onnx"), ("e", "gone.onnx")], "id string, file string"))
    assert {r.id: r.missing for r in loaded.collect()} == {"d": False, "e": True}
    contents = spark.createDataFrame([("a", bytearray(onnx)), ("b", bytearray(onnx)), ("c", bytearray(b"PostProcess: {character_dict: [1, 'x']}")), ("d", bytearray(b""))], "id string, content binary")
    readers = spark.createDataFrame([("a", "metadata", 2), ("b", "metadata", 3), ("c", "yaml", 2), ("d", "other", None)], "id string, source string, count int")
    found = {r.id: (r.characters, r.error is None) for r in models.read_character_lists(contents, readers).collect()}
    assert found == {"a": (["山", "水"], True), "b": (None, False), "c": (["1", "x"], True), "d": (None, False)}
    assets.write_manifest(contents.withColumn("kind", F.lit("rec")), "kind", "id", "content", str(tmp_path / "manifest"))
    row = spark.read.json(str(tmp_path / "manifest")).first()
    assert len(row.version) == 12 and [f.id for f in row.files] == list("abcd") and row.files[0].sha256 == hashlib.sha256(onnx).hexdigest()


def test_benchmark_rows(spark, tmp_path):
    a = spark.createDataFrame([("d1",), ("d2",)], "det string")
    assert assets.configurations(a, a.select(F.col("det").alias("rec")), spark.createDataFrame([(640,), (960,)], "side int")).count() == 8
    assert assets.wanted_kinds(a, "det", []).count() == 2 and assets.wanted_kinds(a, "det", ["d2"]).count() == 1
    found = evaluation.misses(spark.createDataFrame([("f", 1, "山水", "山", 1), ("f", 0, "茶", "", 1), ("f", 2, "x", "x", 0)], "f string, ord int, label string, text string, distance int"), ["f"]).first()
    assert found.misses == ["茶→∅", "山水→山"]
    rows = spark.createDataFrame([("one", 9, 10, 0.01, 5.0)], "config string, exact int, required int, mean_cer double, total_ms double")
    files.write_report(rows, str(tmp_path / "j"), str(tmp_path / "m"), "one")
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["| configuration | exact | mean CER | ms |", "|-|-|-|-|", "| one | 9/10 | 0.010 | 5 |", "Chosen: one"]
    given = files.options(spark.createDataFrame([(["--det=a,b", "--x=1"],), ([],)], "args array<string>"), "args", ["det", "rec"]).collect()
    assert [(r.det, r.rec) for r in given] == [(["a", "b"], None), (None, None)]
    (tmp_path / "o.json").write_text('{"one": {"n": 1}, "two": {"n": 2}}')
    assert sorted((r.name, r.value.n) for r in files.read_json_object(spark, str(tmp_path / "o.json"), "struct<n:int>").collect()) == [("one", 1), ("two", 2)]


def test_lines(spark):
    row = spark.createDataFrame(quads([([0.5, 1.0], 1.5, None, [(0, 0), (4, 1), (3, 9), (-1, 8)])]), f"p array<double>, a double, b double, {QUAD}")
    found = row.select(lines.confidence(F.col("p")).alias("c"), lines.confidence(F.slice("p", 1, 0)).alias("none"), lines.bounds(F.col("quad")).alias("box"), lines.total_time(["a", "b"]).alias("t"), lines.in_reading_order(F.array("quad", F.transform("quad", lambda q: F.struct((q["x"] + 5).alias("x"), q["y"].alias("y"))))).alias("ok"), lines.in_reading_order(F.array("quad", "quad")).alias("not_ok")).first()
    assert (found.c, found.none, tuple(found.box), found.t, found.ok, found.not_ok) == (0.75, 0.0, (-1, 0, 4, 9), 1.5, True, False)
    labels = spark.createDataFrame([(1, "a", 10.0, 20.0, 1.0, 2.0, False), (2, "b", 10.0, 20.0, 1.0, 2.0, True)], "id int, text string, font double, width double, x double, y double, halo boolean")
    drawn = lines.draw_commands(labels, ["id"], F.lit(2.0), F.lit(1.0), F.lit(0.0)).orderBy("id", "layer").collect()
    assert [(r.id, r.op, r.x, r.y, r["size"]) for r in drawn] == [(1, "strip", 3.0, 4.0, 40.0), (1, "text", 3.0, 4.0, 20.0), (2, "outlined text", 3.0, 4.0, 20.0)]


def test_pointers(spark):
    rows = [(1, 0, "down", 0, 0), (2, 0, "move", 5, 5), (3, 0, "move", 8, 9), (4, 1, "down", 8, 19), (5, 1, "move", 8, 29), (6, 0, "move", 8, -11), (7, 1, "up", 8, 29), (8, 0, "move", 9, 9), (9, 0, "move", 9, 10)]
    frame = spark.createDataFrame([("s", *r) for r in rows], "s string, n int, p int, kind string, x int, y int")
    found = [(r.n, r.dx, r.dy, r.ratio) for r in messages.pointer_moves(frame, "s", "n", "p", "kind", "x", "y").orderBy("n").collect()]
    assert found == [(2, None, None, None), (3, 3, 4, None), (5, None, None, None), (6, 0, -10, 2.0), (8, None, None, None), (9, 0, 1, None)]


def test_labels_inside_tokens(spark):
    labels = spark.createDataFrame([("f", 0, "bc"), ("f", 1, "zz"), ("g", 2, "a")], "f string, ord int, label string")
    tokens = spark.createDataFrame([("f", 3, "xbc", ["X", "B", "C"]), ("f", 1, "abcd", ["A", "B", None, "D"]), ("g", 0, "b", ["B"])], "f string, token_no int, text string, readings array<string>")
    assert [(r.ord, r.token_no, r.readings) for r in words.contained(labels, tokens, ["f"]).collect()] == [(0, 1, ["B", None])]


def test_taps_between_equal_centres_take_the_first_quad(spark):
    # Hypotenuses by another formula than roots of sums of squares tell such distances apart.
    draw = random.Random(8)
    given, taps, want = [], [], {}
    for k in range(300):
        x, y = draw.randrange(900, 1000) + draw.randrange(10) / 10, draw.randrange(97)
        for n, (sx, sy) in enumerate(draw.sample([(6.5, 0.0), (2.5, 6.0), (3.9, 5.2), (1.6, 6.3), (3.3, 5.6), (5.2, 3.9)], 2)):
            cx, cy = x + sx, y + sy
            given.append((str(k), 2 * k + n, [(cx - 0.1, cy - 0.1), (cx + 0.1, cy - 0.1), (cx + 0.1, cy + 0.1), (cx - 0.1, cy + 0.1)]))
        taps.append((k, str(k), x, float(y)))
        own = [(np.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), i) for _, i, q in given[-2:] for cx, cy in [((q[0][0] + q[2][0]) / 2, (q[0][1] + q[2][1]) / 2)]]
        want[k] = min(own)[1]
    frame = spark.createDataFrame([(g, i, [{"x": a, "y": b} for a, b in q]) for g, i, q in given], f"g string, id int, {QUAD}").withColumn("ord", F.col("id"))
    found = spatial.quad_hits(spark.createDataFrame(taps, "p int, g string, x double, y double"), frame, ["g"], "p", "id", 22.0, 32.0).collect()
    assert {r.p: r.id for r in found} == want and not any(r.inside for r in found)


def test_taps_on_piles_of_shapes_by_brute_force(spark):
    draw = random.Random(11)
    boxes, quads_ = [], []
    for k in range(400):
        x, y = draw.randrange(900, 960) + draw.randrange(10) / 10, float(draw.randrange(40))
        w, h, lean = float(draw.randrange(1, 51)), float(draw.randrange(1, 30)), float(draw.randrange(7))
        boxes.append(("a", k, x, y, x + w, y + h))
        quads_.append(("a", k, [(x, y), (x + w, y + lean), (x + w - lean, y + h + lean), (x - lean, y + h)]))
    points = [(k, "a", float(draw.randrange(860, 1060)), float(draw.randrange(-30, 90))) for k in range(500)] * 2
    points = [(k, *p[1:]) for k, p in enumerate(points)]
    taps = spark.createDataFrame(points, "p int, g string, x double, y double")
    away = lambda x, y, cx, cy: float(np.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)))

    def best(judged):
        found = [(not i, 0.0 if i else d, k) for k, i, d, far in judged if i or d <= far]
        return (min(found)[2], not min(found)[0]) if found else None

    frame = spark.createDataFrame(boxes, "g string, id int, x0 double, y0 double, x1 double, y1 double").withColumn("ord", -F.col("id"))
    hits = {r.p: (-r.id, r.inside) for r in spatial.hits(taps, frame, ["g"], "p", "id", 22.0, 16.0).collect()}
    want = {p: best([(-k, x0 <= x <= x1 and y0 <= y <= y1, away(x, y, (x0 + x1) / 2, (y0 + y1) / 2), max(22.0, x1 - x0, y1 - y0)) for _, k, x0, y0, x1, y1 in boxes]) for p, _, x, y in points}
    assert hits == {p: v for p, v in want.items() if v} and {v[1] for v in hits.values()} == {True, False}
    frame = spark.createDataFrame([(g, i, [{"x": a, "y": b} for a, b in q]) for g, i, q in quads_], f"g string, id int, {QUAD}").withColumn("ord", F.col("id"))
    hits = {r.p: (r.id, r.inside) for r in spatial.quad_hits(taps, frame, ["g"], "p", "id", 22.0, 32.0).collect()}

    def judge(k, q, x, y):
        sides = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for (ax, ay), (bx, by) in zip(q, q[1:] + q[:1])]
        far = max(22.0, away(*q[1], *q[0]), away(*q[3], *q[0]))
        return k, min(sides) >= 0 or max(sides) <= 0, away(x, y, (q[0][0] + q[2][0]) / 2, (q[0][1] + q[2][1]) / 2), far

    want = {p: best([judge(k, q, x, y) for _, k, q in quads_]) for p, _, x, y in points}
    assert hits == {p: v for p, v in want.items() if v}


def test_overlaps_are_counted_without_pairs(spark, monkeypatch):
    """A row for each box, also for copies, boxes without an inside, and keys with more events than a range holds."""
    draw = random.Random(4)
    rows = [(draw.choice(["g", "h", None]), k, *(float(draw.randrange(9)) for _ in range(4))) for k in range(300)]
    rows += [("g", 1000 + k, *rows[0][2:]) for k in range(5)] + [("g", 2000, None, 1.0, 1.0, 2.0), ("h", 2001, -0.0, 3.0, 0.0, 5.0), ("h", 2002, 0.0, 3.0, -0.0, 5.0)]
    met = lambda a, b: a[0] == b[0] and a[0] and None not in (*a[2:], *b[2:]) and a[2] < b[3] and b[2] < a[3] and a[4] < b[5] and b[4] < a[5]
    want = {a[1]: (min(b[1] for b in rows if (a[0], *a[2:]) == (b[0], *b[2:])), sum(a is not b and bool(met(a, b)) for b in rows)) for a in rows}
    frame = spark.createDataFrame(rows, "g string, id int, x0 double, x1 double, y0 double, y1 double")
    for bound in (100_000, 50):
        monkeypatch.setattr(spatial.ranges, "RANGE", bound)
        found = spatial.overlap_counts(frame, ["g"], "id").collect()
        assert len(found) == len(rows) and {r.id: (r.class_id, r.n_links) for r in found} == want
    assert spatial.overlap_counts(frame.limit(0), ["g"], "id").count() == 0


def test_overlap_pairs_names_both_boxes_of_every_pair(spark, tmp_path):
    """Also of boxes that are equal: a number of links would not tell which boxes are linked."""
    draw = random.Random(6)
    rows = [(k, f"Brand#{k % 2}", draw.randrange(1, 50), 900.0 + draw.randrange(200)) for k in range(1, 200)]
    rows += [(rows[0][0] + 97 * 194 * n, *rows[0][1:]) for n in (1, 2)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    meet = lambda a, b: a[1] == b[1] and a[3] < b[3] + b[2] and b[3] < a[3] + a[2] and abs(a[0] % 97 - b[0] % 97) < 8
    want = sorted((a[1], a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and meet(a, b))
    found = queries.QUERIES["overlap_pairs"](spark, str(tmp_path))
    assert found.columns == ["p_brand", "first", "second"] and sorted(tuple(r) for r in found.collect()) == want
    assert len(want) > 300 and {(rows[0][1], 1, 1 + 97 * 194), (rows[0][1], 1, 1 + 97 * 388)} <= set(want)


def _on_disk(spark, tmp_path, name, frame):
    frame.write.parquet(f"{tmp_path}/{name}")
    return spark.read.parquet(f"{tmp_path}/{name}")


def _plan(monkeypatch, run):
    """The whole plan of a query, as if nothing were stored between its steps, and no table of keys small enough to be broadcast."""
    monkeypatch.setattr(spatial, "materialized", lambda df: df)
    monkeypatch.setattr(spatial, "BROADCAST_KEYS", 0, raising=False)
    return run()._jdf.queryExecution().executedPlan().toString()


def test_taps_on_boxes_are_joined_by_shuffles(spark, monkeypatch, tmp_path):
    """Estimates go by the files' size, so that tables of any size would be broadcast through the driver."""
    boxes = _on_disk(spark, tmp_path, "boxes", spark.range(1000).selectExpr("'a' as g", "id", "id as ord", "id % 100 + 0.5D as x0", "id % 100 + 9D as x1", "id % 7 + 0D as y0", "id % 7 + 5D as y1"))
    taps = _on_disk(spark, tmp_path, "taps", spark.range(1000).selectExpr("id as p", "'a' as g", "id % 150 + 0D as x", "id % 30 + 0D as y"))
    run = lambda: spatial.hits(taps, boxes, ["g"], "p", "id", 22.0, 64.0)
    found = {tuple(r) for r in run().collect()}
    plan = _plan(monkeypatch, run)
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert found and {tuple(r) for r in run().collect()} == found


def test_taps_on_quads_are_joined_by_shuffles(spark, monkeypatch, tmp_path):
    point = lambda x, y: f"named_struct('x', id % 100 + {x}D, 'y', id % 7 + {y}D)"
    quad = f"array({point(0.5, 0)}, {point(9.5, 2)}, {point(8.5, 7)}, {point(-0.5, 5)}) as quad"
    shapes = _on_disk(spark, tmp_path, "quads", spark.range(1000).selectExpr("'a' as g", "id", "id as ord", quad))
    taps = _on_disk(spark, tmp_path, "taps", spark.range(1000).selectExpr("id as p", "'a' as g", "id % 150 + 0D as x", "id % 30 + 0D as y"))
    run = lambda: spatial.quad_hits(taps, shapes, ["g"], "p", "id", 22.0, 32.0)
    found = {tuple(r) for r in run().collect()}
    plan = _plan(monkeypatch, run)
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert found and {tuple(r) for r in run().collect()} == found
