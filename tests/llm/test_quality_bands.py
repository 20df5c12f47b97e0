"""Bands recomputed plainly, and junk in part of a long text."""

import base64
import random

import pytest
import zstandard

from sparkloom.llm import quality

BANDS = quality.Bands()


def ratio(data):
    return len(data) / len(zstandard.ZstdCompressor(level=3).compress(data))


def limits(n, low, high):
    kind = sum(n >= edge for edge in BANDS.edges)
    return low[kind], high[kind]


def plain_verdict(text):
    """(ratio, share of bytes in chunks out of their band, whether the bands reject it)"""
    if not text:
        return None, None, False
    low, high = limits(len(text), BANDS.lowest, BANDS.highest)
    whole, outside = ratio(text), 0
    rest = text
    while rest:
        chunk, rest = rest[:2048], rest[2048:]
        chunk_low, chunk_high = limits(len(chunk), BANDS.chunk_lowest, BANDS.chunk_highest)
        outside += 0 if chunk_low <= ratio(chunk) <= chunk_high else len(chunk)
    return whole, outside / len(text), outside > 0.04 * len(text) or whole < low or whole > high


@pytest.fixture(scope="module")
def prose():
    draw = random.Random(3)
    words = ["".join(draw.choice("etaoinshrdlucmf") for _ in range(draw.randrange(2, 10))) for _ in range(4000)]
    return lambda n: " ".join(draw.choice(words[: draw.choice((200, 4000))]) for _ in range(n))


def test_bands_by_brute_force(spark, prose):
    draw = random.Random(4)
    noise = lambda n: base64.b64encode(draw.randbytes(n)).decode()
    texts = [None, "", "a", "ab " * 20, prose(10), prose(40), prose(300), prose(3000), prose(3000) + noise(2500), noise(9000), "buy now " * 700, prose(2000) + "buy now " * 300, "a" * 2048, "a" * 2049, prose(2000)[: 2048 * 3]]
    rows = {r.doc_id: r for r in quality.quality_figures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for k, text in enumerate(texts):
        whole, outside, rejected = plain_verdict((text or "").encode())
        assert (rows[k].zstd_ratio, rows[k].outside_share) == (pytest.approx(whole) if whole else whole, pytest.approx(outside) if outside is not None else None)
        assert rows[k].band_failed == rejected and rows[k].kept == (not rejected and not rows[k].base_failed)


@pytest.mark.parametrize("words", [3000, 20_000])
def test_junk_in_a_part_is_not_averaged_away(prose, words):
    draw, packer = random.Random(5), zstandard.ZstdCompressor(level=BANDS.level)
    clean = prose(words).encode()
    verdict = lambda data: quality.out_of_band(len(data), *quality.ratios(data, BANDS, packer), BANDS)
    assert not verdict(clean)
    for at in (0, len(clean) // 2, len(clean)):
        assert verdict(clean[:at] + base64.b64encode(draw.randbytes(len(clean) // 8)) + clean[at:])
        assert verdict(clean[:at] + b"buy now " * (len(clean) // 80) + clean[at:])


def test_odd_tables(spark):
    frame = spark.createDataFrame([(None, None, "x", 1.0), (1, "one", "y", 2.0), (1, "one", "y", 2.0)], "doc_id long, text string, kept string, zstd_ratio double")
    rows = quality.quality_figures(frame).collect()
    assert len(rows) == 3 and all(r.base_failed for r in rows)
    assert quality.reject_low_quality(frame).count() == 0 and quality.reject_low_quality(frame).columns == frame.columns
    assert quality.quality_figures(frame.limit(0)).count() == 0
