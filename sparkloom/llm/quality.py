"""Quality rules with compression bands.

A document is compressed with zstandard, once as a whole and once in fixed
chunks that do not see each other, its end included. Repetitive text compresses
too well and noise hardly at all, so each ratio must stay within a band. How
well clean text compresses depends on its length (a short text has no history
to refer to), therefore every band belongs to a length class, of documents and
of chunks alike. A document goes if its own ratio is out of its band or if
chunks out of theirs hold more than a set share of its bytes, so junk in part
of a long text does not hide in the mean.

Nulls and empty texts have no words and fail the base rule; they have no
ratios. Very long texts are many chunks. Repeated rows get equal results, one
each; there are no ties to break. An empty table gives no rows. Other columns
are not looked at, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import map_batches, utf8

SYMBOLS = tuple("#*$%&|<>".encode())
BLANKS = tuple(b" \t\n\v\f\r")
#: Rows that are given back at once.
ROWS_OUT = 1024


@dataclass(frozen=True)
class Bands:
    """Limits of bytes / compressed bytes.

    ``edges`` are the lengths in bytes at which the next class begins;
    ``lowest`` and ``highest`` hold the limits of whole documents, a value for
    each class, ``chunk_lowest`` and ``chunk_highest`` those of chunks.
    ``most_outside`` is the largest share of a document's bytes in chunks that
    are out of their band.
    """

    level: int = 3
    chunk_bytes: int = 2048
    edges: tuple[int, ...] = (64, 128, 256, 512, 1024, 2048, 4096, 16_384, 65_536, 524_288)
    lowest: tuple[float, ...] = (0.05, 0.75, 0.95, 1.15, 1.3, 1.4, 1.5, 1.55, 1.6, 1.6, 1.6)
    highest: tuple[float, ...] = (1.6, 1.9, 2.0, 2.05, 2.1, 2.2, 2.32, 2.5, 2.7, 3.1, 3.5)
    chunk_lowest: tuple[float, ...] = (0.05, 0.75, 0.95, 1.15, 1.3, 1.4, 1.5, 1.5, 1.5, 1.5, 1.5)
    chunk_highest: tuple[float, ...] = (1.6, 1.9, 2.05, 2.1, 2.15, 2.25, 2.35, 2.35, 2.35, 2.35, 2.35)
    most_outside: float = 0.04


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, zstd_ratio double, outside_share double, base_failed boolean, band_failed boolean, kept boolean"


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three that occurs at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = bytearray(len(words))
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered[at : at + 3] = b"\1\1\1"
    return sum(covered)


def base_figures(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    continuation = len(text) - len(text.decode("utf-8", "replace"))
    chars = len(text) - continuation - sum(map(text.count, BLANKS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def within(n_bytes: int, ratio: float, edges: tuple[int, ...], lowest: tuple[float, ...], highest: tuple[float, ...]) -> bool:
    kind = bisect_right(edges, n_bytes)
    return lowest[kind] <= ratio <= highest[kind]


def ratios(text: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float | None, float | None]:
    """Of the whole text, and the share of its bytes in chunks out of their band; None for an empty text."""
    if not text:
        return None, None
    whole, size, outside = len(text) / len(packer.compress(text)), bands.chunk_bytes, 0
    for at in range(0, len(text), size):
        chunk = text[at : at + size]
        if not within(len(chunk), len(chunk) / len(packer.compress(chunk)), bands.edges, bands.chunk_lowest, bands.chunk_highest):
            outside += len(chunk)
    return whole, outside / len(text)


def out_of_band(n_bytes: int, whole: float | None, outside: float | None, bands: Bands) -> bool:
    if whole is None or outside is None:
        return False
    return outside > bands.most_outside or not within(n_bytes, whole, bands.edges, bands.lowest, bands.highest)


def verdicts(bodies: pa.Array, bands: Bands) -> list[pa.Array]:
    """The columns of ``COLUMNS`` for texts given as UTF-8 bytes."""
    packer = zstandard.ZstdCompressor(level=bands.level)
    rows = []
    for value in bodies:
        body = value.as_py()
        n, chars, symbols, lines, repeats = base_figures(body)
        whole, outside = ratios(body, bands, packer)
        base = n < 50 or 100 * repeats > 50 * n
        band = out_of_band(len(body), whole, outside, bands)
        rows.append((n, chars, symbols, lines, repeats, whole, outside, base, band, not (base or band)))
    kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 3
    return [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]


def quality_figures(docs: DataFrame, text: str = "text", id_column: str = "doc_id", bands: Bands = Bands()) -> DataFrame:
    """The id and, for each row, the figures and verdicts in ``COLUMNS``."""
    names = [x.split()[0] for x in COLUMNS.split(", ")]

    def judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), *verdicts(batch.column(1), bands)], [id_column, *names])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(docs.select(id_column, utf8(text)), judge, f"`{id_column}` {kind}, {COLUMNS}")


def reject_low_quality(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs``, unchanged, that pass the base rule and the bands."""

    def passing(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, ROWS_OUT):  # so that few rows are held twice
            part = batch.slice(start, ROWS_OUT)
            bodies = part.column(part.num_columns - 1) if at is None else part.column(at).fill_null("").cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays(part.columns[: len(docs_columns)], docs_columns).filter(verdicts(bodies, bands)[-1])

    docs_columns = docs.columns
    # A text that is a string anyway is sent once.
    at = next((k for k, f in enumerate(docs.schema) if f.name == text and f.dataType.simpleString() == "string"), None)
    kept = [F.col(f"`{c}`").alias(f"kept {k}") for k, c in enumerate(docs_columns)]
    return map_batches(docs.select(*kept, *([utf8(text).alias("body")] if at is None else [])), passing, docs.schema)
