"""How much the sources of a language differ: in which terms a source stands out, and from which other sources.

Terms are counted in each task, summed by Spark by (language, source, term),
and kept if enough documents of their language have them. Each kept term gets a
smoothed share p of a source or language, a whole number of billionths, and two
shares differ by f(p, q) = floor((p - q)^2 / (p + q)).

The terms in which a source stands out are found by a dominance skyband. Where
p > q, f grows with the source's count and falls with the language's, and ties
go to the earlier term; so a term cannot be among the first k if k others have
a count at least as high in the source, at most as high in the language, and
come earlier in UTF-8. Each partition keeps the terms that fewer than k others
in it dominate; these skybands are merged, first in ``SLOTS`` parts of a source,
and what is left is ranked exactly.

All pairs of a language's sources are the result itself, so the sources of a
language (the square root of the rows that come out) are broadcast. Terms are
worked on in blocks of so many shares, pairs in tiles of sources (``Sizes``).

Null texts, languages and sources count as empty strings; a source without
terms is compared by its smoothed shares, all differences are 0 where a
language keeps no term. Long texts are taken whole; repeated rows count each.
Empty tables give no rows, a language's only source no pairs. Other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut

SCALE = 1_000_000_000
LEAST_DOCS, TOP = 10, 10
#: Parts of a source's skyband, and terms that are held against it together.
SLOTS, _BLOCK = 8, 256


@dataclass(frozen=True)
class Sizes:
    """What a task holds: ``entries`` counted before they are handed on, ``cells`` shares worked on together, ``tiles`` of ``tile`` by ``tile`` pairs. No result depends on them."""

    entries: int = 200_000
    cells: int = 1 << 20
    tile: int = 256
    tiles: int = 16


#: Letters lower-cased (only A-Z), all that is no term a space.
TERM_BYTE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

Sources = dict[str, tuple[list[str], np.ndarray, int]]


def term_counts(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """``n`` occurrences in ``docs`` documents of each (lang, source, term), from columns lang, source and body (bytes)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for batch in batches:
            for lang, source, body in zip(*(c.to_pylist() for c in batch.columns)):
                words = body.translate(TERM_BYTE).split()
                occurrences, documents = held[lang, source]
                size -= len(occurrences)
                occurrences.update(words)
                documents.update(set(words))
                size += len(occurrences)
                if size > sizes.entries:
                    yield from counted(held)
                    held.clear()
                    size = 0
        yield from counted(held)

    def counted(held) -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurrences, documents) in held.items():
            terms = list(occurrences)
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string())]
            columns += [pa.array(list(occurrences.values()), pa.int64()), pa.array(list(map(documents.get, terms)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    parts = docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """``lang``, ``term``, its count ``total`` in the language and its ``counts`` (source, n), for terms in enough documents."""
    listed = F.collect_list(F.struct("source", "n")).alias("counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), listed)
    return terms.where(F.col("docs") >= least_docs).drop("docs")


def shares(n: np.ndarray, total) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / total), exact; the caller has added twice the number of terms to ``total``."""
    if len(n) and int(n.max()) > 9_000_000_000:
        return (1 + SCALE * (n.astype(object) + 2) // total).astype(np.int64)
    return 1 + SCALE * (n + 2) // total


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _blocks(batch: pa.RecordBatch, sources: Sources, cells: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each language of a batch of ``kept_terms``: the rows, and the row, source number and n of each count, a block of rows at a time."""
    langs = np.array(batch.column(0).to_pylist(), object)
    counts = batch.column(3)
    lengths = np.diff(counts.offsets.to_numpy())
    entries = counts.flatten()
    names, n = np.array(entries.field(0).to_pylist(), object), entries.field(1).to_numpy()
    of_row = np.repeat(np.arange(len(langs)), lengths)
    for lang in dict.fromkeys(langs.tolist()):
        number = {s: k for k, s in enumerate(sources[lang][0])}
        rows = np.flatnonzero(langs == lang)
        step = max(1, cells // len(number))
        for at in range(0, len(rows), step):
            block = rows[at : at + step]
            mine = np.flatnonzero(np.isin(of_row, block))
            at_source = np.fromiter((number[s] for s in names[mine]), np.int64, len(mine))
            yield lang, block, np.searchsorted(block, of_row[mine]), at_source, n[mine]


def pair_sums(terms: DataFrame, sources, sizes: Sizes = Sizes()) -> DataFrame:
    """Partial sums ``value`` of the differences between two sources, (lang, source, item), both ways."""

    def emit(held) -> Iterator[pa.RecordBatch]:
        for (lang, left, right), sums in held.items():
            names = sources.value[lang][0]
            a, b = np.nonzero(np.ones(sums.shape, bool))
            a, b, value = a + left, b + right, sums.ravel()
            fits = a < b
            a, b, value = a[fits], b[fits], value[fits]
            one, two = [pa.array([names[k] for k in side], pa.string()) for side in (a, b)]
            for first, second in ((one, two), (two, one)):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), first, second, pa.array(value)], ["lang", "source", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], np.ndarray] = {}
        for batch in batches:
            for lang, block, row, source, n in _blocks(batch, sources.value, sizes.cells):
                names, totals, v = sources.value[lang]
                p = np.tile(shares(np.zeros(len(names), np.int64), totals + 2 * v), (len(block), 1))
                p[row, source] = shares(n, (totals + 2 * v)[source])
                for left in range(0, len(names), sizes.tile):
                    for right in range(left, len(names), sizes.tile):
                        tile, others = p[:, left : left + sizes.tile], p[:, right : right + sizes.tile]
                        sums = np.stack([difference(others, tile[:, k : k + 1]).sum(axis=0) for k in range(tile.shape[1])])
                        key = (lang, left, right)
                        held[key] = held[key] + sums if key in held else sums
                        if len(held) > sizes.tiles:
                            yield from emit(held)
                            held.clear()
        yield from emit(held)

    return terms.mapInArrow(run, "lang string, source string, item string, value long")


def skyband(up: np.ndarray, down: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The positions that fewer than k others dominate, with ``up`` no lower, ``down`` no higher and ``place`` earlier (places differ).

    In the order by these three, whatever dominates comes before. It is enough
    to count those that stay: of k that dominate, the first k all stay, as
    what dominates them dominates on.
    """
    order = np.lexsort((place, down, -up))
    kept = np.zeros(0, np.int64)
    for at in range(0, len(order), _BLOCK):
        block = order[at : at + _BLOCK]
        before = ((down[kept] <= down[block, None]) & (place[kept] < place[block, None])).sum(axis=1)
        block, before = block[before < k], before[before < k]
        inside = (down[block] <= down[block, None]) & (place[block] < place[block, None])
        kept = np.concatenate([kept, block[before + np.tril(inside, -1).sum(axis=1) < k]])
    return kept


COLUMNS = ["lang", "source", "item", "n", "total", "value"]


class Skybands:
    """The skyband of what a task has seen of each (lang, source)."""

    def __init__(self, k: int):
        self.k = k
        self.held: dict[tuple[str, str], tuple[np.ndarray, ...]] = {}

    def add(self, key: tuple[str, str], *columns: np.ndarray) -> None:
        """Further terms (item, n, total, value), with those that are held."""
        columns = tuple(np.concatenate(x) for x in zip(self.held[key], columns)) if key in self.held else columns
        place = np.empty(len(columns[0]), np.int64)
        place[sorted(range(len(place)), key=columns[0].__getitem__)] = np.arange(len(place))
        stays = skyband(columns[1], columns[2], place, self.k)
        self.held[key] = tuple(c[stays] for c in columns)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (item, *figures) in self.held.items():
            columns = [pa.array([x] * len(item), pa.string()) for x in (lang, source)] + [pa.array(item.tolist(), pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(f.astype(np.int64)) for f in figures], COLUMNS)


def local_skybands(terms: DataFrame, sources, k: int, sizes: Sizes = Sizes()) -> DataFrame:
    """Of each partition, the terms with p > q of each source that fewer than k others dominate, with their difference ``value``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Skybands(k)
        for batch in batches:
            items, all_totals = np.array(batch.column(1).to_pylist(), object), batch.column(2).to_numpy()
            for lang, block, row, source, n in _blocks(batch, sources.value, sizes.cells):
                names, totals, v = sources.value[lang]
                total = all_totals[block][row]
                p, q = shares(n, (totals + 2 * v)[source]), shares(total, int(totals.sum()) + 2 * v)
                for k_source in np.unique(source[p > q]):
                    at = np.flatnonzero((source == k_source) & (p > q))
                    bands.add((lang, names[k_source]), items[block][row[at]], n[at], total[at], difference(p[at], q[at]))
        yield from bands.batches()

    return terms.mapInArrow(run, "lang string, source string, item string, n long, total long, value long")


def merged_skybands(bands: DataFrame, k: int) -> DataFrame:
    """The skybands of the union of skybands, in ``SLOTS`` parts of each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Skybands(k)
        for batch in batches:
            lang, source, item = (np.array(c.to_pylist(), object) for c in batch.columns[:3])
            figures = [c.to_numpy() for c in batch.columns[3:]]
            for key in dict.fromkeys(zip(lang.tolist(), source.tolist())):
                at = np.flatnonzero((lang == key[0]) & (source == key[1]))
                out.add(key, item[at], *(f[at] for f in figures))
        yield from out.batches()

    slot = F.pmod(F.xxhash64("item"), F.lit(SLOTS))
    return bands.repartition("lang", "source", slot).mapInArrow(run, bands.schema)


def source_table(groups: DataFrame, terms: DataFrame) -> Sources:
    """Of each language: its sources, the occurrences of kept terms in each, and the number of kept terms. All pairs of these come out."""
    found = terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("v"))
    rows = groups.join(found, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["n", "v"]).collect()
    table = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.lang, r.source)):
        table[r.lang].append(r)
    return {lang: ([r.source for r in of], np.array([r.n for r in of], np.int64), of[0].v) for lang, of in table.items()}


def divergence_audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, sizes: Sizes = Sizes()) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value`` and ``rank``: the other sources by difference, and the ``top`` terms."""
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).cast("binary").alias("body"))
    groups = rows.select("lang", "source").distinct()
    terms = cut(kept_terms(term_counts(rows, sizes), least_docs))
    table = source_table(groups, terms)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    others = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = pair_sums(terms, shared, sizes).unionByName(others).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    standing_out = merged_skybands(local_skybands(terms, shared, top, sizes), top).select("lang", "source", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = ["lang", "source", "part", "item", "value", rank]
    best = standing_out.withColumn("part", F.lit("term")).select(*columns).where(F.col("rank") <= top)
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(best)
