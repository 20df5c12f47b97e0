"""A quality classifier from trusted positives and unlabelled text (positive-unlabelled learning).

Each text becomes ``WIDTH`` small whole numbers: shares of pairs of neighbouring
byte classes (lower case, digits, symbols, ...) and figures of its words and
lines. A linear score g is fitted by the non-negative unbiased risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),   l(z) = log(1 + exp(-z)),

where P are rows that a label calls good and U is all text of the folds that
may be learnt from, its labels unseen. If the second term falls below zero, the
fit has begun to call positives negative, and the step goes back along that
term alone. The share of good text in U is not given. After the first round it
is estimated by the least ratio of the two sides' tails above a threshold (best
bin), which needs no good fit but falls short a little; after later rounds it is
the share of U that the fit calls good.

Every step is one Spark job over all of U and P. Tasks return sums, steps are
Newton steps with the covariance as a fixed bound of the curvature. Features,
weights and what rows add are whole numbers of fixed scale, so that sums are
exact, and the model is the same however rows are dealt.

Null and empty texts have no words and get the score of their features like
any other. Long texts are taken whole. Repeated rows get equal scores; a null
id is never held out or labelled; a row with contradicting labels is not
trusted. Without trusted rows every score is 0.5. Empty tables give no rows.
Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import map_batches, stored, utf8

#: Classes of bytes; all others are one more.
CLASSES = (b" \t\r\v\f", b"\n", bytes(range(0x61, 0x7B)), bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A)), bytes(range(0x80, 0x100)), b".", b",", b"!?", b"|", b"#*$%&<>")
KINDS = len(CLASSES) + 1
WIDTH = KINDS * KINDS + 9
_KIND = np.full(256, KINDS - 1, np.uint8)
for _k, _chars in enumerate(CLASSES):
    _KIND[list(_chars)] = _k

#: Features are multiples of 1 / ONE, what a row adds to a sum of 1 / PART, weights of 1 / FINE; bytes classed at once.
ONE, PART, FINE, STEP = 1 << 12, 1 << 20, 1 << 24, 1 << 18
#: Labels of more trusted rows are joined by a shuffle.
BROADCAST_LABELS = 2_000_000


@dataclass(frozen=True)
class Fit:
    """Steps of the rounds (the prior is estimated anew after each but the last), the penalty on squared weights, the first prior, the confidence of the prior's bound."""

    steps: tuple[int, ...] = (8, 8, 16)
    penalty: float = 1e-3
    first_prior: float = 0.5
    doubt: float = 0.1


def text_features(text: bytes) -> np.ndarray:
    """``WIDTH`` whole numbers from 0 to 32767."""
    pairs = np.zeros(KINDS * KINDS, np.int64)
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw) - 1, STEP):
        kinds = _KIND[raw[at : at + STEP + 1]].astype(np.int16)
        pairs += np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts, n = Counter(words), len(words)
    figures = [
        np.log1p(n) / 16,
        len(counts) / max(n, 1),
        sum(map(bytes.__eq__, words, words[1:])) / max(n - 1, 1),
        max(counts.values(), default=0) / max(n, 1),
        len(set(lines)) / max(len(lines), 1),
        sum(map(len, words)) / max(n, 1) / 32,
        np.log1p(len(lines)) / 16,
        n / (n + 16),
        np.log1p(len(counts)) / 16,
    ]
    return np.minimum(np.rint(np.concatenate([np.sqrt(pairs / max(len(raw) - 1, 1)), figures]) * ONE), 32767).astype(np.int16)


def featured(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The id and ``features`` (16-bit numbers) of each row."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [text_features(v.as_py()).tobytes() for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], [id_column, "features"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(docs.select(id_column, utf8(text)), run, f"`{id_column}` {kind}, features binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """The features of a batch, a row each, as floats that hold whole numbers."""
    raw = np.frombuffer(column.buffers()[2], np.int16)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset] // 2 if len(column) else 0
    return raw[at : at + len(column) * WIDTH].reshape(len(column), WIDTH).astype(float)


def _softplus(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, g)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(g / 2))


@dataclass(frozen=True)
class Linear:
    """g = features @ weights / FINE + shift."""

    weights: np.ndarray
    shift: float

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.weights / FINE + self.shift  # whole numbers below 2^53 up to the division


def summed(rows: DataFrame, width: int, of_batch) -> tuple[np.ndarray, np.ndarray]:
    """The sums, over rows that are not ``trusted`` and over those that are, of the ``width`` whole numbers that ``of_batch`` gives for a matrix of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            trusted = batch.column(0).to_numpy(zero_copy_only=False)
            matrix = _matrix(batch.column(1))
            for side in (0, 1):
                mine = matrix[trusted == bool(side)]
                if len(mine):
                    total[side] += of_batch(mine)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total.ravel()[used])], ["slot", "part"])

    parts = rows.select("trusted", "features").mapInArrow(run, "slot int, part long")
    out = np.zeros(2 * width)
    for row in parts.groupBy("slot").agg(F.sum(F.col("part").cast("decimal(38)")).alias("total")).collect():  # a row a number
        out[row.slot] = float(row.total)
    return out[:width], out[width:]


def tail_prior(unlabelled: np.ndarray, trusted: np.ndarray, doubt: float) -> float:
    """The least upper bound, over thresholds, of the unlabelled share above it by the trusted share above it; from counts by score, ascending."""
    n_u, n_p = unlabelled.sum(), trusted.sum()
    above_u, above_p = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (unlabelled, trusted))
    room = np.sqrt(np.log(4 / doubt) / (2 * n_u)) + np.sqrt(np.log(4 / doubt) / (2 * n_p))
    some = above_p > 0
    best = np.argmin((above_u[some] + room) / above_p[some])
    return float(np.clip(above_u[some][best] / above_p[some][best], 0.01, 0.99))


def fit(rows: DataFrame, plan: Fit = Fit()) -> tuple[Linear, float]:
    """The model and the prior, from rows of ``trusted`` and ``features``, a stored frame that is read once for each step."""

    def moments(m: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(m)], m.sum(axis=0), (m.T @ m).ravel()]).astype(np.int64)

    of_u, of_p = summed(rows, 1 + WIDTH + WIDTH * WIDTH, moments)
    n_u, n_p = of_u[0], of_p[0]
    if not n_u or not n_p:
        return Linear(np.zeros(WIDTH), 0.0), plan.first_prior
    mean = of_u[1 : WIDTH + 1] / n_u
    spread = of_u[WIDTH + 1 :].reshape(WIDTH, WIDTH) / n_u - np.outer(mean, mean)
    scale = np.maximum(np.sqrt(np.maximum(np.diag(spread), 0)), ONE / 512)
    penalty = np.append(np.full(WIDTH, plan.penalty), 0.0)
    bound = np.zeros((WIDTH + 1, WIDTH + 1))
    bound[:WIDTH, :WIDTH] = spread / np.outer(scale, scale) / 4
    bound[WIDTH, WIDTH] = 0.25
    inverse = np.linalg.inv(bound + np.diag(penalty + 1e-6))

    def model(w: np.ndarray) -> Linear:
        fine = np.rint(w[:WIDTH] / scale * FINE)
        return Linear(fine, float(w[WIDTH] - fine @ mean / FINE))

    def standard(sums: np.ndarray, weight: float) -> np.ndarray:
        """The weighted sum of features, as that of standard scores and of the constant."""
        return np.append((sums - mean * weight) / scale, weight)

    mean_p = standard(of_p[1 : WIDTH + 1] / n_p, 1.0)

    def at_work(g: Linear):
        def of_batch(m: np.ndarray) -> np.ndarray:
            score = g(m)
            part = np.rint(_sigmoid(score) * PART)
            return np.concatenate([part @ m, [part.sum(), np.rint(_softplus(score) * PART).sum()]]).astype(np.int64)

        return of_batch

    def by_score(g: Linear):
        return lambda m: np.bincount(np.clip(np.floor(g(m) * 4), -200, 200).astype(np.int64) + 200, minlength=401)

    w, prior = np.zeros(WIDTH + 1), plan.first_prior
    for turn, steps in enumerate(plan.steps):
        best = (np.inf, w)
        for _ in range(steps):
            g = model(w)
            u, p = summed(rows, WIDTH + 2, at_work(g))
            slope_u, slope_p = standard(u[:WIDTH] / PART / n_u, u[WIDTH] / PART / n_u), standard(p[:WIDTH] / PART / n_p, p[WIDTH] / PART / n_p)
            as_negative_u, as_negative_p = u[-1] / PART / n_u, p[-1] / PART / n_p
            as_positive = as_negative_p - float(mean_p[:WIDTH] @ (g.weights * scale / FINE) + w[WIDTH])
            negative = as_negative_u - prior * as_negative_p
            risk = prior * as_positive + max(0.0, negative) + float(penalty @ w**2) / 2
            best = min(best, (risk, w), key=lambda x: x[0])
            step = slope_u - prior * mean_p + penalty * w if negative >= 0 else prior * slope_p - slope_u
            w = w - inverse @ step
        w = best[1]
        if turn + 1 < len(plan.steps):
            counts_u, counts_p = summed(rows, 401, by_score(model(w)))
            prior = float(np.clip(counts_u[200:].sum() / n_u, 0.01, 0.99)) if turn else tail_prior(counts_u, counts_p, plan.doubt)
    return model(w), prior


def held_out(id_column: str, folds: int = 3, fold: int = 1):
    """Whether the CRC-32 of the id as text leaves ``fold``."""
    return (F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds) == fold


def training_rows(marked: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``trusted`` and ``features``: all rows that are not held out, as unlabelled; and once more those that labels of ``id_column`` and ``quality`` call good."""
    mine = marked.where(~F.col("held_out"))
    good = labels.where(F.col(id_column).isNotNull() & ~held_out(id_column)).groupBy(id_column).agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
    good = good.where("least = 1 and most = 1").select(id_column)
    good = F.broadcast(good) if good.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS else good
    trusted = mine.where(F.col(id_column).isNotNull()).join(good, id_column, "left_semi")
    return mine.select(F.lit(False).alias("trusted"), "features").union(trusted.select(F.lit(True), "features"))


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", plan: Fit = Fit()) -> DataFrame:
    """The id, ``held_out``, ``score`` (that the text is good, in steps of a millionth) and ``predicted`` of each row."""
    marked = stored(featured(docs, text, id_column).select("*", held_out(id_column).alias("held_out")), "quality-features")
    g, _ = fit(stored(training_rows(marked, labels, id_column), "quality-training"), plan)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        score = np.round(_sigmoid(g(_matrix(batch.column(2)))), 6)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], [id_column, "held_out", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    scored = map_batches(marked.select(id_column, "held_out", "features"), run, f"`{id_column}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
