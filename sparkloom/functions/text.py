"""Text functions; character classes are parameters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

#: The class that is used unless another is given.
CJK = "一-鿿"
#: White space as scripts for the web define it.
BLANK = r"[\t-\r    -     　﻿]"
#: The marked forms of each vowel for tones 1 to 4.
VOWELS, MARKS = "aeiouü", "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜ"


def has_class(text, chars: str = CJK) -> Column:
    return F.col(text).rlike(f"[{chars}]") if isinstance(text, str) else text.rlike(f"[{chars}]")


def class_only(text, chars: str = CJK) -> Column:
    """The text without characters outside the class."""
    return F.regexp_replace(text, f"[^{chars}]", "")


def strip_blank(text) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def without_blank(text) -> Column:
    return F.regexp_replace(text, f"{BLANK}+", "")


def class_runs(text, chars: str = CJK) -> Column:
    """Maximal runs of characters in the class and outside of it, in order."""
    return F.regexp_extract_all(text, F.lit(f"[{chars}]+|[^{chars}]+"), F.lit(0))


def mark_syllable(syllable: Column) -> Column:
    """A numbered syllable with its tone mark: on a or e, else on the o of ou, else on the last of i, o, u, ü."""
    plain = lambda s: F.regexp_replace(F.regexp_replace(s, "u:", "ü"), "U:", "Ü")
    letters = plain(F.regexp_extract(syllable, "^([A-Za-zÜü:]+)[1-5]$", 1))
    tone = F.substring(syllable, -1, 1).try_cast("int")
    low = F.lower(letters)
    at = (
        F.when(low.rlike("[ae]"), F.length(F.regexp_extract(low, "^([^ae]*)", 1)))
        .when(low.contains("ou"), F.instr(low, "ou") - 1)
        .when(low.rlike("[iouü]"), F.length(F.regexp_extract(low, "^(.*)[iouü][^iouü]*$", 1)))
    )
    vowel = F.substr(letters, at + 1, F.lit(1))
    mark = F.substr(F.lit(MARKS), (F.instr(F.lit(VOWELS), F.lower(vowel)) - 1) * 4 + tone, F.lit(1))
    mark = F.when(vowel == F.lower(vowel), mark).otherwise(F.upper(mark))
    marked = F.concat(F.substr(letters, F.lit(1), at), mark, F.substr(letters, at + 2, F.length(letters)))
    return F.when(letters == "", plain(syllable)).when((tone == 5) | at.isNull(), letters).otherwise(marked)


def mark_pinyin(text: Column) -> Column:
    """Every numbered syllable in a text with its tone mark."""
    parts = F.regexp_extract_all(text, F.lit("[A-Za-zÜü:]+[1-5]|[A-Za-zÜü:]+|[^A-Za-zÜü:]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[A-Za-zÜü:]+[1-5]$"), mark_syllable(p)).otherwise(p)), "")


def _spread(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of texts, and of each character its code, text and place."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    places = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return lengths, codes, np.repeat(np.arange(len(texts)), lengths), places


def _edits_by_rows(label: str, text: str) -> int:
    """The table of edits, a row for each character of the label: for few long texts."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    row, steps = np.zeros(len(codes) + 1, np.int64), np.arange(len(codes) + 1)
    for n, c in enumerate(label, 1):
        best = np.empty_like(row)
        best[0] = n
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
        row = np.minimum.accumulate(best - steps) + steps
    return int(row.min())


def _edits_in_step(labels: list[str], texts: list[str], words: int) -> np.ndarray:
    """Columns of that table as differences in 64-bit words (Myers), all pairs a character at a time.

    Labels take ``words`` words each. A shorter text is filled up with a character
    that no label has, which never makes the least distance less.
    """
    size, codes, own, place = _spread(labels)
    letters = np.unique(codes)
    wide = len(letters) + 1
    masks = np.zeros((words, len(labels) * wide), np.uint64)
    np.bitwise_or.at(masks, (place // 64, own * wide + np.searchsorted(letters, codes)), np.uint64(1) << (place % 64).astype(np.uint64))
    lengths, codes, own, place = _spread(texts)
    number = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
    number[letters[number] != codes] = wide - 1
    columns = np.full((int(lengths.max(initial=0)), len(texts)), wide - 1, np.int32)
    columns[place, own] = number
    one, none = np.uint64(1), np.zeros(len(labels), np.uint64)
    up, down = np.full((words, len(labels)), ~np.uint64(0)), np.zeros((words, len(labels)), np.uint64)
    end, base = ((size - 1) % 64).astype(np.uint64), np.arange(len(labels)) * wide
    score, best = size.copy(), size.copy()
    for column in columns:
        at, more, less = base + column, none, none
        for w in range(words):
            same, p, m = masks[w].take(at), up[w], down[w]
            cross = same | m
            same = same | less
            level = (((same & p) + p) ^ p) | same
            rise, fall = m | ~(level | p), p & level
            if w == words - 1:
                score += ((rise >> end) & one).astype(np.int64) - ((fall >> end) & one).astype(np.int64)
            shifted, more = (rise << one) | more, rise >> np.uint64(63)
            lower, less = (fall << one) | less, fall >> np.uint64(63)
            up[w], down[w] = lower | ~(cross | shifted), shifted & cross
        np.minimum(best, score, out=best)
    return best


def substring_edits(labels: list[str], texts: list[str], together: int = 1024, cells: int = 1 << 22) -> np.ndarray:
    """For each pair the least edits that turn the label into some substring of the text.

    Pairs of like sizes are worked on together, ``cells`` table cells at most.
    """
    size, lengths = (np.fromiter(map(len, x), np.int64, len(x)) for x in (labels, texts))
    words = (size + 63) // 64
    out = np.zeros(len(labels), np.int64)
    order = np.lexsort((lengths, words))
    order = order[size[order] > 0]
    starts = np.flatnonzero(np.r_[True, words[order[1:]] != words[order[:-1]]]) if len(order) else []
    waiting = [part[k : k + together] for part in np.split(order, starts[1:]) for k in range(0, len(part), together)]
    while waiting:
        part = waiting.pop()
        n, w = len(part), int(words[part[0]])
        in_step = int(lengths[part].max()) * w * (1.5e-5 + n * 1.5e-8)
        by_rows = float((size[part] * (1e-5 + lengths[part] * 6e-9)).sum())
        own = [labels[i] for i in part]
        if n > 1 and n * max(w * (len(set().union(*own)) + 1), int(lengths[part].max())) > cells:
            waiting += [part[: n // 2], part[n // 2 :]]
        elif by_rows < in_step:
            out[part] = [_edits_by_rows(label, texts[i]) for label, i in zip(own, part)]
        else:
            out[part] = _edits_in_step(own, [texts[i] for i in part], w)
    return out


@F.pandas_udf(IntegerType())
def substring_distance(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Edits that turn a label into some substring of a text; null if either is null."""
    for labels, texts in pairs:
        out = pd.Series([None] * len(labels), dtype="Int32")
        known = np.flatnonzero(labels.notna() & texts.notna())
        out.iloc[known] = substring_edits(labels.iloc[known].tolist(), texts.iloc[known].tolist())
        yield out


@F.pandas_udf(ArrayType(LongType()))
def nearest_texts(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """For each label of an array the nearest text of another one, the first of equals: edits * 2^32 + its place."""

    def nearest(labels: list[str], texts: list[str]) -> list[int]:
        held = [next((k for k, text in enumerate(texts) if label in text), -1) for label in labels]
        rest = [label for label, k in zip(labels, held) if k < 0]
        edits = substring_edits([label for label in rest for _ in texts], texts * len(rest)).reshape(len(rest), len(texts))
        found = iter((int(row.min()) << 32) + int(row.argmin()) for row in edits)
        return [next(found) if k < 0 else k for k in held]

    for labels, texts in pairs:
        yield pd.Series([nearest(list(a), list(b)) for a, b in zip(labels, texts)], dtype=object)


def round_half_up(value: Column) -> Column:
    """floor(x + 0.5), also below zero."""
    return F.floor(value + F.lit(0.5))
