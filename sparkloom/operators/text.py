"""Runs, lexicons, longest-match segmentation, lookup and annotation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.storage import materialized

LONGEST_WORD = 8
#: Lexicons of up to so many words are broadcast; larger ones are joined by a shuffle.
BROADCAST_WORDS = 500_000
#: Of a path's cost with its number of words: bits of the latter.
WORDS_BITS = 40


def runs(docs: DataFrame, text: str, chars: str = T.CJK, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each run of a text: run_no, run, in_class."""
    out = docs.select(*keep, F.posexplode(T.class_runs(F.col(text), chars)).alias("run_no", "run"))
    return out.withColumn("in_class", T.has_class("run", chars))


def runs_in_class(docs: DataFrame, text: str, chars: str = T.CJK) -> DataFrame:
    """A row for each run of characters of the class alone."""
    return docs.select(F.explode(F.regexp_extract_all(text, F.lit(f"[{chars}]+"), F.lit(0))).alias("run"))


def _spans_by_broadcast(words: DataFrame, lexicon: DataFrame, longest: int) -> DataFrame:
    known = words.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in lexicon.collect()))

    @F.pandas_udf("array<int>")
    def cuts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = []
            for run in batch:
                at, ends = 0, []
                while at < len(run):
                    end = next((e for e in range(min(len(run), at + longest), at + 1, -1) if run[at:e] in known.value), at + 1)
                    ends.append(end)
                    at = end
                rows.append(ends)
            yield pd.Series(rows)

    return words.select("run", cuts("run").alias("ends"))


def _spans_by_join(words: DataFrame, lexicon: DataFrame, longest: int) -> DataFrame:
    """Candidates of two characters and more are looked up by a join that keeps the longest for each start."""
    n = F.length("run")
    starts = words.select("run", F.explode(F.sequence(F.lit(1), n)).alias("at")).where(F.col("at") < n)
    candidates = starts.select("run", "at", F.explode(F.sequence(F.lit(2), F.least(F.lit(longest), n - F.col("at") + 1))).alias("size"))
    candidates = candidates.withColumn("word", F.expr("substring(run, at, size)"))
    found = candidates.join(lexicon, "word", "left_semi").groupBy("run", "at").agg(F.max("size").alias("size"))
    steps = found.groupBy("run").agg(F.collect_list(F.struct("at", "size")).alias("steps"))

    @F.pandas_udf("array<int>")
    def cuts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sizes, steps_ in batches:
            rows = []
            for size, own in zip(sizes, steps_):
                jump = {} if own is None else {x["at"] - 1: x["size"] for x in own}
                at, ends = 0, []
                while at < size:
                    at += jump.get(at, 1)
                    ends.append(at)
                rows.append(ends)
            yield pd.Series(rows)

    return words.join(steps, "run", "left").select("run", cuts(n, "steps").alias("ends"))


def segment(words: DataFrame, lexicon: DataFrame, longest: int = LONGEST_WORD) -> DataFrame:
    """Forward longest match of the distinct ``run``: start, end (exclusive) and word of each segment.

    A character without a match is a segment of its own. Time is linear in a
    run's length. Null runs have no segments.
    """
    return _spans_of_ends(_longest_ends(words, lexicon, longest))


def _longest_ends(words: DataFrame, lexicon: DataFrame, longest: int) -> DataFrame:
    words = words.select("run").where("run is not null").distinct()
    lexicon = lexicon.select("word").where(F.length("word").between(2, longest)).distinct()
    small = lexicon.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    return (_spans_by_broadcast if small else _spans_by_join)(words, lexicon, longest)


def lookup_taps(taps: DataFrame, lexicon: DataFrame, tap: str = "tap", longest: int = LONGEST_WORD) -> DataFrame:
    """The word under each tap (tap, run, index, readings of the run's characters) with its entries.

    ``entries`` (pinyin, glosses) come by how well their reading fits, then in
    file order (``ord``); none for a word that the lexicon (word, ord, pinyin,
    glosses) doesn't have. An index outside the run gives nulls and an ``error``.
    """
    spans = segment(taps, lexicon, longest)
    under = (taps["run"] == spans["run"]) & (taps["index"] >= spans["start"]) & (taps["index"] < spans["end"])
    reading = T.without_blank(F.array_join(F.slice("readings", F.col("start") + 1, F.col("end") - F.col("start")), ""))
    found = taps.join(spans, under, "left").select(tap, "word", "start", "end", reading.alias("reading"))
    fits = fit_of(F.col("pinyin"), F.col("reading"))
    entry = F.struct(fits.alias("fit"), F.col("ord"), F.col("pinyin"), F.col("glosses"))
    joined = found.join(lexicon.select("word", "ord", "pinyin", "glosses"), "word", "left")
    grouped = joined.groupBy(tap, "word", "start", "end").agg(F.array_sort(F.collect_list(F.when(F.col("ord").isNotNull(), entry))).alias("entries"))
    shown = F.when(F.col("word").isNotNull(), F.transform("entries", lambda e: F.struct(e["pinyin"], e["glosses"])))
    return grouped.select(tap, "word", "start", "end", shown.alias("entries"), F.when(F.col("word").isNull(), "no character there").alias("error"))


def least_path(size: int, into: dict[int, list[tuple[int, int]]]) -> list[int]:
    """Ends of the words of the cheapest path from 0 to ``size``; ``into`` has the (start, cost) of the words that end at a place.

    Of equal costs the fewer words, then the longer last word.
    """
    best: list[tuple[int, int, int]] = [(0, 0, 0)]
    for end in range(1, size + 1):
        best.append(min((best[start][0] + cost, best[start][1] + 1, start) for start, cost in into[end]))
    ends, at = [], size
    while at:
        ends.append(at)
        at = best[at][2]
    return ends[::-1]


def _paths_by_broadcast(words: DataFrame, costs: DataFrame, unknown: int, longest: int) -> DataFrame:
    known = words.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in costs.collect()})

    @F.pandas_udf("array<int>")
    def cuts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cost = known.value
        for batch in batches:
            rows = []
            for run in batch:
                # Cost and number of words in one number, the cost first; of equal ones the earliest start.
                best, before = [0], []
                for end in range(1, len(run) + 1):
                    least, begin = best[-1] + (cost.get(run[end - 1], unknown) << WORDS_BITS), end - 1
                    for start in range(end - 2, max(0, end - longest) - 1, -1):
                        own = cost.get(run[start:end])
                        if own is not None and (own := best[start] + (own << WORDS_BITS)) <= least:
                            least, begin = own, start
                    best.append(least + 1)
                    before.append(begin)
                ends, at = [], len(run)
                while at:
                    ends.append(at)
                    at = before[at - 1]
                rows.append(ends[::-1])
            yield pd.Series(rows)

    return words.select("run", cuts("run").alias("ends"))


def _paths_by_join(words: DataFrame, costs: DataFrame, unknown: int, longest: int) -> DataFrame:
    n = F.length("run")
    starts = words.select("run", F.explode(F.sequence(F.lit(1), n)).alias("at"))
    pieces = starts.select("run", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("at") + 1))).alias("size")).withColumn("word", F.expr("substring(run, at, size)"))
    found = pieces.join(costs, "word").groupBy("run").agg(F.collect_list(F.struct("at", "size", "cost")).alias("edges"))

    @F.pandas_udf("array<int>")
    def cuts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sizes, edges in batches:
            rows = []
            for size, own in zip(sizes, edges):
                into: dict[int, list[tuple[int, int]]] = {end: [] for end in range(1, size + 1)}
                for x in [] if own is None else own:
                    into[x["at"] - 1 + x["size"]].append((x["at"] - 1, x["cost"]))
                for end, words_ in into.items():
                    if all(start != end - 1 for start, _ in words_):
                        words_.append((end - 1, unknown))
                rows.append(least_path(size, into))
            yield pd.Series(rows)

    return words.join(found, "run", "left").select("run", cuts(n, "edges").alias("ends"))


def segment_by_cost(words: DataFrame, costs: DataFrame, unknown: int, longest: int = LONGEST_WORD) -> DataFrame:
    """As ``segment``, but the words of a run are those whose costs (word, cost: whole numbers) add up to least, of all ways to read it.

    A character that is no word costs ``unknown``. Of equal costs the fewer
    words count, then, from the end, the longer ones. Time is linear in a run's
    length. Of a word with several costs the least counts.
    """
    return _spans_of_ends(_cheapest_ends(words, costs, unknown, longest))


def _cheapest_ends(words: DataFrame, costs: DataFrame, unknown: int, longest: int) -> DataFrame:
    words = words.select("run").where("run is not null").distinct()
    costs = costs.where(F.length("word").between(1, longest)).groupBy("word").agg(F.min("cost").cast("long").alias("cost"))
    small = costs.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    return (_paths_by_broadcast if small else _paths_by_join)(words, costs, unknown, longest)


def _spans_of_ends(found: DataFrame) -> DataFrame:
    spans = found.select("run", F.posexplode("ends").alias("k", "end"), "ends")
    spans = spans.select("run", F.when(F.col("k") == 0, 0).otherwise(F.get("ends", F.col("k") - 1)).alias("start"), "end")
    return spans.withColumn("word", F.expr("substring(run, start + 1, end - start)"))


def _read(found: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Readings of the runs that have words with these ``ends``."""
    first = lexicon.groupBy("word").agg(F.min_by("pinyin", "ord").alias("pinyin"))
    parts = F.split(T.strip_blank(F.col("pinyin")), f"{T.BLANK}+")
    first = first.select("word", parts.alias("parts")).where(F.size("parts") == F.length("word"))
    return (_read_by_broadcast if first.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else _read_by_join)(found, first)


def _read_by_broadcast(found: DataFrame, first: DataFrame) -> DataFrame:
    known = found.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in first.collect()})

    @F.pandas_udf("array<string>")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for runs_, ends in batches:
            rows = []
            for run, own in zip(runs_, ends):
                at, out = 0, []
                for end in own:
                    out += known.value.get(run[at:end]) or run[at:end]
                    at = end
                rows.append(out)
            yield pd.Series(rows)

    return found.where(F.size("ends") > 0).select("run", read("run", "ends").alias("readings"))


def _read_by_join(found: DataFrame, first: DataFrame) -> DataFrame:
    spans = _spans_of_ends(found).join(first, "word", "left")
    own = F.coalesce("parts", F.slice(F.split("word", ""), F.lit(1), F.length("word")))
    listed = spans.select("run", "start", own.alias("own")).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("start", "own"))).alias("all"))
    return listed.select("run", F.flatten(F.transform("all", lambda x: x["own"])).alias("readings"))


def first_readings(runs_: DataFrame, lexicon: DataFrame, longest: int = LONGEST_WORD) -> DataFrame:
    """A reading for each character of the distinct ``run``: from the first entry of its word, the character itself where none has one for each."""
    return _read(_longest_ends(runs_, lexicon, longest), lexicon)


def context_readings(runs_: DataFrame, lexicon: DataFrame, costs: DataFrame, unknown: int, longest: int = LONGEST_WORD) -> DataFrame:
    """The same with the words of the cheapest way to read the whole run, so that a character is read as its neighbours on both sides suggest."""
    return _read(_cheapest_ends(runs_, costs, unknown, longest), lexicon)


def annotate_lines(lines: DataFrame, readings: DataFrame, keys: list[str], chars: str = T.CJK) -> DataFrame:
    """Lines with a character of the class, their runs as ``tokens``: text, in_class and for each character ch and reading.

    ``readings`` (run, readings) is an input, so that any source of readings
    serves; a reading that only repeats its character is none.
    """
    kept = lines.where(T.has_class("text", chars))
    parts = runs(kept, "text", chars, tuple(keys))
    joined = parts.join(readings, (F.col("in_class")) & (parts["run"] == readings["run"]), "left").drop(readings["run"])
    char = lambda c, k: F.struct(c.alias("ch"), F.when(F.col("in_class"), F.nullif(F.get("readings", k), c)).alias("reading"))
    letters = F.transform(F.slice(F.split("run", ""), F.lit(1), F.length("run")), char)
    token = F.struct("run_no", F.col("run").alias("text"), "in_class", letters.alias("chars"))
    tokens = joined.groupBy(*keys).agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    return kept.join(tokens.withColumn("tokens", F.transform("tokens", lambda t: t.dropFields("run_no"))), keys)


def contained(labels: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """For each label (keys, ord, label) the first token (keys, token_no, text, readings) of its key that holds it, and the readings of its characters there."""
    named = tokens.select(*(F.col(k).alias(f"own {k}") for k in keys), "token_no", "text", "readings")
    same = [labels[k] == named[f"own {k}"] for k in keys]
    pairs = labels.join(named, [*same, F.col("text").contains(F.col("label"))])
    found = F.struct("token_no", F.slice("readings", F.instr("text", F.col("label")), F.length("label")).alias("readings"))
    best = pairs.groupBy(*keys, "ord", "label").agg(F.min_by(found, "token_no").alias("first token"))
    return best.select(*keys, "ord", "label", "first token.token_no", "first token.readings")


def fit_of(reading, wanted):
    """0 if two readings agree, 1 if they do but for case, else 2; white space doesn't count."""
    reading, wanted = T.without_blank(reading), T.without_blank(wanted)
    return F.when(reading == wanted, 0).when(F.lower(reading) == F.lower(wanted), 1).otherwise(2)


def rank_entries(entries: DataFrame, word: str, reading: str, wanted: str, order: str) -> DataFrame:
    """Entries of each word by how well their reading fits: equal, equal without case, other; then in file order."""
    fit = fit_of(F.col(reading), F.col(wanted))
    at = Window.partitionBy(word, wanted).orderBy(fit, order)
    return entries.withColumn("fit", fit).withColumn("place", F.row_number().over(at))


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Dictionary lines ``traditional simplified [pinyin] /gloss/gloss/`` as columns; others are left out."""
    solid = T.BLANK.replace("[", "[^", 1)
    pattern = rf"^({solid}+) ({solid}+) \[([^\]]*)\] /(.*)/{T.BLANK}*$"
    part = lambda k: F.regexp_extract(line, pattern, k)
    rows = lines.where(F.col(line).rlike(pattern))
    return rows.withColumns({"traditional": part(1), "simplified": part(2), "pinyin": T.mark_pinyin(part(3)), "glosses": F.split(part(4), "/")})


#: Fixed values of the dictionary's format: what a word in a reference is made of, and notes that only point elsewhere.
NAME = r"[^\s|\[\]/,;()]+"
VARIANT = "(?:old |archaic |Japanese |Taiwan )?variant of "


def _replaced(text, pattern: str, shown):
    """The text with each match of the pattern shown otherwise; other pieces stay."""
    pieces = F.split(text, pattern, -1)
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), shown)
    both = F.zip_with(pieces, matches, lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    return F.array_join(both, "")


def clean_gloss(gloss):
    """A gloss as a reader should see it, empty if nothing is left.

    In this order: asides go, references show their simplified word with its
    reading, bare readings get tone marks, and of two forms the second stays.
    """
    kept = F.regexp_replace(gloss, rf"{T.BLANK}*\((CL:|{VARIANT})[^)]*\)", "")
    reading = lambda m: T.mark_pinyin(F.regexp_extract(m, r"\[([^\]]+)\]$", 1))
    named = _replaced(kept, rf"(?:{NAME}\|)?{NAME}\[[^\]]+\]", lambda m: F.concat(F.regexp_extract(m, rf"^(?:{NAME}\|)?({NAME})\[", 1), F.lit(" ("), reading(m), F.lit(")")))
    marked = _replaced(named, r"\[[^\]]+\]", lambda m: F.concat(F.lit("["), reading(m), F.lit("]")))
    clean = T.strip_blank(F.regexp_replace(marked, rf"{NAME}\|({NAME})", "$1"))
    return F.when(gloss.rlike(rf"^{VARIANT}|^see [^/]*\[|^CL:"), "").otherwise(clean)


def drop_covered(entries: DataFrame, keys: list[str], order: str, glosses: str) -> DataFrame:
    """Entries whose glosses do not all appear in another entry of the group that has more, or as many and comes first.

    Entries with the same glosses are one, of which the first may stay.
    Candidates among those are looked up by the rarest gloss in the group, so
    they grow with the different sets that have it, not with the group.
    """
    known = F.col(glosses).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    own = {"own glosses": F.array_sort(F.array_distinct(glosses)), "own size": F.size(glosses)}
    sets = materialized(entries.where(known).groupBy(*keys, *(v.alias(k) for k, v in own.items())).agg(F.min(order).alias("own order"), F.max(order).alias("own last")))
    each = sets.withColumn("gloss", F.explode("own glosses"))
    counts = each.groupBy(*keys, "gloss").agg(F.count("*").alias("copies"))
    rarest = each.join(counts, [*keys, "gloss"]).groupBy(*keys, "own order", "own glosses", "own size").agg(F.min_by("gloss", F.struct("copies", "gloss")).alias("gloss"))
    others = each.withColumnsRenamed({f"own {c}": f"other {c}" for c in ("order", "last", "glosses", "size")})
    another = (F.col("other order") != F.col("own order")) | (F.col("other last") != F.col("own order"))
    better = ((F.col("other size") > F.col("own size")) & another) | (F.col("other order") < F.col("own order"))
    pairs = rarest.join(others, [*keys, "gloss"]).where(better & (F.size(F.array_except("own glosses", "other glosses")) == 0))
    covered = pairs.select(*keys, "own order", "own glosses", "own size").distinct()
    # An entry without glosses is covered by any that has some, or by an earlier one.
    group = sets.groupBy(*keys).agg(F.max("own size").alias("most"), F.min("own order").alias("earliest"))
    bare = sets.where("`own size` = 0").join(group, keys).where("most > 0 or earliest < `own order`").select(*keys, "own order", "own glosses", "own size")
    stay = sets.join(covered.unionByName(bare), [*keys, "own order", "own glosses", "own size"], "left_anti").select(*keys, F.col("own order").alias(order))
    return entries.where(known).join(stay, [*keys, order], "left_semi").select(*entries.columns).unionByName(entries.where(~known))


def compact_dictionary(lines: DataFrame, line: str = "line", order: str = "line_no", most: int = 3) -> DataFrame:
    """Word, pinyin and shown glosses of dictionary lines, groups in order of first appearance."""
    parsed = parse_lines(lines, line)
    kept = F.filter(F.transform("glosses", clean_gloss), lambda g: g != "")
    shown = parsed.withColumn("glosses", kept).where(F.size("glosses") > 0).select(order, F.col("simplified").alias("word"), "pinyin", F.slice("glosses", 1, most).alias("glosses"))
    groups = shown.groupBy("word", "pinyin").agg(F.min(order).alias("group_no"))
    return drop_covered(shown, ["word", "pinyin"], order, "glosses").join(groups, ["word", "pinyin"])


def good_lines(lines: DataFrame, text: str = "text", score: str = "score", least: float = 0.5) -> DataFrame:
    """Lines that score ``least`` or more and are not blank."""
    return lines.where((F.col(score).cast("double") >= least) & (T.strip_blank(F.col(text)) != ""))


def card_views(cards: DataFrame, reading: str = "reading", entries: str = "entries", error: str = "error") -> DataFrame:
    """Cards (entries: array of pinyin and gloss, null while looked up) with ``status`` and, for each entry, the reading to show, null if it is the card's own."""
    bare = lambda c: F.lower(T.without_blank(c))
    status = F.when(F.col(error).isNotNull(), "unavailable").when(F.col(entries).isNull(), "loading").when(F.size(entries) == 0, "not found").otherwise("")
    shown = F.transform(entries, lambda e: F.when(bare(e["pinyin"]) != bare(F.coalesce(F.col(reading), F.lit(""))), e["pinyin"]))
    return cards.withColumns({"status": status, "shown": shown})
