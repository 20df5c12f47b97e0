r"""Personal data by rules and by bootstrapped contexts, with DataFrame functions only.

Rules find the base spans. Their values are the seeds: the words around each
mention are lexical patterns, and patterns and instances form a bipartite
graph. Round after round, a pattern is scored by the share of its mentions that
are held to be of a kind, and an instance not yet held by the patterns that it
occurs in; patterns with enough support and confidence hand their kind to
instances that the rules did not find. Scores only rise from round to round, so
the rounds end when no further instance is named. Spark keeps the graph: it is
aggregated before each join. What may become an instance:

- words with a digit or an at sign,
- runs of digit groups joined by a blank, dot, hyphen or bracket, as numbers
  are written that the rules don't know,
- matches of the rules that failed their tests (digits, Luhn, parts).

Of candidates inside another the longer one counts, and none that touches a
base span. An instance needs the shape of its kind (``SHAPES``).

Positions are code points, end exclusive. They come from splitting a text at
the matches: pieces and matches alternate, so the lengths add up to the starts.
Patterns are possessive, so long runs cost linear time and no stack; work over
a text's mentions goes in chunks, so it is linear in their number too.

Null texts count as empty; rows without an id and repeated rows keep a row
each; an empty table gives no rows. Columns may have any names: they are renamed
inside. Ties in sorting cannot change the result, as spans are sorted by start,
kind and end and are distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut

KINDS = ("email", "ip", "card", "phone")

#: ``\G`` (the end of the last match) and the look-behinds only spare starts that can't match or would be inside a longer match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IDENTIFIER = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

GROUPS = r"(?<![^\s(\[])[+(]*+[0-9]++(?:[)]?[\x20.-][(]?[0-9]++|[)][0-9]++|[(][0-9]++)++"

#: What an instance of a kind looks like.
SHAPES = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^[0-9]{1,3}([.,:-][0-9]{1,3}){3}$",
    "card": r"^[0-9]([ .-]?[0-9]){11,18}$",
    "phone": r"^[+(]*[0-9](?:[ ().-]{0,2}[0-9]){6,14}$",
}

#: What a pattern needs before it may name instances; what an instance needs.
LEAST_SEEDS, PATTERN_CONFIDENCE, INSTANCE_CONFIDENCE = 3, 0.8, 0.9
#: Array elements that are handled together; code points of a text that are.
_CHUNK, _PIECE = 64, 1024
_WINDOW = 80


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once, also where lambdas use it for each of many elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _running(steps: Column) -> Column:
    """Sums of all whole chunks before each chunk."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _CHUNK).cast("int")), lambda c: _total(F.slice(steps, c * _CHUNK + 1, _CHUNK)))
    return F.aggregate(chunks, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))


def _most_before(numbers: Column) -> Column:
    """For each of the numbers, the largest before it (-1 if there is none)."""
    largest = lambda part: F.coalesce(F.array_max(part), F.lit(-1))

    def each(values: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")), lambda c: largest(F.slice(values, c * _CHUNK + 1, _CHUNK)))
        before = F.aggregate(chunks, F.array(F.lit(-1)), lambda a, x: F.array_append(a, F.greatest(F.element_at(a, -1), x)))
        inside = lambda k, b: F.greatest(F.element_at(b, F.floor(k / _CHUNK).cast("int") + 1), largest(F.slice(values, F.floor(k / _CHUNK).cast("int") * _CHUNK + 1, k % _CHUNK)))
        return _let(before, lambda b: F.transform(values, lambda _, k: inside(k, b)))

    return F.when(F.size(numbers) > 0, _let(numbers, each)).otherwise(F.array().cast("array<int>"))


def _word(column: Column) -> Column:
    return F.lower(F.regexp_replace(column, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}=:]+$", ""))


def _last_word(piece: Column) -> Column:
    """The last word; first sought near the end, and in the whole piece if it doesn't begin there."""
    pattern, near = r"(?<!\S)(\S++)\s*+$", F.right(piece, F.lit(_WINDOW))
    return F.when(near.rlike(r"\s\S++\s*+$"), F.regexp_extract(near, pattern, 1)).otherwise(F.regexp_extract(piece, pattern, 1))


def _first_word(piece: Column) -> Column:
    return F.regexp_extract(piece, r"^\s*+(\S++)", 1)


def _mentions(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Add the array ``name`` of the pattern's matches with their places and the words around them."""
    df = df.withColumn("m", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))

    def mention(k: Column, m: Column, p: Column, steps: Column, before: Column) -> Column:
        chunk = F.floor((k - 1) / _CHUNK).cast("int")
        start = F.element_at(before, chunk + 1) + _total(F.slice(steps, chunk * _CHUNK + 1, k - 1 - chunk * _CHUNK)) + F.length(F.element_at(p, k))
        # Where only white space parts two matches, each is the other's context.
        near, beyond = _last_word(F.element_at(p, k)), _first_word(F.element_at(p, k + 1))
        left = _word(F.when(near == "", _last_word(F.coalesce(F.get(m, k - 2), F.lit("")))).otherwise(near))
        right = _word(F.when(beyond == "", _first_word(F.coalesce(F.get(m, k), F.lit("")))).otherwise(beyond))
        value = F.element_at(m, k)
        return _let(start, lambda at: F.struct(at.alias("start"), (at + F.length(value)).alias("end"), value.alias("value"), left.alias("left"), right.alias("right")))

    def mentions(x: Column) -> Column:
        m, p = x["m"], x["p"]
        steps = F.zip_with(F.slice(p, 1, F.size(m)), m, lambda a, b: F.length(a) + F.length(b))
        each = lambda steps_, before: F.transform(F.sequence(F.lit(1), F.size(m)), lambda k: mention(k, m, p, steps_, before))
        return _let(steps, lambda s: _let(_running(s), lambda b: each(s, b)))

    found = _let(F.struct("m", F.split("text", pattern, -1).alias("p")), mentions)
    empty = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")
    return df.withColumn(name, F.when(F.size("m") > 0, found).otherwise(empty)).drop("m")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    plain = F.reverse(digits)
    doubled = F.translate(plain, "0123456789", "0246813579")
    at = lambda s, k: F.substring(s, k, 1).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, k: a + F.when(k % 2 == 1, at(plain, k)).otherwise(at(doubled, k)))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 12) & (n <= 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _valid_mention(kind: str):
    return lambda m: _valid(kind, m["value"])


def _failing_mention(kind: str):
    return lambda m: ~_valid(kind, m["value"])


def _of_kind(k: int):
    return lambda m: F.struct(m["start"], F.lit(k).alias("kind"), m["end"], m["value"], m["left"], m["right"])


def _is_kind(k: int):
    return lambda s: s["kind"] == k


_MENTIONS = "array<struct<start:int,kind:int,end:int,value:string,left:string,right:string>>"


def _trimmed(m: Column) -> Column:
    """The mention, of no kind, without the signs around it."""
    lead = F.length(F.regexp_extract(m["value"], r"^[^\p{L}\p{N}(+]*+", 0))
    value = F.regexp_replace(m["value"], r"^[^\p{L}\p{N}(+]++|(?<=[\p{L}\p{N})])[^\p{L}\p{N})]++$", "")
    start = m["start"] + lead
    return F.struct(start.alias("start"), F.lit(None).cast("int").alias("kind"), (start + F.length(value)).alias("end"), value.alias("value"), m["left"], m["right"])


def _outermost(mentions: Column) -> Column:
    """Those of the mentions that are inside no other."""
    keyed = F.array_sort(F.transform(mentions, lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("back"), m.alias("m"))))

    def each(items: Column) -> Column:
        before = _most_before(F.transform(items, lambda x: -x["back"]))
        marked = F.zip_with(items, before, lambda x, b: F.struct(x["m"].alias("m"), (-x["back"] > b).alias("ok")))
        return F.transform(F.filter(marked, lambda x: x["ok"]), lambda x: x["m"])

    return _let(keyed, each)


def _clear_of(mentions: Column, base: Column) -> Column:
    """Those of the mentions that touch no base span: up to their end, no base span that began before ends after their start."""
    ends = F.transform(mentions, lambda m: F.struct(m["end"].alias("at"), F.lit(0).alias("tag"), F.lit(-1).alias("last"), m.alias("m")))
    starts = F.transform(base, lambda m: F.struct(m["start"].alias("at"), F.lit(1).alias("tag"), m["end"].alias("last"), m.alias("m")))

    def each(items: Column) -> Column:
        before = _most_before(F.transform(items, lambda x: x["last"]))
        marked = F.zip_with(items, before, lambda x, b: F.struct(x["m"].alias("m"), ((x["tag"] == 0) & (b <= x["m"]["start"])).alias("ok")))
        return F.transform(F.filter(marked, lambda x: x["ok"]), lambda x: x["m"])

    return _let(F.array_sort(F.concat(ends, starts)), each)


def base_mentions(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (a number for each row), the columns ``keep``, ``base`` (mentions by the rules, with their kind) and ``other`` (candidates, kind null)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.select(*(F.col(f"`{c}`").alias(f"kept {k}") for k, c in enumerate(keep)), F.monotonically_increasing_id().alias("row"), body.alias("text"))
    failed = []
    for kind in KINDS:
        df = _mentions(df, kind, PATTERNS[kind])
        if kind != "email":
            failed.append(F.filter(kind, _failing_mention(kind)))
    df = _mentions(_mentions(df, "word", IDENTIFIER), "run", GROUPS)
    df = df.withColumn("found", F.concat("word", "run", *failed))
    for kind in KINDS:
        df = df.withColumn(kind, F.filter(kind, _valid_mention(kind)))
    base = F.array_sort(F.concat(*(F.transform(kind, _of_kind(k)) for k, kind in enumerate(KINDS))))
    df = df.withColumn("base", base)
    other = _outermost(F.filter(F.transform("found", _trimmed), lambda m: m["value"] != ""))
    other = F.when(F.size("base") > 0, _clear_of(other, F.col("base"))).otherwise(other)
    none = F.array().cast(_MENTIONS)
    return df.select("row", *(F.col(f"kept {k}") for k in range(len(keep))), "base", F.when(F.size("found") > 0, other).otherwise(none).alias("other"))


def _noisy_or(column: str) -> Column:
    """One less the product of one less each confidence."""
    return 1 - F.exp(F.sum(F.log(1 - F.least(F.col(column), F.lit(0.999999)))))


def bootstrap(found: DataFrame) -> DataFrame:
    """``value`` and ``kind`` of instances that patterns name with confidence; ``found`` is read once."""
    seen = found.select(F.explode(F.concat("base", "other")).alias("m")).select("m.*")
    patterns = F.array(F.concat(F.lit("l:"), "left"), F.concat(F.lit("r:"), "right"), F.concat_ws("\t", F.lit("lr"), "left", "right"))
    edges = seen.select("kind", F.lower("value").alias("value"), F.explode(patterns).alias("pattern"))
    edges = edges.where(~F.col("pattern").isin("l:", "r:", "lr\t\t"))
    edges = cut(edges.groupBy("pattern", "value", "kind").agg(F.count("*").alias("n")))
    mentions = edges.groupBy("pattern").agg(F.sum("n").alias("all"))
    kind_shape = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(SHAPES[kind]).alias("shape")) for k, kind in enumerate(KINDS)))
    # Only what has the shape of a kind can be named; all else still counts in a pattern's mentions.
    unknown = edges.where(F.col("kind").isNull()).select("pattern", "value", "n", F.inline(kind_shape)).where("value rlike shape").drop("shape")
    seeds = edges.where(F.col("kind").isNotNull()).groupBy("pattern", "kind").agg(F.sum("n").alias("hits"), F.countDistinct("value").alias("seeds"))
    # A pattern that can't reach the confidence even if all its unknown mentions were held will never name one.
    hopes = unknown.groupBy("pattern", "kind").agg(F.sum("n").alias("hope"))
    hopeful = hopes.join(seeds, ["pattern", "kind"], "left").join(mentions, "pattern").where((F.col("hope") + F.coalesce("hits", F.lit(0))) >= PATTERN_CONFIDENCE * F.col("all"))
    hopeful = cut(hopeful.select("pattern", "kind", "all", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("seeds", F.lit(0)).alias("seeds")))
    unknown = cut(unknown.join(hopeful.select("pattern", "kind"), ["pattern", "kind"]))
    held, size = unknown.select("value", "kind", F.lit(0.0).alias("score")).limit(0), 0
    while True:
        more = unknown.join(held, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("more"), F.countDistinct("value").alias("new"))
        known = hopeful.join(more, ["pattern", "kind"], "left")
        confidence = (F.col("hits") + F.coalesce("more", F.lit(0.0))) / F.col("all")
        scored = known.where(F.col("seeds") + F.coalesce("new", F.lit(0)) >= LEAST_SEEDS).select("pattern", "kind", confidence.alias("confidence")).where(F.col("confidence") >= PATTERN_CONFIDENCE)
        reached = unknown.join(scored, ["pattern", "kind"]).groupBy("value", "kind").agg(_noisy_or("confidence").alias("score"))
        held = cut(reached.where(F.col("score") >= INSTANCE_CONFIDENCE))
        before, size = size, held.count()
        if size == before:
            break
    best = held.groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    return best.select("value", "kind")


def personal_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` as ``kept 0`` and so on, ``base`` and ``spans`` (arrays of start, kind number, end), in order, for each row."""
    found = cut(base_mentions(docs, text, keep))
    names = bootstrap(found)
    others = found.select("row", F.explode("other").alias("m")).select("row", "m.start", "m.end", F.lower("m.value").alias("value"))
    more = others.join(names, "value").groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    base = F.transform("base", lambda m: F.struct(m["start"], m["kind"], m["end"]))
    rows = found.withColumn("base", base).join(more, "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return rows.select(*(F.col(f"kept {k}") for k in range(len(keep))), "base", spans.alias("spans"))


def _joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The id, the number of base spans of each kind, their digest and all spans, for each row."""
    rows = personal_spans(docs, text, (id_column,))
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select(F.col("kept 0").alias(id_column), *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text given in pieces of ``_PIECE``."""
    first, last = F.floor(start / _PIECE).cast("int"), F.floor(end / _PIECE).cast("int")
    return F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start - first * _PIECE + 1, end - start)


def _without(body: Column, spans: Column) -> Column:
    """The text with each span replaced; one inside those before it is left out, one that reaches over their end covers the rest."""
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def parts(x: Column) -> Column:
        gaps = F.zip_with(x["s"], x["b"], lambda s, b: F.when(s["start"] >= F.greatest(b, F.lit(0)), F.concat(_between(x["p"], F.greatest(b, F.lit(0)), s["start"]), F.element_at(tags, s["kind"] + 1))).otherwise(""))
        end = F.array_max(F.transform(x["s"], lambda s: s["end"]))
        return F.concat(F.array_join(gaps, ""), _between(x["p"], end, F.length(body)))

    pieces = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    return _let(F.struct(pieces.alias("p"), spans.alias("s"), _most_before(F.transform(spans, lambda s: s["end"])).alias("b")), parts)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with every span of personal data in ``text`` replaced by its kind in brackets; null texts stay null."""
    rows = personal_spans(docs, text, tuple(docs.columns))
    at = docs.columns.index(text)
    body = F.col(f"kept {at}")
    new = F.when(F.size("spans") > 0, _without(body, F.col("spans"))).otherwise(body)
    return rows.select(*((new if k == at else F.col(f"kept {k}")).alias(c) for k, c in enumerate(docs.columns)))
