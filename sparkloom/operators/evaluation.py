"""Scoring of found texts against labels, and choice among configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T


#: Labels and texts that are compared together, and the characters of these texts.
LABELS, TEXTS, CHARACTERS = 64, 256, 1 << 20
#: Keys with more pairs of a label and a line than this look up candidates first.
DIRECT_PAIRS = 1 << 16
#: The length of the grams by which candidates are found.
GRAM = 3


def _blocks(rows: DataFrame, keys: list[str], most: int, name: str, row: Column, size: Column) -> DataFrame:
    """The rows of a key in blocks of about ``most``, also bounded in characters: keys, n_<name> (blocks of the key), <name> (number), and the block, sorted."""
    count = F.ceil(F.greatest(F.count("*") / most, F.sum(size) / CHARACTERS)).cast("int")
    counts = rows.groupBy(*keys).agg(count.alias(f"n_{name}"))
    placed = rows.select(*keys, row.alias("row")).join(counts, keys)
    number = F.pmod(F.xxhash64("row"), F.col(f"n_{name}")).cast("int").alias(name)
    return placed.groupBy(*keys, f"n_{name}", number).agg(F.array_sort(F.collect_list("row")).alias(f"{name} rows"))


def _nearest(labels: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Each label with the nearest of all lines of its key, block by block of both, so that no task has all of a key."""
    own = _blocks(labels, keys, LABELS, "own", F.struct("ord", "label"), F.length("label"))
    other = _blocks(lines, keys, TEXTS, "other", F.struct("line_no", "text"), F.length("text"))
    met = own.join(other.select(*keys, "n_other").distinct(), keys).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_other") - 1)))
    pairs = met.drop("n_own", "n_other").join(other.drop("n_other"), [*keys, "other"])
    found = pairs.withColumn("found", T.nearest_texts("own rows.label", "other rows.text"))
    each = found.select(*keys, "other rows", F.explode(F.arrays_zip(F.col("own rows").alias("own"), "found")).alias("z"))
    line = F.get("other rows", (F.col("z.found") % (1 << 32)).cast("int"))
    best = F.struct(F.shiftright("z.found", 32).cast("int").alias("distance"), line["line_no"].alias("line_no"), line["text"].alias("text"))
    return each.select(*keys, "z.own.ord", "z.own.label", best.alias("best")).groupBy(*keys, "ord", "label").agg(F.min("best").alias("best"))


def _grams(text: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda k: F.substr(text, k, F.lit(GRAM)))


def candidates(labels: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (keys, ord, label, line_no, text) that can be nearer than the label's number of pieces, ``n_pieces``.

    A label is cut in pieces of ``GRAM`` characters or more. Fewer edits than
    pieces leave one whole, so such a line holds that piece's rarest gram.
    """
    cut = labels.where(F.length("label") >= GRAM).withColumn("n_pieces", F.floor(F.length("label") / GRAM).cast("int"))
    start = lambda k: F.floor(k * F.length("label") / F.col("n_pieces")).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.col("n_pieces") - 1), lambda k: F.substr("label", start(k) + 1, start(k + 1) - start(k)))
    each = cut.select(*keys, "ord", "label", "n_pieces", F.posexplode(pieces).alias("piece_no", "piece"))
    each = each.withColumn("gram", F.explode(_grams("piece")))
    index = lines.where(F.length("text") >= GRAM).select(*keys, "line_no", "text", F.explode(F.array_distinct(_grams("text"))).alias("gram"))
    uses = index.groupBy(*keys, "gram").agg(F.count("*").alias("uses"))
    # A gram that no line has shows that its piece is not whole anywhere.
    rarest = each.join(uses, [*keys, "gram"], "left").groupBy(*keys, "ord", "label", "n_pieces", "piece_no").agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "gram")).alias("r"))
    wanted = rarest.where("r.uses > 0").select(*keys, "ord", "label", "n_pieces", "r.gram").distinct()
    return wanted.join(index, [*keys, "gram"]).drop("gram").distinct()


def _of_pairs(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The nearest line of each label among pairs; edits are only counted where a line does not hold the label as it stands."""
    inexact = T.substring_distance(F.when(~F.col("text").contains(F.col("label")), F.col("label")), F.col("text"))
    distance = F.when(F.col("text").contains(F.col("label")), 0).otherwise(inexact)
    return pairs.withColumn("distance", distance).groupBy(*by).agg(F.min(F.struct("distance", "line_no", "text")).alias("best"))


def _looked_up(labels: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """As ``_nearest``; only labels that are far from all lines meet them all."""
    best = _of_pairs(candidates(labels, lines, keys), [*keys, "ord", "label", "n_pieces"])
    near = best.where(F.col("best.distance") < F.col("n_pieces")).drop("n_pieces")
    far = labels.join(near, [*keys, "ord", "label"], "left_anti")
    return near.unionByName(_nearest(far, lines, keys))


def best_matches(labels: DataFrame, lines: DataFrame, keys: list[str], chars: str) -> DataFrame:
    """For each label (keys, ord, label) the line (keys, line_no, text) of its fixture with the fewest edits.

    The first of equals wins. A line as far away as the label is long is no
    match: its text stays empty and cer is 1. Labels that are empty or null are
    left out. Keys with many pairs look up candidates by grams first. A key that
    is null has no lines; with many pairs ord must not be null.
    """
    wanted = labels.where(F.length("label") > 0).select(*keys, "ord", "label")
    clean = lines.select(*keys, "line_no", T.class_only(F.col("text"), chars).alias("text")).where("text <> ''")
    sizes = wanted.groupBy(*keys).agg(F.count("*").alias("n_labels")).join(clean.groupBy(*keys).agg(F.count("*").alias("n_lines")), keys)
    many = sizes.where(F.col("n_labels") * F.col("n_lines") > DIRECT_PAIRS).select(*keys)
    each, some = [*keys, "ord", "label"], not many.isEmpty()
    few = wanted.join(many, keys, "left_anti") if some else wanted
    found = _of_pairs(few.join(clean, keys, "left"), each)
    if some:
        asked = wanted.join(many, keys, "left_semi").distinct()
        nearest = _looked_up(asked, clean.join(many, keys, "left_semi"), keys)
        found = found.unionByName(nearest)
    near = F.col("best.distance") < F.length("label")
    joined = found.withColumn("best", F.when(near, F.col("best")))
    distance = F.coalesce("best.distance", F.length("label"))
    return joined.select(*keys, "ord", "label", F.coalesce("best.text", F.lit("")).alias("text"), distance.alias("distance"), (distance / F.length("label")).alias("cer"))


def summarize(matches: DataFrame, keys: list[str]) -> DataFrame:
    return matches.groupBy(*keys).agg(F.count_if(F.col("distance") == 0).alias("exact"), F.count("*").alias("required"), F.coalesce(F.avg("cer"), F.lit(0.0)).alias("mean_cer"))


def misses(matches: DataFrame, keys: list[str], none: str = "∅") -> DataFrame:
    """For each key its labels that were not read exactly, in order, each with what was read instead."""
    missed = matches.where(F.col("distance") > 0)
    shown = F.concat("label", F.lit("→"), F.when(F.col("text") == "", none).otherwise(F.col("text")))
    return missed.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", shown.alias("m")))), lambda x: x["m"]).alias("misses"))


def upper_median(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The value at place floor(n / 2), counted from 0, of each key's sorted values."""
    by = Window.partitionBy(*keys)
    placed = rows.where(F.col(value).isNotNull()).withColumns({"place": F.row_number().over(by.orderBy(value)), "n": F.count("*").over(by)})
    return placed.where(F.col("place") == F.floor(F.col("n") / 2) + 1).select(*keys, F.col(value).alias(name))


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def choose(configs: DataFrame, keys: list[str], share: float = 0.9) -> DataFrame:
    """Of each key the row with at least ``share`` of ``required`` exact, least total_ms, then least download_mb, then least ord."""
    fit = configs.where(F.col("exact") >= F.lit(share) * F.col("required"))
    by = Window.partitionBy(*keys).orderBy("total_ms", "download_mb", "ord")
    return fit.withColumn("place", F.row_number().over(by)).where("place = 1").drop("place")
