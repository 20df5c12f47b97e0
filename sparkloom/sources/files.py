"""Dictionary, label, URL and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Lines word, pinyin, gloss/gloss, separated by tabs, without blank lines. ``at`` orders them within a file."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where(F.col("value") != "")
    parts = F.split("value", "\t")
    return lines.select("at", parts[0].alias("word"), parts[1].alias("pinyin"), F.split(parts[2], "/").alias("glosses"))


def write_dictionary(entries: DataFrame, path: str) -> None:
    """Entries (group_no, line_no, word, pinyin, glosses) as such lines, in order."""
    ordered = entries.orderBy("group_no", "line_no")
    ordered.select(F.concat_ws("\t", "word", "pinyin", F.array_join("glosses", "/"))).write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines, also of gzip files, with numbers that order them: within a file they follow each other, between parts of it there are gaps."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def read_json_object(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The entries of a JSON object by name: ``name`` and the fields of ``value`` as ``ddl`` says."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{ddl}>")).alias("name", "value"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of fixtures with ``required`` labels: fixture, ord, label."""
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string,struct<description:string,required:array<string>,pinyin:map<string,string>>>")
    rows = whole.select(F.explode(parsed).alias("fixture", "f"))
    return rows.select("fixture", F.posexplode("f.required").alias("ord", "label"))


def url_parameters(pages: DataFrame, url: str, names: list[str], keep: list[str]) -> DataFrame:
    """Query parameters of URLs, null where absent; ``has_<name>`` is true for a bare name, too."""
    value = lambda n: F.regexp_extract(url, f"[?&]{n}=([^&#]*)", 1)
    has = lambda n: F.coalesce(F.col(url).rlike(f"[?&]{n}(=|&|#|$)"), F.lit(False))
    return pages.select(*keep, *(F.when(F.col(url).rlike(f"[?&]{n}="), value(n)).alias(n) for n in names), *(has(n).alias(f"has_{n}") for n in names))


def options(rows: DataFrame, argument: str, names: list[str]) -> DataFrame:
    """Command-line arguments (an array of ``--name=a,b``) as a column of arrays for each name; null, meaning all, where a name is not given."""
    value = lambda n: F.element_at(F.filter(F.col(argument), lambda a: a.startswith(f"--{n}=")), -1)
    given = lambda n: F.exists(F.col(argument), lambda a: a.startswith(f"--{n}="))
    return rows.withColumns({n: F.when(given(n), F.split(F.substring(value(n), len(n) + 4, 1 << 20), ",")) for n in names})


def write_report(rows: DataFrame, json_path: str, markdown_path: str, choice: str | None = None) -> None:
    """Benchmark rows as JSON and as lines of a Markdown table; with a choice the table has a head, and the choice comes last."""
    rows.write.json(json_path)
    line = F.format_string("| %s | %d/%d | %.3f | %d |", F.col("config"), F.col("exact"), F.col("required"), F.col("mean_cer"), F.floor(F.col("total_ms") + 0.5).cast("long"))
    table = rows.select(F.lit(2).alias("part"), line.alias("value"))
    if choice is not None:
        around = [(0, "| configuration | exact | mean CER | ms |"), (1, "|-|-|-|-|"), (3, "Chosen: " + choice)]
        table = table.unionByName(rows.sparkSession.createDataFrame(around, "part int, value string")).coalesce(1).sortWithinPartitions("part")
    table.select("value").write.text(markdown_path)
