"""Catalogues of files with checksums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(files: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Size and SHA-256 of each file."""
    body = F.col(content).cast("binary")
    return files.select(*keys, F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("sha256"))


def version_of(manifest_row):
    """The first 12 digits of the hash of a manifest's compact JSON."""
    return F.substring(F.sha2(F.to_json(manifest_row), 256), 1, 12)


def write_manifest(files: DataFrame, kind: str, name: str, content: str, path: str) -> None:
    """A JSON manifest of files: a row for each with kind, id, size and hash, and the ``version`` of them all."""
    rows = manifest(files, [kind, name], content)
    whole = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(kind).alias("kind"), F.col(name).alias("id"), "size", "sha256"))).alias("files"))
    whole.select(version_of(F.struct("files")).alias("version"), "files").write.mode("overwrite").json(path)


def configurations(detectors: DataFrame, recognisers: DataFrame, sides: DataFrame) -> DataFrame:
    """Every detector with every recogniser and every size: a small product by intention."""
    return detectors.crossJoin(F.broadcast(recognisers)).crossJoin(F.broadcast(sides))


def wanted_kinds(rows: DataFrame, kind: str, asked: list[str]) -> DataFrame:
    """Rows of the kinds that were asked for; all if none was."""
    return rows.where(F.col(kind).isin(asked)) if asked else rows


def first_source(wanted: DataFrame, sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """For each wanted (key, size, sha256) the first source whose copy has that size and hash; null if none has."""
    out = wanted
    for name, copies in sources:
        good = copies.select(F.col(key).alias("k"), F.col("size").alias("s"), F.col("sha256").alias("h"), F.lit(name).alias(f"from_{name}")).distinct()
        out = out.join(good, (F.col(key) == F.col("k")) & (F.col("size") == F.col("s")) & (F.col("sha256") == F.col("h")), "left").drop("k", "s", "h")
    found = F.coalesce(*(F.col(f"from_{name}") for name, _ in sources))
    return out.select(*wanted.columns, found.alias("source"))


def stale(caches: DataFrame, column: str, prefix: str, current: str) -> DataFrame:
    """Caches with the prefix other than the current one."""
    return caches.where(F.col(column).startswith(prefix) & (F.col(column) != current))


def choose_models(requests: DataFrame, shipped: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """For each kind the requested id if it is shipped (kind, id), else its default; other requests in ``rejected``."""
    rejected = []
    for kind, default in kinds.items():
        known = shipped.where(F.col("kind") == kind).select(F.col("id").alias(f"known_{kind}")).distinct()
        requests = requests.join(known, F.col(kind) == F.col(f"known_{kind}"), "left")
        rejected.append(F.when(F.col(kind).isNotNull() & F.col(f"known_{kind}").isNull(), F.concat(F.lit(f"{kind}="), F.col(kind))))
        requests = requests.withColumn(f"chosen_{kind}", F.coalesce(f"known_{kind}", F.lit(default)))
    out = requests.withColumn("rejected", F.array_compact(F.array(*rejected)))
    return reduce(lambda d, k: d.drop(f"known_{k}"), kinds, out)
