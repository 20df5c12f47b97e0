"""Connected components of links between nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import materialized


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node it is linked to, for every node of the edges (a, b), whose ends can be compared.

    Each round every node takes the least root beside it and then that root's
    root, so that distances halve; a component costs no more for being large.
    Tables of nodes are joined by shuffles, never sent through the driver.
    """
    both = materialized(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    roots = materialized(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        beside = both.join(roots.withColumnsRenamed({"node": "b"}).hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        nearer = roots.join(beside.hint("merge"), "node").select("node", "root", F.least("root", "near").alias("next"))
        # What a node has learnt, its root learns, too.
        told = nearer.groupBy(F.col("root").alias("of")).agg(F.min("next").alias("told"))
        learnt = roots.join(told.hint("merge"), F.col("node") == F.col("of"), "left").select("node", F.least("root", F.coalesce("told", "root")).alias("known"))
        merged = nearer.join(learnt.hint("merge"), "node").select("node", "root", F.least("next", "known").alias("next"))
        far = merged.select(F.col("node").alias("at"), F.col("next").alias("further"))
        jumped = materialized(merged.join(far.hint("merge"), F.col("next") == F.col("at")).select("node", "root", F.least("next", "further").alias("next")))
        done = jumped.where("root <> next").isEmpty()
        roots = jumped.select("node", F.col("next").alias("root"))
        if done:
            return roots
