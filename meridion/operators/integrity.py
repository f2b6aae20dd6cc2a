"""Integrity tests as tables of violations, and pure repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collisions(*tables: DataFrame, key: str = "zone") -> DataFrame:
    """Ids that occur in more than one table, or twice in one."""
    ids = tables[0].select(F.col(key).cast("string").alias("id"))
    for t in tables[1:]:
        ids = ids.unionAll(t.select(F.col(t.columns[0]).cast("string").alias("id")))
    return ids.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def broken_sequences(links: DataFrame) -> DataFrame:
    """Trips whose consecutive links don't meet (b of one is not a of the next)."""
    from pyspark.sql import Window

    w = Window.partitionBy("trip").orderBy("link_sequence")
    bad = links.withColumn("__n", F.lead("a").over(w)).filter("__n is not null and __n <> b")
    return bad.groupBy("trip").agg(F.count("*").alias("n"))


def gaps(rows: DataFrame, trip: str, seq: str) -> DataFrame:
    """Trips whose numbers aren't 1..n, each once."""
    g = rows.groupBy(trip).agg(F.min(seq).alias("low"), F.max(seq).alias("high"), F.countDistinct(seq).alias("distinct"), F.count("*").alias("n"))
    return g.filter("low <> 1 or high <> n or distinct <> n")


def circular(stop_times: DataFrame) -> DataFrame:
    """Trips that come back to a stop."""
    return stop_times.groupBy("trip").agg(F.count("*").alias("n"), F.countDistinct("stop").alias("k")).filter("n > k").select("trip", (F.col("n") - F.col("k")).alias("repeats"))


def missing_nodes(links: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Ends of links that are no nodes."""
    ends = links.select(F.col("a").alias(node)).union(links.select(F.col("b").alias(node))).distinct()
    return ends.join(nodes.select(node), node, "left_anti")


def orphan_nodes(links: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Nodes at no link."""
    ends = links.select(F.col("a").alias(node)).union(links.select(F.col("b").alias(node))).distinct()
    return nodes.select(node).join(ends, node, "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def dead_ends(links: DataFrame) -> DataFrame:
    """Nodes that links enter and none leaves."""
    return links.select(F.col("b").alias("node")).distinct().join(links.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
