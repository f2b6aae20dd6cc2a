"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, stored, write


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) longs, undirected, to (node, root) with the least node of each component; nodes without edges have no row.

    Rounds go on until the edges don't change; each round's edges replace those of the last."""
    spark = edges.sparkSession
    path = write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    e = spark.read.schema("a long, b long").parquet(path)
    before, now = None, _state(e)
    while now[0] and now != before:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        old, path = path, write(small, "edges")
        delete(spark, old)
        e = spark.read.schema("a long, b long").parquet(path)
        before, now = now, _state(e)
    out = e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out = stored(out, "components")
    delete(spark, path)
    return out
