"""Trip distribution: gravity models and matrix balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def singly_constrained(skims: DataFrame, beta: float) -> DataFrame:
    """skims (origin, destination, emission, attraction, distance) to volumes that keep emissions."""
    w = F.col("attraction") * F.exp(-beta * F.col("distance"))
    return skims.withColumn("__w", w).select("origin", "destination", (F.col("emission") * F.col("__w") / F.sum("__w").over(Window.partitionBy("origin"))).alias("volume"))


def balance(cells: DataFrame, rounds: int) -> DataFrame:
    """cells (origin, destination, emission, attraction, volume): volume scaled to attraction by columns, then to emission by rows, in turn. One lazy plan; each round is two windows."""
    for _ in range(rounds):
        for key, total in (("destination", "attraction"), ("origin", "emission")):
            s = F.sum("volume").over(Window.partitionBy(key))
            cells = cells.withColumn("volume", F.when(s > 0, F.col("volume") * F.col(total) / s).otherwise(0.0))
    return cells.select("origin", "destination", "volume")


def doubly_constrained(skims: DataFrame, beta: float, rounds: int = 4) -> DataFrame:
    return balance(skims.withColumn("volume", F.exp(-beta * F.col("distance"))), rounds)


def fratar(od: DataFrame, growth: DataFrame, rounds: int = 3) -> DataFrame:
    """od (origin, destination, volume) grown so that rows and columns reach growth (zone, emission, attraction)."""
    o = growth.select(F.col("zone").alias("origin"), "emission")
    d = growth.select(F.col("zone").alias("destination"), "attraction")
    return balance(od.join(o, "origin").join(d, "destination"), rounds)
