"""Assignment of demand to paths, and summaries over loaded paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_paths(od: DataFrame, width: int = 5) -> DataFrame:
    """od (origin, destination) with path: the zones of a grid of that width, along x first, then along y."""
    x = lambda z: z % width
    y = lambda z: F.floor(z / width).cast("int")
    o, d = F.col("origin"), F.col("destination")
    along = F.transform(F.sequence(x(o), x(d)), lambda k: (y(o) * width + k).cast("int"))
    up = F.transform(F.sequence(y(o), y(d)), lambda k: (k * width + x(d)).cast("int"))
    return od.withColumn("path", F.concat(along, F.slice(up, 2, 1_000_000)))


def path_links(paths: DataFrame) -> DataFrame:
    """A row for each pair of consecutive zones of path, with a and b."""
    pairs = F.arrays_zip(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("a"), F.slice("path", 2, 1_000_000).alias("b"))
    return paths.select("*", F.explode(pairs).alias("__l")).select("*", F.col("__l.a").alias("a"), F.col("__l.b").alias("b")).drop("__l", "path")


def assign(paths: DataFrame, volume: str = "volume") -> DataFrame:
    """Volume of each link."""
    return path_links(paths).groupBy("a", "b").agg(F.sum(volume).alias("volume"))


def assign_segmented(paths: DataFrame) -> DataFrame:
    """Volume of each link by segment, and over all ('all')."""
    sets = path_links(paths).groupingSets([["a", "b", "segment"], ["a", "b"]], "a", "b", "segment")
    got = sets.agg(F.sum("volume").alias("volume"), F.grouping("segment").alias("__all"))
    return got.withColumn("segment", F.when(F.col("__all") == 1, "all").otherwise(F.col("segment"))).drop("__all")


def through(paths: DataFrame, checkpoints: list[int], every: bool = True) -> DataFrame:
    """Paths through every one, or any one, of the checkpoints."""
    marks = F.array(*[F.lit(c) for c in checkpoints])
    hit = F.size(F.array_intersect("path", marks)) == len(checkpoints) if every else F.arrays_overlap("path", marks)
    return paths.filter(hit)


def renumber(od: DataFrame, clusters: DataFrame, zone: str = "zone", cluster: str = "cluster", how: str = "sum") -> DataFrame:
    """od (origin, destination, volume) summed, or averaged, over clusters of zones."""
    c = clusters.select(zone, cluster)
    o, d = c.withColumnsRenamed({zone: "origin", cluster: "o"}), c.withColumnsRenamed({zone: "destination", cluster: "d"})
    agg = F.sum("volume") if how == "sum" else F.avg("volume")
    return od.join(o, "origin").join(d, "destination").groupBy(F.col("o").alias("origin"), F.col("d").alias("destination")).agg(agg.alias("volume"))


def weighted_average(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_average"))


def shares(df: DataFrame, keys: list[str], part: str, value: str) -> DataFrame:
    """value by keys and part, over value by keys."""
    from pyspark.sql import Window

    got = df.groupBy(*keys, part).agg(F.sum(value).alias("total"))
    return got.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy(*keys)))


def densify(od: DataFrame, zones: DataFrame) -> DataFrame:
    """od with every pair of zones, 0 where there was none. The zones are the OD universe, not corpus rows."""
    o = zones.select(F.col("zone").alias("origin"))
    d = zones.select(F.col("zone").alias("destination"))
    return o.crossJoin(d).join(od, ["origin", "destination"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def long_form(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(keys, values, "indicator", "value")


def economic_series(df: DataFrame, value: Column, cost: Column) -> DataFrame:
    """Totals of value, cost and their difference."""
    return df.agg(F.sum(value).alias("value"), F.sum(cost).alias("cost"), F.sum(value - cost).alias("benefit"))


def rule_of_half(a: DataFrame, b: DataFrame) -> DataFrame:
    """Surplus of each OD between two scenarios (origin, destination, volume, cost): half the sum of volumes times the fall in cost."""
    j = a.withColumnsRenamed({"volume": "v0", "cost": "c0"}).join(b.withColumnsRenamed({"volume": "v1", "cost": "c1"}), ["origin", "destination"])
    return j.select("origin", "destination", ((F.col("v0") + F.col("v1")) / 2 * (F.col("c0") - F.col("c1"))).alias("surplus"), F.least("v0", "v1").alias("kept"), F.greatest(F.col("v1") - F.col("v0"), F.lit(0.0)).alias("gained"))
