"""Joins that an engine of tables lacks: as-of, range, overlap, nearest, Pareto."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_event(left: DataFrame, right: DataFrame, key: str, t: str, value: str, tolerance: float | None = None) -> DataFrame:
    """left with the first right row of its key at or after its time: next_t, next_value (ties: the least value).

    One union and one window for each key instead of a join of all pairs."""
    cols = left.columns
    a = left.withColumns({"__t": F.col(t), "__side": F.lit(1), "__v": F.lit(None).cast(right.schema[value].dataType), "__nt": F.lit(None).cast(right.schema[t].dataType)})
    b = right.select(F.col(key), F.col(t).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"), F.col(t).alias("__nt"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc("__t"), F.asc("__side"), F.desc("__v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("__side") == 0, F.struct("__nt", "__v")), ignorenulls=True).over(w)
    out = both.withColumn("__n", last).filter("__side = 1").select(*cols, F.col("__n.__nt").alias("next_t"), F.col("__n.__v").alias("next_value"))
    if tolerance is not None:
        late = F.col("next_t") - F.col(t) > tolerance
        out = out.withColumns({"next_value": F.when(~late, F.col("next_value")), "next_t": F.when(~late, F.col("next_t"))})
    return out


def first_after(left: DataFrame, right: DataFrame, key: str, t: str, gap: float) -> DataFrame:
    """left's (key, t) with arrive, the earliest right time at least gap later, where there is one."""
    later = right.select(key, F.col(t).alias("__v"), (F.col(t) - gap).alias(t))
    return next_event(left, later, key, t, "__v").filter("next_value is not null").withColumnRenamed("next_value", "arrive").drop("next_t")


def overlaps(start: Column, end: Column, low, high) -> Column:
    """Whether [start, end) and [low, high) share time."""
    return (start < high) & (end > low)


def _distance() -> Column:
    return F.sqrt((F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty")))


def _cells(x: str, y: str, cell: float, reach: int) -> Column:
    """The grid cells of (x, y) and of its surroundings, as an array."""
    around = F.sequence(F.lit(-reach), F.lit(reach))
    g = lambda c: F.floor(F.col(c) / cell)
    return F.flatten(F.transform(around, lambda i: F.transform(around, lambda j: F.struct((g(x) + i).alias("cx"), (g(y) + j).alias("cy")))))


def _places(rows: DataFrame, at: list[str], key: str, most: int = 1_000_000) -> DataFrame:
    """rows by place: (at, list of keys). Where a list might pass `most` keys, a place has several rows."""
    part = F.pmod(F.xxhash64(key), F.lit(rows.count() // most + 1))
    return rows.groupBy(*at, part.alias("__part")).agg(F.collect_list(F.struct(key)).alias(f"{key}s")).drop("__part")


def within(points: DataFrame, targets: DataFrame, radius: float, measures: dict[str, Column] | None = None) -> DataFrame:
    """points (id, x, y) with all targets (target, tx, ty) up to radius away: target and measures of `distance` (by default itself).

    An equi-join on grid cells of places, so that points and targets of one place are compared once; the pairs of a
    place are told apart last. Both sides have a fixed number of tasks, as few bytes may make many pairs."""
    measures = measures or {"distance": F.col("distance")}
    spark = points.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    p = _places(points.select("id", "x", "y"), ["x", "y"], "id").withColumn("__c", F.explode(_cells("x", "y", radius, 1))).repartition(n, "__c")
    t = _places(targets.select("target", "tx", "ty"), ["tx", "ty"], "target").withColumn("__c", F.element_at(_cells("tx", "ty", radius, 0), 1)).repartition(n, "__c")
    near = p.join(t, "__c").withColumn("distance", _distance()).filter(F.col("distance") <= radius).select("ids", "targets", *[c.alias(m) for m, c in measures.items()])
    return near.select(F.inline("ids"), "targets", *measures).select("id", F.inline("targets"), *measures)


def _extent(points: DataFrame, targets: DataFrame, cell: float, k: int) -> tuple[float, int]:
    """The width of the first cells and how often it has to grow fourfold to be as wide as all points and targets together.

    Where targets are dense, the first cells are narrower than `cell`, so that they hold some 2 k targets on average."""
    both = points.select("x", "y", F.lit(0).alias("n")).unionByName(targets.select(F.col("tx").alias("x"), F.col("ty").alias("y"), F.lit(1).alias("n")))
    wide = both.agg(*[(F.max(v) - F.min(v)).cast("double") for v in (F.when(~F.isnan(c), F.col(c)) for c in ("x", "y"))], F.sum("n")).first()
    sides, n = [v or 0.0 for v in wide[:2]], wide[2] or 0
    widest = max(sides)
    if not 0 < widest < math.inf:
        return cell, 0
    if n > k:
        cell = min(cell, max(math.sqrt(sides[0] * sides[1] * 2 * k / n), widest * 2 * k / n))
    return cell, max(0, math.ceil(math.log(widest * (1 + 1e-9) / cell, 4)))


def nearest(points: DataFrame, targets: DataFrame, k: int, cell: float) -> DataFrame:
    """points (id, x, y; unique ids) with their k nearest targets (target, tx, ty), at any distance: rank, target, distance.

    An equi-join on grid cells and the cells around. Places with fewer than k targets within a cell's width are joined
    again on cells of four times the width, and so on until these span everything; `cell` bears on time, not on results.
    Points of one place are searched for once, and of the targets of one place the k least can be found."""
    nothing = F.array().cast(f"array<struct<distance:double,target:{targets.schema['target'].dataType.simpleString()}>>")
    here = Window.partitionBy("tx", "ty").orderBy("target")
    spots = targets.select("target", "tx", "ty").withColumn("__n", F.row_number().over(here)).filter(F.col("__n") <= k).drop("__n")
    cell, levels = _extent(points, spots, cell, k)
    state = points.select("x", "y").distinct().select("x", "y", nothing.alias("found"), F.lit(False).alias("settled"))
    order = Window.partitionBy("x", "y").orderBy(F.col("distance").asc_nulls_last(), "target")
    for level in range(levels + 1):
        wide = cell * 4**level
        # A settled place keeps one row with a key of its own, which meets no target.
        key = lambda c: F.struct(c["cx"].alias("cx"), c["cy"].alias("cy"), F.lit(0).alias("own"))
        at = spots.withColumn("__c", key(F.element_at(_cells("tx", "ty", wide, 0), 1)))
        own = F.struct(F.xxhash64("x", "y").alias("cx"), F.lit(0).cast("long").alias("cy"), F.lit(1).alias("own"))
        rows = state.withColumn("__c", F.explode(F.when(F.col("settled"), F.array(own)).otherwise(F.transform(_cells("x", "y", wide, 1), key))))
        near = rows.join(at, "__c", "left").withColumn("distance", _distance()).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        got = F.array_sort(F.collect_list(F.when(F.col("target").isNotNull() & F.col("distance").isNotNull(), F.struct("distance", "target"))))
        state = near.groupBy("x", "y").agg(F.first("settled").alias("was"), F.first("found").alias("had"), got.alias("got"))
        state = state.select("x", "y", F.when(F.col("was"), F.col("had")).otherwise(F.col("got")).alias("found"), (F.col("was") | F.coalesce(F.get("got", F.lit(k - 1))["distance"] < wide * (1 - 1e-9), F.lit(False))).alias("settled"))
    found = state.filter(F.size("found") > 0).select("x", "y", "found")
    return points.select("id", "x", "y").join(found, ["x", "y"]).select("id", F.posexplode("found").alias("rank", "f")).select("id", (F.col("rank") + 1).alias("rank"), "f.target", "f.distance")


def pareto(df: DataFrame, keys: list[str], first: str, second: str, tie: list[str]) -> DataFrame:
    """Rows that no other row of their keys beats on both criteria (least is best)."""
    w = Window.partitionBy(*keys).orderBy(first, second, *tie).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__m", F.min(second).over(w)).filter(F.col("__m").isNull() | (F.col(second) < F.col("__m"))).drop("__m")


def knn_regression(found: DataFrame, values: DataFrame, floor: float = 1e-6) -> DataFrame:
    """nearest()'s rows with values (target, value): the mean weighted by inverse distance."""
    w = 1 / F.greatest("distance", F.lit(floor))
    return found.join(values, "target").groupBy("id").agg((F.sum(F.col("value") * w) / F.sum(w)).alias("estimate"))
