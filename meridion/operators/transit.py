"""Timetables: stop sequences, patterns, headways, fares, paths of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stop_links(stop_times: DataFrame) -> DataFrame:
    """(trip, link_sequence, a, b): consecutive stops of each trip (trip, stop, seq)."""
    w = Window.partitionBy("trip").orderBy("seq")
    return stop_times.withColumn("b", F.lead("stop").over(w)).filter("b is not null").select("trip", F.col("seq").alias("link_sequence"), F.col("stop").alias("a"), "b")


def clean_sequences(df: DataFrame, trip: str, order: list[str]) -> DataFrame:
    """df with seq from 1 in the given order, without gaps or repeats."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(trip).orderBy(*order)))


def footprints(stop_times: DataFrame) -> DataFrame:
    """Each trip's stops as one string, in order."""
    s = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "stop"))), lambda x: x["stop"].cast("string")), "-")
    return stop_times.groupBy("trip").agg(s.alias("footprint"))


def patterns(stop_times: DataFrame) -> DataFrame:
    """Trips with the same footprint: its number of trips and the least trip."""
    return footprints(stop_times).groupBy("footprint").agg(F.count("*").alias("n_trips"), F.min("trip").alias("trip"))


def headway_harmonic(links: DataFrame, keys: list[str]) -> DataFrame:
    """Headway of lines that run together: one over the sum of frequencies."""
    return links.groupBy(*keys).agg((1 / F.sum(1 / F.col("headway"))).alias("headway"))


def average_headway(times: DataFrame, key: str, t: str, span: float) -> DataFrame:
    """span over the number of departures."""
    return times.groupBy(key).agg((F.lit(span) / F.count(t)).alias("headway"))


def observed_headway(times: DataFrame, key: str, t: str) -> DataFrame:
    """Mean gap between consecutive departures."""
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t))
    return times.withColumn("__g", gap).filter("__g is not null").groupBy(key).agg(F.avg("__g").alias("headway"), F.count("*").alias("n"))


def line_graph(links: DataFrame) -> DataFrame:
    """Consecutive links (a, b), (b, c) of trips, with the number of trips."""
    u = links.select("trip", "link_sequence", "a", "b")
    n = u.select("trip", (F.col("link_sequence") - 1).alias("link_sequence"), F.col("a").alias("b"), F.col("b").alias("c"))
    return u.join(n, ["trip", "link_sequence", "b"]).groupBy("a", "b", "c").agg(F.count("*").alias("n"))


def turns(links: DataFrame, u_turns: bool = False) -> DataFrame:
    """Pairs of consecutive links (a, b), (b, c) of a road network."""
    got = links.select("a", "b").join(links.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", "b", "c")
    return got if u_turns else got.filter("a <> c")


def boarding_profile(stops: DataFrame, trip: str, order: str, on: str, off: str) -> DataFrame:
    """Load after each stop."""
    w = Window.partitionBy(trip).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stops.withColumn("load", F.sum(F.col(on) - F.col(off)).over(w))


def runs(df: DataFrame, trip: str, order: str, value: str) -> DataFrame:
    """Stretches of equal value along each trip: run number, value, number of links."""
    w = Window.partitionBy(trip).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return df.withColumn("__n", new).withColumn("run", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).groupBy(trip, "run", value).agg(F.count("*").alias("n"))


def cheapest_fare(trips: DataFrame, fares: DataFrame, keys: list[str]) -> DataFrame:
    """Cheapest fare valid for each row of trips (ties: the least fare id)."""
    w = Window.partitionBy(*trips.columns).orderBy("price", "fare")
    return trips.join(fares, keys).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def shared_sets(stop_times: DataFrame) -> DataFrame:
    """Ordered pairs of stops served in that order by more than one trip, with the number of trips; each trip's pairs are its own."""
    s = stop_times.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("seq", "stop"))).alias("s"))
    pair = s.select("trip", F.posexplode("s").alias("i", "p"), "s").select("trip", F.col("p.stop").alias("a"), F.explode(F.slice("s", F.col("i") + 2, 1_000_000)).alias("q")).select("trip", "a", F.col("q.stop").alias("b")).filter("a <> b")
    return pair.distinct().groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1")


def in_window(start: Column, end: Column, low, high, closed: bool = False) -> Column:
    return (start <= high) & (end >= low) if closed else (start < high) & (end > low)
