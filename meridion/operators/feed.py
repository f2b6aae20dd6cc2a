"""Timetable feeds to networks: services, patterns, frequencies, links, directions, common lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active_dates(calendar: DataFrame, exceptions: DataFrame, dates: list[str]) -> DataFrame:
    """(service, date) of the services that run on each date: by weekday and range, with additions (type 1), without removals (type 2).

    calendar (service, mask: seven characters, start_date, end_date); exceptions (service, date, exception_type)."""
    day = calendar.sparkSession.createDataFrame([(d,) for d in dates], "day string").select(F.to_date("day").alias("date"))
    c = calendar.join(F.broadcast(day), (F.col("date") >= F.col("start_date")) & (F.col("date") <= F.col("end_date")))  # the dates asked for
    usual = c.filter(F.substring("mask", F.weekday("date") + 1, F.lit(1)) == "1").select("service", "date")
    e = exceptions.join(F.broadcast(day), "date").select("service", "date", "exception_type")
    return usual.union(e.filter("exception_type = 1").select("service", "date")).distinct().join(e.filter("exception_type = 2"), ["service", "date"], "left_anti")


def grouped_services(active: DataFrame) -> DataFrame:
    """(service, group): services that run on the same dates share a group, the least of them."""
    on = active.groupBy("service").agg(F.array_sort(F.collect_set("date")).alias("dates"))
    return on.withColumn("group", F.min("service").over(Window.partitionBy("dates"))).select("service", "group")


def crossed_groups(a: DataFrame, b: DataFrame) -> DataFrame:
    """(service, group): the parts in which two groupings (service, group) agree, numbered by their least service."""
    both = a.select("service", F.col("group").alias("ga")).join(b.select("service", F.col("group").alias("gb")), "service")
    return both.withColumn("group", F.min("service").over(Window.partitionBy("ga", "gb"))).select("service", "group")


def numbered_patterns(stop_times: DataFrame, trips: DataFrame, group: str) -> DataFrame:
    """(trip, group, pattern, footprint): the stop sequences of a group numbered from 1 in their order."""
    stops = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "stop"))), lambda x: x["stop"].cast("string")), "-")
    foot = stop_times.groupBy("trip").agg(stops.alias("footprint")).join(trips.select("trip", group), "trip")
    # Numbers go to the distinct footprints, so that a footprint of many trips is ranked once.
    ranks = foot.select(group, "footprint").distinct().withColumn("pattern", F.row_number().over(Window.partitionBy(group).orderBy("footprint")))
    return foot.join(ranks, [group, "footprint"]).select("trip", group, "pattern", "footprint")


def span_headway(frequencies: DataFrame, key: list[str], low: float, high: float) -> DataFrame:
    """(key, headway): the range over the departures in it, rounded; 0 where nothing runs.

    frequencies (key, start, end, headway): a departure every headway within start .. end; headway 0 is one departure."""
    start, end = F.greatest("start", F.lit(low)), F.least("end", F.lit(high))
    single = (F.col("headway") == 0) & F.col("start").between(low, high)
    n = F.when(F.col("headway") == 0, F.when(single, 1.0).otherwise(0.0)).otherwise(F.greatest(end - start, F.lit(0.0)) / F.col("headway"))
    got = frequencies.groupBy(*key).agg(F.sum(n).alias("n"))
    return got.select(*key, _rounded_headway(F.col("n"), high - low).alias("headway"))


def _rounded_headway(n: Column, span: float) -> Column:
    return F.when(n > 0, F.round(span / n)).otherwise(0.0).cast("long")


def as_frequencies(stop_times: DataFrame, patterns: DataFrame, group: str, low: float, high: float, order: Column | None = None) -> DataFrame:
    """(group, pattern, trip, headway): one trip for each pattern that runs in low .. high, and the headway of all its trips (trip, departure).

    The trip is the first by `order`, over start (its first departure) and trip; by default the first to depart. Ties go
    to the least trip. A headway may round to 0."""
    first = stop_times.groupBy("trip").agg(F.min("departure").cast("double").alias("start")).join(patterns, "trip")
    order = F.struct(F.col("start") if order is None else order, "trip")
    got = first.groupBy(group, "pattern").agg(F.min_by("trip", order).alias("trip"), F.sum(F.when(F.col("start").between(low, high), 1.0).otherwise(0.0)).alias("n"))
    return got.filter("n > 0").select(group, "pattern", "trip", _rounded_headway(F.col("n"), high - low).alias("headway"))


def timed_links(stop_times: DataFrame) -> DataFrame:
    """(trip, link_sequence, a, b, departure, arrival, time): consecutive stops of each trip (trip, seq, stop, arrival, departure)."""
    w = Window.partitionBy("trip").orderBy("seq")
    on = stop_times.withColumns({"b": F.lead("stop").over(w), "to": F.lead("arrival").over(w), "n": F.row_number().over(w)})
    return on.filter("b is not null").select("trip", F.col("n").alias("link_sequence"), F.col("stop").alias("a"), "b", "departure", F.col("to").alias("arrival"), (F.col("to") - F.col("departure")).alias("time"))


def network_links(stop_times: DataFrame, trips: DataFrame, frequencies: DataFrame) -> DataFrame:
    """timed_links() with the trip's headway and columns; links without a headway are left out."""
    return timed_links(stop_times).join(frequencies.filter("headway > 0").select("trip", "headway"), "trip").join(trips, "trip")


def signed_overlap(links: DataFrame, reference: DataFrame, group: str) -> DataFrame:
    """(trip, overlap): links that a trip has in common with its group's reference trip, less those that it runs the other way, over its links.

    links (trip, group, a, b); reference (group, a, b)."""
    r = reference.select(group, "a", "b").distinct()
    same = links.join(r.withColumn("same", F.lit(1)), [group, "a", "b"], "left")
    both = same.join(r.select(group, F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("back")), [group, "a", "b"], "left")
    return both.groupBy("trip", group).agg(((F.coalesce(F.sum("same"), F.lit(0)) - F.coalesce(F.sum("back"), F.lit(0))) / F.count("*")).alias("overlap"))


def directions(links: DataFrame, group: str) -> DataFrame:
    """(trip, group, direction): 0 for trips that run as the group's longest trip (ties: the least) does, 1 for the other way."""
    size = links.groupBy(group, "trip").count()
    top = size.groupBy(group).agg(F.max_by("trip", F.struct("count", -F.col("trip"))).alias("trip"))
    got = signed_overlap(links, links.join(top, [group, "trip"]), group)
    return got.select("trip", group, F.when(F.col("overlap") >= 0, 0).otherwise(1).alias("direction"))


def first_trips(trips: DataFrame, keys: list[str]) -> DataFrame:
    """One trip, the least, for each key."""
    return trips.groupBy(*keys).agg(F.min("trip").alias("trip"))


def stop_timetable(stop_times: DataFrame, trips: DataFrame, active: DataFrame) -> DataFrame:
    """(date, stop, departure, trip) of the services' dates; trips (trip, service)."""
    return stop_times.join(trips.select("trip", "service"), "trip").join(active, "service").select("date", "stop", "departure", "trip")


def travelled(points: DataFrame, key: str, order: str) -> DataFrame:
    """points (key, order, x, y) with the distance from the first along the line."""
    w = Window.partitionBy(key).orderBy(order)
    leg = F.coalesce(F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)), F.lit(0.0))
    return points.withColumn("__d", leg).withColumn("distance", F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__d")


def by_time(stop_times: DataFrame, lengths: DataFrame) -> DataFrame:
    """stop_times (trip, seq, departure) with the distance of a trip's length (trip, length) in proportion to time."""
    w = Window.partitionBy("trip")
    share = (F.col("departure") - F.min("departure").over(w)) / (F.max("departure").over(w) - F.min("departure").over(w))
    return stop_times.join(lengths, "trip").withColumn("distance", F.col("length") * share).drop("length")


def common_trips(links: DataFrame) -> DataFrame:
    """(trips): the different sets of more than one trip that share a link, largest first."""
    got = links.groupBy("a", "b").agg(F.array_sort(F.collect_set("trip")).alias("trips")).filter("size(trips) > 1").select("trips").distinct()
    return got.orderBy(F.desc(F.size("trips")), "trips")


def shared_stops(stop_times: DataFrame, trips: list) -> DataFrame:
    """(stop, place): the stops that all of the trips serve once, in the first trip's order, without those from which any trip goes back to the next.

    The last stop is kept where the one before it is. The trips' stops alone meet in a task."""
    some = stop_times.filter(F.col("trip").isin(trips))
    at = some.groupBy("stop").agg(F.map_from_entries(F.collect_list(F.struct(F.col("trip").cast("string"), "seq"))).alias("at"), F.count("*").alias("n"), F.countDistinct("trip").alias("trips"))
    both = at.filter((F.col("trips") == len(set(trips))) & (F.col("n") == F.col("trips")))
    w = Window.orderBy(F.element_at("at", F.lit(str(trips[0]))))
    ahead = lambda other: F.reduce(F.map_values(F.map_zip_with("at", other, lambda k, x, y: (y - x > 0).cast("int"))), F.lit(1), lambda a, x: F.least(a, x)) == 1
    on = both.withColumn("__next", F.lead("at").over(w)).withColumn("__ok", F.when(F.col("__next").isNotNull(), ahead(F.col("__next"))))
    on = on.withColumn("__ok", F.coalesce("__ok", F.lag("__ok").over(w))).filter("__ok")
    return on.select("stop", F.row_number().over(w).alias("place"))


def common_segments(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, headway, time, n): lines that run together as one: one over the sum of frequencies, the mean time, their number.

    links (keys, trip, time, headway); a trip's parts of a segment are added up first."""
    own = links.groupBy(*keys, "trip").agg(F.sum("time").alias("time"), F.first("headway").alias("headway"))
    return own.groupBy(*keys).agg((1 / F.sum(1 / F.col("headway"))).alias("headway"), F.avg("time").alias("time"), F.count("*").alias("n"))


def split_volume(common: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, trip, volume): the volume of a common segment (keys, headway, volume), dealt to its trips by their frequency."""
    c = common.select(*keys, F.col("headway").alias("__h"), "volume")
    return links.select(*keys, "trip", "headway").distinct().join(c, keys).select(*keys, "trip", (F.col("volume") * F.col("__h") / F.col("headway")).alias("volume"))


def wide_arrays(stop_times: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A row for each trip with its values as arrays in order of seq."""
    items = F.array_sort(F.collect_list(F.struct("seq", *values)))

    def field(name):
        return F.transform("__s", lambda x: x[name]).alias(name)

    return stop_times.groupBy(*keys).agg(items.alias("__s")).select(*keys, *map(field, values))


def long_trips(patterns: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """Links with arrays of departures and arrivals (one place a run) to one trip for each place."""
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    out = patterns.select("*", F.posexplode(zipped).alias("__n", "__z")).drop(*arrays)
    return out.withColumn(key, F.concat_ws("_", F.col(key).cast("string"), F.col("__n").cast("string"))).select("*", *[F.col(f"__z.{a}").alias(a) for a in arrays]).drop("__n", "__z")


def link_times(stop_times: DataFrame, lengths: Column) -> DataFrame:
    """timed_links() with dwell (departure less arrival at the start) and speed over lengths."""
    w = Window.partitionBy("trip").orderBy("link_sequence")
    on = timed_links(stop_times).withColumn("dwell", F.col("departure") - F.lag("arrival").over(w))
    return on.withColumn("speed", F.when(F.col("time") > 0, lengths / F.col("time")))
