"""Analysis of paths: arrays of vertices (zones, nodes, links), and the loads, times and lengths along them.

`kinds` is a table (vertex, kind) with kind zone, node or link. All of it is one
explode, one join and windows over the places of a path, so nothing depends on
the length of a path or on the size of the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def steps(paths: DataFrame, kinds: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """A row for each vertex of each path: keys, place (from 0), vertex, kind, and the vertex and kind before and after."""
    return beside(paths.select(*keys, F.posexplode(path).alias("place", "vertex")).join(kinds.select("vertex", "kind"), "vertex", "left"), keys)


def beside(at: DataFrame, keys: list[str]) -> DataFrame:
    """steps() of places whose kinds are known: keys, place, vertex, kind."""
    w = Window.partitionBy(*keys).orderBy("place")
    beside = {f"{c}_{side}": f(c).over(w) for c in ("vertex", "kind") for side, f in (("before", F.lag), ("after", F.lead))}
    return at.withColumns(beside)


def roles(step: DataFrame) -> DataFrame:
    """steps() with a flag for what each vertex is on its path; the ends of a path are no vertices of this kind."""
    inner = F.col("vertex_before").isNotNull() & F.col("vertex_after").isNotNull()
    k, p, n = F.col("kind"), F.col("kind_before"), F.col("kind_after")
    is_ = lambda c, x: F.coalesce(c == x, F.lit(False))
    link, node = inner & is_(k, "link"), inner & is_(k, "node")
    return step.withColumns({
        "in_link_path": link,
        "in_node_path": node,
        "boarding_link": link & ~is_(p, "link"),
        "alighting_link": link & ~is_(n, "link"),
        "boarding": node & is_(n, "link"),
        "alighting": node & is_(p, "link"),
        "footpath": node & is_(p, "node"),
        "access": node & is_(p, "zone"),
        "egress": node & is_(n, "zone"),
    })


def described(role: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each path: its lists of vertices by role, transfers, the number of transfers, and whether it is walked alone."""

    def those(flag: str, value: str = "vertex") -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col(flag), F.struct("place", F.col(value).alias("v"))))), lambda x: x["v"])

    lists = {"link_path": "in_link_path", "node_path": "in_node_path", "boardings": "boarding", "alightings": "alighting", "boarding_links": "boarding_link", "alighting_links": "alighting_link"}
    out = role.groupBy(*keys).agg(*[those(f).alias(c) for c, f in lists.items()])
    out = out.withColumn("transfers", F.filter("boardings", lambda x: F.array_contains("alightings", x)))
    return out.withColumns({"ntransfers": F.greatest(F.size("boarding_links") - 1, F.lit(0)), "all_walk": F.size("link_path") == 0})


def loads(role: DataFrame, volumes: DataFrame, keys: list[str]) -> DataFrame:
    """(vertex, volume, boardings, alightings) of links and nodes: demand (keys, volume) summed over the paths that it takes."""
    v = role.join(volumes.filter("volume > 0").select(*keys, F.col("volume").alias("__v")), keys)
    of = lambda *flags: F.sum(F.when(F.greatest(*[F.col(f) for f in flags]) if len(flags) > 1 else F.col(flags[0]), F.col("__v")).otherwise(0.0))
    got = v.groupBy("vertex", "kind").agg(of("in_link_path", "in_node_path").alias("volume"), of("boarding", "boarding_link").alias("boardings"), of("alighting", "alighting_link").alias("alightings"))
    return got.filter("kind <> 'zone' and volume > 0")


def transfer_loads(role: DataFrame, volumes: DataFrame, keys: list[str]) -> DataFrame:
    """(vertex, transfers): demand that alights and boards at a node."""
    both = role.filter("boarding and alighting").join(volumes.select(*keys, "volume"), keys)
    return both.groupBy("vertex").agg(F.sum("volume").alias("transfers"))


def sums_along(role: DataFrame, values: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys and the sum of a column of links (vertex, column) over each path's links."""
    on = role.filter("in_link_path").select(*keys, "vertex").join(values.select("vertex", column), "vertex")
    return on.groupBy(*keys).agg(F.sum(column).alias(column))


def time_parts(role: DataFrame, links: DataFrame, walks: DataFrame, keys: list[str], boarding: float = 0.0) -> DataFrame:
    """in_vehicle, waiting (half the headway of boarded links), boarding, footpath and access times of each path, and their sum.

    links (vertex, time, headway); walks (a, b, time) are footpaths and connectors."""
    legs = role.filter("footpath or access").select(*keys, F.col("vertex_before").alias("a"), F.col("vertex").alias("b"), F.col("footpath").alias("on_foot"))
    legs = legs.unionByName(role.filter("egress").select(*keys, F.col("vertex").alias("a"), F.col("vertex_after").alias("b"), F.lit(False).alias("on_foot")))
    zero = F.lit(0.0)
    legs = legs.join(walks.select("a", "b", F.col("time").alias("t")), ["a", "b"], "left").select(*keys, F.when(F.col("on_foot"), F.col("t")).otherwise(zero).alias("footpath_time"), F.when(F.col("on_foot"), zero).otherwise(F.col("t")).alias("access_time"), zero.alias("in_vehicle_time"), zero.alias("waiting_time"), zero.alias("boarding_time"))
    ride = role.filter("in_link_path").select(*keys, "vertex", "boarding_link").join(links.select("vertex", "time", "headway"), "vertex")
    aboard = lambda x: F.when(F.col("boarding_link"), x).otherwise(zero)
    ride = ride.select(*keys, zero.alias("footpath_time"), zero.alias("access_time"), F.col("time").cast("double").alias("in_vehicle_time"), aboard(F.col("headway") / 2).alias("waiting_time"), aboard(F.lit(boarding)).alias("boarding_time"))
    parts = ["footpath_time", "access_time", "in_vehicle_time", "waiting_time", "boarding_time"]
    out = legs.unionByName(ride).groupBy(*keys).agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in parts])
    return out.withColumn("time", sum((F.col(c) for c in parts[1:]), F.col(parts[0])))


def route_types(role: DataFrame, types: DataFrame, keys: list[str], hierarchy: list[str]) -> DataFrame:
    """The sorted distinct types (vertex, route_type) of each path's links, and the first of the hierarchy among them ('walk' if there is none)."""
    on = role.filter("in_link_path").select(*keys, "vertex").join(types.select("vertex", "route_type"), "vertex")
    every = role.select(*keys).distinct().join(on.groupBy(*keys).agg(F.array_sort(F.collect_set("route_type")).alias("route_types")), keys, "left")
    every = every.withColumn("route_types", F.coalesce("route_types", F.array().cast("array<string>")))
    return every.withColumn("route_type", F.coalesce(*[F.when(F.array_contains("route_types", t), F.lit(t)) for t in hierarchy], F.lit("walk")))


def transfer_list(role: DataFrame, routes: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each transfer of a path: from_stop, to_stop, from_route, to_route (routes: vertex, route of links)."""
    ends = role.filter("boarding_link or alighting_link").join(routes.select("vertex", "route"), "vertex")
    w = Window.partitionBy(*keys).orderBy("place")
    last = {f"from_{c}": F.last(F.when(F.col("alighting_link"), F.col(v)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for c, v in (("stop", "vertex_after"), ("route", "route"))}
    return ends.withColumns(last).filter("boarding_link and from_route is not null").select(*keys, "place", "from_stop", F.col("vertex_before").alias("to_stop"), "from_route", F.col("route").alias("to_route"))


def legs(role: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each ride of a path: agency, route, the zone of the stop where it begins and of that where it ends.

    links (vertex, route, agency, from_zone, to_zone)."""
    ends = role.filter("boarding_link or alighting_link").join(links, "vertex")
    w = Window.partitionBy(*keys).orderBy("place").rowsBetween(0, Window.unboundedFollowing)
    out = F.first(F.when(F.col("alighting_link"), F.col("to_zone")), ignorenulls=True).over(w)
    return ends.withColumn("end_zone", out).filter("boarding_link").select(*keys, "place", "agency", "route", F.col("from_zone").alias("start_zone"), "end_zone")


def node_to_link_path(paths: DataFrame, links: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Paths of nodes to paths of links (link, a, b): keys and link_path, in order; pairs without a link are left out."""
    at = paths.select(*keys, F.posexplode(path).alias("place", "b"))
    pairs = at.withColumn("a", F.lag("b").over(Window.partitionBy(*keys).orderBy("place"))).filter("a is not null")
    on = pairs.join(links.select("a", "b", "link"), ["a", "b"])
    return on.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "link"))), lambda x: x["link"]).alias("link_path"))


def road_link_path(paths: DataFrame, roads: DataFrame, keys: list[str]) -> DataFrame:
    """The road links under a path of links: roads (link, road_links: array), in order."""
    at = paths.select(*keys, F.posexplode("link_path").alias("place", "link")).join(roads.select("link", "road_links"), "link")
    return at.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "road_links"))), lambda x: x["road_links"])).alias("road_link_path"))


def line_od(role: DataFrame, routes: DataFrame, volumes: DataFrame, keys: list[str]) -> DataFrame:
    """(route, from_stop, to_stop, volume): demand between the stops of each line (routes: vertex, route)."""
    ends = role.filter("boarding_link or alighting_link").join(routes.select("vertex", "route"), "vertex")
    w = Window.partitionBy(*keys).orderBy("place").rowsBetween(0, Window.unboundedFollowing)
    stop = F.first(F.when(F.col("alighting_link"), F.col("vertex_after")), ignorenulls=True).over(w)
    ride = ends.withColumn("to_stop", stop).filter("boarding_link").select(*keys, "route", F.col("vertex_before").alias("from_stop"), "to_stop")
    return ride.join(volumes.select(*keys, "volume"), keys).groupBy("route", "from_stop", "to_stop").agg(F.sum("volume").alias("volume"))


def shifted_alightings(loads_: DataFrame, line: str, order: str) -> DataFrame:
    """Links of lines with alightings, one stop further along: what alights at the end of a link stands at the next, and at a row after the last link."""
    w = Window.partitionBy(line).orderBy(order)
    moved = loads_.withColumn("alightings_here", F.coalesce(F.lag("alightings").over(w), F.lit(0.0)))
    last = moved.withColumn("__n", F.lead(order).over(w)).filter("__n is null")
    zero = F.lit(0.0)
    end = last.select(line, (F.col(order) + 1).alias(order), zero.alias("volume"), zero.alias("boardings"), F.col("alightings").alias("alightings_here"))
    return moved.select(line, order, "volume", "boardings", "alightings_here").unionByName(end)
