"""Public transport paths: the graph of boarding, riding and alighting edges, best paths, and alternatives without modes or routes.

Vertices are texts. Searches broadcast the graph (of checked size) and deal out
origins; zones begin and end paths, and none leads through them.
"""

from __future__ import annotations

import heapq
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import network

SCHEMA = "origin string, destination string, gtime double, path array<string>"


def boarding_edges(links: DataFrame, boarding: float = 0.0) -> DataFrame:
    """(a, b, cost): from a stop onto a link: its time, half its headway and the boarding time. links (link, trip, link_sequence, a, b, time, headway)."""
    return links.select("a", F.col("link").alias("b"), (F.col("time") + F.col("headway") / 2 + boarding).alias("cost"))


def riding_edges(links: DataFrame) -> DataFrame:
    """(a, b, cost): from a link to the next of its trip."""
    on = links.select("trip", "link_sequence", F.col("link").alias("b"), "time")
    return links.select("trip", (F.col("link_sequence") + 1).alias("link_sequence"), F.col("link").alias("a")).join(on, ["trip", "link_sequence"]).select("a", "b", F.col("time").cast("double").alias("cost"))


def alighting_edges(links: DataFrame, alighting: float = 0.0) -> DataFrame:
    return links.select(F.col("link").alias("a"), "b", F.lit(float(alighting)).alias("cost"))


def edges(links: DataFrame, footpaths: DataFrame | None = None, connectors: DataFrame | None = None, boarding: float = 0.0, alighting: float = 0.0) -> DataFrame:
    """All edges of the graph; footpaths and connectors are (a, b, time)."""
    out = boarding_edges(links, boarding).unionByName(riding_edges(links)).unionByName(alighting_edges(links, alighting))
    for walk in (footpaths, connectors):
        if walk is not None:
            out = out.unionByName(walk.select("a", "b", F.col("time").cast("double").alias("cost")))
    return out.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "cost")


def _trees(out: dict, zones: frozenset, origin: str, wanted: frozenset | None):
    """(destination, cost, path) of the zones that origin reaches; ties go to the smaller predecessor."""
    cost, before, heap, done = {origin: 0.0}, {}, [(0.0, origin)], set()
    while heap:
        c, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        if u in zones and u != origin:
            if wanted is None or u in wanted:
                path = [u]
                while path[-1] != origin:
                    path.append(before[path[-1]])
                yield u, c, path[::-1]
            continue
        for v, w in out.get(u, ()):
            x, old = c + w, cost.get(v)
            if old is None or x < old or (x == old and u < before.get(v, u)):
                cost[v], before[v] = x, u
                heapq.heappush(heap, (x, v))


def best_paths(graph: DataFrame, zones: DataFrame, pairs: DataFrame | None = None, cutoff: float = float("inf")) -> DataFrame:
    """(origin, destination, gtime, path) between zones, or for the pairs (origin, destination) alone; a zone to itself costs nothing."""
    links = network(graph, "cost")
    around: dict = {}
    for a, b, w in links:
        around.setdefault(a, []).append((b, w))
    names = frozenset(r[0] for r in zones.select(F.col(zones.columns[0]).cast("string")).collect())  # zones are part of the graph
    spread = graph.sparkSession.sparkContext.broadcast((around, names))
    if pairs is None:
        work = zones.select(F.col(zones.columns[0]).cast("string").alias("origin"), F.lit(None).cast("array<string>").alias("to")).distinct()
    else:
        work = pairs.select(F.col("origin").cast("string"), F.col("destination").cast("string")).groupBy("origin").agg(F.collect_set("destination").alias("to"))

    def run(batches):
        around, names = spread.value
        for b in batches:
            for o, to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                wanted = None if to is None else frozenset(to)
                rows = [(o, o, 0.0, [o])] if wanted is None or o in wanted else []
                for d, c, p in _trees(around, names, o, wanted):
                    if c <= cutoff:
                        rows.append((o, d, c, p))
                    if len(rows) >= 5000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return work.repartition(graph.sparkSession.sparkContext.defaultParallelism, "origin").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["origin", "destination", "gtime", "path"])


def users(paths: DataFrame, links: DataFrame, column: str, values: list) -> DataFrame:
    """(origin, destination) of the paths that use a link with one of the values."""
    bad = links.filter(F.col(column).isin(values)).select(F.col("link").alias("vertex"))
    return paths.select("origin", "destination", F.explode("path").alias("vertex")).join(bad, "vertex", "left_semi").select("origin", "destination").distinct()


def end_users(paths: DataFrame, links: DataFrame, column: str) -> DataFrame:
    """(zone, side, value): zones whose first, or last, ride is on a link with the value."""
    on = paths.select("origin", "destination", F.posexplode("path").alias("place", "link")).join(links.select("link", column), "link")
    ends = on.groupBy("origin", "destination").agg(F.min_by(column, "place").alias("first"), F.max_by(column, "place").alias("last"))
    return ends.select(F.explode(F.array(F.struct(F.col("origin").alias("zone"), F.lit("first").alias("side"), F.col("first").alias("value")), F.struct(F.col("destination").alias("zone"), F.lit("last").alias("side"), F.col("last").alias("value")))).alias("e")).select("e.*").distinct()


def broken_paths(links: DataFrame, best: DataFrame, column: str, values: list, zones: DataFrame, **walks) -> DataFrame:
    """Best paths without the links that have one of the values, for the OD whose best path uses them."""
    rest = links.filter(~F.col(column).isin(values))
    return best_paths(edges(rest, **walks), zones, users(best, links, column, values)).withColumn("broken", F.array(*map(F.lit, values)))


def alternatives(links: DataFrame, zones: DataFrame, modes: list[str] = (), routes: list = (), **walks) -> DataFrame:
    """Best paths, and those without each set of modes and each route; a path is kept once, with the first of its broken sets."""
    best = best_paths(edges(links, **walks), zones).withColumn("broken", F.array().cast("array<string>")).persist()
    out = best
    sets = [("mode", list(s)) for n in range(1, len(modes)) for s in itertools.combinations(modes, n)] + [("route", [r]) for r in routes]
    for column, values in sets:
        out = out.unionByName(broken_paths(links, best, column, values, zones, **walks))
    order = Window.partitionBy("origin", "destination", "path").orderBy(F.size("broken"), "broken")
    return out.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def without(graph: DataFrame, vertices: list[str]) -> DataFrame:
    """The graph without some vertices."""
    return graph.filter(~F.col("a").isin(vertices) & ~F.col("b").isin(vertices))


def search_backwards(pairs: DataFrame) -> bool:
    """Whether there are fewer destinations than origins, so that a search from the destinations is shorter."""
    n = pairs.agg(F.countDistinct("origin").alias("o"), F.countDistinct("destination").alias("d")).first()
    return n["d"] < n["o"]


def connector_time(distance: Column, short: float, long: float, threshold: float) -> Column:
    """Seconds over a distance in metres; speed in km/h grows from short to long with the root of the distance."""
    speed = F.greatest(F.lit(short), F.least(F.lit(long), short * F.sqrt(distance / threshold)))
    return distance / speed * 3.6


def time_edges(connections: DataFrame) -> DataFrame:
    """The time-expanded graph of connections (link, trip, link_sequence, a, b, departure, arrival): (from, to, kind, duration).

    A stop's vertices are its times of boarding and of alighting; kinds are ride, board, stay and wait."""
    node = lambda stop, kind, t: F.concat_ws("|", F.col(stop).cast("string"), F.lit(kind), t.cast("string"))
    dep, arr = F.col("departure"), F.col("arrival")
    ride = connections.select(F.concat(F.lit("t|"), F.col("link").cast("string")).alias("from"), node("b", "alight", arr).alias("to"), F.lit("ride").alias("kind"), (arr - dep).cast("double").alias("duration"))
    board = connections.select(node("a", "board", dep).alias("from"), F.concat(F.lit("t|"), F.col("link").cast("string")).alias("to"), F.lit("board").alias("kind"), F.lit(0.0).alias("duration"))
    w = Window.partitionBy("trip").orderBy("link_sequence")
    stay = connections.withColumns({"n": F.lead("link").over(w), "t": F.lead("departure").over(w)}).filter("n is not null")
    stay = stay.select(F.concat(F.lit("t|"), F.col("link").cast("string")).alias("from"), F.concat(F.lit("t|"), F.col("n").cast("string")).alias("to"), F.lit("stay").alias("kind"), (F.col("t") - dep).cast("double").alias("duration"))
    times = connections.select(F.col("a").alias("stop"), dep.alias("t")).distinct()
    s = Window.partitionBy("stop").orderBy("t")
    wait = times.withColumn("n", F.lead("t").over(s)).filter("n is not null").select(node("stop", "board", F.col("t")).alias("from"), node("stop", "board", F.col("n")).alias("to"), F.lit("wait").alias("kind"), (F.col("n") - F.col("t")).cast("double").alias("duration"))
    return ride.unionByName(board).unionByName(stay).unionByName(wait)
