"""Queries of strategies, connection scans, geometry and zonings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assignment as A
from ..operators import choice as C
from ..operators import distribution as D
from ..operators import graph as G
from .demand import PATH, _balance, r4
from .domain import oracle, table

Q: dict = {}
O: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            O[name] = oracle(sql)
        return f

    return put


@query("optimal_strategy_cost")
def _(spark, d):
    edges = table(spark, d, "road_links").select("a", "b", "time", F.when((F.col("a") + F.col("b")) % 3 == 0, F.lit(0.25)).alias("frequency"))
    return C.strategies(edges, table(spark, d, "zones").select("zone")).select("origin", "destination", r4("cost"))


@query("connection_scan")
def _(spark, d):
    at = F.col("trip") % 3600 + F.col("link_sequence") * 60
    c = table(spark, d, "links").select("trip", "a", "b", at.cast("double").alias("departure"), (at + 50).cast("double").alias("arrival"))
    return C.earliest(c, table(spark, d, "zones").select("zone"), 0.0, 10.0)


LEGS = "tp AS (SELECT origin, destination AS park, distance AS cost FROM {skims} WHERE destination % 6 = 0), fp AS (SELECT origin AS park, destination, distance * 0.7 + 0.1 * (origin % 4) AS cost FROM {skims} WHERE origin % 6 = 0)"


@query("park_and_ride", f"WITH {LEGS} SELECT tp.origin, fp.destination, round(min(tp.cost + fp.cost), 4) AS cost FROM tp JOIN fp USING (park) GROUP BY tp.origin, fp.destination")
def _(spark, d):
    k = table(spark, d, "skims")
    to = k.filter("destination % 6 = 0").select("origin", F.col("destination").alias("park"), F.col("distance").alias("cost"))
    on = k.filter("origin % 6 = 0").select(F.col("origin").alias("park"), "destination", (F.col("distance") * 0.7 + 0.1 * (F.col("origin") % 4)).alias("cost"))
    return C.park_and_ride(to, on).groupBy("origin", "destination").agg(F.round(F.min("cost"), 4).alias("cost"))


@query("select_link", f"WITH {PATH} SELECT CAST(z AS INT) AS a, CAST(nz AS INT) AS b, round(sum(volume), 4) AS volume FROM legs SEMI JOIN (SELECT origin, destination, segment FROM legs WHERE z = 6 AND nz = 7) USING (origin, destination, segment) WHERE nz IS NOT NULL GROUP BY z, nz")
def _(spark, d):
    return A.assign(C.select_link(A.grid_paths(table(spark, d, "volumes")), 6, 7)).select("a", "b", r4("volume"))


@query("point_in_polygon", "SELECT id FROM (SELECT c_custkey AS id, CAST(c_custkey * 37 % 101 AS DOUBLE) AS x, CAST(c_custkey * 53 % 103 AS DOUBLE) AS y FROM {customer}) WHERE y > 10.5 AND y < 60.5 AND x > 10.5 + (y - 10.5) * 0.4 AND x < 80.5")
def _(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 101).cast("double").alias("x"), (F.col("c_custkey") * 53 % 103).cast("double").alias("y"))
    return p.filter(C.inside(F.col("x"), F.col("y"), [(10.5, 10.5), (80.5, 10.5), (80.5, 60.5), (30.5, 60.5)])).select("id")


@query("point_segment_distance", "SELECT id, round(sqrt(pow(x - t * 50, 2) + pow(y - t * 80, 2)), 4) AS distance FROM (SELECT *, greatest(0, least(1, (x * 50 + y * 80) / 8900)) AS t FROM (SELECT c_custkey AS id, CAST(c_custkey * 37 % 101 AS DOUBLE) AS x, CAST(c_custkey * 53 % 103 AS DOUBLE) AS y FROM {customer}))")
def _(spark, d):
    at = [F.lit(v) for v in (0.0, 0.0, 50.0, 80.0)]
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(C.segment_distance((F.col("c_custkey") * 37 % 101).cast("double"), (F.col("c_custkey") * 53 % 103).cast("double"), *at), 4).alias("distance"))


@query("two_way_links", "SELECT a, b, time FROM {road_links} WHERE a < b UNION ALL SELECT b, a, length / 500 FROM {road_links} WHERE a < b")
def _(spark, d):
    return C.two_way(table(spark, d, "road_links").filter("a < b").select("a", "b", "time", (F.col("length") / 500).alias("time_r")))


LINES = "sv AS (SELECT l_suppkey % 20 AS line, CAST(l_linenumber * 600 + l_partkey % 5 * 60 AS BIGINT) AS low, CAST(l_linenumber * 600 + l_partkey % 5 * 60 + 900 AS BIGINT) AS high, CAST(300 + l_quantity AS DOUBLE) AS headway FROM {lineitem})"


EVENTS = "e AS (SELECT line, low AS p, 1 / headway AS f, 1 AS n FROM sv UNION ALL SELECT line, high, -1 / headway, -1 FROM sv), g AS (SELECT line, p, sum(f) AS f, sum(n) AS n FROM e GROUP BY line, p), c AS (SELECT line, p AS low, lead(p) OVER w AS high, sum(f) OVER w AS f, sum(n) OVER w AS n FROM g WINDOW w AS (PARTITION BY line ORDER BY p))"


@query("headway_piecewise", f"WITH {LINES}, {EVENTS} SELECT line, low, high, round(1 / f, 4) AS headway FROM c WHERE high IS NOT NULL AND n > 0")
def _(spark, d):
    li = table(spark, d, "lineitem")
    low = (F.col("l_linenumber") * 600 + F.col("l_partkey") % 5 * 60).cast("long")
    s = li.select((F.col("l_suppkey") % 20).alias("line"), low.alias("low"), (low + 900).alias("high"), (300 + F.col("l_quantity")).cast("double").alias("headway"))
    return C.piecewise_headway(s).select("line", "low", "high", r4("headway"))


@query("zoning_redistribute", "WITH s AS (SELECT zone, zone % 4 AS cluster, 0.75::DOUBLE AS share FROM {zones} UNION ALL SELECT zone, (zone + 1) % 4, 0.25::DOUBLE FROM {zones}) SELECT o.cluster AS origin, t.cluster AS destination, round(sum(volume * o.share * t.share), 3) AS volume FROM {od_volumes} v JOIN s o ON v.origin = o.zone JOIN s t ON v.destination = t.zone GROUP BY o.cluster, t.cluster")
def _(spark, d):
    z = table(spark, d, "zones")
    s = z.select("zone", (F.col("zone") % 4).alias("cluster"), F.lit(0.75).alias("share")).union(z.select("zone", ((F.col("zone") + 1) % 4).alias("cluster"), F.lit(0.25)))
    return C.redistribute(table(spark, d, "od_volumes"), s).select("origin", "destination", r4("volume", 3))


@query("te_los_band", "WITH w AS (SELECT origin, destination, CAST(volume * 7 % 3600 AS DOUBLE) AS wish FROM {od_volumes}), s AS (SELECT DISTINCT origin, destination, CAST(orderkey % 3600 AS DOUBLE) AS departure FROM {od}) SELECT origin, destination, wish, departure, abs(departure - wish) AS delay FROM w JOIN s USING (origin, destination) WHERE departure BETWEEN wish - 300 AND wish + 600")
def _(spark, d):
    w = table(spark, d, "od_volumes").select("origin", "destination", (F.col("volume") * 7 % 3600).cast("double").alias("wish"))
    s = table(spark, d, "od").select("origin", "destination", (F.col("orderkey") % 3600).cast("double").alias("departure")).distinct()
    return C.shifted(w, s, 300, 600)


@query("ipf_marginals", _balance("b0 AS (SELECT o.zone AS origin, t.zone AS destination, o.emission, o2.total / t2.total * t.attraction AS attraction, 1 + (o.zone * 3 + t.zone) % 4 + 0.0D0 AS volume FROM {zones} o CROSS JOIN {zones} t CROSS JOIN (SELECT sum(emission) AS total FROM {zones}) o2 CROSS JOIN (SELECT sum(attraction) AS total FROM {zones}) t2)", 5))
def _(spark, d):
    cells = table(spark, d, "skims").withColumn("volume", (1 + (F.col("origin") * 3 + F.col("destination")) % 4).cast("double"))
    return D.balance(cells, 5).select("origin", "destination", r4("volume", 3))


@query("od_sample")
def _(spark, d):
    return C.sampled(table(spark, d, "od_volumes"), 0.1)


@query("turn_penalty_cost")
def _(spark, d):
    """Shortest costs on links as nodes, where a turn costs 0.5 more than going on."""
    r = table(spark, d, "road_links").select((F.col("a") * 100 + F.col("b")).alias("k"), "a", "b", "time")
    n = r.select(F.col("k").alias("k2"), F.col("a").alias("b"), F.col("b").alias("c"), F.col("time").alias("t2"))
    t = r.join(n, "b").filter("a <> c").select(F.col("k").cast("int").alias("a"), F.col("k2").cast("int").alias("b"), (F.col("t2") + F.when(F.col("b") - F.col("a") == F.col("c") - F.col("b"), 0.0).otherwise(0.5)).alias("time"))
    return G.shortest_paths(t, r.select("k")).select("origin", "destination", r4("cost"))
