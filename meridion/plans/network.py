"""Queries over networks and timetables: joins, sequences, integrity, graphs, fares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import assignment as A
from ..operators import graph as G
from ..operators import integrity as I
from ..operators import joins as J
from ..operators import road as R
from ..operators import transit as T
from .demand import r4
from .domain import oracle, table

Q: dict = {}
O: dict[str, str] = {}


def query(name: str, sql: str | None):
    def put(f):
        Q[name] = f
        if sql:
            O[name] = oracle(sql)
        return f

    return put


CLICK = "c AS (SELECT user_id, event_id, t FROM {gps} WHERE event_type = 'click'), p AS (SELECT user_id, t, min(event_id) AS event_id FROM {gps} WHERE event_type = 'purchase' GROUP BY user_id, t)"


def gps(spark, d, kind):
    return table(spark, d, "gps").filter(F.col("event_type") == kind).select("user_id", "event_id", "t")


@query("asof_next_departure", f"WITH {CLICK} SELECT user_id, c.event_id, c.t, coalesce(p.t, -1) AS next_t, coalesce(p.event_id, -1) AS next_value FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t <= p.t".replace("SELECT user_id, c.event_id", "SELECT c.user_id, c.event_id"))
def _(spark, d):
    return J.next_event(gps(spark, d, "click"), gps(spark, d, "purchase"), "user_id", "t", "event_id").fillna(-1)


@query("transfer_range_join", f"WITH {CLICK} SELECT c.user_id, c.event_id, c.t, min(p.t) AS arrive FROM c JOIN p ON c.user_id = p.user_id AND p.t >= c.t + 300 GROUP BY ALL")
def _(spark, d):
    got = J.first_after(gps(spark, d, "click"), gps(spark, d, "purchase"), "user_id", "t", 300)
    return got.select("user_id", "event_id", "t", F.col("arrive").cast("long").alias("arrive"))


@query("pareto_front", "SELECT origin, destination, route_type, n, round(time, 4) AS time FROM {los} l WHERE NOT EXISTS (SELECT 1 FROM {los} m WHERE m.origin = l.origin AND m.destination = l.destination AND m.price <= l.price AND m.time <= l.time AND (m.price < l.price OR m.time < l.time OR m.route_type < l.route_type))")
def _(spark, d):
    return J.pareto(table(spark, d, "los"), ["origin", "destination"], "price", "time", ["route_type"]).select("origin", "destination", "route_type", "n", r4("time"))


POINTS = "pts AS (SELECT c_custkey AS id, CAST(c_custkey * 37 % 101 AS DOUBLE) AS x, CAST(c_custkey * 53 % 103 AS DOUBLE) AS y FROM {customer}), tgt AS (SELECT s_suppkey AS target, CAST(s_suppkey * 41 % 101 AS DOUBLE) AS tx, CAST(s_suppkey * 59 % 103 AS DOUBLE) AS ty FROM {supplier}), nn AS (SELECT id, target, sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) AS distance FROM pts CROSS JOIN tgt)"


def points(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    p = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 101).cast("double").alias("x"), (F.col("c_custkey") * 53 % 103).cast("double").alias("y"))
    return p, s.select(F.col("s_suppkey").alias("target"), (F.col("s_suppkey") * 41 % 101).cast("double").alias("tx"), (F.col("s_suppkey") * 59 % 103).cast("double").alias("ty"))


@query("connector_knn", f"WITH {POINTS} SELECT id, CAST(r AS INT) AS rank, target, round(distance, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, target) AS r FROM nn) WHERE r <= 2")
def _(spark, d):
    return J.nearest(*points(spark, d), 2, 20.0).select("id", "rank", "target", r4("distance"))


@query("connector_radius", f"WITH {POINTS} SELECT id, target, round(distance, 4) AS distance, round(distance / 4 * 3.6, 4) AS time FROM nn WHERE distance <= 10")
def _(spark, d):
    return J.within(*points(spark, d), 10.0, {"distance": r4("distance"), "time": F.round(F.col("distance") / 4 * 3.6, 4)})


@query("knn_regression", f"WITH {POINTS}, k AS (SELECT * FROM nn QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, target) <= 3) SELECT id, round(sum(s_acctbal / greatest(distance, 0.000001)) / sum(1 / greatest(distance, 0.000001)), 2) AS estimate FROM k JOIN {{supplier}} ON target = s_suppkey GROUP BY id")
def _(spark, d):
    v = table(spark, d, "supplier").select(F.col("s_suppkey").alias("target"), F.col("s_acctbal").alias("value"))
    return J.knn_regression(J.nearest(*points(spark, d), 3, 20.0), v).select("id", r4("estimate", 2))


@query("stop_links", "SELECT trip, seq AS link_sequence, a, b FROM (SELECT trip, seq, stop AS a, lead(stop) OVER (PARTITION BY trip ORDER BY seq) AS b FROM {stop_times}) WHERE b IS NOT NULL")
def _(spark, d):
    return T.stop_links(table(spark, d, "stop_times"))


@query("clean_sequences", "SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS seq FROM {lineitem}")
def _(spark, d):
    return T.clean_sequences(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_partkey", "seq")


FOOT = "f AS (SELECT trip, array_to_string(list(stop ORDER BY seq), '-') AS footprint FROM {stop_times} GROUP BY trip)"


@query("trip_footprints", f"WITH {FOOT} SELECT trip, footprint FROM f")
def _(spark, d):
    return T.footprints(table(spark, d, "stop_times"))


@query("trip_patterns", f"WITH {FOOT} SELECT footprint, count(*) AS n_trips, min(trip) AS trip FROM f GROUP BY footprint")
def _(spark, d):
    return T.patterns(table(spark, d, "stop_times"))


@query("headway_harmonic", "SELECT a, b, round(1 / sum(1 / headway), 6) AS headway FROM {links} GROUP BY a, b")
def _(spark, d):
    return T.headway_harmonic(table(spark, d, "links"), ["a", "b"]).select("a", "b", r4("headway", 6))


@query("headway_average", "SELECT user_id, round(86400.0 / count(t), 4) AS headway FROM {gps} GROUP BY user_id")
def _(spark, d):
    return T.average_headway(table(spark, d, "gps"), "user_id", "t", 86400.0).select("user_id", r4("headway"))


@query("headway_observed", "SELECT user_id, round(avg(g), 4) AS headway, count(*) AS n FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS g FROM {gps}) WHERE g IS NOT NULL GROUP BY user_id")
def _(spark, d):
    return T.observed_headway(table(spark, d, "gps"), "user_id", "t").select("user_id", r4("headway"), "n")


@query("line_graph_edges", "SELECT u.a, u.b, v.b AS c, count(*) AS n FROM {links} u JOIN {links} v ON u.trip = v.trip AND v.link_sequence = u.link_sequence + 1 AND u.b = v.a GROUP BY ALL")
def _(spark, d):
    return T.line_graph(table(spark, d, "links"))


for _name, _u in (("turn_expanded_links", True), ("drop_u_turns", False)):

    @query(_name, f"SELECT u.a, u.b, v.b AS c FROM {{road_links}} u JOIN {{road_links}} v ON u.b = v.a {'' if _u else 'WHERE u.a <> v.b'}")
    def _(spark, d, u=_u):
        return T.turns(table(spark, d, "road_links"), u)


@query("boarding_alighting_load", "SELECT trip, seq, round(sum(CASE WHEN seq % 2 = 1 THEN dwell ELSE -dwell / 2 END) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING), 4) AS load FROM {stop_times}")
def _(spark, d):
    s = table(spark, d, "stop_times").withColumns({"on": F.when(F.col("seq") % 2 == 1, F.col("dwell")).otherwise(0.0), "off": F.when(F.col("seq") % 2 == 0, F.col("dwell") / 2).otherwise(0.0)})
    return T.boarding_profile(s, "trip", "seq", "on", "off").select("trip", "seq", r4("load"))


@query("fare_run_length", "WITH s AS (SELECT trip, seq, stop % 3 AS zone, CASE WHEN lag(stop % 3) OVER w IS NOT DISTINCT FROM stop % 3 THEN 0 ELSE 1 END AS fresh FROM {stop_times} WINDOW w AS (PARTITION BY trip ORDER BY seq)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY trip ORDER BY seq) AS run FROM s) SELECT trip, CAST(run AS INT) AS run, zone, count(*) AS n FROM r GROUP BY trip, run, zone")
def _(spark, d):
    return T.runs(table(spark, d, "stop_times").withColumn("zone", F.col("stop") % 3), "trip", "seq", "zone")


@query("fare_cheapest", "WITH f AS (SELECT p_type, p_partkey AS fare, p_retailprice AS price FROM {part}) SELECT n.n_nationkey, t.p_type, fare, price FROM {nation} n CROSS JOIN (SELECT DISTINCT p_type FROM f) t JOIN f ON f.p_type = t.p_type AND fare % 25 = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_nationkey, t.p_type ORDER BY price, fare) = 1")
def _(spark, d):
    f = table(spark, d, "part").select("p_type", (F.col("p_partkey") % 25).alias("n_nationkey"), F.col("p_partkey").alias("fare"), F.col("p_retailprice").alias("price"))
    trips = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey")).crossJoin(f.select("p_type").distinct())
    return T.cheapest_fare(trips, f, ["p_type", "n_nationkey"]).select("n_nationkey", "p_type", "fare", "price")


@query("common_sets", "SELECT s.stop AS a, e.stop AS b, count(DISTINCT s.trip) AS n FROM {stop_times} s JOIN {stop_times} e ON s.trip = e.trip AND s.seq < e.seq AND s.stop <> e.stop GROUP BY s.stop, e.stop HAVING count(DISTINCT s.trip) > 1")
def _(spark, d):
    return T.shared_sets(table(spark, d, "stop_times"))


@query("time_range_filter", "SELECT user_id, low, high FROM (SELECT user_id, min(t) AS low, max(t) AS high FROM {gps} GROUP BY user_id) WHERE low < 1705000000 AND high > 1704200000")
def _(spark, d):
    g = table(spark, d, "gps").groupBy("user_id").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    return g.filter(J.overlaps(F.col("low"), F.col("high"), 1704200000, 1705000000))


@query("weekday_mask", "SELECT o_orderkey, repeat('0', CAST(isodow(o_orderdate) - 1 AS INT)) || '1' || repeat('0', CAST(7 - isodow(o_orderdate) AS INT)) AS mask FROM {orders}")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.weekday_mask(F.col("o_orderdate")).alias("mask"))


@query("hms_roundtrip", "SELECT event_id, printf('%02d:%02d:%02d', (t % 100000) // 3600, (t % 100000) % 3600 // 60, (t % 100000) % 60) AS hms, t % 100000 AS seconds FROM {gps}")
def _(spark, d):
    h = table(spark, d, "gps").select("event_id", X.to_hms(F.col("t") % 100000).alias("hms"))
    return h.withColumn("seconds", X.from_hms(F.col("hms")))


@query("active_services", "SELECT strftime(o_orderdate, '%Y-%m') AS month, isodow(o_orderdate) AS weekday, count(*) AS n FROM {orders} GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), (F.weekday("o_orderdate") + 1).cast("long").alias("weekday")).agg(F.count("*").alias("n"))


@query("integrity_collision", "SELECT id, count(*) AS n FROM (SELECT CAST(zone AS VARCHAR) AS id FROM {zones} UNION ALL SELECT CAST(s_suppkey AS VARCHAR) FROM {supplier}) GROUP BY id HAVING count(*) > 1")
def _(spark, d):
    return I.collisions(table(spark, d, "zones"), table(spark, d, "supplier").select("s_suppkey"))


@query("integrity_sequences", "SELECT l_orderkey, min(l_linenumber) AS low, max(l_linenumber) AS high, count(DISTINCT l_linenumber) AS \"distinct\", count(*) AS n FROM {lineitem} GROUP BY l_orderkey HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)")
def _(spark, d):
    return I.gaps(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("integrity_circular", "SELECT trip, count(*) - count(DISTINCT stop) AS repeats FROM {stop_times} GROUP BY trip HAVING count(*) > count(DISTINCT stop)")
def _(spark, d):
    return I.circular(table(spark, d, "stop_times"))


@query("integrity_broken_sequences", "SELECT trip, count(*) AS n FROM (SELECT trip, b, lead(a) OVER (PARTITION BY trip ORDER BY link_sequence) AS na FROM {shifted}) WHERE na IS NOT NULL AND na <> b GROUP BY trip")
def _(spark, d):
    return I.broken_sequences(table(spark, d, "shifted"))


@query("integrity_nodeset_missing", "SELECT a AS zone FROM {damaged} UNION SELECT b FROM {damaged} EXCEPT SELECT zone FROM {zones}")
def _(spark, d):
    return I.missing_nodes(table(spark, d, "damaged"), table(spark, d, "zones"), "zone")


@query("integrity_nodeset_orphan", "SELECT b AS zone FROM {spurs} EXCEPT (SELECT a FROM {links} UNION SELECT b FROM {links})")
def _(spark, d):
    return I.orphan_nodes(table(spark, d, "links"), table(spark, d, "spurs").select(F.col("b").alias("zone")).distinct(), "zone")


@query("integrity_duplicate_ab", "SELECT a, b, count(*) AS n FROM {links} GROUP BY a, b HAVING count(*) > 1")
def _(spark, d):
    return I.duplicates(table(spark, d, "links"), ["a", "b"])


@query("dead_ends", "SELECT DISTINCT b AS node FROM {spurs} EXCEPT SELECT a FROM {spurs}")
def _(spark, d):
    return I.dead_ends(table(spark, d, "spurs"))


@query("reachable_hops", "WITH RECURSIVE r(origin, node, hops) AS (SELECT zone, zone, 0 FROM {zones} UNION SELECT origin, b, hops + 1 FROM r JOIN {road_links} ON node = a WHERE hops < 4) SELECT origin, node, min(hops) AS hops FROM r GROUP BY origin, node")
def _(spark, d):
    return G.reachable_pairs(table(spark, d, "road_links"), table(spark, d, "zones").select("zone"), 4)


@query("od_shortest_cost", "WITH RECURSIVE r(origin, node, cost, hops) AS (SELECT zone, zone, 0::DOUBLE, 0 FROM {zones} UNION ALL SELECT origin, node, min(cost), hops FROM (SELECT origin, b AS node, cost + time AS cost, hops + 1 AS hops FROM r JOIN {road_links} ON node = a WHERE hops < 16) GROUP BY origin, node, hops) SELECT origin, node AS destination, round(min(cost), 4) AS cost FROM r GROUP BY origin, node")
def _(spark, d):
    return G.shortest_paths(table(spark, d, "road_links"), table(spark, d, "zones").select("zone")).select("origin", "destination", r4("cost"))


@query("components_label", "WITH RECURSIVE e AS (SELECT a, b FROM {road_links} WHERE a // 5 = b // 5), r(node, other) AS (SELECT a, a FROM e UNION SELECT node, b FROM r JOIN e ON other = a) SELECT node, min(other) AS component FROM r GROUP BY node")
def _(spark, d):
    return G.labels(table(spark, d, "road_links").filter("floor(a / 5) = floor(b / 5)"))


@query("road_equilibrium_bfw", None)
def _(spark, d):
    links = table(spark, d, "road_links")
    flow, _ = R.equilibrium(links, table(spark, d, "od_volumes"), "bfw", 6)
    return R.loaded(links, flow).select("a", "b", r4("flow", 3), r4("jam_time", 4))


@query("shortest_path_loads", None)
def _(spark, d):
    paths = G.shortest_paths(table(spark, d, "road_links"), table(spark, d, "zones").select("zone"))
    return A.assign(table(spark, d, "od_volumes").join(paths.select("origin", "destination", "path"), ["origin", "destination"])).select("a", "b", r4("volume"))


@query("path_vertex_analysis", f"WITH {FOOT} SELECT trip, list_first(s) AS first_stop, list_last(s) AS last_stop, len(s) AS n_stops, len(list_distinct(s)) AS n_distinct FROM (SELECT trip, list(stop ORDER BY seq) AS s FROM {{stop_times}} GROUP BY trip)")
def _(spark, d):
    s = F.transform(F.array_sort(F.collect_list(F.struct("seq", "stop"))), lambda x: x["stop"])
    p = table(spark, d, "stop_times").groupBy("trip").agg(s.alias("s"))
    return p.select("trip", F.element_at("s", 1).alias("first_stop"), F.element_at("s", -1).alias("last_stop"), F.size("s").cast("long").alias("n_stops"), F.size(F.array_distinct("s")).cast("long").alias("n_distinct"))


@query("path_time_sum", "SELECT trip, round(sum(minutes), 4) AS minutes, round(sum(minutes) / count(*), 4) AS mean, string_agg(DISTINCT route, '') AS routes FROM {links} GROUP BY trip")
def _(spark, d):
    return table(spark, d, "links").groupBy("trip").agg(F.round(F.sum("minutes"), 4).alias("minutes"), F.round(F.sum("minutes") / F.count("*"), 4).alias("mean"), F.array_join(F.collect_set("route"), "").alias("routes"))


@query("screenline_crossing", "SELECT a, b, round(minutes, 4) AS minutes FROM (SELECT a, b, sum(minutes) AS minutes FROM {links} GROUP BY a, b) WHERE (a % 5 - 2.5) * (b % 5 - 2.5) < 0")
def _(spark, d):
    g = table(spark, d, "links").groupBy("a", "b").agg(F.sum("minutes").alias("minutes"))
    return g.filter((F.col("a") % 5 - 2.5) * (F.col("b") % 5 - 2.5) < 0).select("a", "b", r4("minutes"))


@query("shape_distance", "SELECT trip, seq, round(sum(step) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING), 4) AS distance FROM (SELECT trip, seq, coalesce(sqrt(pow(stop % 5 - lag(stop % 5) OVER w, 2) + pow(stop // 5 - lag(stop // 5) OVER w, 2)), 0) AS step FROM {stop_times} WINDOW w AS (PARTITION BY trip ORDER BY seq))")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("trip").orderBy("seq")
    s = table(spark, d, "stop_times").withColumns({"x": F.col("stop") % 5, "y": F.floor(F.col("stop") / 5)})
    step = F.coalesce(X.euclidean(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w)), F.lit(0.0))
    return s.withColumn("step", step).select("trip", "seq", F.round(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("distance"))


@query("time_bucket_dedupe", "SELECT user_id, t // 3600 AS bucket, min(event_id) AS event_id, count(*) AS n FROM {gps} GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "gps").groupBy("user_id", F.floor(F.col("t") / 3600).alias("bucket")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))
