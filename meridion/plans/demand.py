"""Queries over demand: assignment, summaries, distribution and choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import assignment as A
from ..operators import distribution as D
from ..operators import logit as L
from .domain import oracle, table

Q: dict = {}
O: dict[str, str] = {}
UTILITY = "-(0.0001 * price + 0.05 * time + 5 * transfers)"
PATH = """paths AS (SELECT origin, destination, segment, volume, i, CASE WHEN i <= abs(dx) THEN oy * 5 + ox + i * sign(dx) ELSE (oy + (i - abs(dx)) * sign(dy)) * 5 + ox + dx END AS z
  FROM (SELECT *, unnest(generate_series(0, abs(dx) + abs(dy))) AS i FROM (SELECT *, origin % 5 AS ox, origin // 5 AS oy, destination % 5 - origin % 5 AS dx, destination // 5 - origin // 5 AS dy FROM {volumes}))),
legs AS (SELECT *, lead(z) OVER (PARTITION BY origin, destination, segment ORDER BY i) AS nz FROM paths)"""


def query(name: str, sql: str):
    def put(f):
        Q[name] = f
        O[name] = oracle(sql)
        return f

    return put


def r4(c: str, digits: int = 4):
    return F.round(F.col(c), digits).alias(c)


@query("assign_link_volume", f"WITH {PATH} SELECT CAST(z AS INT) AS a, CAST(nz AS INT) AS b, round(sum(volume), 4) AS volume FROM legs WHERE nz IS NOT NULL GROUP BY z, nz")
def _(spark, d):
    return A.assign(A.grid_paths(table(spark, d, "volumes"))).select("a", "b", r4("volume"))


@query("assign_segmented", f"WITH {PATH} SELECT CAST(z AS INT) AS a, CAST(nz AS INT) AS b, coalesce(segment, 'all') AS segment, round(sum(volume), 4) AS volume FROM legs WHERE nz IS NOT NULL GROUP BY GROUPING SETS ((z, nz, segment), (z, nz))")
def _(spark, d):
    return A.assign_segmented(A.grid_paths(table(spark, d, "volumes"))).select("a", "b", "segment", r4("volume"))


for _name, _every, _cond in (("assign_checkpoint_all", True, "= 2"), ("assign_checkpoint_any", False, ">= 1")):

    @query(_name, f"WITH {PATH}, ok AS (SELECT origin, destination, segment FROM paths WHERE z IN (7, 12) GROUP BY ALL HAVING count(DISTINCT z) {_cond}) SELECT CAST(z AS INT) AS a, CAST(nz AS INT) AS b, round(sum(volume), 4) AS volume FROM legs SEMI JOIN ok USING (origin, destination, segment) WHERE nz IS NOT NULL GROUP BY z, nz")
    def _(spark, d, every=_every):
        return A.assign(A.through(A.grid_paths(table(spark, d, "volumes")), [7, 12], every)).select("a", "b", r4("volume"))


@query("od_volumes", "SELECT origin, destination, round(volume, 4) AS volume FROM {od_volumes}")
def _(spark, d):
    return table(spark, d, "od_volumes").select("origin", "destination", r4("volume"))


for _side in ("origin", "destination"):

    @query(f"od_sum_by_{_side}", f"SELECT {_side}, round(sum(volume), 4) AS volume FROM {{volumes}} GROUP BY {_side}")
    def _(spark, d, side=_side):
        return table(spark, d, "volumes").groupBy(side).agg(F.round(F.sum("volume"), 4).alias("volume"))


for _name, _how in (("renumber_volume", "sum"), ("renumber_od_mean", "avg")):

    @query(_name, f"SELECT o.cluster AS origin, d.cluster AS destination, round({_how}(volume), 4) AS volume FROM {{od_volumes}} v JOIN {{zones}} o ON v.origin = o.zone JOIN {{zones}} d ON v.destination = d.zone GROUP BY o.cluster, d.cluster")
    def _(spark, d, how=_how):
        return A.renumber(table(spark, d, "od_volumes"), table(spark, d, "zones"), how=how).select("origin", "destination", r4("volume"))


@query("weighted_average", "SELECT origin, round(sum(price * quantity) / sum(quantity), 4) AS weighted_average FROM {od} GROUP BY origin")
def _(spark, d):
    return A.weighted_average(table(spark, d, "od"), ["origin"], "price", "quantity").select("origin", r4("weighted_average"))


@query("aggregate_shares", "SELECT origin, segment, round(total, 4) AS total, round(total / sum(total) OVER (PARTITION BY origin), 6) AS share FROM (SELECT origin, segment, sum(volume) AS total FROM {volumes} GROUP BY ALL)")
def _(spark, d):
    return A.shares(table(spark, d, "volumes"), ["origin"], "segment", "volume").select("origin", "segment", r4("total"), r4("share", 6))


@query("densify", "SELECT o.zone AS origin, d.zone AS destination, round(coalesce(v.volume, 0), 4) AS volume FROM {zones} o CROSS JOIN {zones} d LEFT JOIN (SELECT * FROM {od_volumes} WHERE (origin + destination) % 2 = 0) v ON v.origin = o.zone AND v.destination = d.zone")
def _(spark, d):
    return A.densify(table(spark, d, "od_volumes").filter("(origin + destination) % 2 = 0"), table(spark, d, "zones")).select("origin", "destination", r4("volume"))


@query("summary_od_long", "SELECT origin, destination, 'volume' AS indicator, round(sum(quantity), 4) AS value FROM {od} GROUP BY 1, 2 UNION ALL SELECT origin, destination, 'earning', round(sum(price * tax), 4) FROM {od} GROUP BY 1, 2")
def _(spark, d):
    g = table(spark, d, "od").groupBy("origin", "destination").agg(F.sum("quantity").alias("volume"), F.sum(F.col("price") * F.col("tax")).alias("earning"))
    return A.long_form(g, ["origin", "destination"], ["volume", "earning"]).select("origin", "destination", "indicator", r4("value"))


for _name, _agg in (("summary_link_sum", "sum"), ("summary_link_max", "max"), ("summary_link_average", "avg")):

    @query(_name, f"SELECT route, round({_agg}(minutes), 4) AS value FROM {{links}} GROUP BY route")
    def _(spark, d, agg=_agg):
        return table(spark, d, "links").groupBy("route").agg(F.round(getattr(F, agg)("minutes"), 4).alias("value"))


@query("line_summary", "SELECT route, count(*) AS n_links, count(DISTINCT trip) AS n_trips, count(DISTINCT a) AS n_stops, round(sum(minutes), 4) AS minutes, round(avg(headway), 4) AS headway FROM {links} GROUP BY route")
def _(spark, d):
    return table(spark, d, "links").groupBy("route").agg(F.count("*").alias("n_links"), F.countDistinct("trip").alias("n_trips"), F.countDistinct("a").alias("n_stops"), F.round(F.sum("minutes"), 4).alias("minutes"), F.round(F.avg("headway"), 4).alias("headway"))


@query("economic_series", "SELECT round(sum(price), 2) AS value, round(sum(price * tax), 2) AS cost, round(sum(price - price * tax), 2) AS benefit FROM {od}")
def _(spark, d):
    got = A.economic_series(table(spark, d, "od"), F.col("price"), F.col("price") * F.col("tax"))
    return got.select(*[r4(c, 2) for c in got.columns])


HALF = "SELECT origin, destination, sum(quantity) AS volume, avg(price) / 1000 AS cost FROM {{od}} WHERE orderkey % 2 = {} GROUP BY origin, destination"


@query("cost_benefit_delta", f"SELECT a.origin, a.destination, round((a.volume + b.volume) / 2 * (a.cost - b.cost), 3) AS surplus, round(least(a.volume, b.volume), 4) AS kept, round(greatest(b.volume - a.volume, 0), 4) AS gained FROM ({HALF.format(1).replace('{{', '{').replace('}}', '}')}) a JOIN ({HALF.format(0)}) b USING (origin, destination)")
def _(spark, d):
    od = table(spark, d, "od")
    half = lambda k: od.filter(F.col("orderkey") % 2 == k).groupBy("origin", "destination").agg(F.sum("quantity").alias("volume"), (F.avg("price") / 1000).alias("cost"))
    return A.rule_of_half(half(1), half(0)).select("origin", "destination", r4("surplus", 3), r4("kept"), r4("gained"))


@query("modal_split_binary", "SELECT origin, destination, round(1 / (1 + exp(-(avg(price) / 10000 - avg(quantity) / 10))), 6) AS share FROM {od} GROUP BY origin, destination")
def _(spark, d):
    return table(spark, d, "od").groupBy("origin", "destination").agg(F.round(X.logistic(F.avg("price") / 10000 - F.avg("quantity") / 10), 6).alias("share"))


def los(spark, d):
    return table(spark, d, "los").withColumn("utility", F.expr(UTILITY)).withColumn("nest", F.when(F.col("route_type") < "M", "pt").otherwise("private"))


U = f"u AS (SELECT origin, destination, route_type, {UTILITY} AS utility, CASE WHEN route_type < 'M' THEN 'pt' ELSE 'private' END AS nest FROM {{los}})"
MNL = "p AS (SELECT *, exp(utility - m) / sum(exp(utility - m)) OVER (PARTITION BY origin, destination) AS probability FROM (SELECT *, max(utility) OVER (PARTITION BY origin, destination) AS m FROM u))"
OD = ["origin", "destination"]


@query("logit_mnl", f"WITH {U}, {MNL} SELECT origin, destination, route_type, round(probability, 5) AS probability FROM p")
def _(spark, d):
    return L.softmax(los(spark, d), OD).select(*OD, "route_type", r4("probability", 5))


@query("logit_top_n", f"WITH {U}, {MNL.replace('FROM u', 'FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY origin, destination ORDER BY utility DESC, route_type) <= 3)')} SELECT origin, destination, route_type, round(probability, 5) AS probability FROM p")
def _(spark, d):
    return L.softmax(L.top(los(spark, d), OD, 3, ["route_type"]), OD).select(*OD, "route_type", r4("probability", 5))


@query("logit_nested", f"WITH {U}, n AS (SELECT origin, destination, nest, max(utility) AS m FROM u GROUP BY ALL), i AS (SELECT u.*, n.m, exp((utility - n.m) / 0.5) AS e FROM u JOIN n USING (origin, destination, nest)), s AS (SELECT origin, destination, nest, m + 0.5 * ln(sum(e)) AS logsum, sum(e) AS se FROM i GROUP BY origin, destination, nest, m), b AS (SELECT *, exp(logsum) / sum(exp(logsum)) OVER (PARTITION BY origin, destination) AS pb FROM s) SELECT i.origin, i.destination, route_type, round(e / se * pb, 5) AS probability FROM i JOIN b USING (origin, destination, nest)")
def _(spark, d):
    return L.nested(los(spark, d), OD, "nest", 0.5).select(*OD, "route_type", r4("probability", 5))


SYM = "y AS (SELECT u.origin, u.destination, u.route_type, u.nest, (u.utility + coalesce(q.utility, u.utility)) / 2 AS utility FROM u LEFT JOIN u q ON u.origin = q.destination AND u.destination = q.origin AND u.route_type = q.route_type)"


@query("logit_symmetric", f"WITH {U}, {SYM}, {MNL.replace('FROM u', 'FROM y')} SELECT origin, destination, route_type, round(probability, 5) AS probability FROM p")
def _(spark, d):
    return L.softmax(L.symmetric(los(spark, d), "route_type"), OD).select(*OD, "route_type", r4("probability", 5))


@query("logit_logsum", f"WITH {U} SELECT origin, destination, round(m + 0.5 * ln(sum(exp((utility - m) / 0.5))), 5) AS logsum FROM (SELECT *, max(utility) OVER (PARTITION BY origin, destination) AS m FROM u) GROUP BY origin, destination, m")
def _(spark, d):
    return L.logsum(los(spark, d), OD, 0.5).select(*OD, r4("logsum", 5))


@query("logit_incremental_logsum", f"WITH {U}, {MNL} SELECT origin, destination, round(ln(sum(probability * exp(-0.1 * length(route_type))) / sum(probability)), 5) AS change FROM p GROUP BY ALL")
def _(spark, d):
    base = L.softmax(los(spark, d), OD, name="base").withColumn("d", F.length("route_type") * -0.1)
    return L.incremental_logsum(base, OD, "base", "d").select(*OD, r4("change", 5))


TREE = """t AS (SELECT *, CASE WHEN route_type < 'G' THEN 'a' WHEN route_type < 'M' THEN 'b' ELSE 'c' END AS mode FROM u),
m AS (SELECT origin, destination, mode, max(utility) + 0.4 * ln(sum(exp((utility - x) / 0.4))) AS v FROM (SELECT *, max(utility) OVER (PARTITION BY origin, destination, mode) AS x FROM t) GROUP BY origin, destination, mode),
n AS (SELECT *, CASE WHEN mode = 'c' THEN 'car' ELSE 'pt' END AS top FROM m),
l AS (SELECT origin, destination, top, max(v) + 0.7 * ln(sum(exp((v - x) / 0.7))) AS v FROM (SELECT *, max(v) OVER (PARTITION BY origin, destination, top) AS x FROM n) GROUP BY origin, destination, top),
r AS (SELECT l.*, exp(v - x) / sum(exp(v - x)) OVER (PARTITION BY origin, destination) AS p FROM (SELECT *, max(v) OVER (PARTITION BY origin, destination) AS x FROM l) l)"""


@query("logit_tree", f"WITH {U}, {TREE} SELECT t.origin, t.destination, t.route_type, round(r.p * exp((n.v - l.v) / 0.7) * exp((t.utility - n.v) / 0.4), 5) AS probability FROM t JOIN n USING (origin, destination, mode) JOIN l USING (origin, destination, top) JOIN r USING (origin, destination, top)")
def _(spark, d):
    modes = los(spark, d).withColumn("mode", F.when(F.col("route_type") < "G", "a").when(F.col("route_type") < "M", "b").otherwise("c"))
    nests = {"a": "pt", "b": "pt", "c": "car", "pt": "root", "car": "root"}
    got = L.tree(modes, OD, nests, {"a": 0.4, "b": 0.4, "c": 0.4, "pt": 0.7, "car": 0.7, "root": 1.0}, "mode")
    return got.select(*OD, "route_type", r4("probability", 5))


@query("logit_incremental", f"WITH {U}, {MNL} SELECT origin, destination, route_type, round(probability * exp(-0.1 * length(route_type)) / sum(probability * exp(-0.1 * length(route_type))) OVER (PARTITION BY origin, destination), 5) AS probability FROM p")
def _(spark, d):
    base = L.softmax(los(spark, d), OD, name="base").withColumn("change", F.length("route_type") * -0.1)
    return L.incremental(base, OD, "base", "change").select(*OD, "route_type", r4("probability", 5))


@query("logit_rounded_total", f"WITH {U} SELECT DISTINCT origin, destination, CAST(1.0 AS DOUBLE) AS total FROM u")
def _(spark, d):
    return L.rounded(L.softmax(los(spark, d), OD), OD, 2, ["route_type"]).groupBy(*OD).agg(F.round(F.sum("probability"), 6).alias("total"))


@query("mode_utility", f"WITH {U} SELECT origin, destination, round(min(utility), 4) AS least, round(max(utility), 4) AS best, round(avg(utility), 4) AS mean, round(sum(utility), 4) AS total FROM u GROUP BY ALL")
def _(spark, d):
    return los(spark, d).groupBy(*OD).agg(F.round(F.min("utility"), 4).alias("least"), F.round(F.max("utility"), 4).alias("best"), F.round(F.avg("utility"), 4).alias("mean"), F.round(F.sum("utility"), 4).alias("total"))


@query("gravity_singly", "SELECT origin, destination, round(emission * attraction * exp(-0.4 * distance) / sum(attraction * exp(-0.4 * distance)) OVER (PARTITION BY origin), 3) AS volume FROM {skims}")
def _(spark, d):
    return D.singly_constrained(table(spark, d, "skims"), 0.4).select(*OD, r4("volume", 3))


def _balance(start: str, rounds: int) -> str:
    text, last = start, "b0"
    for k in range(rounds):
        for s, (key, total) in enumerate((("destination", "attraction"), ("origin", "emission"))):
            text += f", b{2 * k + s + 1} AS (SELECT origin, destination, emission, attraction, CASE WHEN sum(volume) OVER (PARTITION BY {key}) > 0 THEN volume * {total} / sum(volume) OVER (PARTITION BY {key}) ELSE 0 END AS volume FROM {last})"
            last = f"b{2 * k + s + 1}"
    return f"WITH {text} SELECT origin, destination, round(volume, 3) AS volume FROM {last}"


@query("od_gravity_doubly_constrained", _balance("b0 AS (SELECT origin, destination, emission, attraction, exp(-0.4 * distance) AS volume FROM {skims})", 4))
def _(spark, d):
    return D.doubly_constrained(table(spark, d, "skims"), 0.4, 4).select(*OD, r4("volume", 3))


@query("fratar", _balance("b0 AS (SELECT v.origin, v.destination, o.emission * 1.1 AS emission, t.attraction * 1.1 AS attraction, v.volume FROM {od_volumes} v JOIN {zones} o ON o.zone = v.origin JOIN {zones} t ON t.zone = v.destination)", 3))
def _(spark, d):
    z = table(spark, d, "zones").select("zone", (F.col("emission") * 1.1).alias("emission"), (F.col("attraction") * 1.1).alias("attraction"))
    return D.fratar(table(spark, d, "od_volumes"), z, 3).select(*OD, r4("volume", 3))


@query("skim_haversine", "SELECT origin, destination, round(2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(d.y - o.y) / 2), 2) + cos(radians(o.y)) * cos(radians(d.y)) * pow(sin(radians(d.x - o.x) / 2), 2)))), 3) AS distance FROM {skims} JOIN {zones} o ON origin = o.zone JOIN {zones} d ON destination = d.zone")
def _(spark, d):
    z = table(spark, d, "zones")
    j = z.alias("o").crossJoin(z.alias("d"))
    return j.select(F.col("o.zone").alias("origin"), F.col("d.zone").alias("destination"), F.round(X.haversine(F.col("o.y"), F.col("o.x"), F.col("d.y"), F.col("d.x")), 3).alias("distance"))


@query("skim_euclidean", "SELECT origin, destination, round(distance, 4) AS distance FROM {skims}")
def _(spark, d):
    return table(spark, d, "skims").select(*OD, r4("distance"))


@query("intrazonal_distance", "SELECT origin AS zone, round(min(distance) / 2, 4) AS distance FROM {skims} WHERE origin <> destination GROUP BY origin")
def _(spark, d):
    return table(spark, d, "skims").filter("origin <> destination").groupBy(F.col("origin").alias("zone")).agg(F.round(F.min("distance") / 2, 4).alias("distance"))


FLOW = "(SELECT a, b, time, length, capacity, 100.0 * ((a * 13 + b * 5) % 40) AS flow FROM {road_links})"


def flows(spark, d):
    return table(spark, d, "road_links").withColumn("flow", 100.0 * ((F.col("a") * 13 + F.col("b") * 5) % 40))


@query("bpr_jam_time", f"SELECT a, b, round(time * (1 + 0.15 * pow(flow / capacity, 4)), 2) AS jam_time, round(length / (time * (1 + 0.15 * pow(flow / capacity, 4))), 2) AS jam_speed FROM {FLOW}")
def _(spark, d):
    t = X.bpr(F.col("time"), F.col("flow"), F.col("capacity"))
    return flows(spark, d).select("a", "b", F.round(t, 2).alias("jam_time"), F.round(F.col("length") / t, 2).alias("jam_speed"))


@query("segment_cost", f"SELECT a, b, round(time * (1 + 0.15 * pow(flow / capacity, 4)) + 0.002 * length, 5) AS car, round(time * (1 + 0.15 * pow(flow / capacity, 4)) + 0.004 * length, 5) AS truck FROM {FLOW}")
def _(spark, d):
    timed = flows(spark, d).withColumn("jam_time", X.bpr(F.col("time"), F.col("flow"), F.col("capacity")))
    return timed.select("a", "b", F.round(F.expr("jam_time + 0.002D * length"), 5).alias("car"), F.round(F.expr("jam_time + 0.004D * length"), 5).alias("truck"))


@query("beckmann_objective", f"SELECT round(sum(time * (flow + 0.15 * capacity / 5 * pow(flow / capacity, 5))), 3) AS beckmann, round(sum(flow * time), 3) AS free_flow FROM {FLOW}")
def _(spark, d):
    return flows(spark, d).agg(F.round(F.sum(X.beckmann(F.col("time"), F.col("flow"), F.col("capacity"))), 3).alias("beckmann"), F.round(F.sum(F.col("flow") * F.col("time")), 3).alias("free_flow"))


@query("histogram_score", "SELECT p_partkey, CAST(greatest(1, least(10, floor((p_retailprice - 900) / 1200 * 10) + 1)) AS INT) AS score FROM {part}")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", X.equal_width(F.col("p_retailprice"), 900.0, 2100.0, 10).alias("score"))
