"""Searches and joins against brute force on small fixtures."""

import math
import random

import pytest

from meridion import catalogue
from meridion.operators import choice, joins
from meridion.plans.domain import table

FOLDER = "/root/testdata/sf0.001"


def brute_earliest(rows, origins, start, transfer):
    """Arrivals by relaxing each trip's connections until nothing changes."""
    trips = {}
    for trip, a, b, dep, arr in rows:
        if dep >= start:
            trips.setdefault(trip, []).append((dep, arr, a, b))
    got = {}
    for o in origins:
        best, changed = {o: start - transfer}, True
        while changed:
            changed = False
            for legs in trips.values():
                on = False
                for dep, arr, a, b in sorted(legs):
                    on = on or best.get(a, float("inf")) + transfer <= dep
                    if on and arr < best.get(b, float("inf")):
                        best[b], changed = arr, True
        best[o] = start
        got |= {(o, n): t for n, t in best.items()}
    return got


def arrivals(df):
    return {(r["origin"], r["node"]): r["arrival"] for r in df.collect()}


@pytest.mark.parametrize("most", [1_000_000, 20, 7])
def test_earliest_equals_brute_force(spark, most):
    rng = random.Random(1)
    rows = []
    for trip in range(40):
        at, stop = rng.randrange(0, 200), rng.randrange(12)
        for _ in range(rng.randrange(1, 6)):
            to, end = rng.randrange(12), at + rng.randrange(1, 30)
            rows.append((trip, stop, to, float(at), float(end)))
            stop, at = to, end + rng.randrange(0, 40)
    df = spark.createDataFrame(rows, "trip long, a int, b int, departure double, arrival double")
    origins = spark.createDataFrame([(i,) for i in range(12)], "o int")
    assert arrivals(choice.earliest(df, origins, 20.0, 10.0, most)) == brute_earliest(rows, range(12), 20.0, 10.0)


def test_connection_scan_reads_all_trips(spark):
    links = table(spark, FOLDER, "links").select("trip", "link_sequence", "a", "b").collect()
    rows = [(r["trip"], r["a"], r["b"], float(r["trip"] % 3600 + r["link_sequence"] * 60), float(r["trip"] % 3600 + r["link_sequence"] * 60 + 50)) for r in links]
    zones = [r["zone"] for r in table(spark, FOLDER, "zones").collect()]
    assert arrivals(catalogue.QUERIES["connection_scan"](spark, FOLDER)) == brute_earliest(rows, zones, 0.0, 10.0)


def brute_headway(rows):
    """Each elementary interval of a line with all services that cover it."""
    got = {}
    for line in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == line]
        points = sorted({p for r in own for p in r[1:3]})
        for low, high in zip(points, points[1:]):
            f = [1 / h for _, a, b, h in own if a <= low and b >= high]
            if f:
                got[line, low, high] = 1 / sum(f)
    return got


def headways(df):
    return {(r["line"], r["low"], r["high"]): r["headway"] for r in df.collect()}


def test_piecewise_headway_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i % 3, low := rng.randrange(60), low + rng.randrange(-2, 15), float(rng.randrange(200, 900))) for i in range(60)] + [(7, 0, 5, 300.0), (7, 9, 12, 300.0)]
    df = spark.createDataFrame(rows, "line int, low long, high long, headway double")
    assert headways(choice.piecewise_headway(df)) == pytest.approx(brute_headway(rows), rel=1e-12)


def test_headway_piecewise_reads_all_services(spark):
    rows = [(r["l_suppkey"] % 20, low := r["l_linenumber"] * 600 + r["l_partkey"] % 5 * 60, low + 900, 300.0 + r["l_quantity"]) for r in table(spark, FOLDER, "lineitem").collect()]
    assert headways(catalogue.QUERIES["headway_piecewise"](spark, FOLDER)) == pytest.approx(brute_headway(rows), abs=6e-5)


def test_turn_penalty_cost_starts_from_all_links(spark):
    starts = {r["a"] * 100 + r["b"] for r in table(spark, FOLDER, "road_links").collect()}
    assert {r["origin"] for r in catalogue.QUERIES["turn_penalty_cost"](spark, FOLDER).collect()} == starts


def test_fratar_keeps_all_pairs(spark):
    pairs = {(r["origin"], r["destination"]) for r in table(spark, FOLDER, "od_volumes").collect()}
    assert {(r["origin"], r["destination"]) for r in catalogue.QUERIES["fratar"](spark, FOLDER).collect()} == pairs


def brute_nearest(points, targets, k):
    got = {}
    for i, x, y in points:
        for r, (d, t) in enumerate(sorted((math.sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)), t) for t, tx, ty in targets)[:k]):
            got[i, r + 1] = (t, round(d, 4))
    return got


@pytest.mark.parametrize("k,n", [(1, 30), (3, 30), (4, 2), (2, 0)])
def test_nearest_has_no_radius(spark, k, n):
    rng = random.Random(3)
    points = [(i, rng.uniform(-500, 500), rng.uniform(-500, 500)) for i in range(40)] + [(99, 20.0, 20.0)]
    targets = [(t, rng.gauss(0, 30), rng.gauss(0, 30)) for t in range(n)]
    p, t = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(targets, "target long, tx double, ty double")
    got = joins.nearest(p, t, k, 5.0).collect()
    assert {(r["id"], r["rank"]): (r["target"], round(r["distance"], 4)) for r in got} == brute_nearest(points, targets, k) and len(got) == len(points) * min(k, n)


def test_connector_knn_and_knn_regression_reach_all_points(spark):
    points = [(i := r["c_custkey"], i * 37 % 101, i * 53 % 103) for r in table(spark, FOLDER, "customer").collect()]
    suppliers = {r["s_suppkey"]: r["s_acctbal"] for r in table(spark, FOLDER, "supplier").collect()}
    targets = [(i, i * 41 % 101, i * 59 % 103) for i in suppliers]
    got = {(r["id"], r["rank"]): (r["target"], r["distance"]) for r in catalogue.QUERIES["connector_knn"](spark, FOLDER).collect()}
    assert got == brute_nearest(points, targets, 2)
    want = {}
    for (i, _), (t, d) in brute_nearest(points, targets, 3).items():
        a, b = want.get(i, (0.0, 0.0))
        want[i] = (a + suppliers[t] / max(d, 1e-6), b + 1 / max(d, 1e-6))
    got = {r["id"]: r["estimate"] for r in catalogue.QUERIES["knn_regression"](spark, FOLDER).collect()}
    assert got == pytest.approx({i: a / b for i, (a, b) in want.items()}, abs=0.011)


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_compares_few_pairs(spark, k):
    """2,000 points on 25 places and 900 targets on 36: were all pairs within the cell of 20 compared, a join would make 1,800,000 rows."""
    points = [(i, float(i % 5), float(i // 5 % 5)) for i in range(2000)]
    targets = [(t, t % 6 + 0.25, t // 6 % 6 + 0.5) for t in range(900)]
    p, t = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(targets, "target long, tx double, ty double")
    found = joins.nearest(p, t, k, 20.0)
    assert {(r["id"], r["rank"]): (r["target"], round(r["distance"], 4)) for r in found.collect()} == brute_nearest(points, targets, k)
    assert most_joined(found) <= 2000 * k


def most_joined(df):
    """The rows that the largest join of df's plan makes."""
    df.collect()
    plans, most = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        name = plan.nodeName()
        plans += [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
        if "Join" in name:
            most = max(most, plan.metrics().apply("numOutputRows").value())
    return most


def test_within_compares_places_once(spark):
    points = [(i, float(i % 5), float(i // 5 % 5)) for i in range(500)]
    targets = [(t, t % 6 + 0.25, t // 6 % 6 + 0.5) for t in range(180)]
    p, t = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(targets, "target long, tx double, ty double")
    near = joins.within(p, t, 2.0)
    want = {(i, u): round(d, 6) for i, x, y in points for u, tx, ty in targets if (d := math.sqrt((x - tx) ** 2 + (y - ty) ** 2)) <= 2.0}
    got = [(r["id"], r["target"], round(r["distance"], 6)) for r in near.collect()]
    assert len(got) == len(want) and {(i, u): d for i, u, d in got} == want
    assert most_joined(near) <= 25 * 36


def test_earliest_keeps_a_bit_of_a_trip_under_way(spark, monkeypatch):
    """4,000 trips are under way between windows; node 9 is never reached by day, so that no window is left out."""
    rows = [x for t in range(4000) for x in ((t, 0, 1, float(t % 50), t % 50 + 5.0), (t, 1, 2, 1000.0 + t % 50, 1005.0 + t % 50))] + [(5000, 8, 9, 0.0, 1.0)]
    df, origins = spark.createDataFrame(rows, "trip long, a int, b int, departure double, arrival double"), spark.createDataFrame([(0,), (8,)], "o int")
    sizes, loads = [], choice.pickle.loads
    monkeypatch.setattr(choice.pickle, "loads", lambda b: sizes.append(len(b)) or loads(b))
    got = arrivals(choice.earliest(df, origins, 0.0, 10.0, 2500))
    assert got == brute_earliest(rows, [0, 8], 0.0, 10.0)
    assert sizes and max(sizes) <= 2000
