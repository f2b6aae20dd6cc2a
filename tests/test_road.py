"""Equilibrium and searches on small networks with known results."""

import random

import pytest

from meridion.operators import graph, road

LINKS = [("p", "a", 10.0, 0.0), ("b", "q", 10.0, 0.0), ("a", "m1", 10.0, 200.0), ("m1", "b", 10.0, 0.0), ("a", "m2", 20.0, 400.0), ("m2", "b", 10.0, 0.0), ("a", "m3", 25.0, 300.0), ("m3", "b", 10.0, 0.0)]


@pytest.fixture
def net(spark):
    return spark.createDataFrame(LINKS, "a string, b string, time double, capacity double")


@pytest.mark.parametrize("method,rounds", [("bfw", 60), ("fw", 80), ("msa", 400)])
def test_three_routes(spark, net, method, rounds):
    demand = spark.createDataFrame([("p", "q", 1000.0)], "origin string, destination string, volume double")
    flow, gaps = road.equilibrium(net, demand, method, min(rounds, 40), 1e-5)
    assert flow["p", "a"] == pytest.approx(1000)
    tolerance = 25 if method == "msa" else 6
    for link, want in ((("a", "m1"), 358.329), (("a", "m2"), 464.514), (("a", "m3"), 177.157)):
        assert flow[link] == pytest.approx(want, abs=tolerance)
    assert gaps[-1] < gaps[0]


def test_unknown_zone_raises(spark, net):
    demand = spark.createDataFrame([("p", "nowhere", 1.0)], "origin string, destination string, volume double")
    with pytest.raises(ValueError):
        road.equilibrium(net, demand)


def test_paths(spark):
    links = spark.createDataFrame([(0, 1, 100.0), (1, 2, 1.0), (2, 3, 2.0), (3, 4, 4.0), (2, 5, 5.0), (5, 4, 6.0), (4, 9, 100.0)], "a int, b int, time double")
    got = {r["destination"]: (r["cost"], list(r["path"])) for r in graph.shortest_paths(links, spark.createDataFrame([(0,)], "o int")).collect()}
    assert got[9] == (207.0, [0, 1, 2, 3, 4, 9])


def test_components_of_long_chains(spark):
    rng = random.Random(4)
    ids = rng.sample(range(1000), 300)
    chains = [list(range(2000, 2100)), [1001, *range(3000, 3060), 1002], ids[:200], ids[200:299], [ids[299]] * 2]
    links = spark.createDataFrame([p for c in chains for p in zip(c, c[1:])], "a int, b int")
    got = {r["node"]: r["component"] for r in graph.labels(links).collect()}
    assert got == {n: min(c) for c in chains for n in c}


def f1(spark):
    roads = [("a", "m1", 10.0, 200.0), ("m1", "b", 10.0, 200.0), ("a", "m2", 20.0, 400.0), ("m2", "b", 10.0, 400.0), ("a", "m3", 25.0, 300.0), ("m3", "b", 25.0, 300.0)]
    rows = [("p", "a", 10.0, None, "free_flow"), ("b", "q", 10.0, None, "free_flow"), *((*r, "default_bpr") for r in roads)]
    links = spark.createDataFrame(rows, "a string, b string, time double, capacity double, vdf string")
    return links, spark.createDataFrame([("p", "q", 1000.0)], "origin string, destination string, car double"), spark.createDataFrame([("p",), ("q",)], "zone string")


def brute_equilibrium(routes, demand):
    """Flows of parallel routes with equal times, by bisection on the time."""

    def at(t):
        out = []
        for parts in routes:
            low, high = 0.0, demand * 2.0
            for _ in range(200):
                mid = (low + high) / 2
                cost = sum(x * (1 + 0.15 * (mid / c) ** 4) for x, c in parts)
                low, high = (low, mid) if cost > t else (mid, high)
            out.append(low if sum(x for x, _ in parts) < t else 0.0)
        return out

    low, high = 0.0, 1e5
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(at(mid)) > demand else (mid, high)
    return at(low)


@pytest.mark.parametrize("method,rounds", [("bfw", 60), ("fw", 150)])
def test_equilibrium_meets_equal_times(spark, method, rounds):
    links, demand, zones = f1(spark)
    got = road.Assignment(links, demand, ["car"], zones).equilibrium(method, rounds, 1e-4, track=[("a", "m2")])
    flow = dict(zip(got.links, got.total, strict=True))
    want = brute_equilibrium([[(10, 200), (10, 200)], [(20, 400), (10, 400)], [(25, 300), (25, 300)]], 1000)
    for m, w in zip(("m1", "m2", "m3"), want, strict=True):
        assert flow["a", m] == pytest.approx(w, abs=0.5) and flow["a", m] == pytest.approx(flow[m, "b"])
    users = dict(zip(got.links, got.tracked["a", "m2"], strict=True))
    assert users["a", "m2"] == pytest.approx(flow["a", "m2"]) and users["p", "a"] == pytest.approx(flow["a", "m2"]) and users["a", "m1"] == 0
    assert {r["a"]: r["flow"] for r in got.table(spark, "string").filter("b = 'q'").collect()} == {"b": pytest.approx(1000)}


ROADS = {("a", "b"): 1.0, ("b", "c"): 5.0, ("b", "d"): 2.0, ("d", "e"): 4.0, ("e", "c"): 6.0}


def f2(spark, **more):
    both = {**ROADS, **{(b, a): t for (a, b), t in ROADS.items()}}
    access = [("z1", "a"), ("a", "z1"), ("e", "z2"), ("z2", "e"), ("z2", "c")]
    rows = [(a, b, 100.0, None, "free_flow", 0.0, 10.0) for a, b in access] + [(a, b, t, 50.0, more.get("vdf", "free_flow"), more.get("base", {}).get((a, b), 0.0), 10.0) for (a, b), t in both.items()]
    links = spark.createDataFrame(rows, "a string, b string, time double, capacity double, vdf string, base_flow double, length double")
    demand = spark.createDataFrame([("z1", "z2", 150.0, 100.0), ("z2", "z1", 100.0, 0.0)], "origin string, destination string, car double, truck double")
    return links, demand, spark.createDataFrame([("z1",), ("z2",)], "zone string")


def test_free_flow_paths_and_turns(spark):
    links, demand, zones = f2(spark)
    job = road.Assignment(links, demand, ["car"], zones)
    cost = job.cost_of(job.base)["car"]
    got = {(r["origin"], r["destination"]): (r["cost"], list(r["path"])) for r in job.paths(cost, demand).collect()}
    assert got == {("z1", "z2"): (207.0, ["z1", "a", "b", "d", "e", "z2"]), ("z2", "z1"): (206.0, ["z2", "c", "b", "a", "z1"])}
    flow = dict(zip(job.links, job.equilibrium("aon").total, strict=True))
    assert (flow["z1", "a"], flow["z2", "c"], flow["a", "z1"], flow["e", "z2"]) == (150, 100, 100, 150)
    turns = spark.createDataFrame([("a", "b", "d", 100.0)], "a string, b string, c string, penalty double")
    job = road.Assignment(links, demand, ["car"], zones, turns)
    got = {(r["origin"], r["destination"]): list(r["path"]) for r in job.paths(cost, demand).collect()}
    assert got["z1", "z2"] == ["z1", "a", "b", "c", "e", "z2"]


def test_segments_and_base_flow(spark):
    base = {("a", "b"): 1.0, ("b", "d"): 1.0, ("c", "e"): 1.0}
    links, demand, zones = f2(spark, vdf="default_bpr", base=base)
    costs = {"car": "jam_time + 2 * length", "truck": "jam_time + length"}
    job = road.Assignment(links, demand, ["car", "truck"], zones, costs=costs)
    for method in ("msa", "fw", "bfw"):
        got = job.equilibrium(method, 8, track=[("a", "b")])
        assert got.total == pytest.approx(got.flow["car"] + got.flow["truck"] + job.base)
        assert got.cost["car"] - got.jam_time == pytest.approx(2 * job.columns["length"]) and got.cost["truck"] - got.jam_time == pytest.approx(job.columns["length"])
        at = job.at["a", "b"]
        assert got.tracked["a", "b"][at] == pytest.approx(got.total[at] - 1.0)
    assert got.gaps[-1] < got.gaps[0]


def test_expressions_are_arithmetic_only():
    with pytest.raises(ValueError):
        road.evaluated("__import__('os').getcwd()", {})
    assert road.evaluated("-x ** 2 + max(x, 3)", {"x": 2}) == -1
