"""Operators that SQL states badly, against brute force and small known cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from meridion.operators import clean, fares, feed, graph, logit, paths, pt


def brute_chains(links):
    """Chains through nodes with one link in and one out: (a, b, number of links, sum)."""
    ins, outs = {}, {}
    for a, b, _ in links:
        outs.setdefault(a, []).append(b)
        ins.setdefault(b, []).append(a)
    inner = {n for n in ins if len(ins[n]) == 1 and len(outs.get(n, [])) == 1}
    of = {(a, b): x for a, b, x in links}
    out = []
    for a, b, x in links:
        if a in inner:
            continue
        n, total = 1, x
        while b in inner:
            c = outs[b][0]
            n, total, b = n + 1, total + of[b, c], c
        out.append((a, b, n, total))
    return sorted(out)


def test_contracted_chains(spark):
    long = [(i, i + 1, 1.0) for i in range(100, 140)]
    links = [(1, 2, 5.0), (2, 3, 1.0), (3, 1, 2.0), (1, 4, 1.0), (4, 3, 7.0), (3, 100, 1.0), *long, (140, 1, 4.0), (140, 9, 1.0), (9, 8, 1.0)]
    got = clean.contracted(spark.createDataFrame(links, "a int, b int, x double"), ["x"])
    assert sorted(tuple(r) for r in got.select("a", "b", "n_links", "x").collect()) == brute_chains(links)


def test_dead_ends_reach(spark):
    rng = random.Random(3)
    links = {(rng.randrange(60), rng.randrange(60)) for _ in range(75)}
    links = sorted((a, b) for a, b in links if a != b)

    def reach(edges, n, hops):
        seen = now = {n}
        for _ in range(hops):
            now = {b for a, b in edges if a in now} - seen
            seen = seen | now
        return len(seen) - 1

    back = [(b, a) for a, b in links]
    nodes = {x for e in links for x in e}
    want = {n for n in nodes if reach(links, n, 3) < 3 or reach(back, n, 3) < 3}
    assert {r["node"] for r in clean.dead_ends(spark.createDataFrame(links, "a int, b int"), 3).collect()} == want


def test_segments_become_a_graph(spark):
    rows = [(0.0, 0.0, 1.0, 1.0), (1.0, 1.0, 2.0, 0.0), (0.0, 0.0, 1.0, 1.0)]
    links, nodes = clean.from_segments(spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double"))
    assert links.count() == 2 and nodes.count() == 3


STOPS = {"trip_1": "1234567", "trip_2": "012345678"}
SEQUENCES = {"trip_1": range(11, 18), "trip_2": [1, 2, 3, 4, 5, 6, 7, 8, 10], "trip_2_bis": range(1, 8), "trip_3": range(1, 7), "trip_4": range(1, 7), "trip_4_short": range(1, 5)}


@pytest.mark.parametrize("trips,want", [
    (["trip_1", "trip_2"], ["1", "2", "3", "4", "5", "6", "7"]),
    (["trip_1", "trip_2_bis"], ["1", "4", "5", "6", "7"]),
    (["trip_1", "trip_3"], ["4", "6", "7"]),
    (["trip_1", "trip_4"], ["1", "2", "4", "6"]),
    (["trip_1", "trip_4_short"], ["4", "6"]),
])
def test_shared_stops(spark, trips, want):
    stops = {"trip_1": list("1234567"), "trip_2": list("012345678"), "trip_2_bis": list("0145678"), "trip_3": ["4", "3", "2", "52", "6", "7"], "trip_4": ["4", "6", "42", "1", "2", "3"], "trip_4_short": ["4", "6", "42", "1"]}
    rows = [(t, s, k) for t, ss in stops.items() for s, k in zip(ss, SEQUENCES[t], strict=True)]
    got = feed.shared_stops(spark.createDataFrame(rows, "trip string, stop string, seq int"), trips)
    assert sorted(r["stop"] for r in got.collect()) == want


def test_fares(spark):
    one = spark.range(1)
    table = F.create_map(*[x for k, p, c in (("A", 2.0, 1.0), ("B", 1.5, 0.0), ("C", 4.2, None)) for x in (F.lit(k), F.struct(F.lit(p).alias("price"), F.lit(c).cast("double").alias("transfers")))])
    price = {"A": (2.0, 1), "B": (1.5, 0), "C": (4.2, None)}
    legs = [["A", "B"], ["B", "C"], ["A"], ["A", "C"]]
    column = F.array(*[F.array(*map(F.lit, x)) for x in legs])

    def cost(ids, in_a_row):
        runs = [(k, len(list(g))) for k, g in itertools.groupby(ids)] if in_a_row else [(k, ids.count(k)) for k in set(ids)]
        return sum(p if c is None else max(-(-n // (c + 1)), 1) * p for k, n in runs for p, c in [price[k]])

    for in_a_row in (False, True):
        got = one.select(fares.cheapest(column, table, in_a_row).alias("f")).first()["f"]
        want = min((cost(x, in_a_row), x) for x in map(list, itertools.product(*legs)))
        assert (got["price"], list(got["ids"])) == (pytest.approx(want[0]), want[1])
    barred = F.create_map(F.lit("A"), F.array(F.lit("A")))
    got = one.select(fares.combinations(column, never_after=barred).alias("c")).first()["c"]
    assert sorted(map(list, got)) == sorted(list(x) for x in itertools.product(*legs) if not any(a == b == "A" for a, b in itertools.pairwise(x)))
    leg = lambda a, r, b: F.struct(F.lit(a).alias("from_stop"), F.lit(r).alias("route"), F.lit(b).alias("to_stop"))
    rides = F.array(leg("s", "r1", "t"), leg("t", "r2", "u"), leg("u", "r3", "v"), leg("w", "r1", "x"))
    got = one.select(fares.merged(rides, fares.joint_routes([["r1", "r2"], ["r2", "r3"]])).alias("m")).first()["m"]
    assert [tuple(x) for x in got] == [("s", "r1", "v"), ("w", "r1", "x")]


LINKS = [("l1", "t1", 1, "n1", "n2", 4.0, 10.0, "bus", "r1"), ("l2", "t1", 2, "n2", "n3", 4.0, 10.0, "bus", "r1"), ("m1", "t2", 1, "n1", "n3", 3.0, 6.0, "metro", "r2"), ("b1", "t3", 1, "n2", "n3", 9.0, 2.0, "bus", "r3")]


def test_public_transport_paths(spark):
    links = spark.createDataFrame(LINKS, "link string, trip string, link_sequence int, a string, b string, time double, headway double, mode string, route string")
    zones = spark.createDataFrame([("z1",), ("z2",)], "zone string")
    walks = spark.createDataFrame([("z1", "n1", 1.0), ("n3", "z2", 2.0), ("n1", "z1", 1.0), ("z2", "n3", 2.0)], "a string, b string, time double")
    best = {(r["origin"], r["destination"]): (r["gtime"], list(r["path"])) for r in pt.best_paths(pt.edges(links, connectors=walks), zones).collect()}
    assert best == {("z1", "z1"): (0.0, ["z1"]), ("z2", "z2"): (0.0, ["z2"]), ("z1", "z2"): (1 + 3 + 3 + 2, ["z1", "n1", "m1", "n3", "z2"])}
    got = {(tuple(r["path"]), tuple(r["broken"])): r["gtime"] for r in pt.alternatives(links, zones, ["bus", "metro"], ["r1", "r2", "r3"], connectors=walks).filter("origin <> destination").collect()}
    assert got == {(("z1", "n1", "m1", "n3", "z2"), ()): 9.0, (("z1", "n1", "l1", "l2", "n3", "z2"), ("metro",)): 1 + 4 + 5 + 4 + 2}
    pairs = spark.createDataFrame([("z1", "z2")], "origin string, destination string")
    assert pt.best_paths(pt.edges(links, connectors=walks), zones, pairs).count() == 1 and not pt.search_backwards(pairs)
    path = pt.best_paths(pt.edges(links, connectors=walks), zones)
    assert {tuple(r) for r in pt.end_users(path, links, "route").collect()} == {("z1", "first", "r2"), ("z2", "last", "r2")}
    assert pt.best_paths(pt.without(pt.edges(links, connectors=walks), ["m1", "l2", "b1"]), zones).filter("origin <> destination").count() == 0


def test_transfers_at_one_stop(spark):
    rows = [(1, ["z1", "n1", "a", "n2", "b", "n3", "z2"]), (2, ["z1", "n1", "n2", "z2"])]
    kinds = [(v, k) for k, vs in (("zone", ("z1", "z2")), ("node", ("n1", "n2", "n3")), ("link", ("a", "b"))) for v in vs]
    role = paths.roles(paths.steps(spark.createDataFrame(rows, "od int, path array<string>"), spark.createDataFrame(kinds, "vertex string, kind string"), ["od"]))
    got = {r["od"]: r for r in paths.described(role, ["od"]).collect()}
    assert (list(got[1]["transfers"]), got[1]["ntransfers"], got[1]["all_walk"]) == (["n2"], 1, False) and (got[2]["all_walk"], got[2]["ntransfers"]) == (True, 0)
    volumes = spark.createDataFrame([(1, 5.0), (2, 7.0)], "od int, volume double")
    assert [tuple(r) for r in paths.transfer_loads(role, volumes, ["od"]).collect()] == [("n2", 5.0)]


def test_logit_tree_without_nests_is_multinomial(spark):
    rng = random.Random(1)
    rows = [(o, m, rng.random()) for o in range(5) for m in "abc" for _ in range(rng.randint(1, 3))]
    los = spark.createDataFrame(rows, "origin int, route_type string, utility double")
    got = logit.tree(los, ["origin"], {m: "root" for m in "abc"}, {"root": 1.0}).collect()
    want = logit.softmax(los, ["origin"]).collect()
    key = lambda rs: sorted((r["origin"], r["route_type"], r["utility"], round(r["probability"], 9)) for r in rs)
    assert key(got) == key(want)


def test_kept_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    assert graph.kept(spark.range(3)).count() == 3
