"""More network operators: strategies, connection scan, park and ride, sampling, geometry."""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import MAX_LINKS


def _small(df: DataFrame, columns: list[str]) -> list[tuple]:
    got = df.select(*columns).limit(MAX_LINKS + 1).collect()
    if len(got) > MAX_LINKS:
        raise ValueError(f"a network of more than {MAX_LINKS} rows")
    return [tuple(r) for r in got]


def strategy(edges: list[tuple], target) -> tuple[dict, dict, list]:
    """Optimal strategy to a target over (i, j, time, frequency; None: no wait): expected cost, combined frequency, chosen edges in order."""
    into: dict = {}
    for k, (_, j, _, _) in enumerate(edges):
        into.setdefault(j, []).append(k)
    cost, freq, chosen = {target: 0.0}, {}, []
    heap, done = [(edges[k][2], k) for k in into.get(target, ())], set()
    heapq.heapify(heap)
    while heap:
        c, k = heapq.heappop(heap)
        if k in done:
            continue
        done.add(k)
        i, j, t, f = edges[k]
        old = cost.get(i, float("inf"))
        if c >= old:
            continue
        if f is None:
            cost[i], freq[i] = c, float("inf")
        else:
            now = freq.get(i, 0.0)
            if now == float("inf"):
                continue
            cost[i] = (1 + f * c) / f if now == 0 else (now * old + f * c) / (now + f)
            freq[i] = now + f
        chosen.append(k)
        for m in into.get(i, ()):
            if m not in done:
                heapq.heappush(heap, (cost[i] + edges[m][2], m))
    return cost, freq, chosen


def strategies(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(origin, destination, cost): expected time with waiting of 1 / frequency, for each target; nodes are ints."""
    spread = edges.sparkSession.sparkContext.broadcast(_small(edges, ["a", "b", "time", "frequency"]))

    def run(batches):
        for b in batches:
            for d in b.column(0).to_pylist():
                cost = strategy(spread.value, d)[0]
                yield pa.RecordBatch.from_arrays([pa.array(list(cost), pa.int32()), pa.array([d] * len(cost), pa.int32()), pa.array(list(cost.values()), pa.float64())], ["origin", "destination", "cost"])

    return targets.select(F.col(targets.columns[0]).cast("int").alias("d")).distinct().mapInArrow(run, "origin int, destination int, cost double")


def _scan(table: pa.Table, best: dict, aboard: bytearray, transfer: float) -> None:
    """Brings best (node: arrival) and aboard (by place of a trip) up to date by connections in order."""
    for batch in table.to_batches(100_000):
        for dep, arr, trip, i, j in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if aboard[trip] or best.get(i, float("inf")) + transfer <= dep:
                aboard[trip] = 1
                if arr < best.get(j, float("inf")):
                    best[j] = arr


def earliest(connections: DataFrame, origins: DataFrame, start: float, transfer: float = 0.0, most: int = 1_000_000) -> DataFrame:
    """Connection scan over (trip, a, b, departure, arrival): (origin, node, arrival) from `start`, with a least time to change trips.

    More than `most` connections are cut into windows of departures, which are broadcast one after another; arrivals and
    the trips under way go from one window to the next. Connections of one departure stay in one window. The driver holds
    one window, and of a trip under way its id and a bit for each origin. Where no connection arrives before it departs, the
    scan ends as soon as all later ones depart after each origin's last arrival at every node."""
    sc = connections.sparkSession.sparkContext
    key = ["departure", "arrival", "trip", "a", "b"]
    last = F.max("departure").over(Window.partitionBy("trip")).alias("last")
    # In ranges of departures, so that a window is read from few of them.
    c = connections.select(*key, last).filter(F.col("departure") >= start).repartitionByRange("departure").persist(StorageLevel.MEMORY_AND_DISK)
    n, backward = c.agg(F.count("*"), F.coalesce(F.max(F.col("arrival") < F.col("departure")), F.lit(False))).first()
    parts = max(1, -(-n // most))
    cuts = sorted(set(c.approxQuantile("departure", [k / parts for k in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    ends = {r[0] for r in c.select("b").distinct().limit(most + 1).collect()} if cuts and not backward else set()
    ends = ends if len(ends) <= most else set()
    deal = origins.select(F.col(origins.columns[0]).cast("int").alias("o")).distinct().repartition(sc.defaultParallelism, "o")
    state: dict = {}
    under_way = np.zeros(0, np.int64)

    def search(window: pa.Table | None, trips: np.ndarray, stay: np.ndarray | None):
        """Brings the state of each origin over a window; without `stay`, which says which trips go on, its arrivals."""
        spread = sc.broadcast((window, len(trips), np.searchsorted(trips, under_way), stay, state))

        def run(batches):
            table, n, places, stay, before = spread.value
            for b in batches:
                for o in b.column(0).to_pylist():
                    best, bits = before.get(o) or ({o: start - transfer}, None)
                    best, aboard = dict(best), np.zeros(n, np.uint8)
                    if bits is not None:
                        aboard[places] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(places))
                    aboard = bytearray(aboard)
                    if table is not None:
                        _scan(table, best, aboard, transfer)
                    if stay is None:
                        best[o] = start
                        yield pa.RecordBatch.from_arrays([pa.array([o] * len(best), pa.int32()), pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.float64())], ["origin", "node", "arrival"])
                    else:
                        kept = pickle.dumps((best, np.packbits(np.frombuffer(aboard, np.uint8)[stay]).tobytes()))
                        yield pa.RecordBatch.from_arrays([pa.array([o], pa.int32()), pa.array([kept], pa.binary())], ["origin", "state"])

        return deal.mapInArrow(run, "origin int, node int, arrival double" if stay is None else "origin int, state binary"), spread

    edges = [float("-inf"), *cuts, float("inf")]
    for k, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        window = c.filter((F.col("departure") >= low) & (F.col("departure") < high)).toArrow().sort_by([(x, "ascending") for x in key])
        at, leaves = window["trip"].to_numpy(), window["last"].to_numpy()
        trips = np.union1d(at, under_way) if len(under_way) else np.unique(at)
        place = np.searchsorted(trips, at)
        stay = np.ones(len(trips), bool)  # a trip under way that has no connection in this window has one later
        stay[place] = leaves >= high
        window = window.select(["departure", "arrival"]).append_column("trip", pa.array(place)).append_column("a", window["a"]).append_column("b", window["b"])
        if k == len(cuts):
            out, _ = search(window, trips, None)
            break
        got, spread = search(window, trips, np.flatnonzero(stay))
        state = {r["origin"]: pickle.loads(r["state"]) for r in got.collect()}
        spread.destroy()
        under_way = trips[stay]
        # Whatever departs later arrives later still than these.
        if ends and all(len(best) >= len(ends) and all(best.get(j, float("inf")) <= high for j in ends) for best, _ in state.values()):
            out, _ = search(None, under_way, None)
            break
    c.unpersist()
    return out


def park_and_ride(to_park: DataFrame, from_park: DataFrame, spread: float = 0.0) -> DataFrame:
    """(origin, park, cost) with (park, destination, cost): the parks of each OD within `spread` of its least cost."""
    j = to_park.withColumnRenamed("cost", "c1").join(from_park.withColumnRenamed("cost", "c2"), "park").withColumn("cost", F.col("c1") + F.col("c2"))
    least = F.min("cost").over(Window.partitionBy("origin", "destination"))
    return j.withColumn("__m", least).filter(F.col("cost") <= F.col("__m") + spread).select("origin", "destination", "park", "cost")


def sampled(od: DataFrame, share: float, seed: int = 1, block: int = 100_000) -> DataFrame:
    """A sampling operator: a unit of volume is kept with chance `share`, by a hash of OD and unit; the mean stays volume * share.

    The units of a row are dealt out in blocks."""
    whole = F.floor("volume").cast("int")
    most = F.greatest(whole, F.lit(1))
    u = lambda *c: F.pmod(F.xxhash64(F.lit(seed), "origin", "destination", *c), F.lit(1_000_003)) / 1_000_003.0
    sc = od.sparkSession.sparkContext
    tasks = max(int(od.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * sc.defaultParallelism)
    parts = od.withColumn("__id", F.monotonically_increasing_id()).withColumn("__from", F.explode(F.sequence(F.lit(1), most, F.lit(block)))).repartition(tasks, "__id", "__from")
    units = F.sequence(F.col("__from"), F.col("__from") + F.least(most - F.col("__from"), F.lit(block - 1)))
    kept = F.aggregate(units, F.lit(0.0), lambda a, k: a + F.when((u(k) < share) & (whole >= k), 1.0).otherwise(0.0))
    got = parts.withColumn("__kept", kept).groupBy("__id", *od.columns).agg(F.sum("__kept").alias("__kept")).drop("__id")
    return got.withColumn("volume", F.col("__kept") + F.when(u(F.lit(-1)) < share * (F.col("volume") - whole), 1.0).otherwise(0.0)).drop("__kept")


def select_link(paths: DataFrame, a: int, b: int) -> DataFrame:
    """Paths over the link a-b."""
    pair = F.exists(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda i: (F.get("path", i - 1) == a) & (F.get("path", i) == b))
    return paths.filter(pair)


def inside(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon, by ray casting."""
    odd = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 == y2:
            continue
        cross = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        odd = odd != cross
    return odd


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / n))).otherwise(0.0)
    return F.sqrt(F.pow(x - x1 - t * dx, 2) + F.pow(y - y1 - t * dy, 2))


def two_way(links: DataFrame) -> DataFrame:
    """Links and their reverses, with the columns `x_r` as x of the reverse where they are."""
    back = [c for c in links.columns if c.endswith("_r") and c[:-2] in links.columns]
    ahead = [c for c in links.columns if c not in back]
    swap = {"a": "b", "b": "a"} | {c[:-2]: c for c in back}
    return links.select(ahead).unionByName(links.select(*[F.col(swap.get(c, c)).alias(c) for c in ahead]))


def piecewise_headway(services: DataFrame) -> DataFrame:
    """(line, low, high, headway): over each elementary interval of a line, one over the sum of the frequencies that run.

    A running sum of frequencies that start and end, in place of a join of intervals and services. Frequencies are
    decimals, so that what ends takes off exactly what its start added."""
    s = services.select("line", "low", "high", (1 / F.col("headway")).cast("decimal(28,18)").alias("f"))
    runs = F.coalesce(F.col("low") < F.col("high"), F.lit(False)).cast("int")
    end = lambda at, sign: F.struct(F.col(at).alias("p"), (runs * sign).alias("n"), (F.col("f").isNotNull().cast("int") * runs * sign).alias("m"), F.when(runs == 1, F.coalesce("f", F.lit(0).cast("decimal(28,18)")) * sign).alias("f"))
    ends = s.select("line", F.explode(F.array(end("low", 1), end("high", -1))).alias("e")).select("line", "e.*").filter("p is not null")
    # Few rows are left for the window: one for each point of a line.
    at = ends.groupBy("line", "p").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("f").alias("f"))
    w = Window.partitionBy("line").orderBy("p")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = at.select("line", F.col("p").alias("low"), F.lead("p").over(w).alias("high"), F.sum("n").over(so_far).alias("n"), F.sum("m").over(so_far).alias("m"), F.sum("f").over(so_far).cast("double").alias("f"))
    return cut.filter("high is not null and n > 0 and line is not null").select("line", "low", "high", F.when(F.col("m") > 0, 1 / F.col("f")).alias("headway"))


def redistribute(od: DataFrame, shares: DataFrame) -> DataFrame:
    """od to another zoning: shares (zone, cluster, share) of each zone."""
    o = shares.select(F.col("zone").alias("origin"), F.col("cluster").alias("o"), F.col("share").alias("so"))
    d = shares.select(F.col("zone").alias("destination"), F.col("cluster").alias("d"), F.col("share").alias("sd"))
    return od.join(o, "origin").join(d, "destination").groupBy(F.col("o").alias("origin"), F.col("d").alias("destination")).agg(F.sum(F.col("volume") * F.col("so") * F.col("sd")).alias("volume"))


def shifted(volumes: DataFrame, los: DataFrame, before: float, after: float) -> DataFrame:
    """Demand (origin, destination, wish) with services (origin, destination, departure) in its band, and the delay beyond 0."""
    j = volumes.join(los, ["origin", "destination"]).filter((F.col("departure") >= F.col("wish") - before) & (F.col("departure") <= F.col("wish") + after))
    return j.withColumn("delay", F.abs(F.col("departure") - F.col("wish")))
