"""Graph searches over a network that fits one executor.

Networks (links) are small beside demand, so a search broadcasts the network,
checked against MAX_LINKS, and deals the origins out to tasks.
"""

from __future__ import annotations

import atexit
import heapq
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LINKS = 5_000_000


def network(links: DataFrame, cost: str) -> list[tuple]:
    """(a, b, cost) of a checked number of links, on the driver."""
    got = links.select("a", "b", F.col(cost).cast("double")).limit(MAX_LINKS + 1).collect()
    if len(got) > MAX_LINKS:
        raise ValueError(f"a network of more than {MAX_LINKS} links; cut it into parts first")
    return [tuple(r) for r in got]


def dijkstra(out: dict, origin, limit: float = float("inf")) -> tuple[dict, dict]:
    """Costs and predecessors from origin; ties go to the smaller predecessor."""
    cost, before, heap, done = {origin: 0.0}, {}, [(0.0, origin)], set()
    while heap:
        c, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        for v, w in out.get(u, ()):
            x = c + w
            if x > limit:
                continue
            old = cost.get(v)
            if old is None or x < old or (x == old and u < before.get(v, u)):
                cost[v] = x
                before[v] = u
                heapq.heappush(heap, (x, v))
    return cost, before


def adjacency(links: list[tuple]) -> dict:
    out: dict = {}
    for a, b, w in links:
        out.setdefault(a, []).append((b, w))
    return out


def shortest_paths(links: DataFrame, origins: DataFrame, cost: str = "time", limit: float = float("inf")) -> DataFrame:
    """(origin, destination, cost, path) for each origin and each node it reaches; nodes are ints."""
    spread = links.sparkSession.sparkContext.broadcast(network(links, cost))

    def run(batches):
        out = adjacency(spread.value)
        for b in batches:
            for o in b.column(0).to_pylist():
                found, before = dijkstra(out, o, limit)
                rows = []
                for d, c in found.items():
                    path = [d]
                    while path[-1] != o:
                        path.append(before[path[-1]])
                    rows.append((o, d, c, path[::-1]))
                o_, d_, c_, p_ = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(o_, pa.int32()), pa.array(d_, pa.int32()), pa.array(c_, pa.float64()), pa.array(p_, pa.list_(pa.int32()))], ["origin", "destination", "cost", "path"])

    return origins.select(F.col(origins.columns[0]).cast("int").alias("origin")).distinct().mapInArrow(run, "origin int, destination int, cost double, path array<int>")


def reachable_pairs(links: DataFrame, origins: DataFrame, hops: int) -> DataFrame:
    """(origin, node, hops) for nodes within a number of links, by joins alone."""
    now = origins.select(F.col(origins.columns[0]).alias("origin"), F.col(origins.columns[0]).alias("node"), F.lit(0).alias("hops"))
    every = now
    for k in range(1, hops + 1):
        now = now.join(links.select(F.col("a").alias("node"), F.col("b").alias("to")), "node").select("origin", F.col("to").alias("node"), F.lit(k).alias("hops")).distinct()
        every = every.unionByName(now)
    return every.groupBy("origin", "node").agg(F.min("hops").alias("hops"))


def kept(df: DataFrame) -> DataFrame:
    """df computed once and written to the checkpoint folder, which all executors share; only a local master may do without one being set."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
            path = tempfile.mkdtemp(prefix="meridion-")
            atexit.register(shutil.rmtree, path, True)
        sc.setCheckpointDir(path)
    return df.checkpoint()


def labels(links: DataFrame) -> DataFrame:
    """(node, component) with the least node of each component, by hooking and pointer jumping until nothing changes.

    A round gives each node, and the node that it points to, the least label of its neighbours; then each label
    becomes the label of the node that it names."""
    e = links.select("a", "b").union(links.select("b", "a")).distinct()
    e = kept(e)
    now = e.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    changed = True
    while changed:
        seen = e.join(now.select(F.col("node").alias("b"), F.col("component").alias("m")), "b").join(now.select(F.col("node").alias("a"), "component"), "a")
        told = seen.select(F.explode(F.array("a", "component")).alias("node"), F.col("m").alias("component"), F.lit(None).cast(now.schema["component"].dataType).alias("old"))
        least = now.withColumn("old", F.col("component")).unionByName(told).groupBy("node").agg(F.min("component").alias("component"), F.max("old").alias("old"))
        jump = least.select(F.col("node").alias("component"), F.col("component").alias("to"))
        got = kept(least.join(jump, "component", "left").select("node", F.coalesce("to", "component").alias("component"), "old"))
        changed = not got.filter("component < old").isEmpty()
        now = got.select("node", "component")
    return now
