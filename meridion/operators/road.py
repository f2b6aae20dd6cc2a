"""Congested road assignment: volume-delay functions, segments, base flow, averages of all-or-nothing steps, trackers.

Demand stays a distributed table; a step is one search over a broadcast network
(checked size) and one sum by link for each segment. Link flows, one number a
link and segment, are numpy arrays on the driver between steps.
"""

from __future__ import annotations

import ast
import heapq
import operator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import MAX_LINKS

VDF = {"default_bpr": "time * (1 + 0.15 * pow(flow / capacity, 4))", "free_flow": "time"}
_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.USub: operator.neg}
_FUNCTIONS = {"pow": np.power, "sqrt": np.sqrt, "exp": np.exp, "log": np.log, "abs": np.abs, "min": np.minimum, "max": np.maximum}


def evaluated(text: str, columns: dict[str, np.ndarray]) -> np.ndarray:
    """An arithmetic expression over columns, by name; nothing else is allowed in it."""

    def value(node):
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
            return node.value
        if isinstance(node, ast.Name):
            return columns[node.id]
        if isinstance(node, ast.BinOp | ast.UnaryOp):
            parts = (node.left, node.right) if isinstance(node, ast.BinOp) else (node.operand,)
            return _OPERATORS[type(node.op)](*map(value, parts))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            return _FUNCTIONS[node.func.id](*map(value, node.args))
        raise ValueError(f"not an arithmetic expression: {text}")

    with np.errstate(all="ignore"):
        return value(ast.parse(text, mode="eval").body)


def delays(columns: dict[str, np.ndarray], flow: np.ndarray, vdf: dict[str, str]) -> np.ndarray:
    """Each link's time at a flow by the function that its `vdf` names; where that gives no number, the free-flow time."""
    out = columns["time"].copy()
    for key, text in vdf.items():
        here = columns["vdf"] == key
        if here.any():
            got = np.broadcast_to(evaluated(text, columns | {"flow": flow}), out.shape)[here]
            out[here] = np.where(np.isfinite(got), got, out[here])
    return out


@dataclass
class Network:
    """Links in the order of their start nodes; zones begin and end paths and have none through them."""

    a: np.ndarray
    b: np.ndarray
    start: np.ndarray
    closed: np.ndarray
    turns: dict = field(default_factory=dict)

    def tree(self, origin: int, cost: np.ndarray) -> tuple[dict, dict]:
        """From a node: (cost of each node, the link by which it is reached)."""
        best, by, heap, done = {origin: 0.0}, {}, [(0.0, origin)], set()
        while heap:
            c, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if self.closed[u] and u != origin:
                continue
            for k in range(self.start[u], self.start[u + 1]):
                v, x = int(self.b[k]), c + cost[k]
                if x < best.get(v, np.inf):
                    best[v], by[v] = x, k
                    heapq.heappush(heap, (x, v))
        return best, by

    def turning_tree(self, origin: int, cost: np.ndarray) -> tuple[dict, dict, dict]:
        """As tree(), with links as vertices so that a turn may cost: (cost of each node, its last link, the link before each link)."""
        best, before, last, reached = {}, {}, {}, {origin: 0.0}
        heap = []
        for k in range(self.start[origin], self.start[origin + 1]):
            best[k] = cost[k]
            heapq.heappush(heap, (cost[k], k))
        done = set()
        while heap:
            c, k = heapq.heappop(heap)
            if k in done:
                continue
            done.add(k)
            v = int(self.b[k])
            if v not in reached:
                reached[v], last[v] = c, k
            if self.closed[v]:
                continue
            for m in range(self.start[v], self.start[v + 1]):
                x = c + cost[m] + self.turns.get((k, m), 0.0)
                if x < best.get(m, np.inf):
                    best[m], before[m] = x, k
                    heapq.heappush(heap, (x, m))
        return reached, last, before

    def path(self, origin: int, end: int, tree: tuple) -> list[int]:
        """The links of a tree's path, last first."""
        out = []
        if len(tree) == 2:
            while end != origin and end in tree[1]:
                out.append(tree[1][end])
                end = int(self.a[out[-1]])
        elif end in tree[1]:
            k = tree[1][end]
            while k is not None:
                out.append(k)
                k = tree[2].get(k)
        return out

    def search(self, origin: int, cost: np.ndarray) -> tuple:
        return self.turning_tree(origin, cost) if self.turns else self.tree(origin, cost)


@dataclass
class Result:
    """Flows and costs by segment, times, the relative gap (percent) of each pass after the first, and the flows of tracked links' users."""

    links: list[tuple]
    flow: dict[str, np.ndarray]
    cost: dict[str, np.ndarray]
    total: np.ndarray
    jam_time: np.ndarray
    gaps: list[float]
    tracked: dict

    def table(self, spark, kind: str) -> DataFrame:
        """(a, b, flow, jam_time, flow_<segment>, cost_<segment>)"""
        names = [x for s in self.flow for x in (f"flow_{s}", f"cost_{s}")]
        columns = [self.total, self.jam_time, *(c for s in self.flow for c in (self.flow[s], self.cost[s]))]
        rows = [(a, b, *(float(c[i]) for c in columns)) for i, (a, b) in enumerate(self.links)]
        return spark.createDataFrame(rows, f"a {kind}, b {kind}, flow double, jam_time double" + "".join(f", {n} double" for n in names))


class Assignment:
    """A network on the driver and demand on the executors.

    links: a, b, time and, where they are, capacity, length, vdf, base_flow and other numbers that expressions name.
    volumes: origin, destination and a column for each segment. zones: no path goes through them. turns: (a, b, c,
    penalty) of the turn from a-b into b-c."""

    def __init__(self, links: DataFrame, volumes: DataFrame, segments: list[str], zones: DataFrame | None = None, turns: DataFrame | None = None, vdf: dict[str, str] = VDF, costs: dict[str, str] | None = None):
        rows = links.limit(MAX_LINKS + 1).toPandas()
        if len(rows) > MAX_LINKS:
            raise ValueError(f"a network of more than {MAX_LINKS} links")
        self.spark, self.segments, self.vdf = links.sparkSession, segments, vdf
        # Every pass reads the demand: it is summed once, not derived again from what it came from.
        self.volumes = volumes.groupBy("origin", "destination").agg(*[F.sum(s).cast("double").alias(s) for s in segments]).persist(StorageLevel.MEMORY_AND_DISK)
        self.kind = links.schema["a"].dataType.simpleString()
        self.costs = {s: (costs or {}).get(s, "jam_time") for s in segments}
        nodes = sorted({*rows["a"], *rows["b"]})
        self.index = {n: i for i, n in enumerate(nodes)}
        ia = rows["a"].map(self.index).to_numpy()
        order = np.argsort(ia, kind="stable")
        rows = rows.iloc[order].reset_index(drop=True)
        self.links = list(zip(rows["a"].tolist(), rows["b"].tolist(), strict=True))
        self.at = {e: k for k, e in enumerate(self.links)}
        self.columns = {c: rows[c].to_numpy(float) for c in rows.columns if c not in ("a", "b", "vdf") and rows[c].dtype.kind in "fiub"}
        self.columns["vdf"] = rows["vdf"].fillna("free_flow").to_numpy(object) if "vdf" in rows else np.full(len(rows), next(iter(vdf)) if "capacity" in rows else "free_flow", object)
        self.base = self.columns.get("base_flow", np.zeros(len(rows)))
        closed = np.zeros(len(nodes), bool)
        if zones is not None:
            closed[[self.index[r[0]] for r in zones.select(zones.columns[0]).collect() if r[0] in self.index]] = True
        start = np.searchsorted(ia[order], np.arange(len(nodes) + 1))
        penalty = {(self.at[r[0], r[1]], self.at[r[1], r[2]]): float(r[3]) for r in turns.select("a", "b", "c", "penalty").collect()} if turns is not None else {}
        self.net = Network(ia[order], rows["b"].map(self.index).to_numpy(), start, closed, penalty)
        for name in ("origin", "destination"):
            lost = [r[0] for r in self.volumes.select(name).distinct().limit(len(nodes) + 1).collect() if r[0] not in self.index]
            if lost:
                raise ValueError(f"demand names {name} {lost[0]!r}, which no link reaches")

    def jam(self, total: np.ndarray) -> np.ndarray:
        return delays(self.columns, total, self.vdf)

    def cost_of(self, total: np.ndarray) -> dict[str, np.ndarray]:
        columns = self.columns | {"jam_time": self.jam(total), "flow": total}
        return {s: np.broadcast_to(np.asarray(evaluated(e, columns), float), total.shape) for s, e in self.costs.items()}

    def load(self, segment: str, cost: np.ndarray, track: list[int]) -> tuple[np.ndarray, dict]:
        """All demand of a segment on its shortest paths: flow by link, and by link of those who use each tracked link."""
        spread, index = self.spark.sparkContext.broadcast((self.net, cost, self.index, track)), None

        def run(batches):
            net, cost, index, track = spread.value
            flow, tracked, origin, tree = {}, {}, None, None
            for b in batches:
                for o, d, v in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    o, d = index[o], index[d]
                    if o != origin:
                        origin, tree = o, net.search(o, cost)
                    path = net.path(o, d, tree)
                    for k in path:
                        flow[-1, k] = flow.get((-1, k), 0.0) + v
                    for t in track:
                        if t in path:
                            for k in path:
                                tracked[t, k] = tracked.get((t, k), 0.0) + v
            flow |= tracked
            if flow:
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in flow], pa.int64()), pa.array([k for _, k in flow], pa.int64()), pa.array(list(flow.values()), pa.float64())], ["tracked", "link", "flow"])

        demand = self.volumes.select("origin", "destination", F.col(segment).alias("v")).filter("v > 0 and origin <> destination")
        got = demand.repartition("origin").sortWithinPartitions("origin").mapInArrow(run, "tracked long, link long, flow double").groupBy("tracked", "link").agg(F.sum("flow").alias("flow"))
        out, users = np.zeros(len(self.links)), {t: np.zeros(len(self.links)) for t in track}
        for t, k, v in got.collect():
            (out if t < 0 else users[t])[k] = v
        return out, users

    def step(self, x: dict, y: dict, most: float) -> float:
        """The share of y in 0 .. most for which the mix of x and y is cheapest: where costs along the direction add up to nothing."""
        d = {s: y[s] - x[s] for s in self.segments}
        low, high = 0.0, most
        for _ in range(50):
            mid = (low + high) / 2
            cost = self.cost_of(sum(x[s] + mid * d[s] for s in self.segments) + self.base)
            low, high = (low, mid) if sum((cost[s] * d[s]).sum() for s in self.segments) > 0 else (mid, high)
        return (low + high) / 2

    def slope(self, total: np.ndarray, h: float = 1e-3) -> np.ndarray:
        """By central differences, how the segments' costs grow with flow, in all."""
        up, down = self.cost_of(total + h), self.cost_of(np.maximum(total - h, 0))
        width = np.minimum(total, h) + h
        return sum((up[s] - down[s]) / width for s in self.segments)

    def equilibrium(self, method: str = "bfw", maxiters: int = 10, tolerance: float = 0.01, track: list[tuple] = ()) -> Result:
        """method: aon, msa (steps 1 / (i + 2)), fw (line search) or bfw (directions conjugate to the last two, then line search).

        The gap is in percent. Flows of tracked links' users take the same mixes as all flows."""
        spots = [self.at[tuple(e)] for e in track]
        names = [(s, None) for s in self.segments] + [(s, t) for s in self.segments for t in spots]
        zero = {n: np.zeros(len(self.links)) for n in names}
        x, past, gaps, phi = dict(zero), [], [], 1.0
        for i in range(1 if method == "aon" else maxiters + 1):
            total = sum(x[s, None] for s in self.segments) + self.base
            cost = self.cost_of(total)
            y = {}
            for s in self.segments:
                y[s, None], users = self.load(s, cost[s], spots)
                y |= {(s, t): u for t, u in users.items()}
            if i:
                now, best = (sum((z[s, None] * cost[s]).sum() for s in self.segments) for z in (x, y))
                gaps.append(100 * (now - best) / now if now else 0.0)
                if gaps[-1] <= tolerance:
                    break
            plain = lambda z: {s: z[s, None] for s in self.segments}
            if i == 0:
                phi = 1.0
            elif method == "msa":
                phi = 1 / (i + 2)
            else:
                if method == "bfw":
                    if i > 2:
                        weights = self.conjugate(total, plain(x), plain(y), [plain(p) for p in past], phi)
                        y = {n: weights[0] * y[n] + weights[1] * past[0][n] + weights[2] * past[1][n] for n in names}
                    past = [y, *past][:2]
                phi = self.step(plain(x), plain(y), 1 / i**0.5)
            x = {n: (1 - phi) * x[n] + phi * y[n] for n in names}
        total = sum(x[s, None] for s in self.segments) + self.base
        tracked = {self.links[t]: sum(x[s, t] for s in self.segments) for t in spots}
        return Result(self.links, {s: x[s, None] for s in self.segments}, self.cost_of(total), total, self.jam(total), gaps, tracked)

    def conjugate(self, total, x, y, past, phi) -> tuple[float, float, float]:
        """Weights of the new target and of the last two for which the direction is conjugate to the last two directions (Mitradjieva and Lindberg 2013)."""
        h = self.slope(total)
        flow, aux, one, two = (sum(z[s] for s in self.segments) for z in (x, y, past[0], past[1]))
        now, last, older = aux - flow, one - flow, phi * one + (1 - phi) * two - flow
        ratio = lambda n, m: max(0.0, -n / m) if m else 0.0
        mu = ratio((older * h * now).sum(), (older * h * (two - one)).sum())
        bottom = (last * h * last).sum()
        nu = max(0.0, (-(last * h * now).sum() / bottom if bottom else 0.0) + mu * phi / max(1e-9, 1 - phi))
        whole = 1 + mu + nu
        return 1 / whole, nu / whole, mu / whole

    def paths(self, cost: np.ndarray, pairs: DataFrame) -> DataFrame:
        """pairs (origin, destination) with their cost and path of nodes; an origin to itself costs nothing."""
        names = list(self.index)
        spread = self.spark.sparkContext.broadcast((self.net, cost, self.index, names))
        kind = self.kind

        def run(batches):
            net, cost, index, names = spread.value
            origin, tree = None, None
            for b in batches:
                out = []
                for o, d in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    if o != origin:
                        origin, tree = o, net.search(index[o], cost)
                    links = net.path(index[o], index[d], tree)[::-1]
                    if links or o == d:
                        out.append((o, d, float(tree[0].get(index[d], 0.0)) if o != d else 0.0, [o, *(names[int(net.b[k])] for k in links)]))
                yield pa.RecordBatch.from_pylist([dict(zip(("origin", "destination", "cost", "path"), r, strict=True)) for r in out], schema=pa.schema([("origin", b.schema.field(0).type), ("destination", b.schema.field(1).type), ("cost", pa.float64()), ("path", pa.list_(b.schema.field(0).type))]))

        return pairs.select("origin", "destination").repartition("origin").sortWithinPartitions("origin").mapInArrow(run, f"origin {kind}, destination {kind}, cost double, path array<{kind}>")


def equilibrium(links: DataFrame, volumes: DataFrame, method: str = "bfw", rounds: int = 10, gap: float = 1e-4) -> tuple[dict, list[float]]:
    """Of links (a, b, time, capacity) and volumes (origin, destination, volume): flow by (a, b), and the relative gaps as shares."""
    over = Assignment(links, volumes, ["volume"])
    got = over.equilibrium(method, rounds, 100 * gap)
    over.volumes.unpersist()
    return dict(zip(got.links, got.total.tolist(), strict=True)), [g / 100 for g in got.gaps]


def loaded(links: DataFrame, flow: dict) -> DataFrame:
    """links with flow and jam_time."""
    kind = links.schema["a"].dataType.simpleString()
    f = links.sparkSession.createDataFrame([(a, b, v) for (a, b), v in flow.items()], f"a {kind}, b {kind}, flow double")
    delay = F.when(F.col("capacity") > 0, F.col("time") * (1 + 0.15 * F.pow(F.col("flow") / F.col("capacity"), F.lit(4.0)))).otherwise(F.col("time"))
    return links.join(f, ["a", "b"], "left").withColumn("flow", F.coalesce("flow", F.lit(0.0))).withColumn("jam_time", delay)
