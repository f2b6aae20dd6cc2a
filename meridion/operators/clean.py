"""Repairs of networks: each takes tables and gives the mended ones. Lazy plans, but for those that go in rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, integrity


def prefixed(c: Column, prefix: str) -> Column:
    """A text with a prefix, once."""
    text = c.cast("string")
    return F.when(text.startswith(prefix), text).otherwise(F.concat(F.lit(prefix), text))


def with_prefixes(tables: dict[str, DataFrame], columns: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    """Tables whose id columns have prefixes: columns maps a table to its columns and their prefixes."""
    return {t: df.withColumns({c: prefixed(F.col(c), x) for c, x in columns.get(t, {}).items()}) for t, df in tables.items()}


def whole_sequences(links: DataFrame) -> DataFrame:
    """Links of the trips whose links meet end to end, numbered from 1 without gaps."""
    kept = links.join(integrity.broken_sequences(links).select("trip"), "trip", "left_anti")
    w = Window.partitionBy("trip").orderBy("link_sequence", "a", "b")
    return kept.withColumn("link_sequence", F.row_number().over(w))


def without_circular(links: DataFrame) -> DataFrame:
    """Links of the trips that leave no stop twice."""
    twice = links.groupBy("trip", "a").count().filter("count > 1").select("trip").distinct()
    return links.join(twice, "trip", "left_anti")


def renamed_repeats(stop_times: DataFrame, mark: str = "_again_") -> DataFrame:
    """Stops of a trip as texts; from its second visit on, a stop has the mark and the number of the visit."""
    nth = F.row_number().over(Window.partitionBy("trip", "stop").orderBy("seq"))
    name = F.col("stop").cast("string")
    return stop_times.withColumn("__n", nth).withColumn("stop", F.when(F.col("__n") == 1, name).otherwise(F.concat(name, F.lit(mark), F.col("__n") - 1))).drop("__n")


def new_nodes(stop_times: DataFrame, nodes: DataFrame, node: str, mark: str = "_again_") -> DataFrame:
    """nodes and, for each marked stop, a copy of the node that it was."""
    made = stop_times.filter(F.col("stop").contains(mark)).select("stop").distinct().withColumn("__of", F.element_at(F.split("stop", mark), 1))
    text = nodes.withColumn(node, F.col(node).cast("string"))
    more = made.join(text, made["__of"] == text[node]).select(*[F.col("stop").alias(node) if c == node else text[c] for c in nodes.columns])
    return text.unionByName(more)


def consistent(links: DataFrame, nodes: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """Links between known nodes, and nodes at such links."""
    known = nodes.select(F.col(node).alias("a"))
    kept = links.join(known, "a", "left_semi").join(known.withColumnRenamed("a", "b"), "b", "left_semi").select(links.columns)
    ends = kept.select(F.col("a").alias(node)).union(kept.select("b")).distinct()
    return kept, nodes.join(ends, node, "left_semi")


def one_link(links: DataFrame, by: str, least: bool = True) -> DataFrame:
    """One link for each (a, b): the least, or greatest, by a column."""
    order = F.col(by).asc() if least else F.col(by).desc()
    w = Window.partitionBy("a", "b").orderBy(order, *[c for c in links.columns if c not in ("a", "b", by)])
    return links.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def largest_component(links: DataFrame) -> DataFrame:
    """Links of the component with most nodes (ties: the one of the least node)."""
    of = graph.labels(links)
    size = of.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return links.join(of.join(size, "component").select(F.col("node").alias("a")), "a", "left_semi").select(links.columns)


def reached(links: DataFrame, cutoff: int) -> DataFrame:
    """(node, n): how many other nodes each node reaches within `cutoff` links, counted up to `cutoff`.

    A node carries `cutoff` other nodes at most from round to round, which is enough to tell whether it reaches that many."""
    e = links.select("a", "b").filter("a <> b").distinct()
    kind = e.schema["a"].dataType.simpleString()
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    now = nodes.withColumn("seen", F.array().cast(f"array<{kind}>"))
    for _ in range(cutoff):
        told = e.join(now.select(F.col("node").alias("b"), "seen"), "b").select(F.col("a").alias("node"), F.explode(F.concat(F.array("b"), F.col("seen"))).alias("x"))
        told = told.unionByName(now.select("node", F.explode("seen").alias("x"))).filter("x <> node").distinct()
        nth = F.row_number().over(Window.partitionBy("node").orderBy("x"))
        kept = told.withColumn("n", nth).filter(F.col("n") <= cutoff).groupBy("node").agg(F.collect_list("x").alias("seen"))
        now = graph.kept(nodes.join(kept, "node", "left").select("node", F.coalesce("seen", F.array().cast(f"array<{kind}>")).alias("seen")))
    return now.select("node", F.size("seen").alias("n"))


def dead_ends(links: DataFrame, cutoff: int = 5) -> DataFrame:
    """Nodes that reach, or are reached from, fewer than `cutoff` others within `cutoff` links."""
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    few = reached(links, cutoff).unionByName(reached(back, cutoff)).filter(F.col("n") < cutoff)
    return few.select("node").distinct()


def pruned(links: DataFrame, cutoff: int = 5) -> DataFrame:
    """Links between nodes that are no dead ends, in either direction."""
    bad = dead_ends(links, cutoff)
    return links.join(bad.select(F.col("node").alias("a")), "a", "left_anti").join(bad.select(F.col("node").alias("b")), "b", "left_anti").select(links.columns)


def mended_roads(links: DataFrame, cutoff: int = 5, depth: int = 1) -> DataFrame:
    """The largest component without dead ends, `depth` times over."""
    for _ in range(depth):
        links = graph.kept(pruned(graph.kept(largest_component(links)), cutoff))
    return links


def constrained_nodes(links: DataFrame) -> DataFrame:
    """Nodes with one link in and one out."""
    ins = links.groupBy(F.col("b").alias("node")).count().filter("count = 1").select("node")
    return ins.join(links.groupBy(F.col("a").alias("node")).count().filter("count = 1").select("node"), "node")


def contracted(links: DataFrame, extensive: list[str], intensive: list[str] = (), shared: list[str] = ()) -> DataFrame:
    """Chains through constrained nodes as one link (a, b, n_links): sums, means and first values of columns.

    The links of a chain find its first node by pointer jumping: each round doubles the reach. Circles of constrained
    nodes alone have no end and are left out."""
    inner = constrained_nodes(links)
    nxt = graph.kept(links.join(inner.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("a").alias("node"), F.col("b").alias("to")))
    # A constrained node points to the node before it; others are heads.
    before = links.join(inner.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("b").alias("node"), F.col("a").alias("head"), F.lit(1).alias("place"))
    now, open_ = graph.kept(before), nxt.count()
    reach = 1
    while reach <= open_:
        on = now.select(F.col("node").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"))
        now = graph.kept(now.join(on, "head", "left").select("node", F.coalesce("further", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")))
        reach *= 2
    now = now.join(inner.select(F.col("node").alias("head")), "head", "left_anti")
    # The link that leaves a head is named by itself, those that follow by the first constrained node of their chain.
    first = now.filter("place = 1").select(F.col("node").alias("first"), F.col("head").alias("first_head"))
    chain = links.join(now.select(F.col("node").alias("a"), "head", "place"), "a", "left").withColumns({"head": F.coalesce("head", "a"), "place": F.coalesce("place", F.lit(0))})
    ends = _chain_ids(now, first, nxt)
    chain = chain.join(ends.select(F.col("node").alias("a"), "first"), "a", "left").withColumn("first", F.coalesce("first", F.when(F.col("place") == 0, F.col("b"))))
    circles = inner.join(now.select("node"), "node", "left_anti").select(F.col("node").alias("a"))
    chain = chain.join(circles, "a", "left_anti")
    aggs = [F.max_by("b", "place").alias("b"), F.count("*").alias("n_links"), *[F.sum(c).alias(c) for c in extensive], *[F.avg(c).alias(c) for c in intensive], *[F.min_by(c, "place").alias(c) for c in shared]]
    return chain.groupBy("head", "first").agg(*aggs).select(F.col("head").alias("a"), "b", "n_links", *extensive, *intensive, *shared)


def _chain_ids(now: DataFrame, first: DataFrame, nxt: DataFrame) -> DataFrame:
    """(node, first): the first constrained node of each one's chain, told on along the chain by doubling."""
    known = graph.kept(first.select(F.col("first").alias("node"), "first"))
    jump, n = nxt, 0
    todo = now.count()
    while known.count() < todo and n < 64:
        more = known.join(jump, "node").select(F.col("to").alias("node"), "first").join(now.select("node"), "node", "left_semi")
        known = graph.kept(known.unionByName(more).distinct())
        jump = graph.kept(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")))
        n += 1
    return known


def dense_ids(links: DataFrame, nodes: DataFrame, node: str, start: int = 0) -> tuple[DataFrame, DataFrame]:
    """Links and nodes with node ids start, start + 1, and so on in the order of the old ones.

    Places in the whole order come from sorted partitions and their counts, so the nodes never meet in one task."""
    part = nodes.select(node).distinct().repartitionByRange(node).sortWithinPartitions(node).withColumn("__p", F.spark_partition_id())
    part = graph.kept(part.withColumn("__k", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33)))
    sizes = part.groupBy("__p").count()
    before = sizes.withColumn("__s", F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).select("__p", F.coalesce("__s", F.lit(0)).alias("__s"))
    ids = part.join(F.broadcast(before), "__p").select(node, (F.col("__k") + F.col("__s") + start).alias("__id"))
    to = lambda df, c: df.join(ids.withColumnsRenamed({node: c, "__id": "__new"}), c).withColumn(c, F.col("__new")).drop("__new")
    return to(to(links, "a"), "b").select(links.columns), to(nodes, node).select(nodes.columns)


def from_segments(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments (x1, y1, x2, y2) to nodes (node, x, y) and one link (a, b) for each pair: a node's id is a hash of its place."""
    at = lambda k: F.xxhash64(f"x{k}", f"y{k}")
    links = segments.select(at(1).alias("a"), at(2).alias("b")).distinct()
    ends = segments.select(at(1).alias("node"), F.col("x1").alias("x"), F.col("y1").alias("y")).union(segments.select(at(2), "x2", "y2")).distinct()
    return links, ends


def report(links: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """(test, violations) of every test that a network of links and nodes has."""
    tests = {
        "duplicated_links": integrity.duplicates(links, ["a", "b"]),
        "missing_nodes": integrity.missing_nodes(links, nodes, node),
        "orphan_nodes": integrity.orphan_nodes(links, nodes, node),
        "dead_ends": integrity.dead_ends(links),
        "duplicated_nodes": integrity.duplicates(nodes, [node]),
    }
    out = None
    for name, bad in tests.items():
        row = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("test"), "violations")
        out = row if out is None else out.unionByName(row)
    return out
