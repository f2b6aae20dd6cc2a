"""Discrete choice: multinomial, nested, incremental and truncated logit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def softmax(los: DataFrame, keys: list[str], utility: str = "utility", scale: float = 1.0, name: str = "probability") -> DataFrame:
    """Probabilities of the alternatives of each key, shifted by the best utility."""
    w = Window.partitionBy(*keys)
    e = F.exp((F.col(utility) - F.max(utility).over(w)) / scale)
    return los.withColumn("__e", e).withColumn(name, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def top(los: DataFrame, keys: list[str], n: int, tie: list[str], utility: str = "utility") -> DataFrame:
    """The n alternatives of highest utility of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(utility), *tie)
    return los.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def nested(los: DataFrame, keys: list[str], nest: str, phi: float, utility: str = "utility") -> DataFrame:
    """Two levels: within a nest at scale phi, between nests on phi times the logsum."""
    inner = softmax(los, [*keys, nest], utility, phi, "within")
    best = F.max(utility)
    sums = los.withColumn("__m", best.over(Window.partitionBy(*keys, nest))).groupBy(*keys, nest).agg((F.max("__m") + phi * F.log(F.sum(F.exp((F.col(utility) - F.col("__m")) / phi)))).alias("logsum"))
    outer = softmax(sums, keys, "logsum", 1.0, "between")
    return inner.join(outer, [*keys, nest]).withColumn("probability", F.col("within") * F.col("between"))


def incremental(los: DataFrame, keys: list[str], share: str, change: str) -> DataFrame:
    """New shares from base shares and changes of utility."""
    e = F.col(share) * F.exp(F.col(change))
    return los.withColumn("__e", e).withColumn("probability", F.col("__e") / F.sum("__e").over(Window.partitionBy(*keys))).drop("__e")


def rounded(los: DataFrame, keys: list[str], decimals: int, tie: list[str]) -> DataFrame:
    """Probabilities cut to decimals; what that leaves goes to the most probable alternative."""
    unit = 10.0**decimals
    cut = F.floor(F.col("probability") * unit + 1e-9) / unit
    w = Window.partitionBy(*keys)
    first = F.row_number().over(w.orderBy(F.desc("probability"), *tie)) == 1
    out = los.withColumn("__c", cut).withColumn("__left", 1 - F.sum("__c").over(w)).withColumn("__first", first)
    return out.withColumn("probability", F.col("__c") + F.when(F.col("__first"), F.col("__left")).otherwise(0.0)).drop("__c", "__left", "__first")


def symmetric(los: DataFrame, part: str, utility: str = "utility") -> DataFrame:
    """Utility of each OD and alternative, averaged with that of the opposite OD (as it is where there is none)."""
    back = los.select(F.col("origin").alias("destination"), F.col("destination").alias("origin"), part, F.col(utility).alias("__b"))
    return los.join(back, ["origin", "destination", part], "left").withColumn(utility, (F.col(utility) + F.coalesce("__b", utility)) / 2).drop("__b")


def logsum(los: DataFrame, keys: list[str], phi: float = 1.0, utility: str = "utility") -> DataFrame:
    """phi times the logarithm of the sum of exp(utility / phi) of each key; phi 0 counts as 1."""
    phi = phi or 1.0
    best = los.withColumn("__m", F.max(utility).over(Window.partitionBy(*keys)))
    return best.groupBy(*keys).agg((F.max("__m") + phi * F.log(F.sum(F.exp((F.col(utility) - F.col("__m")) / phi)))).alias("logsum"))


def incremental_logsum(los: DataFrame, keys: list[str], share: str, change: str) -> DataFrame:
    """The change of a nest's utility: the logarithm of the mean of exp(change), weighted by the shares."""
    return los.groupBy(*keys).agg(F.log(F.sum(F.exp(change) * F.col(share)) / F.sum(share)).alias("change"))


def tree(los: DataFrame, keys: list[str], nests: dict[str, str], phi: dict[str, float], mode: str = "route_type", utility: str = "utility") -> DataFrame:
    """Nested logit over a tree: nests maps each mode or nest to its parent; phi of a nest or mode, or else its parent's, or 1 at the root.

    Paths of a mode compete at the mode's phi, modes and nests within their parent at the parent's. The tree is small and
    known on the driver; each of its levels is one window pass. Gives `probability` of each row."""

    def scale(name):
        while name is not None:
            if name in phi:
                return phi[name] or 1.0
            name = nests.get(name)
        return 1.0

    def depth(name):
        return 0 if name not in nests else 1 + depth(nests[name])

    every = {*nests, *nests.values()}
    of = lambda f, c: F.element_at(F.create_map(*[x for n in sorted(every) for x in (F.lit(n), F.lit(f(n)))]), c)
    w = Window.partitionBy(*keys, mode)
    s = of(scale, F.col(mode))
    out = los.withColumn("__s", s).withColumn("__m", F.max(utility).over(w)).withColumn("__e", F.exp((F.col(utility) - F.col("__m")) / F.col("__s")))
    out = out.withColumn("probability", F.col("__e") / F.sum("__e").over(w)).withColumn("__node", F.col(mode)).withColumn("__u", F.col("__m") + F.col("__s") * F.log(F.sum("__e").over(w))).drop("__s", "__m", "__e")
    for level in range(max(map(depth, every)), 0, -1):
        # Nodes of this level compete within their parent; the rest wait. A node counts once, whatever its rows.
        here = of(depth, F.col("__node")) == level
        parent = F.when(here, of(lambda n: nests.get(n), F.col("__node"))).otherwise(F.col("__node"))
        out = out.withColumns({"__parent": parent, "__here": here})
        once = F.row_number().over(Window.partitionBy(*keys, "__node").orderBy(F.lit(1)))
        w = Window.partitionBy(*keys, "__parent")
        out = out.withColumn("__once", F.when(once == 1, 1.0)).withColumn("__s", of(scale, F.col("__parent"))).withColumn("__m", F.max("__u").over(w))
        e = F.exp((F.col("__u") - F.col("__m")) / F.col("__s"))
        out = out.withColumn("__e", e).withColumn("__t", F.sum(F.col("__e") * F.col("__once")).over(w))
        out = out.withColumn("probability", F.when(F.col("__here"), F.col("probability") * F.col("__e") / F.col("__t")).otherwise(F.col("probability")))
        out = out.withColumn("__u", F.when(F.col("__here"), F.col("__m") + F.col("__s") * F.log("__t")).otherwise(F.col("__u"))).withColumn("__node", F.col("__parent")).drop("__parent", "__here", "__once", "__s", "__m", "__e", "__t")
    return out.drop("__node", "__u")
