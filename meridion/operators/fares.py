"""Fares of rides: options of a leg, their combinations, and the cheapest. All are column expressions on arrays.

A leg's options are an array of fare ids; `table` maps a fare id to a struct of
price and transfers (null: flat), as a map column or literal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def price_of(count: Column, transfers: Column, price: Column) -> Column:
    """A ticket allows `transfers` changes, so count rides take count / (transfers + 1) of them, rounded up; null transfers: one ticket."""
    return F.when(transfers.isNull() | F.isnan(transfers.cast("double")), price).otherwise(F.greatest(F.ceil(count / (transfers + 1)), F.lit(1)) * price)


def options(routes: Column, fares: Column) -> Column:
    """The fare ids of each route of an array: fares is a map from route to an array of ids; an unknown route has no fare (an array of null)."""
    nothing = F.array(F.lit(None).cast("string"))
    return F.transform(routes, lambda r: F.coalesce(F.element_at(fares, r), nothing))


def combinations(legs: Column, legs_type: str = "array<array<string>>", never_after: Column | None = None) -> Column:
    """All choices of one id for each leg, in order of the legs' options; never_after (map of id to ids) bars ids right behind an id."""

    def extend(every, leg):
        def longer(one):
            allowed = leg if never_after is None else F.when(F.size(one) == 0, leg).otherwise(F.array_except(leg, F.coalesce(F.element_at(never_after, F.element_at(one, -1)), F.array().cast("array<string>"))))
            return F.transform(allowed, lambda x: F.concat(one, F.array(x)))

        return F.flatten(F.transform(every, longer))

    return F.aggregate(legs, F.array(F.array().cast("array<string>")).cast(legs_type), extend)


def counts(ids: Column, in_a_row: bool = False) -> Column:
    """How often an array holds each id (null left out): in all, or for each run of one id, as an array of (id, n)."""
    if not in_a_row:
        known = F.filter(ids, lambda x: x.isNotNull())
        return F.transform(F.array_sort(F.array_distinct(known)), lambda x: F.struct(x.alias("id"), F.size(F.filter(known, lambda y: y == x)).alias("n")))
    empty = F.array().cast("array<struct<id:string,n:int>>")

    def add(runs, x):
        last = F.element_at(runs, -1)
        again = (F.size(runs) > 0) & F.get(runs, F.size(runs) - 1)["id"].eqNullSafe(x)
        more = F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.struct(last["id"].alias("id"), (last["n"] + 1).cast("int").alias("n"))))
        return F.when(again, more).otherwise(F.concat(runs, F.array(F.struct(x.alias("id"), F.lit(1).alias("n")))))

    return F.filter(F.aggregate(ids, empty, add), lambda r: r["id"].isNotNull())


def total(counted: Column, table: Column) -> Column:
    """The price of counted ids, each as a ticket of its own for each entry."""
    one = lambda c: price_of(c["n"], F.element_at(table, c["id"])["transfers"], F.element_at(table, c["id"])["price"])
    return F.aggregate(counted, F.lit(0.0), lambda s, c: s + F.coalesce(one(c), F.lit(0.0)))


def cheapest(legs: Column, table: Column, in_a_row: bool = False, never_after: Column | None = None) -> Column:
    """(price, ids) of the cheapest combination; of equal ones the first by ids."""
    every = F.transform(combinations(legs, never_after=never_after), lambda ids: F.struct(total(counts(ids, in_a_row), table).alias("price"), ids.alias("ids")))
    return F.array_min(every)


def merged(legs: Column, joint: Column) -> Column:
    """Legs (array of from_stop, route, to_stop) without the taps between them: legs that meet at a stop, whose routes `joint` (map of route to routes) ties, become one."""
    kind = "array<struct<from_stop:string,route:string,to_stop:string,last:string>>"

    def add(done, leg):
        end = F.get(done, F.size(done) - 1)
        tied = (F.size(done) > 0) & (end["to_stop"] == leg["from_stop"]) & F.array_contains(F.coalesce(F.element_at(joint, end["last"]), F.array().cast("array<string>")), leg["route"])
        one = F.struct(leg["from_stop"].alias("from_stop"), leg["route"].alias("route"), leg["to_stop"].alias("to_stop"), leg["route"].alias("last"))
        both = F.struct(end["from_stop"].alias("from_stop"), end["route"].alias("route"), leg["to_stop"].alias("to_stop"), leg["route"].alias("last"))
        return F.when(F.coalesce(tied, F.lit(False)), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(one)))

    return F.transform(F.aggregate(legs, F.array().cast(kind), add), lambda x: F.struct(x["from_stop"], x["route"], x["to_stop"]))


def joint_routes(networks: list[list[str]]) -> Column:
    """A map of each route to the routes of all networks that it is in."""
    out: dict[str, list[str]] = {}
    for n in networks:
        for r in n:
            out[r] = sorted({*out.get(r, []), *n})
    return F.create_map(*[x for r, rs in sorted(out.items()) for x in (F.lit(r), F.array(*map(F.lit, rs)))])
