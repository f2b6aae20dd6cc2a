"""Column expressions on polylines: arrays of points (struct of x and y)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def length(line: Column) -> Column:
    pairs = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)


def bearing(line: Column) -> Column:
    """Radians from 0 to two pi, counter-clockwise from the x axis, from the first point to the last."""
    a, b = F.element_at(line, 1), F.element_at(line, -1)
    return F.pmod(F.atan2(b["y"] - a["y"], b["x"] - a["x"]), F.lit(2 * math.pi))


def crosses_to_the_left(a: Column, b: Column) -> Column:
    """Whether b's bearing is less than a half turn counter-clockwise of a's."""
    return F.pmod(bearing(b) - bearing(a), F.lit(2 * math.pi)) < math.pi


def segments(line: Column) -> Column:
    """The pieces between consecutive points, each a polyline of two."""
    return F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda k: F.slice(line, k, F.lit(2)))


def joined(lines: Column) -> Column:
    """Polylines end to end; a point where two meet is kept once."""
    start = F.slice(F.element_at(lines, 1), 1, F.lit(1))
    return F.aggregate(lines, start, lambda done, line: F.concat(done, F.when(F.element_at(done, -1) == F.element_at(line, 1), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0)))).otherwise(line)))


def cut(line: Column, distance: Column) -> Column:
    """The two parts of a line at a distance along it (one part, where it lies beyond an end)."""
    let = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  # a value that is used often, worked out once
    n = F.size(line)
    gap = lambda k: F.sqrt(F.pow(F.get(line, k)["x"] - F.get(line, k - 1)["x"], 2) + F.pow(F.get(line, k)["y"] - F.get(line, k - 1)["y"], 2))
    # The distance from the start at each point; the sum of the first k gaps is kept as the last of an array.
    runs = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.array(F.lit(0.0)), lambda done, k: F.when(k < n, F.concat(done, F.array(F.element_at(done, -1) + gap(k)))).otherwise(done))

    def parted(run):
        # The first point after the start that lies at the distance or beyond.
        end = F.array_position(F.transform(run, lambda r, k: (k > 0) & (r >= distance)), True).cast("int")
        return let(F.when(end > 0, end), lambda k: let(_between(line, run, distance, k), lambda at: F.array(F.concat(F.slice(line, 1, k - 1), F.array(at)), F.when(F.get(run, k - 1) > distance, F.concat(F.array(at), F.slice(line, k, n - k + 1))).otherwise(F.slice(line, k, n - k + 1)))))

    return let(runs, lambda run: F.when((distance <= 0) | (distance >= F.element_at(run, -1)), F.array(line)).otherwise(parted(run)))


def _between(line: Column, run: Column, distance: Column, k: Column) -> Column:
    """The point at a distance, between the points k - 1 and k (from 1) of a line with the distances at its points."""
    a, b, before = F.get(line, k - 2), F.get(line, k - 1), F.get(run, k - 2)
    share = (distance - before) / (F.get(run, k - 1) - before)
    return F.struct((a["x"] + (b["x"] - a["x"]) * share).alias("x"), (a["y"] + (b["y"] - a["y"]) * share).alias("y"))
