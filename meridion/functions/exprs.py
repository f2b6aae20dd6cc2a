"""Column expressions: distances, volume-delay, times, utilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    s = lambda x: F.sin(x / 2)
    a = F.pow(s(F.radians(lat2 - lat1)), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(s(F.radians(lon2 - lon1)), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def bpr(time: Column, flow: Column, capacity: Column, alpha: float = 0.15, beta: float = 4.0) -> Column:
    return time * (1 + alpha * F.pow(flow / capacity, F.lit(beta)))


def beckmann(time: Column, flow: Column, capacity: Column, alpha: float = 0.15, beta: float = 4.0) -> Column:
    """Integral of bpr from 0 to flow."""
    return time * (flow + alpha * capacity / (beta + 1) * F.pow(flow / capacity, F.lit(beta + 1)))


def to_hms(seconds: Column) -> Column:
    """HH:MM:SS of a number of seconds; hours go past 24."""
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    s = seconds.cast("long")
    hours = F.floor(s / 3600)
    return F.concat_ws(":", F.when(hours > 99, hours.cast("string")).otherwise(part(hours)), part(F.floor(s % 3600 / 60)), part(s % 60))


def from_hms(text: Column) -> Column:
    p = F.split(text, ":")
    return (p[0].cast("long") * 3600 + p[1].cast("long") * 60 + p[2].cast("long")).cast("long")


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def weekday_mask(day: Column) -> Column:
    """Seven characters, Monday first, with 1 at the weekday of the day."""
    k = F.weekday(day)
    return F.concat(F.repeat(F.lit("0"), k), F.lit("1"), F.repeat(F.lit("0"), F.lit(6) - k))


def equal_width(x: Column, low: float, high: float, classes: int) -> Column:
    """The class of x, from 1, in equal-width classes; outside values go to the ends."""
    return F.greatest(F.lit(1), F.least(F.lit(classes), (F.floor((x - low) / (high - low) * classes) + 1).cast("int")))
