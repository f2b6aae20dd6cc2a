"""Column expressions of operations: dwell times, loads of vehicles, speed profiles, days of service."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dwell_time(boardings: Column, alightings: Column, door: float, flow: float, least: float) -> Column:
    return F.greatest((boardings + alightings) / flow + door, F.lit(least))


def seated(load: Column, seats: Column) -> Column:
    return F.least(load, seats)


def standing_density(load: Column, seats: Column, capacity: Column, full: float = 4.0) -> Column:
    """Those who stand, a square metre, where `capacity` is at `full` a square metre."""
    return F.greatest(load - seats, F.lit(0.0)) / (capacity - seats) * full


def capacity_at(seats: Column, capacity: Column, density: float, full: float = 4.0) -> Column:
    """Places at a density of standing passengers, where `capacity` is at `full` a square metre."""
    return seats + (capacity - seats) * density / full


def peak_speed(distance: Column, up: float, down: float) -> Column:
    """The speed reached where a run speeds up and slows down without a cruise."""
    return F.sqrt(2 * distance * up * down / (up + down))


def run_time(distance: Column, up: float, down: float, most: float) -> Column:
    """Time over a distance with acceleration `up`, deceleration `down` and speed `most`, from standstill to standstill."""
    peak = peak_speed(distance, up, down)
    ramps = most * most / 2 * (1 / up + 1 / down)
    return F.when(peak < most, peak / up + peak / down).otherwise(most / up + most / down + (distance - ramps) / most)


def days_of_week(start: Column, end: Column) -> Column:
    """How many of each weekday, Monday first, lie in [start, end): an array of seven."""
    n = F.datediff(end, start)
    first = F.weekday(start)
    return F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.greatest(F.floor((n - F.pmod(k - first, F.lit(7)) + 6) / 7), F.lit(0)).cast("int"))


def masked_days(start: Column, end: Column, mask: Column) -> Column:
    """Days in [start, end) whose weekday (Monday first) has 1 in a mask of seven."""
    return F.aggregate(F.zip_with(days_of_week(start, end), mask, lambda n, m: n * m), F.lit(0), lambda a, x: a + x)


def span_seconds(text: Column) -> Column:
    """Seconds of a duration 'N days HH:MM:SS' (the days may be missing)."""
    days = F.coalesce(F.regexp_extract(text, r"(-?\d+) days?", 1).try_cast("long"), F.lit(0))
    part = lambda k: F.coalesce(F.regexp_extract(text, r"(\d+):(\d+):(\d+)", k).try_cast("long"), F.lit(0))
    return days * 86400 + part(1) * 3600 + part(2) * 60 + part(3)


def least_lanes(value: Column) -> Column:
    """The least number in an array of texts."""
    return F.array_min(F.transform(value, lambda x: x.try_cast("int")))


def best_class(value: Column, order: list[str]) -> Column:
    """The class of an array that comes first in an order."""
    rank = F.create_map(*[x for k, c in enumerate(order) for x in (F.lit(c), F.lit(k))])
    at = F.array_min(F.transform(value, lambda c: F.element_at(rank, c)))
    return F.element_at(F.array(*map(F.lit, order)), at + 1)


def zone_of(lat: Column, lon: Column) -> Column:
    """The EPSG code of the UTM zone of a place."""
    return (32700 - F.bround((45 + lat) / 90) * 100 + F.bround((183 + lon) / 6)).cast("int")


def emission_cost(distance: Column, sigma: float, power: float = 2.0) -> Column:
    """Minus the log likelihood of a track point at a distance from a link."""
    return F.pow(distance / sigma, F.lit(power)) / 2


def transition_cost(routed: Column, straight: Column, beta: float) -> Column:
    return F.abs(routed - straight) / beta


def turn_cost(angle: Column, beta: float, most: float = 50.0) -> Column:
    """A penalty for turns (degrees), up to most / beta, that sets in smoothly around a right angle."""
    turn = F.abs(F.pmod(angle + 180, F.lit(360)) - 180)
    return most / (1 + F.exp(-0.09 * (turn - 90))) / beta
