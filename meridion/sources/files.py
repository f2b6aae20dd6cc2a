"""Readers and writers: CSV, JSON records, GeoJSON, GTFS, key-value parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a timetable feed's files.
GTFS = {
    "agency": "agency_id string, agency_name string",
    "routes": "route_id string, agency_id string, route_short_name string, route_long_name string, route_type int, route_color string",
    "trips": "trip_id string, route_id string, service_id string, direction_id int, shape_id string",
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double, parent_station string",
    "stop_times": "trip_id string, stop_id string, stop_sequence int, arrival_time string, departure_time string",
    "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string",
    "calendar_dates": "service_id string, date string, exception_type int",
    "frequencies": "trip_id string, start_time string, end_time string, headway_secs int",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int",
    "fare_attributes": "fare_id string, price double, transfers int, agency_id string",
    "fare_rules": "fare_id string, route_id string, origin_id string, destination_id string",
}
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def read_gtfs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The files that the unpacked feed has, by name; columns that a file lacks are null."""
    out = {}
    for name, schema in GTFS.items():
        try:
            raw = spark.read.csv(f"{path}/{name}.txt", header=True)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        columns = [c.rsplit(" ", 1) for c in schema.split(", ")]
        has = {c.strip().lstrip("﻿").lower(): c for c in raw.columns}
        out[name] = raw.select(*[(F.trim(F.col(f"`{has[c]}`")).cast(t) if c in has else F.lit(None).cast(t)).alias(c) for c, t in columns])
    return out


def services_on(feed: dict[str, DataFrame], day: str) -> DataFrame:
    """service_id of the services that run on a day (yyyymmdd): calendar, plus additions, less removals; a feed may have either table alone."""
    on = F.element_at(F.array(*[F.col(d) for d in DAYS]), F.weekday(F.to_date(F.lit(day), "yyyyMMdd")) + 1) == 1
    parts = []
    if "calendar" in feed:
        parts.append(feed["calendar"].filter(on & (F.col("start_date") <= day) & (F.col("end_date") >= day)).select("service_id"))
    if "calendar_dates" in feed:
        extra = feed["calendar_dates"].filter(F.col("date") == day)
        parts.append(extra.filter("exception_type = 1").select("service_id"))
        out = parts[0].union(parts[-1]) if len(parts) > 1 else parts[0]
        return out.distinct().join(extra.filter("exception_type = 2").select("service_id"), "service_id", "left_anti")
    if not parts:
        raise ValueError("a feed needs calendar or calendar_dates")
    return parts[0].distinct()


def restrict(feed: dict[str, DataFrame], trips: DataFrame) -> dict[str, DataFrame]:
    """The feed of some trips (trip_id): every table cut down to what they use."""
    out = dict(feed)
    chain = (("trips", "trip_id", trips), ("stop_times", "trip_id", "trips"), ("frequencies", "trip_id", "trips"), ("routes", "route_id", "trips"), ("calendar", "service_id", "trips"), ("calendar_dates", "service_id", "trips"), ("shapes", "shape_id", "trips"), ("stops", "stop_id", "stop_times"), ("agency", "agency_id", "routes"))
    for name, key, by in chain:
        if name in out and not (isinstance(by, str) and by not in out):
            keys = out[by] if isinstance(by, str) else by
            out[name] = out[name].join(keys.select(key).distinct(), key, "left_semi")
    return out


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A row for each feature: properties (map), kind, coordinates (JSON text)."""
    doc = spark.read.text(path, wholetext=True)
    shape = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
    f = doc.select(F.explode(F.from_json("value", shape)["features"]).alias("f"))
    return f.select(F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def write_geojson_lines(df: DataFrame, path: str, x: str, y: str) -> None:
    """Points as one GeoJSON feature a line."""
    rest = [c for c in df.columns if c not in (x, y)]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"))
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON: one array of records, or a record a line."""
    return (spark.read.schema(schema) if schema else spark.read).option("multiLine", True).json(path)


def parameters(df: DataFrame, scenario: str, names: list[str] | None = None) -> dict:
    """A column of a parameter sheet (category, parameter, one column a scenario) as {(category, parameter): value}."""
    got = df.select("category", "parameter", scenario)
    return {(r[0], r[1]): r[2] for r in got.filter(F.col("parameter").isin(names) if names else F.lit(True)).limit(100_000).collect()}
