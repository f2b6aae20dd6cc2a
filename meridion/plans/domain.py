"""Transport tables derived from the star schema, one SQL text for both engines.

zones is the nation grid, volumes the ordered quantities between customer and
supplier nations, stop_times and links the orders read as trips over parts as
stops, los the alternatives (part types) of each origin and destination.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

DOMAIN = {
    "od": """SELECT CAST(c_nationkey AS INT) AS origin, CAST(s_nationkey AS INT) AS destination, c_mktsegment AS segment, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_orderkey AS orderkey, l_partkey AS partkey
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey""",
    "volumes": "SELECT origin, destination, segment, sum(quantity) AS volume FROM {od} GROUP BY origin, destination, segment",
    "od_volumes": "SELECT origin, destination, sum(quantity) AS volume FROM {od} GROUP BY origin, destination",
    "zones": """SELECT CAST(n_nationkey AS INT) AS zone, CAST(n_regionkey AS INT) AS cluster, CAST(n_nationkey % 5 AS DOUBLE) AS x, CAST(floor(n_nationkey / 5) AS DOUBLE) AS y,
        coalesce(e.emission, 0) AS emission, coalesce(t.attraction, 0) AS attraction
        FROM {nation} LEFT JOIN (SELECT origin, sum(volume) AS emission FROM {od_volumes} GROUP BY origin) e ON n_nationkey = e.origin
        LEFT JOIN (SELECT destination, sum(volume) AS attraction FROM {od_volumes} GROUP BY destination) t ON n_nationkey = t.destination""",
    "skims": """SELECT o.zone AS origin, d.zone AS destination, o.emission, d.attraction, sqrt((o.x - d.x) * (o.x - d.x) + (o.y - d.y) * (o.y - d.y)) AS distance FROM {zones} o CROSS JOIN {zones} d""",
    "road_links": """SELECT a.zone AS a, b.zone AS b, CAST(1 + (a.zone * 7 + b.zone * 3) % 5 AS DOUBLE) AS time, 1000.0D0 AS length, 2000 + 500.0D0 * ((a.zone + b.zone) % 7) AS capacity
        FROM {zones} a JOIN {zones} b ON abs(a.x - b.x) + abs(a.y - b.y) = 1""",
    "los": """SELECT origin, destination, p_type AS route_type, avg(price) AS price, avg(quantity) AS time, avg(tax) AS transfers, count(*) AS n
        FROM {od} JOIN {part} ON partkey = p_partkey GROUP BY origin, destination, p_type""",
    "stop_times": """SELECT l_orderkey AS trip, CAST(l_partkey % 25 AS INT) AS stop, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS seq, l_quantity AS dwell FROM {lineitem}""",
    "links": """SELECT trip, seq AS link_sequence, a, b, minutes, route, headway FROM (
        SELECT trip, seq, stop AS a, lead(stop) OVER (PARTITION BY trip ORDER BY seq) AS b, dwell AS minutes, o_orderpriority AS route, CAST(300 + 60 * (trip % 7) AS DOUBLE) AS headway FROM {stop_times} JOIN {orders} ON trip = o_orderkey) t WHERE b IS NOT NULL""",
    # Links in which every eleventh begins elsewhere, every 97th is there twice, and one-way spurs to places off the grid.
    "shifted": "SELECT trip, link_sequence, CASE WHEN (trip + link_sequence) % 11 = 0 THEN a + 30 ELSE a END AS a, b, minutes, route, headway FROM {links}",
    "damaged": """SELECT trip, link_sequence, a, b, minutes, route, headway FROM {shifted}
        UNION ALL SELECT trip, link_sequence, a, b, minutes, route, headway FROM {links} WHERE (trip + link_sequence) % 97 = 0""",
    "spurs": """SELECT a, b, time, length FROM {road_links} UNION ALL SELECT zone, zone + 200, 1.0D0, 500.0D0 FROM {zones} WHERE zone % 4 = 0
        UNION ALL SELECT zone + 200, zone + 300, 2.0D0, 400.0D0 FROM {zones} WHERE zone % 8 = 0 UNION ALL SELECT zone + 500, zone + 501, 1.0D0, 100.0D0 FROM {zones} WHERE zone < 6""",
    # Each trip as a path from zone to zone: its links, and for every other trip a walk and a ride on a link m of another line.
    "ride_ends": "SELECT trip, CAST(max(link_sequence) AS INT) AS k, min_by(a, link_sequence) AS fa, max_by(b, link_sequence) AS lb, min(route) AS route FROM {links} GROUP BY trip",
    "ride_steps": """SELECT trip, 0 AS place, 'z' || CAST(fa AS STRING) AS vertex, 'zone' AS kind FROM {ride_ends} UNION ALL SELECT trip, 1, 'n' || CAST(fa AS STRING), 'node' FROM {ride_ends}
        UNION ALL SELECT trip, link_sequence + 1, 'l' || CAST(trip AS STRING) || '_' || CAST(link_sequence AS STRING), 'link' FROM {links}
        UNION ALL SELECT trip, k + 2, 'n' || CAST(lb AS STRING), 'node' FROM {ride_ends}
        UNION ALL SELECT trip, k + 3, 'n' || CAST(lb + 25 AS STRING), 'node' FROM {ride_ends} WHERE trip % 2 = 0 UNION ALL SELECT trip, k + 4, 'm' || CAST(trip AS STRING), 'link' FROM {ride_ends} WHERE trip % 2 = 0
        UNION ALL SELECT trip, k + 5, 'n' || CAST(lb + 50 AS STRING), 'node' FROM {ride_ends} WHERE trip % 2 = 0
        UNION ALL SELECT trip, CASE WHEN trip % 2 = 0 THEN k + 6 ELSE k + 3 END, 'z' || CAST(lb AS STRING), 'zone' FROM {ride_ends}""",
    "ride_links": """SELECT 'l' || CAST(trip AS STRING) || '_' || CAST(link_sequence AS STRING) AS vertex, trip, route, minutes AS time, headway, a AS from_zone, b AS to_zone FROM {links}
        UNION ALL SELECT 'm' || CAST(trip AS STRING), trip, 'M', 3.0D0, 120.0D0, lb, lb FROM {ride_ends} WHERE trip % 2 = 0""",
    "timed": """SELECT trip, seq, stop, CAST(trip % 500 * 60 + seq * 100 AS DOUBLE) AS arrival, CAST(trip % 500 * 60 + seq * 100 + dwell AS DOUBLE) AS departure FROM {stop_times}""",
    "gps": "SELECT user_id, event_id, event_type, value, ts, CAST(floor(epoch_s) AS BIGINT) AS t FROM (SELECT *, {epoch} AS epoch_s FROM {events}) e",
}


# Spark's way to the same tables. Items are dealt out by trip under its own name, so that nothing over trips deals them out again.
ITEMS = "SELECT l_orderkey AS trip, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM {lineitem}"
SPARK = {
    "stop_times": "SELECT trip, CAST(l_partkey % 25 AS INT) AS stop, CAST(row_number() OVER (PARTITION BY trip ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS seq, l_quantity AS dwell FROM {items}",
    # One reading of links: what surrounds a trip's links stands at its first one and at its last.
    "ride_steps": """SELECT trip, e.place, e.vertex, e.kind FROM (SELECT trip, link_sequence, a AS fa, b AS lb, lead(link_sequence) OVER o IS NULL AS at_end, lag(link_sequence) OVER o IS NULL AS at_start, CAST(link_sequence AS INT) AS k FROM {links} WINDOW o AS (PARTITION BY trip ORDER BY link_sequence))
        LATERAL VIEW inline(concat(
            CASE WHEN at_start THEN array(struct(0 AS place, 'z' || CAST(fa AS STRING) AS vertex, 'zone' AS kind), struct(1 AS place, 'n' || CAST(fa AS STRING) AS vertex, 'node' AS kind)) ELSE array() END,
            array(struct(k + 1 AS place, 'l' || CAST(trip AS STRING) || '_' || CAST(link_sequence AS STRING) AS vertex, 'link' AS kind)),
            CASE WHEN at_end THEN array(struct(k + 2 AS place, 'n' || CAST(lb AS STRING) AS vertex, 'node' AS kind)) ELSE array() END,
            CASE WHEN at_end AND trip % 2 = 0 THEN array(struct(k + 3 AS place, 'n' || CAST(lb + 25 AS STRING) AS vertex, 'node' AS kind), struct(k + 4 AS place, 'm' || CAST(trip AS STRING) AS vertex, 'link' AS kind), struct(k + 5 AS place, 'n' || CAST(lb + 50 AS STRING) AS vertex, 'node' AS kind)) ELSE array() END,
            CASE WHEN at_end THEN array(struct(CASE WHEN trip % 2 = 0 THEN k + 6 ELSE k + 3 END AS place, 'z' || CAST(lb AS STRING) AS vertex, 'zone' AS kind)) ELSE array() END)) e AS place, vertex, kind""",
}
TASK_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base or derived table."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "items":
        return dealt(run(spark, sf_dir, ITEMS), table(spark, sf_dir, "lineitem"), "trip")
    text = SPARK.get(name, DOMAIN.get(name)).replace("{epoch}", "unix_timestamp(ts)").replace("D0", "D")
    return run(spark, sf_dir, text)


def dealt(df: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """df by key in one task for each TASK_BYTES of its source's files, which bounds what a task sorts; small ones are left to Spark.

    Spark makes tasks of equal compressed bytes, and columns that compress well may be many times larger in memory."""
    parts = -(-int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // TASK_BYTES)
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key) if parts > 4 else df


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over tables named in braces."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def oracle(text: str) -> str:
    """DuckDB SQL with the derived tables that the text names in braces as CTEs."""
    need: list[str] = []

    def visit(t: str) -> None:
        for n in re.findall(r"\{(\w+)\}", t):
            if n in DOMAIN and n not in need:
                visit(DOMAIN[n])
                need.append(n)

    visit(text)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t.replace("{epoch}", "epoch(ts)")).replace("D0", "::DOUBLE")
    head = ", ".join(f"{n} AS ({plain(DOMAIN[n])})" for n in need)
    body = plain(text).strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    return f"WITH {head}, {body[4:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
