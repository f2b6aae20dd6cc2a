"""Queries over events and other tables, as batches of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as S
from .domain import oracle, table

Q: dict = {}
O: dict[str, str] = {}


def windows(spark, d):
    w = S.windowed(table(spark, d, "events"))
    return w.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def sessions(spark, d):
    return S.sessions(table(spark, d, "events")).select("user_id", F.unix_timestamp("start").alias("start"), "n")


Q["event_windows"] = windows
O["event_windows"] = oracle("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM {events} GROUP BY 1, 2")
Q["event_sessions"] = sessions
O["event_sessions"] = oracle("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k")
