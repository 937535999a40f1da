"""Queries in the shape of streams, run once over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ledger as L
from .base import query, table


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark, sf):
    out = L.windowed_counts(table(spark, sf, "events"), ["event_type"], "1 hour")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf):
    out = L.sessions(table(spark, sf, "events"), ["user_id"], "6 hours")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 256")
def telemetry_ring(spark, sf):
    return L.ring(table(spark, sf, "events"), [F.desc("ts"), F.desc("event_id")]).select("event_id", "event_type")
