"""Queries of the streaming operators, run to the end of a bounded stream."""

from __future__ import annotations

from sheaf.plans.registry import ORACLES, QUERIES
from sheaf.streaming import streams


def _streamed(spark, sf_dir, table):
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    # A stream reads folders; the glob also fits a single file of that name.
    return spark.readStream.schema(schema).parquet(path if "*" in path else path.replace(".parquet", ".parque*"))


def _windowed(spark, sf_dir):
    return streams.drained(streams.windowed_counts(_streamed(spark, sf_dir, "events"))).selectExpr("cast(start as timestamp_ntz) as start", "event_type", "n", "total")


def _sessions(spark, sf_dir):
    return streams.drained(streams.sessions(_streamed(spark, sf_dir, "events"))).selectExpr("user_id", "cast(start as timestamp_ntz) as start", "n")


def _newest(spark, sf_dir):
    changes = _streamed(spark, sf_dir, "events").selectExpr("user_id as key", "event_id as seq", "value")
    return streams.drained(streams.newest_by_key(changes), "update").groupBy("key").agg({"seq": "max"}).withColumnRenamed("max(seq)", "seq")


QUERIES["str01_windowed_counts"] = _windowed
ORACLES["str01_windowed_counts"] = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
QUERIES["str02_sessions"] = _sessions
ORACLES["str02_sessions"] = """
    WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
    s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
QUERIES["str03_newest_state"] = _newest
ORACLES["str03_newest_state"] = "SELECT user_id AS key, max(event_id) AS seq FROM events GROUP BY user_id"
