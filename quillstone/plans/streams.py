"""Streams over the whole table, run once to its end, and a window's plan over it as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans.registry import query
from quillstone.sources.catalog import table
from quillstone.streaming import events as E
from quillstone.streaming.events import windowed


@query("extension", "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(table(spark, sf_dir, "events")).withColumn("start", F.unix_timestamp("start"))


_SESSIONS = """WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS s FROM (SELECT *, '' AS event_type FROM o)),
x AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS last_end, count(*) AS n, round(sum(value), 2) AS total FROM g GROUP BY user_id, s)
SELECT * FROM x WHERE last_end <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"""


@query("extension", _SESSIONS)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users that have ended when the stream has."""
    return E.collected(E.sessions(E.read_stream(spark, sf_dir)))


@query("extension", "SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_sent_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in which every event comes twice, and is kept once."""
    twice = E.read_stream(spark, sf_dir).unionByName(E.read_stream(spark, sf_dir))
    return E.collected(E.sent_once(twice, ["event_id"])).select("event_id", "ts", "user_id", "event_type", "value")


@query("extension C14", "SELECT event_id, event_type, c_mktsegment AS segment FROM events LEFT JOIN customer ON c_custkey = user_id")
def stream_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the segment of their user, as a table of customers has it."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return E.collected(E.enriched(E.read_stream(spark, sf_dir), known, "user_id", ["segment"]).select("event_id", "event_type", "segment"))
