"""Structured Streaming over the events table, run to completion with availableNow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import drafts
from ..streaming import events as live
from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)


@query("q_stream_tumbling", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(t):
    return live.tumbling(t.spark, t.sf_dir, "10 minutes")


@query(
    "q_stream_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, b DESC ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s",
)
def stream_sessions(t):
    return live.sessions(t.spark, t.sf_dir, "30 minutes")


@query("q_stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, ts FROM events) GROUP BY ALL")
def stream_dedup(t):
    return live.distinct_counts(t.spark, t.sf_dir)


@query("q_stream_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n FROM events GROUP BY user_id")
def stream_latest(t):
    return live.latest_state(t.spark, t.sf_dir)


def _polls(t):
    """Every event as a poll of its user's draft: the cursor comes from its properties, the slot it
    saw too; an error saw the slot empty."""
    rows = live.source(t.spark, t.sf_dir).withColumn("k", F.get_json_object("props", "$.k"))
    holder = F.when(F.col("event_type") != "error", F.col("event_type"))
    slots = F.array(F.struct((F.col("k").cast("int") % 10).alias("slot"), holder.alias("holder")))
    return rows.select(F.col("user_id").cast("string").alias("draft"), "at", F.col("event_id").alias("no"), F.col("k").alias("cursor"), F.lit(False).alias("whole"), slots.alias("slots"))


_DELTAS = """
WITH p AS (SELECT CAST(user_id AS VARCHAR) AS draft, ts, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN event_type <> 'error' THEN event_type END AS holder FROM events),
c AS (SELECT *, lag(k) OVER (PARTITION BY draft ORDER BY ts, event_id) AS before FROM p),
h AS (SELECT draft, ts, event_id, k % 10 AS slot, holder, lag(holder) OVER (PARTITION BY draft, k % 10 ORDER BY ts, event_id) AS held FROM c WHERE before IS DISTINCT FROM k),
d AS (SELECT *, row_number() OVER (PARTITION BY draft ORDER BY ts, event_id) AS seq FROM h WHERE holder IS DISTINCT FROM held)
"""


@query(
    "q_live_deltas",
    _DELTAS + "SELECT draft, seq, ts AS at, CASE WHEN holder IS NULL THEN 'undo' WHEN held IS NULL THEN 'pick' ELSE 'repick' END AS kind, slot, holder FROM d",
)
def live_deltas(t):
    told = drafts.replay(_polls(t), stale_after=10 * 365 * 86_400_000)
    return told.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("q_live_board", _DELTAS + "SELECT draft, slot, arg_max(coalesce(holder, ''), seq) AS holder, max(seq) AS seq, false AS stale FROM d GROUP BY draft, slot HAVING arg_max(coalesce(holder, ''), seq) <> ''")
def live_board(t):
    return drafts.board(drafts.replay(_polls(t), stale_after=10 * 365 * 86_400_000))
