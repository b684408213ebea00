"""Registered queries: progress-event streams; every one runs as a stream over the given events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.operators import outline
from corpusgraph.plans.catalog import query
from corpusgraph.plans.q_ingest import _OUTLINE
from corpusgraph.session import run_dir
from corpusgraph.sources.buckets import BucketTable
from corpusgraph.sources.derived import VIEWS
from corpusgraph.streaming import progress as P
from corpusgraph.streaming import stateful

_RAW = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _read(d, table, schema):
    """A stream over one given table's file."""
    return d.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(d.folder)


def event_stream(d):
    return d.spark.sql(VIEWS["stream_events"], events=_read(d, "events", _RAW))


def _clock(d):
    """A tick 90 days after the last event, which moves the watermark past everything that is kept."""
    end = d.events.agg((F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 90 DAYS")).alias("ts")).first()["ts"]
    return stateful.tick(d.spark, end)


def _plain(df):
    """Timestamps without a zone, as the given table has them."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@query("ss1_stream_status", "stream_events", sql="""
SELECT stream_id, event_type, message, progress, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts DESC, event_id DESC) AS r FROM stream_events WHERE progress IS NOT NULL) WHERE r = 1""")
def ss1(d):
    return _plain(P.stream_status_streaming(event_stream(d), _clock(d)))


@query("ss2_stream_history", "stream_events", sql="""
SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS seq, event_id, event_type, ts FROM stream_events""")
def ss2(d):
    return _plain(P.stream_history_streaming(event_stream(d)))


_GAPS = """
SELECT stream_id, ts AS since, CAST(floor(gap / 3600) AS BIGINT) AS beats, last_progress FROM (
  SELECT *, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS gap,
    last_value(progress IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_progress
  FROM stream_events WINDOW w AS (PARTITION BY stream_id ORDER BY ts, event_id)) WHERE gap > 3600"""


@query("ss3_idle_heartbeat", "stream_events", sql=_GAPS)
def ss3(d):
    told = P.idle_gaps_streaming(event_stream(d), 3600.0, _clock(d))
    last = d.stream_events.groupBy("stream_id").agg(F.max(F.col("ts").cast("timestamp")).alias("since"))
    return _plain(told.join(last, ["stream_id", "since"], "left_anti"))


@query("ss3_heartbeats", "stream_events", sql="""
SELECT stream_id, ts AS since, CAST(least(floor(gap / 3600), 1440) AS BIGINT) AS beats, last_progress FROM (
  SELECT *, (coalesce(epoch_us(lead(ts) OVER w), max(epoch_us(ts)) OVER () + 90 * 86400000000) - epoch_us(ts)) / 1e6 AS gap,
    last_value(progress IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_progress
  FROM stream_events WINDOW w AS (PARTITION BY stream_id ORDER BY ts, event_id)) WHERE gap > 3600""")
def ss3_heartbeats(d):
    """The silence behind the last event too, given up after 60 days."""
    return _plain(P.idle_gaps_streaming(event_stream(d), 3600.0, _clock(d)))


@query("ss3_idle_heartbeat_batch", "stream_events", sql=_GAPS)
def ss3_batch(d):
    return _plain(P.idle_gaps(d.stream_events, 3600.0))


_UNTIL = """
SELECT e.event_id, e.stream_id, e.event_type, e.ts FROM stream_events e LEFT JOIN (SELECT stream_id, min(event_id) AS last_id FROM stream_events WHERE event_type = 'agent_complete' GROUP BY 1) c USING (stream_id)
WHERE last_id IS NULL OR event_id <= last_id"""


@query("ss4_stream_termination", "stream_events", sql=_UNTIL)
def ss4(d):
    return _plain(P.until_complete_streaming(event_stream(d), "agent_complete", _clock(d)).select("event_id", "stream_id", "event_type", "ts"))


@query("ss4_stream_termination_batch", "stream_events", sql=_UNTIL)
def ss4_batch(d):
    return _plain(P.until_complete(d.stream_events, "agent_complete").select("event_id", "stream_id", "event_type", "ts"))


@query("ss5_agent_progress", "stream_events", sql="""
, m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY stream_id ORDER BY ts, event_id) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM stream_events)
, s AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM m)
, a AS (SELECT stream_id, sid, min(ts) AS started, max(ts) AS last_ts, count(*) AS n_events, count(*) FILTER (event_type = 'agent_complete') AS completed, count(*) FILTER (event_type = 'agent_start') AS total FROM s GROUP BY ALL)
SELECT stream_id, started, last_ts, round((epoch_us(last_ts) - epoch_us(started)) / 1e6, 3) AS seconds, n_events, completed, total,
  round(30 + CASE WHEN total > 0 THEN least(completed * 1.0e0 / total, 1) ELSE 0 END * 60 + 1e-9, 3) AS progress FROM a""")
def ss5(d):
    out = P.agent_progress_streaming(event_stream(d), clock=_clock(d))
    return _plain(out.withColumn("seconds", F.round("seconds", 3)).withColumn(
        "progress", F.round(F.col("progress") + 1e-9, 3)))


@query("ss5_stage_durations", "stream_events", sql="""
SELECT stream_id, event_type, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds, count(*) AS n_events FROM stream_events GROUP BY ALL""")
def ss5_stages(d):
    return _plain(P.stage_durations_streaming(event_stream(d), _clock(d)).withColumn("seconds", F.round("seconds", 3)))


@query("ss5_stage_durations_batch", "stream_events", sql="""
SELECT stream_id, event_type, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds, count(*) AS n_events FROM stream_events GROUP BY ALL""")
def ss5_stages_batch(d):
    return _plain(P.stage_durations(d.stream_events).withColumn("seconds", F.round("seconds", 3)))


@query("ss6_incremental_index", "files", sql=_OUTLINE + "SELECT id, file_path, start_line, end_line, node_type, name FROM outl")
def ss6(d):
    """Every file arrives twice, first in an older form; the stream stops in between, and runs once more with nothing new."""
    feed, folder = run_dir(d.spark, "arriving"), run_dir(d.spark, "indexer")
    schema = outline.outline(d.files).schema
    table = BucketTable(d.spark, run_dir(d.spark, "index"), schema, "file_path")
    older = F.concat(F.lit("def before():\n    pass\n"), "content")
    for files in (d.files.withColumn("content", older), d.files):
        files.write.mode("append").parquet(feed)
        arriving = d.spark.readStream.schema(d.files.schema).parquet(feed)
        P.incremental_index(arriving, outline.outline, table, folder)
    out = P.incremental_index(arriving, outline.outline, table, folder)
    return out.select("id", "file_path", "start_line", "end_line", "node_type", "name")


@query("ss7_active_requests", sql="""
SELECT a.event_id, count(*) AS active, count(*) > 3 AS over_limit FROM events a JOIN events b
  ON (b.ts < a.ts OR (b.ts = a.ts AND b.event_id <= a.event_id)) AND b.ts >= a.ts - INTERVAL 300 SECOND GROUP BY a.event_id""")
def ss7(d):
    return _plain(P.active_requests(d.events))


@query("ss7_expire_active", "stream_events", sql="""
SELECT event_id, stream_id, count(*) OVER (PARTITION BY stream_id ORDER BY ts RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW) AS active FROM stream_events""")
def ss7_streaming(d):
    return _plain(P.active_per_stream_streaming(event_stream(d), 7200, _clock(d)))


@query("ss7_expire_active_batch", "stream_events", sql="""
SELECT event_id, stream_id, count(*) OVER (PARTITION BY stream_id ORDER BY ts RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW) AS active FROM stream_events""")
def ss7_batch(d):
    return _plain(P.active_per_stream(d.stream_events, 7200))
