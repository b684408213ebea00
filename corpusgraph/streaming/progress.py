"""Progress-event streams: each monitoring query in a batch form and a streaming form.

``events(event_id, stream_id, event_type, ts, message, progress)``; both forms give equal tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.operators.windows import running_sum
from corpusgraph.session import run_dir
from corpusgraph.sources.buckets import BucketTable
from corpusgraph.streaming import stateful

SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("stream_id", T.StringType()),
    T.StructField("event_type", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("message", T.StringType()), T.StructField("progress", T.DoubleType())])

# ---- fixed values: progress marks and limits ----
START_MARK, SPAN = 30.0, 60.0
IDLE_SECONDS = 1.0
EXPIRE_SECONDS, MOST_ACTIVE = 300, 3
#: Seconds after its newest event until a stream's state goes; a stream that speaks again later starts anew.
KEEP_SECONDS = 60 * 86400.0
#: How late an event may be against the newest one.
DELAY = "1 hour"


def run_available(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None] | None = None,
                  folder: str | None = None, reports: list | None = None) -> DataFrame:
    """Run a stream over what is available now; returns the rows written, with their ``batch``.

    Every micro-batch overwrites its own folder, so a batch that is retried is not doubled. A later call with the same
    ``folder`` goes on where the last one ended and returns the rows of both. ``reports`` receives Spark's progress reports.
    """
    spark = stream.sparkSession
    folder, schema = folder or run_dir(spark, "stream"), stream.schema
    out = f"{folder}/rows"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)  # timers need it
    try:
        query = (
            stream.writeStream.outputMode(mode).foreachBatch(write or save)
            .option("checkpointLocation", f"{folder}/commits").trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    query.awaitTermination()
    if reports is not None:
        reports.extend(query.recentProgress)
    if write is not None:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(T.StructType(list(schema.fields) + [T.StructField("batch", T.IntegerType())]))
    return reader.option("basePath", out).parquet(out)


def _us(column) -> Column:
    """Microseconds of a timestamp column of either kind."""
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def _latest(df: DataFrame) -> DataFrame:
    return df.groupBy("stream_id").agg(F.max_by(
        F.struct("event_type", "message", "progress"), F.struct("ts", "event_id")).alias("s"), F.max("ts").alias("ts"))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("stream_id", "s.event_type", "s.message", "s.progress", "ts")


def stream_status(events: DataFrame) -> DataFrame:
    """Latest stage, message and progress per stream; events without progress change nothing."""
    return _flat(_latest(events.filter("progress IS NOT NULL")))


def stream_status_streaming(events: DataFrame, clock: DataFrame | None = None, keep: float = KEEP_SECONDS, **run) -> DataFrame:
    """The same, from a log of status changes; a stream's state goes ``keep`` seconds after its last event."""
    log = run_available(stateful.process(stateful.timed(events, clock, DELAY), stateful.Status(keep), stateful.Status.schema),
                        "append", **run)
    return _flat(_latest(log))


def stream_history(events: DataFrame) -> DataFrame:
    """Numbered events of every stream in time order."""
    w = Window.partitionBy("stream_id").orderBy("ts", "event_id")
    return events.withColumn("seq", F.row_number().over(w)).select("stream_id", "seq", "event_id", "event_type", "ts")


def stream_history_streaming(events: DataFrame) -> DataFrame:
    return stream_history(run_available(events, "append").drop("batch"))


def idle_gaps(events: DataFrame, idle: float = IDLE_SECONDS) -> DataFrame:
    """One row per silence longer than ``idle``: when it began, heartbeats due in it, last progress."""
    w = Window.partitionBy("stream_id").orderBy("ts", "event_id")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    seconds = (_us(F.lead("ts").over(w)) - _us("ts")) / 1e6
    rows = events.withColumn("_gap", seconds).withColumn(
        "last_progress", F.last("progress", ignorenulls=True).over(past))
    return rows.filter(F.col("_gap") > idle).select(
        "stream_id", F.col("ts").alias("since"), F.floor(F.col("_gap") / idle).alias("beats"), "last_progress")


def idle_gaps_streaming(events: DataFrame, idle: float = IDLE_SECONDS, clock: DataFrame | None = None,
                        keep: float = KEEP_SECONDS, final: str | None = None, **run) -> DataFrame:
    """The same rows, and one for the silence that lasts: the heartbeats due until the clock.

    Events may come out of order within ``DELAY``. A stream is given up after ``keep`` seconds of silence or a ``final`` event.
    """
    told = run_available(stateful.process(stateful.timed(events, clock, DELAY), stateful.Silences(idle, keep, final),
                                          stateful.Silences.schema), "append", **run)
    return told.groupBy("stream_id", "since").agg(F.sum("beats").alias("beats"), F.max("last_progress").alias("last_progress"))


def heartbeats(events: DataFrame, idle: float = IDLE_SECONDS, final: str | None = None, most: int = 3600) -> DataFrame:
    """A stream of heartbeats by the wall clock (``stateful.Watch``), for a query that keeps running."""
    return stateful.process(events, stateful.Watch(idle, final, most), stateful.Watch.schema, time="ProcessingTime")


def until_complete(events: DataFrame, final: str) -> DataFrame:
    """Events up to and including the first ``final`` event of their stream."""
    ends = events.filter(F.col("event_type") == final).groupBy("stream_id").agg(
        F.min(F.struct("ts", "event_id")).alias("_end"))
    return events.join(ends, "stream_id", "left").filter(
        F.col("_end").isNull() | (F.struct("ts", "event_id") <= F.col("_end"))).drop("_end")


def until_complete_streaming(events: DataFrame, final: str, clock: DataFrame | None = None, keep: float = KEEP_SECONDS,
                             **run) -> DataFrame:
    """The same, in time order whatever order the events come in; a closed stream is forgotten after ``keep`` seconds."""
    out = stateful.process(stateful.timed(events, clock, DELAY), stateful.UntilFinal(final, keep), stateful.UntilFinal.schema)
    return run_available(out, "append", **run).drop("batch").select(*events.columns)


def agent_progress(events: DataFrame, gap: str = "1 day") -> DataFrame:
    """Per stream and session: start, end, seconds, agents started and completed, and progress
    30 + 60 * completed / started."""
    done = F.count_if(F.col("event_type") == "agent_complete")
    total = F.count_if(F.col("event_type") == "agent_start")
    grouped = events.groupBy("stream_id", F.session_window("ts", gap).alias("w")).agg(
        F.max("ts").alias("last_ts"), F.count("*").alias("n_events"), done.alias("completed"), total.alias("total"))
    seconds = (_us("last_ts") - _us("w.start")) / 1e6
    share = F.when(F.col("total") > 0, F.least(F.col("completed") / F.col("total"), F.lit(1.0))).otherwise(0.0)
    return grouped.select("stream_id", F.col("w.start").alias("started"), "last_ts", seconds.alias("seconds"), "n_events",
                          "completed", "total", (START_MARK + share * SPAN).alias("progress"))


def agent_progress_streaming(events: DataFrame, gap: str = "1 day", clock: DataFrame | None = None, **run) -> DataFrame:
    """The same sessions, each written once when the watermark has passed its end; its state goes with it."""
    timed = stateful.only_events(stateful.timed(events, clock, DELAY))
    return run_available(agent_progress(timed, gap), "append", **run).drop("batch")


def stage_durations(events: DataFrame) -> DataFrame:
    """Seconds from the first to the last event of every stage of a stream."""
    return events.groupBy("stream_id", "event_type").agg(
        ((_us(F.max("ts")) - _us(F.min("ts"))) / 1e6).alias("seconds"), F.count("*").alias("n_events"))


def stage_durations_streaming(events: DataFrame, clock: DataFrame | None = None, keep: float = KEEP_SECONDS, **run) -> DataFrame:
    """The same; a stage's state goes ``keep`` seconds after its last event, and what comes later is added up."""
    spans = run_available(stateful.process(stateful.timed(events, clock, DELAY), stateful.Span(keep), stateful.Span.schema,
                                           ("stream_id", "event_type")), "append", **run)
    return spans.groupBy("stream_id", "event_type").agg(
        ((F.max("last") - F.min("first")) / 1e6).alias("seconds"), F.sum("n").alias("n_events"))


def active_requests(events: DataFrame, seconds: int = EXPIRE_SECONDS, most: int = MOST_ACTIVE) -> DataFrame:
    """Requests active when each one starts (itself included), a request expiring after ``seconds``.

    Starts so far minus expiries so far, as a two-step running sum over time.
    """
    us = _us("ts")
    starts = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("step"), F.lit(1).alias("kind"))
    # a request leaves once it is older than the limit, so one exactly that old still counts
    ends = events.select("event_id", F.timestamp_micros(us + seconds * 1_000_000).alias("ts"), F.lit(-1).alias("step"),
                         F.lit(2).alias("kind"))
    total = running_sum(starts.unionByName(ends), "ts", ["kind", "event_id"], "step", "active")
    return total.filter("kind = 1").select("event_id", F.col("active").cast("long").alias("active"),
                                           (F.col("active") > most).alias("over_limit"))


def active_per_stream(events: DataFrame, seconds: int = EXPIRE_SECONDS) -> DataFrame:
    """The same count within each stream."""
    w = Window.partitionBy("stream_id").orderBy(_us("ts")).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("active", F.count("*").over(w)).select("event_id", "stream_id", "active")


def active_per_stream_streaming(events: DataFrame, seconds: int = EXPIRE_SECONDS, clock: DataFrame | None = None,
                                **run) -> DataFrame:
    """Keeps only the starts that have not expired, per stream; the last ones go by a timer."""
    out = stateful.process(stateful.timed(events, clock, DELAY), stateful.Active(seconds), stateful.Active.schema)
    return run_available(out, "append", **run).drop("batch")


def incremental_index(file_stream: DataFrame, to_chunks: Callable[[DataFrame], DataFrame], table: BucketTable,
                      folder: str) -> DataFrame:
    """Re-chunk arriving files and replace their rows in a stored table of chunks; returns the table.

    A micro-batch rewrites the buckets of its files and of the ids it brings, under its number, so that a repeated one changes
    nothing. A later call with the same ``folder`` goes on where the last one ended.
    """

    def write(batch: DataFrame, number: int) -> None:
        files = batch.select(F.col("path").alias("file_path"))
        table.merge(to_chunks(batch), ["file_path", "id"], {"file_path": files}, writer=folder, batch=number)

    run_available(file_stream, "append", write, folder)
    return table.read()
