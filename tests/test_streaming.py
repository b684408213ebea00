"""Streams against their batch form: micro-batches out of order, late rows, restarts, state that leaves, wall-clock timers."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from corpusgraph.session import run_dir
from corpusgraph.streaming import progress as P
from corpusgraph.streaming import stateful as S

START = dt.datetime(2024, 5, 1)
SCHEMA = "event_id long, stream_id string, event_type string, ts timestamp, message string, progress double"
CLOCK = START + dt.timedelta(days=400)


def event(i, stream, minute, kind="log", progress=None):
    return i, stream, kind, START + dt.timedelta(minutes=minute), f"m{i}", progress


#: Three micro-batches; within one and between them events come up to 40 minutes out of order.
BATCHES = [
    [event(1, "a", 0, "agent_start", 1.0), event(3, "a", 20), event(2, "a", 10, "agent_start"), event(4, "b", 5, "log", 3.0),
     event(5, "b", 200, "log", 4.0)],
    [event(7, "b", 170, "agent_start"), event(6, "a", 190, "agent_complete", 9.0), event(8, "a", 191, "log", 8.0),
     event(9, "b", 400, "log", 5.0)],
    [event(10, "b", 380, "agent_complete"), event(11, "c", 500, "log", 7.0), event(12, "b", 470, "log", 6.0),
     event(13, "c", 500, "log")],
]
LATE = event(99, "a", 1, "agent_complete", 99.0)  # hours behind the watermark


@pytest.fixture(scope="module")
def feed(spark):
    """(stream over one file for each micro-batch, function that adds a micro-batch)."""

    def make(batches):
        folder = run_dir(spark, "feed")

        def add(rows):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            time.sleep(1.1)  # files are read in the order of their times, which have seconds

        for b in batches:
            add(b)
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), add

    return make


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


FORMS = {
    "status": (P.stream_status, P.stream_status_streaming),
    "until": (lambda e: P.until_complete(e, "agent_complete"), lambda e, **r: P.until_complete_streaming(e, "agent_complete", **r)),
    "agents": (lambda e: P.agent_progress(e, "2 hours"), lambda e, **r: P.agent_progress_streaming(e, "2 hours", **r)),
    "stages": (P.stage_durations, P.stage_durations_streaming),
    "active": (lambda e: P.active_per_stream(e, 3600), lambda e, **r: P.active_per_stream_streaming(e, 3600, **r)),
}


@pytest.mark.parametrize("form", FORMS)
def test_stream_equals_batch(spark, feed, form):
    batch, stream = FORMS[form]
    want = rows(batch(spark.createDataFrame([r for b in BATCHES for r in b], SCHEMA)))
    source, add = feed(BATCHES[:2])
    folder = run_dir(spark, "query")
    stream(source, folder=folder)  # stops, and goes on where it was with what has come since
    add(BATCHES[2])
    add([LATE])
    stream(source, folder=folder)
    reports: list = []
    add([event(0, None, 400 * 1440)])  # the clock
    got = stream(source, folder=folder, reports=reports)
    assert rows(got.select(*batch(spark.createDataFrame([], SCHEMA)).columns)) == want
    # behind the last event and its keeping time nothing is left
    assert reports[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_silences_out_of_order(spark, feed):
    source, add = feed([*BATCHES, [LATE], [event(0, None, 400 * 1440)]])
    got = P.idle_gaps_streaming(source, 3600.0, keep=86400.0)
    every = [r for b in BATCHES for r in b]
    gaps = rows(P.idle_gaps(spark.createDataFrame(every, SCHEMA), 3600.0))
    last = {s: max(r[3] for r in every if r[1] == s) for s in "abc"}
    known = {"a": 8.0, "b": 6.0, "c": 7.0}
    assert rows(got) == sorted(gaps + [(24, known[s], t, s) for s, t in last.items()], key=str)


def test_silence_until_the_clock_and_final_event(spark, feed):
    source, add = feed([[event(1, "a", 0, "log", 1.0), event(2, "b", 0, "agent_complete", 2.0)], [event(0, None, 60 + 185)]])
    got = P.idle_gaps_streaming(source, 3600.0, final="agent_complete")
    # the watermark is an hour behind the clock; b has ended
    assert rows(got) == [(3, 1.0, START, "a")]


def test_heartbeats_by_the_wall_clock(spark, feed):
    source, add = feed([[event(1, "a", 0, "log", 5.0), event(2, "b", 0, "log", 6.0)]])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.PROVIDER)
    query = (P.heartbeats(source, 1.0, "agent_complete", most=500).writeStream.format("memory").queryName("beats")
             .option("checkpointLocation", run_dir(spark, "commits")).trigger(processingTime="300 milliseconds").start())
    try:
        def beats(stream, more=0):
            end = time.time() + 60
            while time.time() < end:
                found = spark.table("beats").filter(F.col("stream_id") == stream).count()
                if found > more:
                    return found
                time.sleep(0.3)
            raise AssertionError("no heartbeat")

        beats("a"), beats("b")
        add([event(3, "b", 1, "agent_complete")])
        add([event(4, "a", -100, "log", 4.0)])  # a late event: the newest one's progress stays
        time.sleep(4)
        ended, going = spark.table("beats").filter("stream_id = 'b'").count(), spark.table("beats").filter("stream_id = 'a'").count()
        beats("a", going + 1)  # nothing comes any more, and the silence is still told
        assert spark.table("beats").filter("stream_id = 'b'").count() == ended
        told = spark.table("beats").filter("stream_id = 'a'").collect()
        assert {r.last_progress for r in told} == {5.0} and {r.since for r in told} == {START}
        assert 1 in [r.beat for r in told][1:]  # the late event started the silence anew
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
