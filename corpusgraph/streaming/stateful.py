"""Keyed state with timers over progress events: rows in event-time order, silences, expiry, retention.

All processors here follow the watermark: what a stream still keeps goes by a timer, without a further event of that stream.
A clock (``tick`` or Spark's rate source) moves the watermark on when no events come at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusgraph.session import run_dir

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What is known of a waiting event.
_EVENT = "us long, event_id long, event_type string, message string, progress double"


def tick(spark: SparkSession, at) -> DataFrame:
    """A stream of one clock row at the timestamp ``at`` (a column or a value)."""
    path = run_dir(spark, "clock")
    spark.range(1).select(F.lit(at).cast("timestamp").alias("ts")).write.parquet(path)
    return spark.readStream.schema("ts timestamp").parquet(path)


def timed(events: DataFrame, clock: DataFrame | None = None, delay: str = "1 hour") -> DataFrame:
    """``events`` under a watermark that the rows of ``clock`` (ts) move on too; clock rows have no stream_id."""
    if clock is not None:
        events = events.unionByName(clock.select("ts"), allowMissingColumns=True)
    return events.withWatermark("ts", delay)


def only_events(timed_events: DataFrame) -> DataFrame:
    """Without the clock's rows; the condition reads ``ts``, so that it isn't moved below the watermark."""
    return timed_events.filter(F.when(F.col("stream_id").isNotNull(), F.col("ts")).isNotNull())


def process(events: DataFrame, processor: StatefulProcessor, schema: str, keys: tuple[str, ...] = ("stream_id",),
            time: str = "EventTime") -> DataFrame:
    """Rows of a processor over ``events`` (of ``timed``, for event time)."""
    rows = events.select(*keys, *[c for c in ("ts", "event_id", "event_type", "message", "progress") if c not in keys])
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", time)


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy("datetime64[us]").astype(np.int64)


def _times(us) -> pd.Series:
    return pd.Series(np.asarray(us, np.int64).astype("datetime64[us]"))


def _ms(us: int) -> int:
    """The first millisecond that is not before ``us``."""
    return -(-us // 1000)


class InOrder(StatefulProcessor):
    """Hands a key's events to ``step`` in time order, once the watermark has passed them; equal times by event_id.

    ``step(key, ready, held, now)`` gets a frame of ready events (it may be empty: only time has passed), what it held (a tuple of
    ``held`` or None) and the watermark in microseconds; it returns its rows (or None), what to hold on (None: nothing) and
    when it wants to be called again without an event (microseconds or None).
    """

    held = "nothing boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT)
        self.kept = handle.getValueState("kept", self.held)

    def step(self, key, ready: pd.DataFrame, held: tuple | None, now: int):
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        new = pd.concat(list(rows), ignore_index=True)
        us = _micros(new["ts"])
        event_type, message = (new[c].where(new[c].notna(), None).tolist() if c in new else [None] * len(new)
                               for c in ("event_type", "message"))
        progress = [None if pd.isna(x) else float(x) for x in new["progress"]]
        # a batch with clock rows has ids as floats
        self.waiting.appendList(list(zip(us.tolist(), new["event_id"].astype("int64").tolist(), event_type, message, progress)))
        self.handle.registerTimer(_ms(int(us.min())))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get(), key=lambda r: r[:2]) if self.waiting.exists() else []
        n = sum(r[0] <= now for r in waiting)
        if n and n < len(waiting):
            self.waiting.put(waiting[n:])
        elif n:
            self.waiting.clear()
        ready = pd.DataFrame(waiting[:n], columns=["us", "event_id", "event_type", "message", "progress"])
        out, held, again = self.step(key, ready, self.kept.get() if self.kept.exists() else None, now)
        if held is None:
            self.kept.clear()
        else:
            self.kept.update(held)
        for at in [*([waiting[n][0]] if n < len(waiting) else []), *([again] if again is not None else [])]:
            self.handle.registerTimer(max(_ms(at), now // 1000 + 1))
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


class Silences(InOrder):
    """Heartbeats due while a stream is silent: since when, how many new ones, last progress.

    They are reported as time passes, also behind the last event; rows of one silence add up. After ``give_up`` seconds, or
    at an event of type ``final``, the stream is forgotten.
    """

    held = "last long, told long, progress double"
    schema = "stream_id string, since timestamp, beats long, last_progress double"

    def __init__(self, idle: float, give_up: float, final: str | None = None):
        self.idle, self.give_up, self.final = round(idle * 1e6), round(give_up * 1e6), final

    def step(self, key, ready, held, now):
        told, progress, us = 0, None, ready["us"].to_numpy(np.int64)
        if held is not None:
            told, progress, us = held[1], held[2], np.r_[held[0], us]
        seen = pd.Series([*([progress] if held is not None else []), *ready["progress"]], dtype=float).ffill().to_numpy()
        ends = self.final is not None and (ready["event_type"] == self.final).any()
        if ends:
            stop = len(us) - len(ready) + int((ready["event_type"] == self.final).to_numpy().argmax()) + 1
            us, seen = us[:stop], seen[:stop]
        # a silence ends with the next event; the last one goes on until now, unless the stream has ended
        until = np.r_[us[1:], us[-1] if ends else max(now, us[-1])] if len(us) else us
        gap = np.minimum(until - us, self.give_up)
        beats = np.where(gap > self.idle, gap // self.idle, 0)
        if len(us) and not ends and gap[-1] < self.give_up and gap[-1] >= self.idle and gap[-1] % self.idle == 0:
            beats[-1] = gap[-1] // self.idle - 1  # due only once it has passed
        new = beats.copy()
        if held is not None and len(new):
            new[0] -= told
        use = new > 0
        out = pd.DataFrame({"stream_id": key[0], "since": _times(us[use]), "beats": new[use], "last_progress": seen[use]})
        if not len(us) or ends or gap[-1] >= self.give_up:
            return out, None, None
        last, told = int(us[-1]), int(beats[-1])
        progress = None if np.isnan(seen[-1]) else float(seen[-1])
        return out, (last, told, progress), last + min((told + 1) * self.idle + 1, self.give_up)


class UntilFinal(InOrder):
    """Events up to the first ``final`` one. A closed stream is remembered for ``keep`` seconds; an open one holds no state."""

    held = "closed long"
    schema = "event_id long, stream_id string, event_type string, ts timestamp, message string, progress double"

    def __init__(self, final: str, keep: float):
        self.final, self.keep = final, round(keep * 1e6)

    def step(self, key, ready, held, now):
        if held is not None:
            forget = held[0] + self.keep
            return None, (held if now < forget else None), (forget if now < forget else None)
        ends = (ready["event_type"] == self.final).to_numpy()
        if ends.any():
            ready = ready.iloc[:ends.argmax() + 1]
        out = pd.DataFrame({"event_id": ready["event_id"], "stream_id": key[0], "event_type": ready["event_type"],
                            "ts": _times(ready["us"]), "message": ready["message"], "progress": ready["progress"].astype(float)})
        if not ends.any():
            return out, None, None
        closed = int(ready["us"].iloc[-1])
        return out, ((closed,) if now < closed + self.keep else None), (closed + self.keep if now < closed + self.keep else None)


class Active(InOrder):
    """Starts of the last ``seconds`` at each start. A stream's state goes when its last start expires."""

    held = "live array<long>"
    schema = "event_id long, stream_id string, active long"

    def __init__(self, seconds: float):
        self.limit = round(seconds * 1e6)

    def step(self, key, ready, held, now):
        new = ready["us"].to_numpy(np.int64)
        starts = np.r_[np.array(held[0] if held is not None else [], np.int64), new]
        active = np.searchsorted(starts, new, "right") - np.searchsorted(starts, new - self.limit, "left")
        out = pd.DataFrame({"event_id": ready["event_id"], "stream_id": key[0], "active": active})
        # a later event is after the watermark
        live = starts[starts + self.limit > now]
        return out, ((live.tolist(),) if len(live) else None), (int(live[-1]) + self.limit if len(live) else None)


class Retained(StatefulProcessor):
    """One aggregate for each key that is dropped ``keep`` seconds after the key's newest event; needs no order."""

    def __init__(self, keep: float):
        self.keep = round(keep * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.held)

    def add(self, old: tuple | None, us: np.ndarray, rows: pd.DataFrame) -> tuple | None:
        """The new value, whose first item is the newest event's time in microseconds."""
        raise NotImplementedError

    def changed(self, key, old: tuple | None, new: tuple) -> pd.DataFrame | None:
        return None

    def leaves(self, key, value: tuple) -> pd.DataFrame | None:
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        new = pd.concat(list(rows), ignore_index=True)
        old = self.value.get() if self.value.exists() else None
        value = self.add(old, _micros(new["ts"]), new)
        if value is None or value == old:
            return
        self.value.update(value)
        if old is None:
            self.handle.registerTimer(_ms(value[0] + self.keep))
        out = self.changed(key, old, value)
        if out is not None:
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value = self.value.get()
        now = timerValues.getCurrentWatermarkInMs()
        if _ms(value[0] + self.keep) > now:  # newer events have come since
            self.handle.registerTimer(_ms(value[0] + self.keep))
            return
        self.value.clear()
        out = self.leaves(key, value)
        if out is not None:
            yield out

    def close(self) -> None:
        pass


class Status(Retained):
    """The status of a stream whenever a newer event with progress changes it."""

    held = "us long, event_id long, event_type string, message string, progress double"
    schema = "stream_id string, event_type string, message string, progress double, ts timestamp, event_id long"

    def add(self, old, us, rows):
        known = rows["progress"].notna().to_numpy()
        if not known.any():
            return old
        at = np.flatnonzero(known)
        last = at[np.lexsort((rows["event_id"].to_numpy()[at], us[at]))[-1]]
        r = rows.iloc[last]
        new = (int(us[last]), int(r["event_id"]), r["event_type"], r["message"], float(r["progress"]))
        return new if old is None or new[:2] > tuple(old[:2]) else old

    def changed(self, key, old, new):
        return pd.DataFrame({"stream_id": [key[0]], "event_type": [new[2]], "message": [new[3]], "progress": [new[4]],
                             "ts": _times([new[0]]), "event_id": [new[1]]})


class Span(Retained):
    """First and last event and their number, of each key, when the key leaves."""

    held = "last long, first long, n long"
    schema = "stream_id string, event_type string, first long, last long, n long"

    def add(self, old, us, rows):
        last, first, n = old if old is not None else (int(us.max()), int(us.min()), 0)
        return max(last, int(us.max())), min(first, int(us.min())), n + len(us)

    def leaves(self, key, value):
        return pd.DataFrame({"stream_id": [key[0]], "event_type": [key[1]], "first": [value[1]], "last": [value[0]], "n": [value[2]]})


class Watch(StatefulProcessor):
    """Heartbeats by the wall clock: one row for each ``idle`` seconds in which a stream stays silent, with its last progress.

    A stream is watched from its first event to its ``final`` one, at most for ``most`` heartbeats in a row. Late events end a
    silence too, but the newest event's progress counts.
    """

    schema = "stream_id string, since timestamp, beat long, last_progress double"

    def __init__(self, idle: float, final: str | None = None, most: int = 3600):
        self.idle, self.final, self.most = round(idle * 1000), final, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, told long, progress double, known long")

    def _restart(self, now: int | None) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if now is not None:
            self.handle.registerTimer(now + self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        if self.final is not None and (new["event_type"] == self.final).any():
            self.seen.clear()
            self._restart(None)
            return
        us = _micros(new["ts"])
        last, _, progress, known = self.seen.get() if self.seen.exists() else (None, 0, None, None)
        has = np.flatnonzero(new["progress"].notna().to_numpy())
        if len(has):
            newest = has[np.argmax(us[has])]
            if known is None or us[newest] >= known:
                known, progress = int(us[newest]), float(new["progress"].iloc[newest])
        self.seen.update((max(int(us.max()), last or 0), 0, progress, known))
        self._restart(timerValues.getCurrentProcessingTimeInMs())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, told, progress, known = self.seen.get()
        if told + 1 < self.most:
            self.seen.update((last, told + 1, progress, known))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        else:
            self.seen.clear()
        yield pd.DataFrame({"stream_id": [key[0]], "since": _times([last]), "beat": [told + 1],
                            "last_progress": pd.Series([progress], dtype=float)})

    def close(self) -> None:
        pass
