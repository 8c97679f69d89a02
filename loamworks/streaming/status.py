"""Status streams: readiness from progress events, idle sessions, registrations and request pairs; each works on a stream and on a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_completion(events: DataFrame, key: str, kind: str = "event_type", end: str = "end", ts: str = "ts") -> DataFrame:
    """When each key completed: its first end event; later ones do not change it."""
    return events.filter(F.col(kind) == end).groupBy(key).agg(F.min(ts).alias("completed_at"), F.count("*").alias("n_end"))


def percent(value):
    """Progress held to 0..100."""
    return F.greatest(F.least(value, F.lit(100)), F.lit(0))


def idle_sessions(events: DataFrame, key: str, minutes: int = 15, ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after so many idle minutes; on a stream, by watermark."""
    d = events.withWatermark(ts, watermark) if events.isStreaming else events
    return d.groupBy(F.session_window(ts, f"{minutes} minutes"), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def evictable(last_used: DataFrame, now, minutes: int = 15) -> DataFrame:
    """Rows (last_used, in_flight) unused for longer than the limit and with nothing in flight."""
    return last_used.filter((F.col("last_used") < F.lit(now) - F.expr(f"interval {minutes} minutes")) & (F.col("in_flight") == 0))


def request_pairs(requests: DataFrame, responses: DataFrame, key: str = "id", seconds: int = 10, ts: str = "ts") -> DataFrame:
    """Every request with the response of its id within the time bound, and its ``outcome``: answered, cancelled (the response says so) or timed_out (there is none). On streams both sides have watermarks, so state is dropped and a request times out when the watermark passes its bound."""
    q, r = requests.withColumnRenamed(ts, "sent"), responses.withColumnRenamed(ts, "answered").withColumnRenamed(key, "_id")
    if requests.isStreaming:
        q, r = q.withWatermark("sent", f"{seconds} seconds"), r.withWatermark("answered", f"{seconds} seconds")
    both = q.join(r, (F.col(key) == F.col("_id")) & (F.col("answered") >= F.col("sent")) & (F.col("answered") <= F.col("sent") + F.expr(f"interval {seconds} seconds")), "left_outer")
    gone = F.coalesce(F.col("cancelled"), F.lit(False)) if "cancelled" in responses.columns else F.lit(False)
    return both.withColumn("outcome", F.when(F.col("_id").isNull(), "timed_out").when(gone, "cancelled").otherwise("answered")).drop("_id")


def registrations(events: DataFrame, key: str = "id", ts: str = "ts") -> DataFrame:
    """Whether each registration holds: the last of its register and unregister events; those given from the start never end."""
    last = F.max_by(F.col("action"), F.struct(F.col(ts), F.col("action")))
    return events.groupBy(key).agg(F.bool_or(F.col("static")).alias("static"), last.alias("last")).select(key, (F.col("static") | (F.col("last") == "register")).alias("active"))


def lagged(events: DataFrame, key: str, capacity: int = 64) -> DataFrame:
    """How many events of each key a bounded channel keeps, its last ``capacity``, and how many it dropped; counted, not sorted."""
    d = events.groupBy(key).agg(F.count("*").alias("n"))
    return d.select(key, F.least("n", F.lit(capacity)).alias("kept"), F.greatest(F.col("n") - capacity, F.lit(0)).alias("dropped"))


# Seconds of silence after which a language counts as ready.
TIMEOUTS = {"java": 120, "rust": 60, "typescript": 45, "javascript": 45, "go": 30, "python": 30}
READINESS = "key string, percent int, complete boolean, by_timeout boolean"
_STATE = "percent int, complete boolean, by_timeout boolean"


def readiness(events: DataFrame, seconds: int = 30, timeouts: dict[str, int] = TIMEOUTS):
    """A stream of (key, kind, percent, ts) as states: report sets the percent, end completes once, and silence of the key's ``timeouts``, else of ``seconds`` (event time), completes by timeout; an end after that changes nothing."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        wait = timeouts.get(key[0], seconds) * 1000
        now = state.get if state.exists else (0, False, False)
        if state.hasTimedOut:
            now = (now[0], True, True) if not now[1] else now
            state.update(now)
        else:
            latest = 0
            for b in batches:
                for kind, value, ts in zip(b["kind"], b["percent"], b["ts"], strict=True):
                    latest = max(latest, int(pd.Timestamp(ts).timestamp() * 1000))
                    if kind == "report" and not now[1]:
                        now = (max(0, min(100, int(value or 0))), False, False)
                    elif kind == "end" and not now[1]:
                        now = (100, True, False)
            state.update(now)
            if not now[1]:
                state.setTimeoutTimestamp(max(latest + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *now)], columns=["key", "percent", "complete", "by_timeout"])

    return events.withWatermark("ts", "0 seconds").groupBy("key").applyInPandasWithState(step, READINESS, _STATE, "update", "EventTimeTimeout")


CHANNEL = "key string, kept int, dropped long, held array<string>"


def channel(events: DataFrame, capacity: int = 64) -> DataFrame:
    """A stream of (key, value, ts) as the state of each key's bounded channel: its last ``capacity`` values in order of arrival, how many it keeps and how many it dropped. The state is the ring itself, of bounded size."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ring, dropped = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for b in batches:
            new = b.sort_values(["ts", "value"], kind="stable")["value"].tolist()
            dropped += max(0, len(ring) + len(new) - capacity)
            ring = [*ring, *new][-capacity:]
        state.update((ring, dropped))
        yield pd.DataFrame([(key[0], len(ring), dropped, ring)], columns=["key", "kept", "dropped", "held"])

    return events.groupBy("key").applyInPandasWithState(step, CHANNEL, "ring array<string>, dropped long", "update", "NoTimeout")


def registered(events: DataFrame) -> DataFrame:
    """A stream of (id, action, static, ts) as whether each registration holds, by the last action in event time; a late event does not undo a newer one, and what was given from the start never ends."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        given, at, action = state.get if state.exists else (False, -1, "")
        for b in batches:
            for what, static, ts in zip(b["action"], b["static"], b["ts"], strict=True):
                given = given or bool(static)
                at, action = max((at, action), (pd.Timestamp(ts).value // 1000, what or ""))
        state.update((given, at, action))
        yield pd.DataFrame([(key[0], given or action == "register")], columns=["id", "active"])

    return events.groupBy("id").applyInPandasWithState(step, "id string, active boolean", "given boolean, at long, action string", "update", "NoTimeout")


def probes(events: DataFrame, seconds: int = 300) -> DataFrame:
    """A stream of probe results (key, ok, ts) as a cache whose entries end ``seconds`` after their last probe: key, ok, valid. When the watermark passes an entry's end its state goes, and a row tells that it is no longer valid."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ok, _ = state.get
            state.remove()
            yield pd.DataFrame([(key[0], ok, False)], columns=["key", "ok", "valid"])
            return
        ok, at = state.get if state.exists else (False, -1)
        for b in batches:
            for value, ts in zip(b["ok"], b["ts"], strict=True):
                at, ok = max((at, ok), (pd.Timestamp(ts).value // 1_000_000, bool(value)))
        if at + seconds * 1000 <= state.getCurrentWatermarkMs():  # all of it came too late to be valid
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], ok, False)], columns=["key", "ok", "valid"])
            return
        state.update((ok, at))
        state.setTimeoutTimestamp(at + seconds * 1000)
        yield pd.DataFrame([(key[0], ok, True)], columns=["key", "ok", "valid"])

    return events.withWatermark("ts", "0 seconds").groupBy("key").applyInPandasWithState(step, "key string, ok boolean, valid boolean", "ok boolean, at long", "update", "EventTimeTimeout")
