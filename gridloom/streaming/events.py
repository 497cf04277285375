"""Operators on event streams. Each takes a streaming or a batch DataFrame of events (event_id, ts, user_id, event_type, value,
props); the state of the streaming forms is bounded by the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.keyed import first_rows, running
from .state import ms, with_state

#: Reasons why a telemetry event is dropped, in the order tried; fixed values.
MALFORMED, OUT_OF_RANGE = "malformed", "out_of_range"
K_MOST = 89


def publish_once(events: DataFrame, keys: list[str], ttl: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """The first event of each key in each ttl window; later ones are repeats. Streaming: repeats within the watermark go, whichever
    arrives first stays. Batch: the earliest by (ts, event_id)."""
    start = F.window("ts", ttl)["start"].alias("slot")
    rows = events.withColumn("slot", start)
    if events.isStreaming:
        return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark([*keys, "slot"])
    first = rows.groupBy(*keys, "slot").agg(F.min(F.struct("ts", "event_id")).alias("first"), F.count("*").alias("seen"))
    return first.select(*keys, "slot", "first.ts", "first.event_id", "seen")


def published(events: DataFrame, keys: list[str], ttl_seconds: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """keys, ts, event_id and first_id: the event that was published for it, itself or the one that its key published at most ttl_seconds before.
    The time runs from the published event, not from repeats.

    Batch: each key's events follow each other in one sorted partition and one row of state is held, as every decision needs the one before.
    Stream: the state of a key goes when its time is over."""
    kinds = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    out = f"{kinds}, ts {events.schema['ts'].dataType.simpleString()}, event_id long, first_id long"
    if events.isStreaming:

        def step(r, now):
            at = ms(r.ts)
            first = (now[1], now[2]) if now is not None and at < now[1] + ttl_seconds * 1000 else (at, int(r.event_id))
            return (max(at, now[0] if now is not None else at), *first), (*[getattr(r, k) for k in keys], r.ts, int(r.event_id), first[1])

        return with_state(events.select(*keys, "ts", "event_id"), keys, ["ts", "event_id"], out, "last_ms long, first_ms long, first_id long", step, ttl_seconds * 1000, delay)
    rows = events.select(*keys, "ts", "event_id").repartition(*keys).sortWithinPartitions(*keys, "ts", "event_id")
    # as text in Python, where whole numbers beside nulls would become floats
    text = rows.select(*[F.col(k).cast("string").alias(k) for k in keys], "ts", F.col("event_id").cast("string").alias("event_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at, first = None, None, None
        for batch in batches:
            firsts = []
            for key, ts, n in zip(zip(*[batch[k] for k in keys]), batch["ts"], batch["event_id"]):
                if key != held or ts >= at + pd.Timedelta(seconds=ttl_seconds):
                    held, at, first = key, ts, n
                firsts.append(first)
            yield batch.assign(first_id=firsts)

    made = text.mapInPandas(run, ", ".join([*[f"`{k}` string" for k in keys], f"ts {events.schema['ts'].dataType.simpleString()}, event_id string, first_id string"]))
    return made.select(*[F.col(k).cast(events.schema[k].dataType).alias(k) for k in keys], "ts", *[F.col(c).cast("long").alias(c) for c in ("event_id", "first_id")])


def window_counts(events: DataFrame, keys: list[str], width: str, limit: int, delay: str = "10 minutes") -> DataFrame:
    """keys, start, n, over: events in each fixed window, and how many go beyond the limit."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    n = rows.groupBy(*keys, F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return n.select(*keys, F.col("w.start").alias("start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("over"))


def telemetry(events: DataFrame) -> DataFrame:
    """events with k (the number in props) and cause: null where accepted. Nothing is dropped here; counts tell."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    cause = F.when(k.isNull(), MALFORMED).when((k < 0) | (k > K_MOST), OUT_OF_RANGE)
    return events.withColumns({"k": k, "cause": cause})


def after(events: DataFrame, ts: Column, event_id: int) -> DataFrame:
    """Events strictly after a place in the order (ts, event_id)."""
    return events.where((F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("event_id") > event_id)))


def late_points(events: DataFrame, keys: list[str], delay: str = "10 minutes", quiet_seconds: int = 86_400) -> DataFrame:
    """events in order of arrival (event_id) with seen, the latest ts that arrived before of the key, and is_late: not after it.

    Stream: keys, ts, event_id, seen, is_late; a key that is quiet for quiet_seconds begins anew."""
    if events.isStreaming:
        kinds = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
        out = f"{kinds}, ts {events.schema['ts'].dataType.simpleString()}, event_id long, seen {events.schema['ts'].dataType.simpleString()}, is_late boolean"

        def step(r, now):
            at = ms(r.ts)
            seen = pd.Timestamp(now[0], unit="ms") if now is not None else pd.NaT
            return (max(at, now[0]) if now is not None else at,), (*[getattr(r, k) for k in keys], r.ts, int(r.event_id), seen, now is not None and at <= now[0])

        return with_state(events.select(*keys, "ts", "event_id"), keys, ["event_id"], out, "last_ms long", step, quiet_seconds * 1000, delay)
    out = running(events, keys, F.floor(F.col("event_id") / 1000), [F.asc("event_id")], F.col("ts"), "max", "seen")
    return out.withColumn("is_late", F.coalesce(F.col("ts") <= F.col("seen"), F.lit(False)))


def metric_points(points: DataFrame, job: str, split: str, step: str, sent: str, now: Column, own: Column, most: int) -> DataFrame:
    """Points that are stored: those of the job's own measure, once for each (job, split, step), the first most of a job by arrival (event_id), with
    recorded_at (not after now) and is_late: a step not beyond those of its split that arrived before. Late points stay."""
    rows = points.where(F.coalesce(own, F.lit(False)))
    once = first_rows(rows, [job, split, step], [F.asc("event_id")], 1).drop("rank")
    kept = first_rows(once, [job], [F.asc("event_id")], most).drop("rank")
    out = running(kept, [job, split], F.floor(F.col("event_id") / 1000), [F.asc("event_id")], F.col(step), "max", "before")
    late = F.coalesce(F.col(step) <= F.col("before"), F.lit(False))
    return out.withColumns({"recorded_at": F.least(F.col(sent), now), "is_late": late}).drop("before")


#: The version of an envelope and the events that it may have; fixed values.
ENVELOPE, MOST_EVENTS = 1, 20


def envelopes(bodies: DataFrame, names: list[str]) -> DataFrame:
    """batch, outcome, n of JSON bodies (batch, body): a body that is no envelope, of another version or with too many events is rejected whole
    (n 1); of the others each event counts by its own outcome: malformed, unknown or accepted."""
    kind = "schemaVersion int, sessionId string, events array<struct<sequence: long, atMs: long, event: struct<name: string>>>"
    read = bodies.select("batch", F.from_json("body", kind).alias("b"))
    fault = F.when(F.col("b").isNull() | F.col("b.events").isNull() | F.col("b.sessionId").isNull(), "not_an_envelope").when(F.col("b.schemaVersion") != ENVELOPE, "version").when(F.size("b.events") > MOST_EVENTS, "too_many")
    read = read.withColumn("fault", fault)
    whole = read.where("fault is not null").select("batch", F.col("fault").alias("outcome"))
    each = read.where("fault is null").select("batch", F.explode("b.events").alias("e"))
    outcome = F.when(F.col("e.sequence").isNull() | F.col("e.atMs").isNull() | F.col("e.event.name").isNull(), MALFORMED).when(~F.col("e.event.name").isin(names), "unknown").otherwise("accepted")
    return whole.unionByName(each.select("batch", outcome.alias("outcome"))).groupBy("batch", "outcome").agg(F.count("*").alias("n"))


def monotone_progress(beats: DataFrame, key: str, delay: str = "10 minutes", quiet_seconds: int = 3600) -> DataFrame:
    """The furthest epoch and the last beat of each job, whatever order its beats (key, ts, epoch, final) arrive in: a final beat
    settles the epoch.

    Stream: a row for each beat that moves its job on; a job that is quiet for quiet_seconds is forgotten."""
    if beats.isStreaming:
        out = f"{key} {beats.schema[key].dataType.simpleString()}, epoch long, last_beat {beats.schema['ts'].dataType.simpleString()}, final boolean"

        def step(r, now):
            last, epoch, final = now if now is not None else (0, -1, False)
            ends = bool(r.final)
            further = not final and (ends or int(r.epoch) > epoch)
            state = (max(last, ms(r.ts)), int(r.epoch) if further else epoch, final or ends)
            return state, (getattr(r, key), state[1], pd.Timestamp(state[0], unit="ms"), state[2]) if further else None

        return with_state(beats.select(key, "ts", "epoch", "final"), [key], ["ts"], out, "last_ms long, epoch long, final boolean", step, quiet_seconds * 1000, delay)
    settled = F.max(F.when(F.col("final"), F.col("epoch")))
    return beats.groupBy(key).agg(F.coalesce(settled, F.max("epoch")).alias("epoch"), F.max("ts").alias("last_beat"), F.max("final").alias("final"))


def silent(jobs: DataFrame, started: str, beat: str, cutoff: Column) -> DataFrame:
    """Jobs without a beat since the cutoff; those that never beat count from their start."""
    return jobs.where(F.coalesce(beat, started) < cutoff)

