"""Streaming forms against batch forms and plain loops, over files read in several batches."""

import datetime as dt
import random

import pytest

from gridloom.streaming import events

T0 = dt.datetime(2024, 1, 1)


def streamed(spark, rows, schema, tmp_path, operator, name):
    """operator over the rows, a file and batch for each part, collected from a memory table."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    source = f"{tmp_path}/in*"
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in0").schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = operator(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


@pytest.fixture(scope="module")
def beats():
    rng = random.Random(3)
    rows = [(i, T0 + dt.timedelta(minutes=i * 7 + rng.randrange(40)), rng.randrange(3)) for i in range(90)]
    return [rows[:30], rows[30:60], rows[60:]]


def plain_published(rows, ttl):
    at, out = {}, {}
    for n, ts, user in sorted(rows, key=lambda r: (r[1], r[0])):
        if user not in at or ts >= at[user][0] + ttl:
            at[user] = (ts, n)
        out[n] = at[user][1]
    return out


def test_published_batch(spark, beats):
    rows = [r for part in beats for r in part]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    got = {r["event_id"]: r["first_id"] for r in events.published(df, ["user_id"], 7200).collect()}
    assert got == plain_published(rows, dt.timedelta(hours=2)) and 10 < len(set(got.values())) < 80


def test_published_stream(spark, beats, tmp_path):
    rows = [sorted(part, key=lambda r: r[1]) for part in beats]
    whole = sorted((r for p in rows for r in p), key=lambda r: r[1])
    parts = [whole[:30], whole[30:60], whole[60:]]
    got = streamed(spark, parts, "event_id long, ts timestamp, user_id long", tmp_path, lambda s: events.published(s, ["user_id"], 7200), "published")
    assert {r["event_id"]: r["first_id"] for r in got} == plain_published(whole, dt.timedelta(hours=2))


def test_late_points_stream(spark, beats, tmp_path):
    got = streamed(spark, beats, "event_id long, ts timestamp, user_id long", tmp_path, lambda s: events.late_points(s, ["user_id"]), "late")
    seen, want = {}, {}
    for n, ts, user in (r for part in beats for r in part):
        want[n] = user in seen and ts <= seen[user]
        seen[user] = max(ts, seen.get(user, ts))
    assert {r["event_id"]: r["is_late"] for r in got} == want and any(want.values())


def test_progress_stream(spark, tmp_path):
    beats = [(1, T0, 1, False), (2, T0, 5, False), (1, T0 + dt.timedelta(minutes=5), 3, False)], [(1, T0 + dt.timedelta(minutes=3), 2, False), (2, T0 + dt.timedelta(minutes=9), 4, True)], [(2, T0 + dt.timedelta(minutes=12), 9, False), (1, T0 + dt.timedelta(minutes=14), 4, False)]
    schema = "job long, ts timestamp, epoch long, final boolean"
    got = streamed(spark, list(beats), schema, tmp_path, lambda s: events.monotone_progress(s, "job"), "progress")
    last = {}
    for r in got:
        last.setdefault(r["job"], []).append((r["epoch"], r["final"]))
    assert last == {1: [(1, False), (3, False), (4, False)], 2: [(5, False), (4, True)]}
    batch = events.monotone_progress(spark.createDataFrame([b for p in beats for b in p], schema), "job").collect()
    assert {r["job"]: (r["epoch"], r["final"]) for r in batch} == {1: (4, False), 2: (4, True)}


def test_axis_shares(spark):
    """Pairs of direction families by their definition: every pair of middles, each bin once."""
    import numpy as np

    from gridloom.operators import stats

    rng = np.random.default_rng(9)
    rings = {"spread": rng.random(900), "two": np.zeros(900), "round": np.zeros(900), "near": np.zeros(900), "none": np.zeros(900)}
    rings["two"][[10, 50, 455, 700]] = (3, 2, 4, 1)
    rings["round"][[895, 5, 60, 100]] = (1, 2, 3, 1)
    rings["near"][[100, 181, 182, 261, 262]] = (1, 1, 1, 1, 1)
    rows = [(k, b, float(w)) for k, ring in rings.items() for b, w in enumerate(ring) if w or (k == "none" and b < 2)] + [("two", None, 5.0)]
    got = {r["k"]: r["share"] for r in stats.axis_shares(spark.createDataFrame(rows, "k string, b long, w double"), ["k"], "b", "w").collect()}
    for k, ring in rings.items():
        inside = np.array([[min((i - b) % 900, (b - i) % 900) <= 40 for b in range(900)] for i in range(900)])
        best = max(float(((inside[i] | inside) * ring).sum(axis=1).max()) for i in range(900))
        assert abs(got[k] - (best / ring.sum() if ring.sum() else 1.0)) < 1e-9, k


def test_published_beside_nulls(spark):
    """Null keys are one key, and large numbers stay whole."""
    import datetime

    from gridloom.streaming import events

    big, at = (1 << 60) + 1, lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=n)
    rows = [(big, at(0), big + 4), (big, at(5), 2), (big + 2, at(6), 3), (None, at(0), 4), (None, at(7), 5), (None, at(70), 6)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, event_id long").coalesce(1)
    got = {(r["k"], r["event_id"], r["first_id"]) for r in events.published(df, ["k"], 60).collect()}
    assert got == {(big, big + 4, big + 4), (big, 2, big + 4), (big + 2, 3, 3), (None, 4, 4), (None, 5, 4), (None, 6, 6)}
