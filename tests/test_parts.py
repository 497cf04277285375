"""Operators and functions on small tables, with the odd cases that the driver's tables lack."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry, text
from gridloom.operators import boxes, changes, log, scale, spatial, stats
from gridloom.sources import tables
from gridloom.streaming import events

T0 = datetime.datetime(2024, 1, 1, 12)


def minutes(n):
    return T0 + datetime.timedelta(minutes=n)


def test_lengths(spark):
    #: What each text means in mm.
    wanted = {"3000": 3000, "3 000mm": 3000, "3.5m": 3500, "3,5 m": 3500, "3.500": 3500, "1,234.5": 1234.5, "1.234,5": 1234.5, "12cm": 120, "door": None, "": None}
    got = spark.createDataFrame([(k,) for k in wanted], "t string").select("t", text.length_mm(F.col("t")).cast("double").alias("mm")).collect()
    assert {r.t: r.mm for r in got} == wanted


def test_outlines(spark):
    square = [(0, 0), (2000, 0), (2000, 1000), (0, 1000)]
    turned = square[::-1]
    concave = [(0, 0), (3000, 0), (3000, 3000), (1500, 1000), (0, 3000)]
    rows = [(1, square), (2, turned), (3, concave), (4, square[:2]), (5, [])]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in o]) for i, o in rows], "id int, o array<struct<x:long,y:long>>")
    got = {r.id: (r.m2, r.at) for r in df.select("id", geometry.area_m2(F.col("o")).alias("m2"), geometry.contains(F.col("o"), F.lit(1500.0), F.lit(500.0)).alias("at")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 2.0, 2: 2.0, 3: 6.0, 4: 0.0, 5: 0.0}
    assert [got[k][1] for k in (1, 2, 3)] == [True, True, True]
    halves = spark.createDataFrame([(0.5,), (-0.5,), (-1.5,), (2.49,), (0.49999999999999994,)], "x double").select(geometry.js_round(F.col("x")).alias("r"))
    assert [int(r.r) for r in halves.collect()] == [1, 0, -1, 2, 0]


def test_suppressed(spark):
    rows = [(1, "a", 0.9, 0, 0, 10, 10), (1, "a", 0.8, 1, 1, 11, 11), (1, "b", 0.7, 1, 1, 11, 11), (1, "a", 0.6, 20, 20, 30, 30), (2, "a", 0.1, 0, 0, 10, 10)]
    df = spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in rows], "page int, label string, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.score for r in spatial.suppressed(df).collect()) == [0.1, 0.6, 0.7, 0.9]


def test_boxes(spark):
    rows = [(1, 0, 0, 10, 10), (2, 10, 10, 12, 12), (3, -5, -5, 100, 1), (4, 50, 50, 60, 60), (5, 9, 9, 8, 8), (6, 0, 0, 10, 10)]
    df = spark.createDataFrame([(r[0], *map(float, r[1:])) for r in rows], "id long, x1 double, y1 double, x2 double, y2 double")
    for cell in (1.0, 7.0, 1000.0):
        got = [(r.a, r.b) for r in boxes.meeting(df, cell).collect()]
        assert sorted(got) == [(1, 2), (1, 3), (1, 6), (2, 6), (3, 6)], cell
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, -1.0, 0.0), (4, 9.0, 9.0)], "id long, x double, y double")
    assert sorted((r.id, r.near) for r in boxes.nearest(points, 1.5).collect()) == [(1, 2), (2, 1), (3, 1)]


def clusters(spark, groups):
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    return {r.k: (r.centre, r.members) for r in scale.densest_cluster(df, ["k"], "v", lambda c: c * 0.02, 5.0).collect()}


def test_densest_cluster(spark):
    got = clusters(spark, {"one": [50.0, 50.5, 51.0, 100.0], "tie": [50.0, 50.5, 100.0, 101.0], "chain": [50.0, 51.0, 52.0, None], "lone": [7.0, 7.0], "none": [None]})
    assert got == {"one": (50.0, 3), "chain": (51.0, 3), "lone": (7.0, 2)}


def test_scales(spark):
    groups = {
        "good": [(100, 5000), (200, 10000), (50, 2500), (60, 3000), (70, 3500), (10, 9000), (0, 100)],
        "two": [(100, 5000), (200, 10010)],
        "same": [(100, 5000), (100, 5000)],
        "wide": [(1, 10), (1, 20), (1, 30), (1, 40)],
        "bad": [(0, 10), (None, 5)],
    }
    df = spark.createDataFrame([(k, None if a is None else float(a), float(b)) for k, v in groups.items() for a, b in v], "k string, px double, mm double")
    got = {r.k: r for r in scale.inferred(df, ["k"], "px", "mm").collect()}
    assert {k: r.reason for k, r in got.items()} == {"good": None, "two": None, "same": "tooFewSamples", "wide": "lowConfidence", "bad": "tooFewSamples"}
    assert (got["good"].mm_per_px, got["good"].n_samples, got["good"].confidence) == (50.0, 5, 1.0)
    assert (got["bad"].suggested, got["bad"].n_samples, got["wide"].mm_per_px) == (None, 0, None)


def test_logs(spark):
    rows = [("a", 1, True, False), ("a", 2, False, False), ("b", 1, False, False), ("b", 2, True, False), ("c", 1, True, True), (None, 3, True, None)]
    df = spark.createDataFrame(rows, "id string, rev long, removed boolean, pipeline boolean")
    assert sorted(str(r.id) for r in log.tombstones(df, ["id"], ["rev"], F.col("removed"), F.col("pipeline")).collect()) == ["None", "b"]
    assert [(r.id, r.rev) for r in log.changes_since(df, ["id"], "rev", F.lit(0), 2).collect()] == [("b", 2), (None, 3)]
    steps = spark.createDataFrame([("x", 1, True), ("x", 2, False), ("x", 3, True), ("y", 1, True), ("y", 2, True), ("z", 1, None)], "k string, step int, done boolean")
    assert {r.k: r.next_step for r in log.next_step(steps, ["k"], "step", F.col("done")).collect()} == {"x": 2, "y": 3, "z": 1}
    spans = spark.createDataFrame([(1, "u", minutes(0), 5), (2, "u", minutes(4), 5), (3, "u", minutes(5), 5), (4, "u", minutes(5), 0), (5, "v", minutes(5), 1)], "id long, u string, ts timestamp_ntz, n int")
    got = log.open_at_start(spans, ["u"], "ts", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("n")), "id", F.to_date("at"))
    assert {r.id: r.n_open for r in got.collect()} == {1: 1, 2: 2, 3: 2, 5: 1}
    new = spark.createDataFrame([("x", None)], "k string, step int")
    assert sorted((r.k, r.step) for r in log.updated(steps.where("step = 1").select("k", "step"), new, ["k"]).collect() if r.step) == [("y", 1), ("z", 1)]


def test_changes_empty(spark):
    empty = spark.createDataFrame([], "k long, a string")
    some = spark.createDataFrame([(1, "x"), (1, "w"), (2, None)], "k long, a string")
    assert sorted((r.k, r.a or "") for r in changes.insert_new(empty, some, ["k"]).collect()) == [(1, "w"), (2, "")]
    assert changes.field_changes(empty, empty, "k", ["a"]).count() == 0
    assert stats.outliers(empty.select("k", F.lit(1.0).alias("v")), ["k"], "v").count() == 0


def test_manifest(spark, tmp_path):
    good = [("b.png", "0" * 64, 3), ("a.png", "f" * 64, 0)]
    df = spark.createDataFrame(good, "path string, sha256 string, bytes long")
    tables.write_manifest(df, str(tmp_path / "out"))
    assert sorted((r.path, r.fault) for r in tables.read_manifest(spark, str(tmp_path / "out")).collect()) == [("a.png", None), ("b.png", None)]
    with pytest.raises(ValueError):
        tables.write_manifest(df.union(df), str(tmp_path / "twice"))
    (tmp_path / "bad.json").write_text("not json\n" + json.dumps({"path": "", "sha256": "0" * 64, "bytes": 1}) + "\n" + json.dumps({"path": "x", "sha256": "Z", "bytes": 1}) + "\n")
    assert sorted(r.fault for r in tables.read_manifest(spark, str(tmp_path / "bad.json")).collect()) == ["malformed", "path", "sha256"]


def test_corrupt(spark):
    from pyspark.sql.types import IntegerType, StructType

    df = spark.createDataFrame([('{"a": 1}',), ("{",), (None,)], "doc_text string")
    right, wrong = tables.split_corrupt(df, "doc_text", StructType().add("a", IntegerType()))
    assert [r.doc.a for r in right.collect()] == [1]
    assert wrong.count() == 2


def streamed(spark, tmp_path, rows, schema, build, mode="append"):
    """What a streaming query over the rows, a file each, leaves in memory."""
    where = str(tmp_path / "in")
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(where)
    name = f"sink_{tmp_path.name}"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)
    query = build(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_publish_once_stream(spark, tmp_path):
    rows = [(i, minutes(m), u, "t", 1.0, "{}") for i, (m, u) in enumerate([(0, 1), (1, 1), (2, 2), (90, 1)])]
    got = streamed(spark, tmp_path, rows, EVENTS, lambda s: events.publish_once(s, ["user_id"]))
    assert len(got) == 3 and {r.user_id for r in got} == {1, 2}


def test_windows_stream(spark, tmp_path):
    rows = [(i, minutes(m), 1, "t", 1.0, "{}") for i, m in enumerate([0, 1, 61, 200])]
    got = streamed(spark, tmp_path, rows, EVENTS, lambda s: events.window_counts(s, ["user_id"], "1 hour", 1), "update")
    most = {}
    for r in got:
        most[r.start] = max(most.get(r.start, 0), r.n)
    assert sorted(most.values()) == [1, 1, 2]


def test_progress(spark, tmp_path):
    beats = spark.createDataFrame([("j", minutes(0), 3, False), ("j", minutes(2), 2, False), ("k", minutes(0), 5, False), ("k", minutes(1), 4, True)], "job string, ts timestamp, epoch int, final boolean")
    assert {r.job: (r.epoch, r.final) for r in events.monotone_progress(beats, "job").collect()} == {"j": (3, False), "k": (4, True)}
    jobs = spark.createDataFrame([(1, minutes(0), minutes(9)), (2, minutes(0), None), (3, minutes(0), minutes(1))], "id int, started timestamp, beat timestamp")
    assert sorted(r.id for r in events.silent(jobs, "started", "beat", F.lit(minutes(5))).collect()) == [2, 3]
