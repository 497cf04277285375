"""Boxes, segments and greedy rules of unequal sizes and long chains against plain loops."""

import itertools
import math

import numpy as np
import pytest

from gridloom.operators import boxes, detection, furniture, graph
from gridloom.plans import flows, shapes

HOME = {"bathroom": {"sanitaryFixture", "shower", "washingMachine"}, "kitchen": {"kitchenCabinet"}, "bedroom": {"bed", "wardrobe"}}
FIXED = {"sanitaryFixture", "shower", "washingMachine", "kitchenCabinet", "bed", "wardrobe"}
ITEM = "page long, id long, kind string, x1 double, y1 double, x2 double, y2 double, confidence double, usage string, suggested boolean, variant string"


def shared(a, b):
    """IoU and share of the smaller box."""
    w, h = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]), min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
    if w <= 0 or h <= 0:
        return 0.0, 0.0
    size = [(r["x2"] - r["x1"]) * (r["y2"] - r["y1"]) for r in (a, b)]
    return w * h / (sum(size) - w * h), w * h / min(size)


def plain_duplicates(items):
    """Pairs in order, one loop."""
    pairs = []
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    key = lambda r: (r["x1"], r["y1"], r["x2"], r["y2"], r["kind"], r["confidence"] or 0.0)
    for a, b in itertools.combinations([r for r in items if area(r) > 0], 2):
        if a["page"] != b["page"] or "sink" in (a["variant"], b["variant"]):
            continue
        iou, iom = shared(a, b)
        kinds = {a["kind"], b["kind"]}
        if len(kinds) == 1:
            same = iou >= 0.5 or (not kinds & {"other", "chair"} and iom >= 0.8)
        else:
            fixed = kinds <= FIXED and kinds not in ({"wardrobe", "kitchenCabinet"}, {"washingMachine", "kitchenCabinet"})
            same = iou >= 0.6 or (fixed and iom >= 0.8)
        if same and iou > 0:
            small, big = sorted((a, b), key=lambda r: (area(r), key(r), r["id"]))
            pairs.append((-iou, key(small), small["id"], key(big), big["id"], small, big))
    gone, sinks = set(), []
    for negative, _, _, _, _, s, b in sorted(pairs, key=lambda p: p[:5]):
        iou, home = -negative, [r["kind"] in HOME.get(r["usage"], ()) for r in (s, b)]
        if s["kind"] == "sanitaryFixture" and b["kind"] == "kitchenCabinet" and bool(s["suggested"]) == bool(b["suggested"]) and iou < 0.6 and "bathroom" not in (s["usage"], b["usage"]):
            sinks.append((s["id"], b["id"]))
            continue
        if s["id"] in gone or b["id"] in gone:
            continue
        if bool(s["suggested"]) != bool(b["suggested"]):
            loser = s if s["suggested"] else b
        elif iou < (0.5 if s["kind"] == b["kind"] else 0.6):
            loser = b if home[0] and not home[1] else s
        elif home[0] != home[1]:
            loser = b if home[0] else s
        elif (s["confidence"] or 0) != (b["confidence"] or 0):
            loser = s if (s["confidence"] or 0) < (b["confidence"] or 0) else b
        else:
            loser = s if key(s)[:5] > key(b)[:5] else b
        gone.add(loser["id"])
    return {(i, "dropped", None) for i in gone} | {(a, "sink", b) for a, b in dict(x for x in sinks if not gone & set(x)).items()}


def furnished(seed, n):
    """Boxes from a hundredth of the page to all of it, many inside others."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if i % 3 and out:  # close to or inside an earlier one
            o = out[rng.integers(len(out))]
            w, h = o["x2"] - o["x1"], o["y2"] - o["y1"]
            part = float(rng.choice([1.0, 0.95, 0.9, 0.3, 0.05]))
            x1, y1 = (o[c] + float(np.round(rng.choice([0, 0, 0.02, 0.5]) * s)) for c, s in (("x1", w), ("y1", h)))
            w, h = w * part, h * part
        else:
            x1, y1, w, h = *(float(v) for v in rng.integers(0, 4000, 2)), *(float(v) for v in np.round(10 * 2 ** rng.uniform(0, 7, 2)))
        kind = str(rng.choice(["chair", "other", "bed", "wardrobe", "kitchenCabinet", "sanitaryFixture", "washingMachine"]))
        usage = [None, "kitchen", "bathroom", "bedroom", "hall"][rng.integers(5)]
        out.append(dict(page=int(i % 2), id=i, kind=kind, x1=x1, y1=y1, x2=x1 + w, y2=y1 + h, confidence=[None, 0.5, 0.75][rng.integers(3)], usage=usage, suggested=[None, False, True][rng.integers(3)], variant="sink" if rng.random() < 0.05 else None))
    for i, usage in enumerate(("kitchen", "bathroom")):  # a sink in a run of cabinets
        run = dict(out[0], id=n + 10 + 2 * i, x1=20_000.0, y1=5000.0 * i, x2=23_000.0, y2=5000.0 * i + 600, kind="kitchenCabinet", usage=usage, suggested=None, variant=None)
        out += [run, dict(run, id=n + 11 + 2 * i, x1=21_000.0, x2=21_600.0, kind="sanitaryFixture")]
    out.append(dict(out[0], id=n, x1=0.0, y1=0.0, x2=9000.0, y2=9000.0, kind="bed"))  # as large as the page
    out.append(dict(out[0], id=n + 1, x2=out[0]["x1"]))  # without an area
    return out


def test_duplicates(spark):
    items = furnished(1, 240)
    rows = spark.createDataFrame([tuple(r.values()) for r in items], ITEM)
    want = plain_duplicates(items)
    assert {tuple(r) for r in furniture.duplicates(rows, ["page"]).collect()} == want
    assert len([w for w in want if w[1] == "dropped"]) > 30 and any(w[1] == "sink" for w in want)
    assert furniture.duplicates(rows.limit(0), ["page"]).count() == 0


def test_duplicate_boxes(spark):
    assert {r["fate"] for r in shapes.duplicate_boxes(spark, "/root/testdata/sf0.001").collect()} >= {"dropped"}


def test_nested_by_a_hundredth(spark):
    big = (1, 1, "bed", 0.0, 0.0, 1000.0, 1000.0, 0.9, None, False, None)
    small = (1, 2, "bed", 10.0, 10.0, 60.0, 60.0, 0.99, None, False, None)
    rows = spark.createDataFrame([big, small], ITEM)
    assert [tuple(r)[:2] for r in furniture.duplicates(rows, ["page"]).collect()] == [(2, "dropped")]


@pytest.mark.parametrize("iou", [0.0, 0.3])
def test_overlaps(spark, iou):
    items = furnished(2, 150)
    rows = spark.createDataFrame([(r["page"], r["id"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in items], "page long, id long, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r["l"]["id"], r["r"]["id"]) for r in detection.overlaps(rows, rows, ["page"], iou).collect())
    assert got == sorted((a["id"], b["id"]) for a in items for b in items if a["page"] == b["page"] and shared(a, b)[0] > 0 and shared(a, b)[0] >= iou)
    assert detection.overlaps(rows.limit(0), rows, ["page"], iou).count() == 0


def crossing(a, b):
    rx, ry, sx, sy = a[4] - a[2], a[5] - a[3], b[4] - b[2], b[5] - b[3]
    across = rx * sy - ry * sx
    if abs(across) < 1e-9:
        return False
    t, u = ((b[2] - a[2]) * sy - (b[3] - a[3]) * sx) / across, ((b[2] - a[2]) * ry - (b[3] - a[3]) * rx) / across
    et, eu = 3 / max(math.hypot(rx, ry), 1e-9), 3 / max(math.hypot(sx, sy), 1e-9)
    return -et <= t <= 1 + et and -eu <= u <= 1 + eu


def test_segments(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(2)), i, *(float(round(v)) for v in rng.uniform(-300, 300, 4))) for i in range(150)]
    rows += [(0, 200 + i, x, -200.0, x, 200.0) for i, x in enumerate((-80.0, 0.0, 40.0, 41.5))] + [(0, 210, -200.0, 40.0, 200.0, 40.0), (0, 211, 5.0, 5.0, 5.0, 5.0), (0, 212, None, 0.0, 1.0, 1.0), (0, 213, -9000.0, -9001.0, 9000.0, 9002.0)]
    df = spark.createDataFrame(rows, "k int, id long, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r["a"], r["b"]) for r in boxes.segments_meeting(df, ["k"], 40.0).collect())
    whole = [r for r in rows if None not in r]
    assert got == sorted((a[1], b[1]) for a in whole for b in whole if a[0] == b[0] and a[1] < b[1] and crossing(a, b))


@pytest.mark.parametrize("local", [20_000, 5])
def test_long_chains(spark, monkeypatch, local):
    """Chains in which each decision waits for the one before, settled by components or, where these are large, by rounds."""
    monkeypatch.setattr(graph, "LOCAL", local)
    n = 1000 if local > 5 else 24
    pairs = [(i, i + 1, i + 1, i) for i in range(n)] + [(5000 + i, 6000 + i, 5000 + i, 9000 + i) for i in range(3)]
    gone = set()
    for a, b, loser, _ in pairs:
        if a not in gone and b not in gone:
            gone.add(loser)
    df = spark.createDataFrame(pairs, "a long, b long, loser long, rank long")
    assert {r["id"] for r in graph.dropped_by_pairs(df).collect()} == gone
    worse = df.selectExpr("least(a, b) as better", "greatest(a, b) as worse", "least(a, b) as rank")
    assert {r["id"] for r in graph.beaten(worse).collect()} == {i for i in range(1, n + 1, 2)} | {6000, 6001, 6002}
    wish = [(i, i + k, i, 1.0 - k / 2) for i in range(n) for k in (0, 1)] + [(-1, 0, -1, 1.0)]
    got = {(r["a"], r["b"]) for r in detection.one_to_one(spark.createDataFrame(wish, "a long, b long, rank long, worth double")).collect()}
    assert got == {(i, i + 1) for i in range(n)} | {(-1, 0)}


def test_boxes_of_flows(spark):
    assert flows.suppressed_boxes(spark, "/root/testdata/sf0.001").count() > 10
