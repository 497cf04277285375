"""Measures of detectors against plain loops."""

import numpy as np

from gridloom.operators import detection
from gridloom.plans import flows

DATA = "/root/testdata/sf0.001"


def iou(a, b):
    w, h = max(0, min(a.x2, b.x2) - max(a.x1, b.x1)), max(0, min(a.y2, b.y2) - max(a.y1, b.y1))
    union = (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - w * h
    return w * h / union if union else 0.0


def plain_ap(hits, positives):
    """Trapezoids over 101 points of the interpolated envelope."""
    tp = np.cumsum(hits)
    recall, precision = tp / positives, tp / np.arange(1, len(hits) + 1)
    r, p = np.r_[0.0, recall, recall[-1], 1.0], np.r_[1.0, precision, 0.0, 0.0]
    p = np.maximum.accumulate(p[::-1])[::-1]
    x = np.arange(101) / 100
    return float(np.trapezoid(np.interp(x + 1e-12, r, p), x))


def test_greedy_matches_and_precision(spark):
    truth, guess = (df.toPandas() for df in flows.boxes(spark, DATA))
    taken, hits = {}, {}
    for g in guess.sort_values(["score", "id"], ascending=[False, True]).itertuples():
        free = [t for t in truth[(truth.page == g.page) & (truth.label == g.label)].itertuples() if t.id not in taken.values() and iou(g, t) >= 0.5]
        best = max(free, key=lambda t: (iou(g, t), -t.id), default=None)
        hits.setdefault(g.label, []).append(best is not None)
        if best is not None:
            taken[g.id] = best.id
    assert {r["guess"]: r["truth"] for r in flows.iou_matching(spark, DATA).collect()} == taken and len(taken) > 20
    got = {r["label"]: r["ap_millionths"] for r in flows.detection_ap(spark, DATA).collect()}
    for label, n in truth.groupby("label").size().items():
        assert abs(got[label] / 1e6 - plain_ap(np.array(hits[label], float), n)) < 0.006, label


def test_suppression(spark):
    _, guess = (df.toPandas() for df in flows.boxes(spark, DATA))
    kept = []
    for g in guess.sort_values(["score", "x1", "y1", "id"], ascending=[False, True, True, True]).itertuples():
        if not any(k.page == g.page and k.label == g.label and iou(k, g) >= detection.SUPPRESS_IOU for k in kept):
            kept.append(g)
    assert {r["id"] for r in flows.suppressed_boxes(spark, DATA).collect()} == {k.id for k in kept} and 10 < len(kept) < len(guess)


def test_one_to_one_chain(spark):
    """A chain where each choice waits for the one before."""
    rows = [(i, i + k, i, 1.0 - k / 2) for i in range(30) for k in (0, 1)] + [(40, 0, 40, 1.0), (41, 29, -1, 1.0)]
    got = {(r["a"], r["b"]) for r in detection.one_to_one(spark.createDataFrame(rows, "a long, b long, rank long, worth double")).collect()}
    assert got == {(i, i) for i in range(29)} | {(29, 30), (41, 29)}
    assert detection.one_to_one(spark.createDataFrame([], "a long, b long, rank long, worth double")).count() == 0
    assert detection.suppressed(spark.createDataFrame([], "id long, page long, score double, x1 double, y1 double, x2 double, y2 double"), ["page"]).count() == 0


def test_precision_corners(spark):
    for hits in ([1], [0], [0, 1], [1, 0, 1, 1, 0], [0, 0, 1, 1, 1, 0, 1], [1] * 7):
        rows = [(1, i, float(-i), h, 9) for i, h in enumerate(hits)]
        df = spark.createDataFrame(rows, "k long, id long, score double, hit int, positives int")
        from pyspark.sql import functions as F

        curve = detection.precision_at(df, ["k"], F.lit(0), [F.asc("id")], "hit", "positives")
        assert abs(detection.interpolated_ap(curve, ["k"]).first()["ap"] - plain_ap(np.array(hits, float), 9)) < 1e-6, hits


def test_matched_cer(spark):
    r = flows.matched_cer(spark, DATA).first()
    assert 0 < r["edits"] < r["chars"]
