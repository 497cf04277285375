"""What the findings of round 3 asked for: steps whose work or memory grew faster than their rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import graph, regions, scale, spatial, stats

from test_findings import both

WALL = "k string, id long, x1 double, y1 double, x2 double, y2 double, thickness double"


def apart(a, b):
    """Distance of two segments."""
    side = lambda s, x, y: (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])
    if side(a, *b[:2]) * side(a, *b[2:]) < 0 and side(b, *a[:2]) * side(b, *a[2:]) < 0:
        return 0.0

    def foot(s, x, y):
        dx, dy = s[2] - s[0], s[3] - s[1]
        t = min(max(((x - s[0]) * dx + (y - s[1]) * dy) / (dx * dx + dy * dy), 0), 1)
        return math.hypot(s[0] + t * dx - x, s[1] + t * dy - y)

    return min(foot(a, *b[:2]), foot(a, *b[2:]), foot(b, *a[:2]), foot(b, *a[2:]))


def test_clusters_of_walls(spark):
    """against all pairs, with walls that share no end, a thickness below 0, and nulls."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        x, y = (float(v) for v in rng.integers(0, 60, 2) * 170)
        dx, dy = float(rng.integers(1, 5) * 300), float(rng.integers(-4, 5) * 300)
        rows.append(("ab"[i % 2], i, x, y, x + dx, y + dy, float(rng.choice([-700.0, 100.0, 220.0]))))
    label = {r[1]: r[1] for r in rows}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and apart(a[2:6], b[2:6]) <= (a[6] + b[6]) / 2 + 150:
                one, two = sorted((label[a[1]], label[b[1]]))
                label = {k: one if v == two else v for k, v in label.items()}
    assert 10 < len(set(label.values())) < 150
    more = [(None, 500, 0.0, 0.0, 400.0, 0.0, 100.0), (None, 501, 0.0, 0.0, 400.0, 0.0, 100.0), ("a", 502, None, 0.0, 400.0, 0.0, 100.0)]
    got = {r["id"]: r["cluster"] for r in regions.wall_clusters(spark.createDataFrame(rows + more, WALL), ["k"]).collect()}
    assert got == label | {500: 500, 501: 501}


def test_walls_of_one_place_make_few_links(spark, monkeypatch):
    """300 walls from one corner were 44,850 links."""
    links, plain = [], regions.components

    def counted(nodes, edges):
        links.append(edges.count())
        return plain(nodes, edges)

    monkeypatch.setattr(regions, "components", counted)
    rows = [("a", i, 10.0, 10.0, 2000.0 + 7 * i, 900.0 + 11 * i, 100.0) for i in range(300)]
    got = {r["cluster"] for r in regions.wall_clusters(spark.createDataFrame(rows, WALL), ["k"]).collect()}
    assert got == {0} and sum(links) < 300


def test_medians_order_few_rows(spark, tmp_path):
    """only rows of the bucket that holds a median are put in order, and medians of what stays hold no group."""
    rng = np.random.default_rng(5)
    rows = [(k, float(rng.integers(1, 50)), float(v)) for k in range(5) for v in np.round(rng.lognormal(6, 1.5, 400 + k), 2)]
    rows += [(7, 10.0, 1000.0), (7, 20.0, 2000.0), (10, 2.0, 4.0)]
    rows += [(11, 2.0, 4.0)] * 6 + [(11, 2.0, 5.0)] * 6  # both ranks of the middle, in two values
    df = spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_extendedprice double")
    got, want = both(spark, tmp_path, "scale_inference", lineitem=df)
    assert got == want and len(got) == 8
    plan = scale.inferred(df, ["l_suppkey"], "l_quantity", "l_extendedprice")._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan and "percentile(" not in plan
    ratio = df.where("l_quantity > 0").select("l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    found = stats.middle(ratio, ["l_suppkey"], "v", lambda v: F.floor(v / 1000), "m")
    plain = {r[0]: r[1] for r in ratio.groupBy("l_suppkey").agg(F.median("v")).collect()}
    assert {r["l_suppkey"]: r["m"] for r in found.collect()} == plain


def test_components_without_pairs(spark):
    """as the components of all pairs, with copies, points on the distance, and points without a place; pairs aren't made."""
    rng = np.random.default_rng(9)
    at = np.r_[rng.normal(0, 0.2, (500, 2)), np.round(rng.uniform(-2, 2, (500, 2)) * 50) / 50, np.full((40, 2), 0.31)]
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(2000, None, 1.0), (2001, math.nan, 1.0), (2002, math.nan, 1.0), (2003, 3e13, 1.0), (2004, 3e13, 1.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    plain = graph.components(points.select("id"), spatial.pairs_within(points.where("id < 2000"), 0.02))
    want = {r["id"]: r["component"] for r in plain.collect()} | {2004: 2003}
    got = spatial.near_components(points, 0.02).collect()
    assert len(got) == len(rows) and {r["id"]: r["component"] for r in got} == want and len(set(want.values())) > 100


def test_components_of_one_place(spark, monkeypatch):
    """3,000 points of one place and 3,000 beside it were 18 million links."""
    links, plain = [], graph.components

    def counted(nodes, edges):
        links.append(edges.count())
        return plain(nodes, edges)

    monkeypatch.setattr(graph, "components", counted)
    rows = spark.range(6000).select("id", (F.col("id") % 2 * 0.015).alias("x"), F.lit(0.0).alias("y"))
    assert {r["component"] for r in spatial.near_components(rows, 0.02).collect()} == {0} and sum(links) <= 2
