"""Curved walls to chords and back, against plain loops."""

import math

from gridloom.operators import arcs
from gridloom.plans import plan_layers

PIECE = "k long, arc long, number int, count int, id long, x1 double, y1 double, x2 double, y2 double, thickness double, confidence double"


def test_exploded(spark):
    rows = [(1, 1, 1000.0, 1000.0, 3000.0, 1000.0, 100.0, 400.0), (1, 2, 0.0, 0.0, 500.0, 0.0, 100.0, 0.0), (1, 3, 0.0, 0.0, 500.0, 0.0, 100.0, None), (1, 4, None, 0.0, 1.0, 1.0, 5.0, 9.0), (1, 5, 5000.0, 5000.0, 5000.0, 5400.0, 200.0, -90.0)]
    got = {}
    for r in arcs.exploded(spark.createDataFrame(rows, "k long, id long, x1 double, y1 double, x2 double, y2 double, thickness double, sagitta double"), ["k"]).collect():
        got.setdefault(r["arc"], []).append(r)
    assert [len(got[i]) for i in (2, 3, 4)] == [1, 1, 1] and got[4][0]["x1"] is None
    for i, (x1, y1, x2, y2), thick, depth in ((1, rows[0][2:6], 100.0, 400.0), (5, rows[4][2:6], 200.0, -90.0)):
        size = math.hypot(x2 - x1, y2 - y1)
        radius = size**2 / (8 * abs(depth)) + abs(depth) / 2
        sweep = 4 * math.atan(2 * abs(depth) / size)
        its = sorted(got[i], key=lambda r: r["number"])
        step = max(5.0, math.degrees(1.5 * thick / radius))
        assert len(its) == 2 * max(1, math.ceil(math.degrees(sweep) / (2 * step))) == its[0]["count"]
        assert all(a["x2"] == b["x1"] and a["y2"] == b["y1"] for a, b in zip(its, its[1:]))
        assert (its[0]["x1"], its[0]["y1"], its[-1]["x2"], its[-1]["y2"]) == (x1, y1, x2, y2)
        chord = 2 * radius * math.sin(sweep / len(its) / 2)
        assert all(abs(math.hypot(r["x2"] - r["x1"], r["y2"] - r["y1"]) - chord) < 1e-6 for r in its)


def plain(pieces, openings):
    """Walls and openings after the join."""
    walls, into = [], {}
    for k, arc in {(r[0], r[1]) for r in pieces if r[1] is not None and r[3] > 1}:
        its = sorted((r for r in pieces if (r[0], r[1]) == (k, arc)), key=lambda r: r[2])
        if len(its) != its[0][3] or len(its) % 2 or [r[2] for r in its] != sorted({r[2] for r in its}) or any(a[7:9] != b[5:7] for a, b in zip(its, its[1:])):
            continue
        sizes = [math.hypot(r[7] - r[5], r[8] - r[6]) for r in its]
        a, b, top = complex(*its[0][5:7]), complex(*its[-1][7:9]), complex(*its[len(its) // 2][5:7])
        bend = -((top - (a + b) / 2) * (b - a).conjugate()).imag / abs(b - a)
        bend = math.floor(bend) + (bend - math.floor(bend) >= 0.5)
        half = math.floor(abs(b - a) / 2)
        walls.append((k, its[0][4], a.real, a.imag, b.real, b.imag, float(max(-half, min(half, bend))), its[0][9], round(sum(r[10] * s for r, s in zip(its, sizes)) / sum(sizes), 3)))
        for i, r in enumerate(its):
            into[k, r[4]] = (its[0][4], sum(sizes[:i]))
    walls += [(r[0], r[4], *r[5:9], 0.0, r[9], r[10]) for r in pieces if (r[0], r[4]) not in into]
    put = []
    for k, name, wall, offset in openings:
        at = into.get((k, wall), (wall, 0.0))
        put.append((k, name, at[0], math.floor(offset + at[1] + 0.5)))
    return sorted(walls), sorted(put), into


def test_joined(spark):
    pieces, n = [], 0
    for arc in range(12):
        count = 6 if arc % 4 else 4
        points = [(1000.0 * arc + round(400 * math.cos(t * 0.3)), round(400 * math.sin(t * 0.3) * (-1) ** arc)) for t in range(count + 1)]
        for i in range(count):
            n += 1
            if arc == 3 and i == 2:
                continue  # a chord is gone
            x1, y1 = points[i]
            pieces.append((arc % 2, arc, i, count, n, float(x1 + (7 if arc == 5 and i == 3 else 0)), float(y1), float(points[i + 1][0]), float(points[i + 1][1]), 100.0 + arc, 0.5 + i / 20))
    pieces += [(0, None, None, 1, 900, 0.0, 0.0, 1.0, 1.0, 5.0, 0.5), (0, 77, 0, 1, 901, 0.0, 0.0, 1.0, 1.0, 5.0, 0.25), (0, 78, 0, 3, 902, 0.0, 0.0, 1.0, 0.0, 5.0, 0.25), (0, 78, 1, 3, 903, 1.0, 0.0, 2.0, 0.0, 5.0, 0.25), (0, 78, 2, 3, 904, 2.0, 0.0, 3.0, 0.0, 5.0, 0.25)]
    openings = [(p[0], i, p[4], 10 * i) for i, p in enumerate(pieces[::3])]
    df, given = spark.createDataFrame(pieces, PIECE), spark.createDataFrame(openings, "k long, id long, wall long, offset long")
    walls, put, alias = (x.collect() for x in arcs.joined(df, given, ["k"]))
    want, moved, into = plain(pieces, openings)
    assert sorted(tuple(r[c] for c in ("k", "id", "x1", "y1", "x2", "y2", "curve", "thickness", "confidence")) for r in walls) == want
    assert sorted(tuple(r[c] for c in ("k", "id", "wall", "offset")) for r in put) == moved
    assert {(r["k"], r["id"]): r["into"] for r in alias} == {k: v[0] for k, v in into.items()} and len({v[0] for v in into.values()}) == 10
    assert [x.count() for x in arcs.joined(df.limit(0), given.limit(0), ["k"])] == [0, 0, 0]


def test_query(spark):
    got = plan_layers.curved_walls(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and sum(r["curve"] != 0 for r in got) > 80
    assert all(abs(r["curve"] - r["sagitta"]) <= 3 for r in got if r["sagitta"])
