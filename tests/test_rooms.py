"""Clear areas against a plain version with complex numbers, and by figures worked out by hand."""

import math
import statistics

import numpy as np

from gridloom.operators import rooms
from gridloom.plans import plan_layers

WALL = "k long, id long, x1 double, y1 double, x2 double, y2 double, thickness double"
ROOM = "k long, room long, outline array<struct<x: long, y: long>>"


def cross(a, b):
    return (a.conjugate() * b).imag


def plain(outline, walls):
    """Square metres within the walls' faces."""
    ring = [complex(*p) for p in outline or []]
    if outline is None:
        return None
    gross = sum(cross(a, b) for a, b in zip(ring, ring[1:] + ring[:1])) / 2 if len(ring) > 2 else 0.0
    if gross == 0:
        return 0.0
    while len(ring) > 3:
        turns = [(ring[i] - ring[i - 1], ring[(i + 1) % len(ring)] - ring[i]) for i in range(len(ring))]
        at = next((i for i, (u, v) in enumerate(turns) if abs(cross(u, v)) <= 0.01 * abs(u) * abs(v)), None)
        if at is None:
            break
        ring.pop(at)
    side, usual = (1 if gross > 0 else -1), statistics.median(w[5] for w in walls) / 2 if walls else 0.0
    lines = []
    for p, q in zip(ring, ring[1:] + ring[:1]):
        unit, beside = (q - p) / abs(q - p), []
        for i, (n, x1, y1, x2, y2, thick) in enumerate(sorted(walls)):
            a, b = complex(x1, y1), complex(x2, y2)
            t = sorted((unit.conjugate() * (z - p)).real for z in (a, b))
            over = min(t[1], abs(q - p)) - max(t[0], 0.0)
            if abs(cross(unit, b - a)) <= 0.09 * abs(b - a) and abs(cross(unit, (a + b) / 2 - p)) <= thick and over > 0:
                beside.append((-over, i, thick / 2))
        half = min(beside)[2] if beside else usual
        lines.append((p + unit * 1j * side * half, unit))

    def corner(i):
        (p, u), (q, v) = lines[i - 1], lines[i % len(lines)]
        return p + u * cross(q - p, v) / cross(u, v)

    while True:
        if len(lines) < 3:
            return None
        n = len(lines)
        at = next((i for i in range(n) if ((corner((i + 1) % n) - corner(i)) * lines[i][1].conjugate()).real < 0 and abs(cross(lines[i - 1][1], lines[(i + 1) % n][1])) > 0.01), None)
        if at is None:
            break
        lines.pop(at)
    inner = [corner(i) for i in range(len(lines))]
    net = sum(cross(a, b) for a, b in zip(inner, inner[1:] + inner[:1])) / 2 * side
    return math.floor(net / 1e6 * 100 + 0.5) / 100 if 0 < net <= abs(gross) * (1 + 1e-9) else None


def test_by_hand(spark):
    box = [(0, 0), (5000, 0), (5000, 4000), (0, 4000)]
    sides = [(i, *map(float, (*a, *b)), 200.0) for i, (a, b) in enumerate(zip(box, box[1:] + box[:1]))]
    split = box[:1] + [(2000, 0)] + box[1:]
    narrow = [(0, 0), (5000, 0), (5000, 150), (0, 150)]
    given = [(1, 1, box), (1, 2, box[::-1]), (1, 3, split), (1, 4, None), (1, 5, []), (1, 6, box[:2]), (1, 7, [(0, 0), (9, 0), (18, 0)]), (2, 8, box), (3, 9, narrow)]
    walls = [(1, *w) for w in sides] + [(3, i, *map(float, (*a, *b)), 200.0) for i, (a, b) in enumerate(zip(narrow, narrow[1:] + narrow[:1]))] + [(1, 99, None, 0.0, 1.0, 1.0, 5.0)]
    got = {r["room"]: (r["gross"], r["clear"]) for r in rooms.clear_areas(spark.createDataFrame(given, ROOM), spark.createDataFrame(walls, WALL), ["k"]).collect()}
    assert got == {1: (20.0, 18.24), 2: (20.0, 18.24), 3: (20.0, 18.24), 4: (None, None), 5: (0.0, 0.0), 6: (0.0, 0.0), 7: (0.0, 0.0), 8: (20.0, 20.0), 9: (0.75, None)}
    assert rooms.clear_areas(spark.createDataFrame([], ROOM), spark.createDataFrame([], WALL), ["k"]).count() == 0


def test_random_outlines(spark):
    rng = np.random.default_rng(6)
    given, walls = [], []
    for k in range(3):
        for room in range(40):
            n = int(rng.integers(3, 9))
            angle = np.sort(rng.uniform(0, 2 * math.pi, n))
            cx, cy = rng.integers(-20_000, 20_000, 2)
            ring = [(int(cx + r * math.cos(a)), int(cy + r * math.sin(a))) for a, r in zip(angle, rng.uniform(300, 4000, n))]
            if room % 3 == 0:
                ring = ring[::-1] + ring[-1:]  # clockwise, with a repeated corner
            given.append((k, room, ring))
            for p, q in zip(ring, ring[1:] + ring[:1]):
                if k and rng.random() < 0.8:
                    shift = rng.integers(-60, 60, 4)
                    walls.append((k, len(walls), float(p[0] + shift[0]), float(p[1] + shift[1]), float(q[0] + shift[2]), float(q[1] + shift[3]), float(rng.choice([100, 220, 400]))))
    got = {(r["k"], r["room"]): r["clear"] for r in rooms.clear_areas(spark.createDataFrame(given, ROOM), spark.createDataFrame(walls, WALL), ["k"]).collect()}
    want = {(k, room): plain(ring, [w[1:] for w in walls if w[0] == k]) for k, room, ring in given}
    off = {x: (got[x], want[x]) for x in want if (got[x] is None) != (want[x] is None) or (want[x] is not None and abs(got[x] - want[x]) > 0.011)}
    assert not off and len({v for v in want.values()}) > 60


def test_query(spark):
    data = "/root/testdata/sf0.001"
    given, walls = plan_layers.plans(spark, data)
    held = {}
    for w in walls.collect():
        held.setdefault(w["floor"], []).append((w["id"], w["x1"], w["y1"], w["x2"], w["y2"], w["thickness"]))
    want = {r["room"]: plain([(p["x"], p["y"]) for p in r["outline"]], held.get(r["floor"], [])) for r in given.collect()}
    got = {r["room"]: r["clear"] for r in plan_layers.clear_room_areas(spark, data).collect()}
    assert got.keys() == want.keys() and len(got) > 50
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 0.011) for k in want)
