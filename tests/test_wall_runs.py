"""Merged runs of walls against a union-find over all pairs."""

import math

import numpy as np

from gridloom.operators import wall_runs
from gridloom.plans import plan_layers

WALL = "k long, ord long, id string, kind string, x1 double, y1 double, x2 double, y2 double, thickness double, detected double, source string, reviewed boolean, curve double, confidence double"
OPENING = "k long, id string, wall string, offset long, width long, swing string"
USUAL = (100, 150, 200, 220, 300, 400)


class Wall:
    def __init__(self, row):
        self.k, self.ord, self.id, self.kind, x1, y1, x2, y2, self.thick, self.detected, self.source, self.reviewed, self.curve, self.sure = row
        self.a, self.b = complex(x1, y1), complex(x2, y2)
        self.size = abs(self.b - self.a)
        self.unit = (self.b - self.a) / self.size if self.size else 0
        self.measured = self.detected or self.thick

    def along(self, z):
        return ((z - self.a) * self.unit.conjugate()).real

    def beside(self, z):
        return abs(((z - self.a) * self.unit.conjugate()).imag)


def usual(mm):
    return min(USUAL, key=lambda t: (abs(mm - t), t))


def half_up(x):
    return math.floor(x) + (x - math.floor(x) >= 0.5)


def linked(a, b, reach):
    tips = [z for z in (a.a, a.b) if min(b.a.real, b.b.real) - reach <= z.real <= max(b.a.real, b.b.real) + reach and min(b.a.imag, b.b.imag) - reach <= z.imag <= max(b.a.imag, b.b.imag) + reach]
    if a.kind != b.kind or not tips or abs((a.unit.conjugate() * b.unit).imag) > math.sin(math.radians(2)) or max(a.beside(b.a), a.beside(b.b)) > max(a.thick, b.thick) / 2:
        return False
    own, other = (sorted(a.along(z) for z in (w.a, w.b)) for w in (a, b))
    return max(own[0], other[0]) - min(own[1], other[1]) <= 10


def plain(rows, openings):
    """Walls by id, openings by id, and what merged."""
    walls = [Wall(r) for r in rows]
    out = {(w.k, w.id): (w.a, w.b, w.thick, w.sure) for w in walls}
    put = {(o[0], o[1]): o[2:] for o in openings}
    alias = {}
    for k in sorted({w.k for w in walls}):
        able = sorted((w for w in walls if w.k == k and w.source == "ai" and w.reviewed is False and not w.curve and w.size), key=lambda w: w.ord)
        reach = 10 + max((w.thick for w in able), default=0) / 2
        group = {i: i for i in range(len(able))}
        for _ in able:
            for i, a in enumerate(able):
                for j, b in enumerate(able):
                    if i != j and group[i] != group[j] and linked(a, b, reach):
                        low, high = sorted((group[i], group[j]))
                        group = {x: low if g == high else g for x, g in group.items()}
        for g in sorted(set(group.values())):
            its = [able[i] for i in group if group[i] == g]
            first = its[0]
            its.sort(key=lambda w: (min(first.along(w.a), first.along(w.b)), w.ord))
            parts, tiers = [], []
            for w in its:
                more = tiers + [usual(w.measured)] * (w.size > 600)
                if parts and (not more or max(more) <= 1.5 * min(more)):
                    parts[-1].append(w)
                    tiers = more
                else:
                    parts.append([w])
                    tiers = more[-1:] if w.size > 600 else []
            for part in parts:
                lead = max(part, key=lambda w: w.size)
                tips = [z for w in part for z in (w.a, w.b)]
                if len(part) < 2 or max(map(lead.beside, tips)) > max(w.thick for w in part) / 2:
                    continue
                low, high = min(map(lead.along, tips)), max(map(lead.along, tips))
                begin, end = (complex(half_up((lead.a + lead.unit * t).real), half_up((lead.a + lead.unit * t).imag)) for t in (low, high))
                total, upto = sum(w.size for w in part), 0.0
                for median, size in sorted((w.measured, w.size) for w in part):
                    upto += size
                    if upto >= total / 2 * (1 - 1e-9):
                        break
                new = []
                for w in part:
                    back = (w.unit * lead.unit.conjugate()).real < 0
                    shift = ((w.a - begin) * lead.unit.conjugate()).real
                    for o in openings:
                        if o[0] == k and o[2] == w.id:
                            at = max(0, half_up(shift - o[3] - o[4] if back else shift + o[3]))
                            new.append((at, o[1], o[4], {"left": "right", "right": "left"}.get(o[5], o[5]) if back else o[5]))
                new.sort()
                if any(b[0] < a[0] + a[2] for a, b in zip(new, new[1:])) or (new and new[-1][0] + new[-1][2] > high - low):
                    continue
                for w in part:
                    del out[k, w.id]
                    alias[k, w.id] = lead.id
                out[k, lead.id] = (begin, end, usual(median), min(w.sure for w in part))
                put |= {(k, name): (lead.id, at, width, swing) for at, name, width, swing in new}
    return out, put, alias


def test_runs(spark):
    rng = np.random.default_rng(4)
    rows, openings = [], []
    for k in range(2):
        for line in range(30):
            angle = rng.choice([0, math.pi / 2, math.pi, 0.6])
            at, step = complex(*rng.uniform(-9000, 9000, 2)), complex(math.cos(angle), math.sin(angle))
            for _ in range(int(rng.integers(1, 7))):
                size = float(rng.choice([300, 900, 1500, 2500]))
                side = step * 1j * float(rng.choice([0, 0, 20, 60]))
                a, b = at + side, at + step * size + side * float(rng.choice([1, 1, 0.5]))
                a, b = (b, a) if rng.random() < 0.4 else (a, b)
                name = f"w{len(rows)}"
                thick = float(rng.choice([100, 150, 200, 220, 300, 400]))
                rows.append((k, 1000 - len(rows), name, str(rng.choice(["envelope", "envelope", "partition"])), *(float(round(v)) for v in (a.real, a.imag, b.real, b.imag)), thick, [None, 0.0, thick + 13][rng.integers(3)], ["ai", "ai", "ai", "ai", "human"][rng.integers(5)], bool(rng.random() < 0.05), 0.0, float(rng.integers(1, 9)) / 10))
                for _ in range(int(rng.random() < 0.4)):
                    openings.append((k, f"o{len(openings)}", name, int(rng.integers(0, 200)), int(rng.choice([90, 700])), str(rng.choice(["left", "right", "none"]))))
                at += step * (size + float(rng.choice([0, 5, 10, 200])))
    walls, given = spark.createDataFrame(rows, WALL), spark.createDataFrame(openings, OPENING)
    got = [df.collect() for df in wall_runs.merged_runs(walls, given, ["k"])]
    out, put, alias = plain(rows, openings)
    assert {(r["k"], r["id"]): r["into"] for r in got[2]} == alias and len(alias) > 40
    assert {(r["k"], r["id"]): (complex(r["x1"], r["y1"]), complex(r["x2"], r["y2"]), r["thickness"], r["confidence"]) for r in got[0]} == out
    assert {(r["k"], r["id"]): (r["wall"], r["offset"], r["width"], r["swing"]) for r in got[1]} == put


def test_odd_rows(spark):
    rows = [(1, 1, "a", "e", 0.0, 0.0, None, 0.0, 100.0, None, "ai", False, None, 0.5), (1, 2, "b", "e", 5.0, 5.0, 5.0, 5.0, 100.0, None, "ai", False, 0.0, 0.5), (1, 3, "c", "e", 0.0, 0.0, 900.0, 0.0, None, None, "ai", False, 0.0, None), (1, 4, "d", "e", 900.0, 0.0, 1800.0, 0.0, 100.0, None, None, None, 0.0, 0.5)]
    walls, none = spark.createDataFrame(rows, WALL), spark.createDataFrame([], OPENING)
    got = wall_runs.merged_runs(walls, none, ["k"])
    assert sorted(r["id"] for r in got[0].collect()) == ["a", "b", "c", "d"] and got[1].count() == got[2].count() == 0
    got = wall_runs.merged_runs(walls.limit(0), none, ["k"])
    assert [df.count() for df in got] == [0, 0, 0]


def test_query(spark):
    data = "/root/testdata/sf0.001"
    walls, openings = plan_layers.pieces(spark, data)
    rows = [tuple(r[c] for c in ("floor", "ord", "id", "kind", "x1", "y1", "x2", "y2", "thickness", "detected", "source", "reviewed", "curve", "confidence")) for r in walls.collect()]
    given = [tuple(r[c] for c in ("floor", "id", "wall", "offset", "width", "swing")) for r in openings.collect()]
    out, put, alias = plain(rows, given)
    got = plan_layers.merged_wall_runs(spark, data).collect()
    assert {(r["floor"], r["id"]): (complex(r["x1"], r["y1"]), complex(r["x2"], r["y2"]), r["thickness"]) for r in got} == {k: v[:3] for k, v in out.items()}
    assert len(alias) > 100 and sum(r["n_openings"] for r in got) == len(put) and sum(r["offsets"] or 0 for r in got) == sum(v[1] for v in put.values())
