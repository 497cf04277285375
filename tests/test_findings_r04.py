"""What the findings of round 4 asked for: steps whose pairs, or what they wrote, grew faster than their rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import wall_runs

LINE = "k string, node long, kind string, x1 double, y1 double, x2 double, y2 double, thickness double"


def touch(a, b, reach):
    """Whether the wall b touches a, as all pairs were judged."""
    if a[0] is None or a[0] != b[0] or a[2] != b[2]:
        return False
    (ax, ay, bx, by, ta), (cx, cy, dx, dy, tb) = a[3:], b[3:]
    if not any(min(cx, dx) - reach <= x <= max(cx, dx) + reach and min(cy, dy) - reach <= y <= max(cy, dy) + reach for x, y in ((ax, ay), (bx, by))):
        return False
    size, other = math.hypot(bx - ax, by - ay), math.hypot(dx - cx, dy - cy)
    ux, uy, vx, vy = (bx - ax) / size, (by - ay) / size, (dx - cx) / other, (dy - cy) / other
    off = [abs((x - ax) * uy - (y - ay) * ux) for x, y in ((cx, cy), (dx, dy))]
    along = sorted((x - ax) * ux + (y - ay) * uy for x, y in ((cx, cy), (dx, dy)))
    return abs(ux * vy - uy * vx) <= math.sin(math.radians(2)) and max(off) <= max(ta, tb) / 2 and max(0, along[0]) - min(size, along[1]) <= 10


def test_lines_of_walls(spark):
    """against all pairs, with copies, level, upright and leaning walls, gaps of 10, thicknesses below 0, and nulls."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(260):
        x, y = (float(v) for v in rng.integers(0, 8, 2) * 505)
        length, lean, side = float(rng.choice([495.0, 500.0, 990.0, 2000.0])), float(rng.choice([0.0, 0.0, 0.0, 12.0, -7.0])), float(rng.choice([0.0, 0.0, 60.0, 90.0]))
        ends = (x, y + side, x + length, y + side + lean) if i % 2 else (x + side, y, x + side + lean, y + length)
        rows.append(("ab"[i % 7 == 0], i, "pq"[i % 5 == 0], *(ends if i % 3 else (*ends[2:], *ends[:2])), float(rng.choice([100.0, 150.0, 220.0, -40.0]))))
    rows += [(*r[:1], r[1] + 300, *r[2:]) for r in rows[:40]] + [(None, 900, "p", 0.0, 0.0, 500.0, 0.0, 100.0), (None, 901, "p", 0.0, 0.0, 500.0, 0.0, 100.0)]
    reach = {k: 10 + max(r[7] for r in rows if r[0] == k) / 2 for k in "ab"}
    label, linked = {r[1]: r[1] for r in rows}, set()
    for a in rows:
        for b in rows:
            if a[1] != b[1] and touch(a, b, reach.get(a[0], 0)):
                linked |= {a[1], b[1]}
                one, two = sorted((label[a[1]], label[b[1]]))
                label = {k: one if v == two else v for k, v in label.items()}
    want = {n: c for n, c in label.items() if n in linked}
    got = {r["node"]: r["line"] for r in wall_runs.lines(spark.createDataFrame(rows, LINE), ["k"]).collect()}
    assert got == want and len(set(want.values())) > 15


def test_walls_of_one_line_make_few_links(spark, monkeypatch):
    """300 walls on one line that overlap were 89,700 links."""
    links, plain = [], wall_runs.components

    def counted(nodes, edges):
        links.append(edges.count())
        return plain(nodes, edges)

    monkeypatch.setattr(wall_runs, "components", counted)
    rows = [("a", i, 0, "ai", False, 10.0 * i, 0.0, 4000.0 + 11 * i, 0.0, 100.0 + i % 3 * 50) for i in range(300)]
    walls = spark.createDataFrame(rows, "k string, node long, ord long, source string, reviewed boolean, x1 double, y1 double, x2 double, y2 double, thickness double").withColumns({"kind": F.lit("p"), "measured": F.col("thickness")})
    got = {r["line"] for r in wall_runs.runs(walls, ["k"]).collect()}
    assert got == {0} and sum(links) < 300


def test_ink_is_read_by_cells(spark):
    """against points one by one; before, each point of each wall was a row, and each dot of ink."""
    from gridloom.operators import line_pairs

    rng = np.random.default_rng(6)
    runs = [(k, int(y), int(x), int(x + n)) for k in (1, 2) for y, x, n in zip(rng.integers(-300, 600, 900), rng.integers(-300, 500, 900), rng.integers(1, 400, 900))]
    ink = line_pairs.united(spark.createDataFrame([*runs, (1, 5, None, 9), (None, 5, 0, 9)], "k long, y long, x1 long, x2 long").where("x1 is not null"), ["k", "y"], "x1", "x2")
    dots = {(k, y, x) for k, y, a, b in runs for x in range(a, b)}
    assert sum(r.x2 - r.x1 for r in ink.where("k is not null").collect()) == len(dots)
    walls = []
    for i in range(200):
        turn = float(rng.choice([0.0, 90.0, 33.0, 179.9, 90.2]))
        walls.append((1 + i % 3, i, math.cos(math.radians(turn)), math.sin(math.radians(turn)), float(rng.uniform(-300, 300)), float(a := rng.uniform(-300, 100)), float(a + rng.uniform(1, 500)), 5.0))
    want = {}
    for k, i, ux, uy, place, s0, s1, _ in walls:
        n = min(max(math.floor(s1 - s0), 8), 256)
        at = [s0 + (s1 - s0) * j / (n - 1) for j in range(n)]
        want[i] = sum((k, math.floor(uy * s + ux * place), math.floor(ux * s - uy * place)) in dots for s in at) / n
    given = spark.createDataFrame(walls, "k long, id long, ux double, uy double, place double, s0 double, s1 double, thickness double")
    assert {r["id"]: r["score"] for r in line_pairs.inked(given, ink, ["k"]).collect()} == want and 0 < sum(want.values())


def test_ink_of_drawings_is_runs(spark):
    """ink is as few runs as its rows have; before, every dot was one."""
    from gridloom.operators import line_pairs
    from gridloom.plans import plan_layers

    _, ink, _ = plan_layers.drawn(spark, "/root/testdata/sf0.001")
    rows = ink.groupBy("floor", "y").agg(F.sort_array(F.collect_list(F.struct("x1", "x2"))).alias("r"))
    assert rows.where(F.exists(F.transform("r", lambda x, i: F.coalesce(F.get("r", i + 1)["x1"] <= x["x2"], F.lit(False))), lambda x: x)).isEmpty()
    assert ink.where("x2 - x1 > 20").count() > 100


def test_edited_walls_within_their_row(spark, monkeypatch):
    """as entity by entity, with repeated and null ids, kinds that are names of types, and a layer without a key; nothing but the layer moves."""
    from gridloom.operators import nested
    from gridloom.plans import registry

    rng = np.random.default_rng(8)
    wall = lambda: (None if rng.random() < 0.05 else f"w{rng.integers(4)}", "A", 0, 0, int(rng.integers(3)), 0, int(rng.integers(2)), [], ["ai", "human", None][rng.integers(3) if rng.random() < 0.2 else 0], False, [False, True, None][rng.integers(3) if rng.random() < 0.2 else 0], 1.0)
    opening = lambda: (f"w{rng.integers(4)}", "w1", ["door", "wall", "vertex", None][rng.integers(4) if rng.random() < 0.3 else 0], int(rng.integers(2)))
    layer = lambda: ([wall() for _ in range(rng.integers(0, 6))], [opening() for _ in range(rng.integers(0, 3))], [], None)
    one = "struct<walls:array<struct<id:string,level:string,x1:long,y1:long,x2:long,y2:long,thickness:long,openings:array<string>,source:string,reviewed:boolean,edited:boolean,confidence:double>>,openings:array<struct<id:string,wall:string,kind:string,width:long>>,rooms:array<struct<id:string,level:string,name:string,usage:string>>,furniture:array<struct<id:string,level:string,room:string,kind:string>>>"
    rows = [(None if k == 3 else k, layer() if k % 9 else None, layer() if k % 7 else None) for k in range(150)]
    both = spark.createDataFrame(rows, f"k long, old {one}, new {one}").cache()
    found = lambda df: sorted(map(str, df.collect()))
    by_row, parts = found(nested.edited_of(both, "k")), nested.changes(*[both.select("k", f"{v}.*") for v in ("old", "new")], "k")
    assert by_row == found(nested._edited_by_entity(both, "k")) == found(nested.edited(*[both.where(f"{v} is not null").select("k", f"{v}.*") for v in ("old", "new")], "k"))
    monkeypatch.setattr(nested, "NEAR", 5)
    assert by_row == found(nested.edited_of(both, "k"))
    changed = {(r.k, r.owner) for r in parts.where("type in ('wall', 'vertex') and field <> '__deleted__'").collect()}
    for k, old, new in rows:
        was, want = [w for w in (old or ([],))[0]] if k is not None else [], []
        for w in (new or ([],))[0]:
            before = [x for x in ((o[10] if o[10] or o[8] is not None else None) or (None if o[8] is None else (o[8] == "human" or o[10])) for o in was if o[0] == w[0] and w[0] is not None) if x is not None]
            want.append(bool(w[10]) or not before or any(before) or (k, w[0]) in changed)
        assert sorted(want) == sorted(r.edited for r in nested.edited_of(both.where("k <=> %s" % ("null" if k is None else k)), "k").collect()) if k in (1, 2, None, 4) else True
    plan = registry.QUERIES["edited_flags"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MergeJoin" not in plan and "HashJoin" not in plan


def test_closure_writes_nothing(spark, monkeypatch):
    """a chain of 300 walls and openings, links to ids that don't exist, and a layer without a key; before, each step was a round that wrote all found so far."""
    from gridloom.operators import nested
    from gridloom.sources import tables

    monkeypatch.setattr(tables, "kept", lambda df: (_ for _ in ()).throw(AssertionError("a table is written")))
    wall = lambda i, source, *openings: (f"w{i}", source, list(openings))
    chain = [wall(i, "human" if i == 5 else "ai", f"o{i}") for i in range(300)]
    layers = [(1, chain, [(f"o{i}", f"w{i + 1}") for i in range(300)], [("r", ["w7"])], None), (2, [wall(1, "ai", "o1")], [("o1", "w1")], [], []), (None, [wall(1, "human", "o1"), wall(2, None)], [("o1", "w1")], [], []), (9007199254740993, [wall(1, "human", "gone", None)], [], [], [("f", None)])]
    rows = spark.createDataFrame(layers, "k long, walls array<struct<id:string,source:string,openings:array<string>>>, openings array<struct<id:string,wall:string>>, rooms array<struct<id:string,walls:array<string>>>, furniture array<struct<id:string,room:string>>")
    got = sorted((r.k or 0, r.id) for r in nested.kept_closure(rows, "k", lambda e: e["source"] == "human").collect())
    assert got == sorted([(1, f"w{i}") for i in range(5, 300)] + [(1, f"o{i}") for i in range(5, 300)] + [(0, "w1"), (9007199254740993, "w1")])


def test_crossings_are_not_written(spark, monkeypatch):
    """as the greedy pass over all points, in several turns, and only few of the crossings are written."""
    from gridloom.operators import boxes, spatial

    written, plain = [], spatial.kept

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    rng = np.random.default_rng(12)
    rows = [("ab"[i % 2], i, *(float(v) for v in rng.uniform(-40, 40, 4))) for i in range(240)] + [("a", 900, None, 0.0, 1.0, 1.0), (None, 901, 0.0, 0.0, 1.0, 1.0)]
    segments = spark.createDataFrame(rows, "k string, id long, x1 double, y1 double, x2 double, y2 double")
    end = F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("b"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2)]))
    ends = segments.select("k", F.lit(0).alias("kind"), F.col("id").alias("a"), end)
    met = boxes.segments_meeting(segments, ["k"], 10.0).select("k", F.lit(1).alias("kind"), "a", "b", "at.x", "at.y")
    all_ = spatial.merged_points(ends.unionByName(met), ["k"], ["kind", "a", "b", "k"], 3.0).cache()
    kinds = all_.groupBy(F.col("into").alias("n")).agg((F.max("kind") == 1).alias("junction"))
    want = sorted(map(str, all_.where("n = into").join(kinds, "n").select("k", "x", "y", "junction").collect()))
    for name, value in (("TURN", 200), ("PROBED", 20), ("kept", counted)):
        monkeypatch.setattr(spatial, name, value)
    got = sorted(map(str, spatial.snapped_ends(segments, ["k"], 3.0).collect()))
    assert got == want and met.count() > 3000 and max(written) < 1500


def test_things_of_one_place_meet_once(spark, monkeypatch):
    """of 200 walls and 200 rooms of one place one goes to the cells; before, all did and met everything there."""
    from gridloom.operators import post_rules

    given = []
    for name in ("crossed_cells", "_covered"):
        plain = getattr(post_rules, name)
        monkeypatch.setattr(post_rules, name, lambda df, *a, plain=plain: given.append(df.count()) or plain(df, *a))
    i = F.col("id")
    long = lambda **of: [F.lit(v).cast("long").alias(c) for c, v in of.items()]
    walls = spark.range(200).select(F.lit("k").alias("k"), (i + 7).alias("ord"), *long(level=0, x1=0, y1=0, x2=4000, y2=0), F.lit(100.0).alias("thickness"), F.when(i % 2 == 0, 0.0).alias("curve"))
    item = spark.range(1).select(F.lit("k").alias("k"), *long(ord=1, level=0, cx=1000, cy=300, x1=800, y1=150, x2=1200, y2=450), F.lit("kitchenCabinet").alias("kind"), F.lit(None).cast("string").alias("variant"), F.lit(0.0).alias("rotation"), F.lit("ai").alias("source"), F.lit(False).alias("reviewed"), F.lit(0.9).alias("confidence"))
    moved = post_rules.snapped(item, walls, ["k"]).first()
    assert (moved["y1"], moved["y2"], moved["confidence"]) == (50, 350, 0.5)
    assert [r["facing"] for r in post_rules._backs(item, walls, ["k"]).collect()] == [0]
    at = lambda x, y: F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y"))
    rooms = spark.range(200).select(F.lit("k").alias("k"), (i * 7 % 200 + 3).alias("ord"), F.when(i == 0, "kitchen").otherwise("bedroom").alias("usage"), F.array(at(0, 0), at(900, 0), at(900, 900), at(0, 900)).alias("outline"))
    points = spark.createDataFrame([("k", 1, 50.0, 60.0), ("k", 2, 5000.0, 60.0)], "k string, p long, x double, y double")
    assert [(r["p"], r["room"], r["usage"]) for r in post_rules.rooms_at(points, rooms, ["k"]).collect()] == [(1, 3, "kitchen")]
    assert len(given) >= 4 and max(given) == 1
