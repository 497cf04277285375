"""Walls in one line that touch, merged to one wall with one thickness; openings move to it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import js_round, usual_thickness
from ..sources.tables import dropped, kept
from .graph import components
from .spatial import crossed_cells, parts_of

#: Gap in mm that touches, largest angle between walls of a line in degrees, largest ratio of thicknesses in a run, length in mm up to which a wall doesn't count for it; fixed values.
TOUCH_MM, ALIGN_DEG, TIER_RATIO, SLIVER_MM = 10, 2.0, 1.5, 600
CELL_MM, TURN_DEG = 1000.0, 10.0
#: Names that a task holds while it unites links.
HELD = 1_000_000
ENDS = ("x1", "y1", "x2", "y2")


def _unit(of: str = "") -> tuple[Column, Column, Column]:
    """Direction and length of the wall in a struct, or of the row."""
    x1, y1, x2, y2 = (F.col(f"{of}{c}") for c in ENDS)
    size = F.hypot(x2 - x1, y2 - y1)
    return (x2 - x1) / size, (y2 - y1) / size, size


def _beside(of: str, x: Column, y: Column) -> Column:
    """Distance of a point from the line of a wall."""
    ux, uy, _ = _unit(of)
    return F.abs((x - F.col(f"{of}x1")) * uy - (y - F.col(f"{of}y1")) * ux)


def _along(of: str, x: Column, y: Column) -> Column:
    ux, uy, _ = _unit(of)
    return (x - F.col(f"{of}x1")) * ux + (y - F.col(f"{of}y1")) * uy


#: What is asked of two walls is the same for all walls with these.
PLACE = ("kind", *ENDS, "thickness")


def touching(walls: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """a, b, the names of a wall and one of others (keys, name, kind, x1, y1, x2, y2, thickness, reach) of the same keys and kind with nearly one direction, where both ends
    of b are within half of the thicker one of a's line, both overlap or touch along it, and an end of a is near b; of different names. Ends of walls meet the
    cells that other walls pass, by turns of direction."""
    parts = parts_of(walls)
    wall = F.struct("name", *ENDS, "thickness", *[u.alias(c) for u, c in zip(_unit(), ("ux", "uy"))]).alias("wall")  # roots are taken once a wall, not once a pair
    walls, others = (df.select(*keys, "kind", *ENDS, "reach", wall) for df in (walls, others))
    cell = lambda c: F.floor(F.col(c) / CELL_MM)
    at = [*keys, "kind", "turn", "cx", "cy"]
    angle = F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))) + TURN_DEG / 2  # level and upright ones in the middle of a turn
    turn = lambda more: F.pmod(F.floor((angle + more) / TURN_DEG), F.lit(round(180 / TURN_DEG)))
    turns = F.explode(F.array_distinct(F.array(turn(-ALIGN_DEG * 1.01), turn(ALIGN_DEG * 1.01)))).alias("turn")
    passed = crossed_cells(others.repartition(parts).withColumn("turn", turn(0.0)), ENDS, CELL_MM, 1.5 * F.col("reach") + 1).select(*at, F.col("wall").alias("b"))
    tip = F.inline(F.array(*[F.struct(F.col(f"x{i}").alias("tx"), F.col(f"y{i}").alias("ty")) for i in (1, 2)]))
    tips = walls.select("*", turns).select(*keys, "kind", "turn", "reach", F.col("wall").alias("a"), tip).withColumns({"cx": cell("tx"), "cy": cell("ty")})
    met = tips.repartition(parts, *at).join(passed, at).where("a.name <> b.name")
    low = lambda c: F.least(f"b.{c}1", f"b.{c}2") - F.col("reach")
    high = lambda c: F.greatest(f"b.{c}1", f"b.{c}2") + F.col("reach")
    near = (F.col("tx") >= low("x")) & (F.col("tx") <= high("x")) & (F.col("ty") >= low("y")) & (F.col("ty") <= high("y"))
    (ux, uy), (vx, vy) = ([F.col(f"{w}.{c}") for c in ("ux", "uy")] for w in "ab")
    limit = F.greatest("a.thickness", "b.thickness") / 2
    off = {(w, i): (F.col(f"{w}.x{i}") - F.col("a.x1"), F.col(f"{w}.y{i}") - F.col("a.y1")) for w in "ab" for i in (1, 2)}
    beside = lambda i: F.abs(off["b", i][0] * uy - off["b", i][1] * ux)
    straight = (F.abs(ux * vy - uy * vx) <= math.sin(math.radians(ALIGN_DEG))) & (beside(1) <= limit) & (beside(2) <= limit)
    along = {w: [off[w, i][0] * ux + off[w, i][1] * uy for i in (1, 2)] for w in "ab"}
    gap = F.greatest(F.least(*along["a"]), F.least(*along["b"])) - F.least(F.greatest(*along["a"]), F.greatest(*along["b"]))
    return met.where(near & straight & (gap <= TOUCH_MM)).select(*at, F.least("a.name", "b.name").alias("a"), F.greatest("a.name", "b.name").alias("b"))


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links a, b of a task as links of each name to one of its group; HELD names are held at once."""
    into: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := into.setdefault(x, x)) != x:
            into[x] = x = into[y]
        return x

    def links() -> pd.DataFrame:
        return pd.DataFrame([(r, x) for x in into if (r := root(x)) != x], columns=["a", "b"], dtype="int64")

    for batch in batches:
        for x, y in zip(batch["a"].tolist(), batch["b"].tolist()):
            x, y = root(x), root(y)
            into[max(x, y)] = min(x, y)
        if len(into) > HELD:
            yield links()
            into.clear()
    yield links()


def _grouped(names: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """id and component of names (id) by links (by, a, b), which are united where they lie near each other first, so that few rounds are left."""
    tile = [F.floor(F.col(c) / 16) for c in ("cx", "cy")]
    dealt = links.groupBy(*by, "a", "b").agg(F.min("cx").alias("cx"), F.min("cy").alias("cy")).repartition(parts_of(links), *by, *tile)
    united = kept(dealt.select("a", "b").mapInPandas(_united, "a long, b long"))
    found = kept(components(names, united))
    dropped(united)
    return found


def _stretches(rows: DataFrame, by: list[str], number: str) -> DataFrame:
    """rows (by, s, e) with the number of the stretch that each is in: a stretch ends where the next one of the same by begins more than TOUCH_MM on."""
    along = Window.partitionBy(*by).orderBy("s", "name")
    before = F.max("e").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("s") - before <= TOUCH_MM, 0).otherwise(1))
    return rows.withColumn(number, F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def _level_links(flat: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of level and upright walls (keys, PLACE, name): name and stretch, the least name of those on exactly one line without a gap, and the links a, b of stretches.

    Two of them touch where their lines are at most half of the thicker one apart and the gap along is small. What touches a wall of a stretch is what touches the
    stretch, so pairs are made of the stretches of each line and thickness with those of other lines, and not of walls."""
    upright = F.col("x1") == F.col("x2")
    own = F.when(upright, F.col("x1")).otherwise(F.col("y1"))
    begin, end = (F.when(upright, f("y1", "y2")).otherwise(f("x1", "x2")) for f in (F.least, F.greatest))
    line = [*keys, "kind", "upright", "at"]
    rows = flat.select(*keys, "kind", "name", "thickness", upright.alias("upright"), own.alias("at"), begin.alias("s"), end.alias("e"))
    rows = _stretches(rows, line, "i").withColumn("stretch", F.min("name").over(Window.partitionBy(*line, "i")))
    rows = kept(rows)
    whole = rows.groupBy(*line, "stretch").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    bands = _stretches(rows, [*line, "stretch", "thickness"], "j").groupBy(*line, "stretch", "thickness", "j").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    cell = lambda c: F.floor(c / CELL_MM)
    span = lambda low, high: F.explode(F.sequence(cell(low), cell(high)))
    half = F.col("thickness") / 2
    band = F.struct("stretch", "at", "s", "e", half.alias("half")).alias("a")
    a = bands.select(*keys, "kind", "upright", band, span(F.col("at") - half - 1, F.col("at") + half + 1).alias("cx"), "s", "e").select(*keys, "kind", "upright", "a", "cx", span(F.col("s") - TOUCH_MM - 1, F.col("e") + TOUCH_MM + 1).alias("cy"))
    b = whole.select(*keys, "kind", "upright", F.struct("stretch", "at", "s", "e").alias("b"), cell(F.col("at")).alias("cx"), span(F.col("s"), F.col("e")).alias("cy"))
    gap = F.greatest("a.s", "b.s") - F.least("a.e", "b.e")
    met = a.join(b, [*keys, "kind", "upright", "cx", "cy"]).where((F.col("a.stretch") != F.col("b.stretch")) & (F.abs(F.col("a.at") - F.col("b.at")) <= F.col("a.half")) & (gap <= TOUCH_MM))
    return rows.select("name", "stretch"), met.select(*keys, "kind", "cx", "cy", F.least("a.stretch", "b.stretch").alias("a"), F.greatest("a.stretch", "b.stretch").alias("b"))


def lines(walls: DataFrame, keys: list[str]) -> DataFrame:
    """node and line, the least node, of walls (keys, node, PLACE) that touch others, over others too. Walls of one place and thickness touch, so they are one first; level and
    upright ones are linked by stretches of their lines, and only what leans meets others wall by wall."""
    known = " and ".join([*[f"`{k}` is not null" for k in keys], "kind is not null", *[f"abs({c}) < double('infinity')" for c in (*ENDS, "thickness")]])
    reach = walls.groupBy(*keys).agg((TOUCH_MM + F.max("thickness") / 2).alias("reach"))
    thick = F.col("thickness") >= 0
    flat = ((F.col("x1") == F.col("x2")) | (F.col("y1") == F.col("y2"))) & thick
    put = {f"{c}{i}": F.when(flat, f(f"{c}1", f"{c}2")).otherwise(F.col(f"{c}{i}")) for c in "xy" for i, f in ((1, F.least), (2, F.greatest))}
    # a wall of less than no thickness touches none like itself
    rows = kept(walls.where(known).select(*keys, "node", *PLACE).withColumns(put | {"own": F.when(thick, -1).otherwise(F.col("node"))}))
    place = [*keys, *PLACE, "own"]
    once = kept(rows.groupBy(*place).agg(F.min("node").alias("name"), F.count("*").alias("n")).withColumn("leans", ~flat))
    stretch, links = _level_links(once.where("not leans"), keys)
    of = _grouped(stretch.select(F.col("stretch").alias("id")).distinct(), links, [*keys, "kind"]).withColumnRenamed("id", "stretch")
    first = stretch.join(of, "stretch").select("name", F.col("component").alias("one"))
    named = kept(once.join(first, "name", "left").withColumn("one", F.coalesce("one", "name")))
    asked = named.join(reach, keys).drop("name").withColumnRenamed("one", "name")
    askew = asked.where("leans")
    pairs = touching(askew, asked, keys).unionByName(touching(asked.where("not leans"), askew, keys))
    last = _grouped(named.select(F.col("one").alias("id")).distinct(), pairs, [*keys, "kind"]).withColumnsRenamed({"id": "one", "component": "line"})
    found = kept(named.join(last, "one"))
    many = found.groupBy("line").agg(F.sum("n").alias("n")).where("n > 1").select("line")
    out = rows.join(found.join(many, "line", "left_semi").select(*place, "line"), place).select("node", "line")
    out = kept(out)
    dropped(rows, once, stretch, of, named, last, found)
    return out


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers the runs of each line's walls, which come in order: a run ends where the usual thicknesses of its longer walls would differ too much."""
    line, run, least, most = None, 0, 0.0, 0.0
    for batch in batches:
        out = []
        for component, node, tier, long in zip(batch["line"], batch["node"], batch["tier"], batch["long"]):
            low, high = (min(least or tier, tier), max(most, tier)) if long else (least, most)
            if component == line and (not high or high <= TIER_RATIO * low):
                least, most = low, high
            else:
                line, run = component, 0 if component != line else run + 1
                least, most = (tier, tier) if long else (0.0, 0.0)
            out.append((component, node, run))
        yield pd.DataFrame(out, columns=["line", "node", "run"])


def runs(walls: DataFrame, keys: list[str]) -> DataFrame:
    """line, run, node of walls in a run of two or more. Walls: keys, node (a number that rises with their order), kind, ends, thickness, measured.

    Lines are components of touching walls; along each, by the nearer end on the line of its first wall, runs are cut by thickness. The rule of
    the cut looks at the run so far, so a task reads a line's walls one after the other, without holding them."""
    whole = kept(walls)
    of = lines(whole, keys)  # named by their first wall
    first = whole.select(F.col("node").alias("line"), F.struct(*ENDS).alias("f"))
    rows = whole.join(of, "node").join(first, "line")
    at = F.least(*[_along("f.", F.col(f"x{i}"), F.col(f"y{i}")) for i in (1, 2)])
    rows = rows.select("line", "node", at.alias("at"), usual_thickness(F.col("measured")).cast("double").alias("tier"), (_unit()[2] > SLIVER_MM).alias("long"))
    parts = int(walls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "line").sortWithinPartitions("line", "at", "node")
    found = kept(dealt.select("line", "node", "tier", "long").mapInPandas(_runs, "line long, node long, run long"))
    several = found.groupBy("line", "run").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    out = kept(found.join(several, ["line", "run"]))
    dropped(of, found)
    return out


def merged_runs(walls: DataFrame, openings: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """walls, openings and alias (keys, id, into) after the merge of runs.

    walls: keys, ord (their order), id, kind, ends, thickness, detected, source, reviewed, curve, confidence; openings: keys, id, wall, offset, width, swing. Only straight
    walls of a machine that nobody reviewed merge. The longest wall of a run gives id, kind and line, the weighted median of what was measured the thickness, the
    least confidence counts; an opening's offset is told from the new start, and where its wall ran the other way left and right change. A run stays as it was
    where it isn't straight as a whole or where openings would overlap or stick out. Nulls: a wall with one in its ends or thickness never merges, a null
    source or reviewed isn't a machine's, a null curve is straight."""
    walls, openings = kept(walls), kept(openings)
    order = kept(walls.select(*keys, "ord", "id").repartitionByRange(*keys, "ord", "id").sortWithinPartitions(*keys, "ord", "id").withColumn("node", F.monotonically_increasing_id()))
    usable = (F.col("source") == "ai") & ~F.coalesce("reviewed", F.lit(True)) & (F.coalesce("curve", F.lit(0)) == 0) & (_unit()[2] > 0) & F.col("thickness").isNotNull()
    able = kept(walls.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))).where(usable).join(order, [*keys, "ord", "id"]).withColumn("measured", F.when(F.coalesce("detected", F.lit(0)) != 0, F.col("detected")).otherwise(F.col("thickness")).cast("double")))
    of = runs(able, keys)
    run = ["line", "run"]
    rows = kept(able.join(of, "node").withColumn("size", _unit()[2]))
    # the longest, of walls as long the first along the line: that is the order in which runs came
    first = able.select(F.col("node").alias("line"), F.struct(*ENDS).alias("f"))
    at = F.least(*[_along("f.", F.col(f"x{i}"), F.col(f"y{i}")) for i in (1, 2)])
    placed = rows.join(first, "line").withColumn("at", at)
    lead = placed.groupBy(*run).agg(F.min(F.struct((-F.col("size")).alias("s"), "at", "node")).alias("best"), F.min("node").alias("spot")).select(*run, F.col("best.node").alias("lead"), "spot")
    lead = lead.join(able.select(F.col("node").alias("lead"), F.struct("id", "kind", *ENDS).alias("l")), "lead")
    both = kept(rows.join(lead, run))
    ends = [(F.col(f"x{i}"), F.col(f"y{i}")) for i in (1, 2)]
    off, low, high = F.greatest(*[_beside("l.", *p) for p in ends]), F.least(*[_along("l.", *p) for p in ends]), F.greatest(*[_along("l.", *p) for p in ends])
    shape = both.groupBy(*keys, *run, "lead", "spot", "l").agg(F.max(off).alias("off"), (F.max("thickness") / 2).alias("limit"), F.min(low).alias("low"), F.max(high).alias("high"), F.min("confidence").alias("confidence"), F.sum("size").alias("total"))
    weights = both.groupBy(*run, "measured").agg(F.sum("size").alias("w"))
    # lengths are sums of roots: half of them counts as half whatever their order
    upto = weights.withColumn("upto", F.sum("w").over(Window.partitionBy(*run).orderBy("measured")))  # a row for each thickness that was measured
    median = upto.join(shape.select(*run, "total"), run).where("upto >= total / 2 * (1 - 1e-9)").groupBy(*run).agg(F.min("measured").alias("median"))
    ux, uy, _ = _unit("l.")
    tip = lambda c, u, t: js_round(F.col(f"l.{c}1") + u * F.col(t)).cast("double")
    made = shape.where("off <= limit").join(median, run, "left").withColumns({"x1": tip("x", ux, "low"), "y1": tip("y", uy, "low"), "x2": tip("x", ux, "high"), "y2": tip("y", uy, "high")})
    made = kept(made)
    wx, wy, _ = _unit("m.")
    turned = wx * ux + wy * uy < 0
    member = both.select(*keys, *run, F.col("id").alias("wall"), F.struct(*ENDS).alias("m")).join(made.select(*run, "l", "low", "high", F.struct("x1", "y1").alias("s")), run)
    shift = (F.col("m.x1") - F.col("s.x1")) * ux + (F.col("m.y1") - F.col("s.y1")) * uy
    moved = openings.join(member, [*keys, "wall"])
    near = F.col("offset") + F.when(turned, F.col("width")).otherwise(0)
    offset = F.greatest(F.lit(0), js_round(F.when(turned, shift - near).otherwise(shift + near))).cast("long")
    swing = F.when(turned & (F.col("swing") == "left"), "right").when(turned & (F.col("swing") == "right"), "left").otherwise(F.col("swing"))
    moved = kept(moved.select(*keys, "id", *run, F.col("l.id").alias("wall"), offset.alias("offset"), "width", swing.alias("swing"), (F.col("high") - F.col("low")).alias("room")))
    before = F.lag(F.col("offset") + F.col("width")).over(Window.partitionBy(*run).orderBy("offset", "id"))
    last = F.col("offset") + F.col("width")
    bad = moved.withColumn("before", before).groupBy(*run).agg(F.max((F.col("before") > F.col("offset"))).alias("over"), F.max_by(last, F.struct("offset", "id")).alias("end"), F.first("room").alias("room"))
    bad = kept(bad.where(F.coalesce("over", F.lit(False)) | (F.col("end") > F.col("room"))).select(*run))
    good = kept(made.join(bad, run, "left_anti"))
    gone = both.join(good.select(*run), run, "left_semi").select(*keys, "id", F.col("l.id").alias("into"))
    columns = [*keys, "id", "kind", *ENDS, "thickness", "detected", "confidence"]
    new = good.select(*keys, F.col("l.id").alias("id"), F.col("l.kind").alias("kind"), *ENDS, usual_thickness(F.col("median")).cast("double").alias("thickness"), F.greatest(F.lit(1), js_round(F.col("median"))).cast("double").alias("detected"), "confidence")
    stay = walls.join(gone.select(*keys, "id"), [*keys, "id"], "left_anti").select(*[F.col(c).cast("double") if c in ("thickness", "detected") else c for c in columns])
    put = moved.join(good.select(*run), run, "left_semi").select(*keys, "id", "wall", "offset", "width", "swing")
    rest = openings.join(put.select(*keys, "id"), [*keys, "id"], "left_anti").select(*keys, "id", "wall", "offset", "width", "swing")
    return stay.unionByName(new), rest.unionByName(put), gone
