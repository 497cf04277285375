"""Clear areas of rooms: outlines moved inwards by half of the walls that stand on their edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import doubled_area, js_round
from .spatial import crossed_cells

#: A wall stands on an edge up to this sine between both; a corner is none up to this one; fixed values.
PARALLEL_SIN, COLLINEAR_SIN = 0.09, 0.01
#: Width in mm of the cells by which edges meet walls.
CELL_MM = 2000.0


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _at(ring: Column, i: Column) -> Column:
    """An entry of a ring by its number from 0, which may run over either end."""
    return F.element_at(ring, F.pmod(i, F.size(ring)).cast("int") + 1)


def _without(ring: Column, i: Column) -> Column:
    """A ring without its entry i, from 0."""
    return F.concat(F.slice(ring, 1, i), F.slice(ring, i + 2, F.size(ring)))


def _first(ring: Column, holds) -> Column:
    """The number from 0 of the first entry for which holds(i), -1 without one."""
    numbers = F.sequence(F.lit(0), F.size(ring) - 1)
    return F.coalesce(F.get(F.filter(numbers, holds), F.lit(0)), F.lit(-1))


def joined_corners(outline: Column) -> Column:
    """An outline without repeated and straight corners, as long as more than three are left: the first such corner goes, then
    the first of what is left."""
    def straight(ring: Column, i: Column) -> Column:
        a, b, c = _at(ring, i - 1), _at(ring, i), _at(ring, i + 1)
        turn = F.struct((b["x"] - a["x"]).alias("ux"), (b["y"] - a["y"]).alias("uy"), (c["x"] - b["x"]).alias("vx"), (c["y"] - b["y"]).alias("vy"))
        return _let(turn, lambda t: F.abs(t["ux"] * t["vy"] - t["uy"] * t["vx"]) <= COLLINEAR_SIN * F.hypot(t["ux"], t["uy"]) * F.hypot(t["vx"], t["vy"]))

    def step(ring: Column, _: Column) -> Column:
        return _let(_first(ring, lambda i: straight(ring, i)), lambda found: F.when((F.size(ring) > 3) & (found >= 0), _without(ring, found)).otherwise(ring))

    plain = F.transform(outline, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(outline), F.lit(1))), plain, step)


def _corner(ring: Column, i: Column) -> Column:
    """Where the moved line i meets the one before; null where they are parallel."""
    def meet(two: Column) -> Column:
        p, q = two["p"], two["q"]
        t = F.try_divide((q["x"] - p["x"]) * q["uy"] - (q["y"] - p["y"]) * q["ux"], p["ux"] * q["uy"] - p["uy"] * q["ux"])
        return _let(t, lambda t: F.struct((p["x"] + p["ux"] * t).alias("x"), (p["y"] + p["uy"] * t).alias("y")))

    return _let(F.struct(_at(ring, i - 1).alias("p"), _at(ring, i).alias("q")), meet)


def inner_ring(lines: Column) -> Column:
    """The corners of a ring of moved lines (a point x, y and a direction ux, uy). An edge that has turned round between two that aren't parallel goes, the
    first one first, and both sides meet anew; null where fewer than three are left."""
    def turned(ring: Column, i: Column) -> Column:
        def back(edge: Column) -> Column:
            line, before, after = edge["line"], edge["before"], edge["after"]
            turns = (edge["b"]["x"] - edge["a"]["x"]) * line["ux"] + (edge["b"]["y"] - edge["a"]["y"]) * line["uy"] < 0
            return turns & (F.abs(before["ux"] * after["uy"] - before["uy"] * after["ux"]) > COLLINEAR_SIN)

        return _let(F.struct(_at(ring, i).alias("line"), _at(ring, i - 1).alias("before"), _at(ring, i + 1).alias("after"), _corner(ring, i).alias("a"), _corner(ring, i + 1).alias("b")), back)

    def step(ring: Column, _: Column) -> Column:
        return _let(_first(ring, lambda i: turned(ring, i)), lambda found: F.when((F.size(ring) >= 3) & (found >= 0), _without(ring, found)).otherwise(ring))

    left = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lines, step)
    corners = lambda ring: F.transform(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: _corner(ring, i))
    return _let(left, lambda ring: F.when(F.size(ring) >= 3, corners(ring)))


def half_thicknesses(edges: DataFrame, walls: DataFrame, keys: list[str]) -> DataFrame:
    """keys, room, edge, half: for edges (keys, room, edge, x1, y1, x2, y2) half the thickness of the wall (keys, id, x1, y1, x2, y2, thickness) of the same
    keys that is parallel, has its middle within its thickness of the edge's line, and runs longest beside it; the smaller id of two as long. Edges
    without such a wall are left out. Walls go to the cells that any edge they stand on must cross. Edges of one place are one, and so are walls of
    one place and thickness, by their smallest id; level and upright ones are kept apart."""
    ends = ["x1", "y1", "x2", "y2"]
    places = edges.select(*keys, *ends).distinct()
    walls = walls.groupBy(*keys, *ends, "thickness").agg(F.min("id").alias("id"))
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    places = places.withColumn("flat", dy <= dx)
    # beyond 45 degrees by more than the sine's angle a wall is beside no edge of that kind
    walls = walls.withColumn("flat", F.explode(F.filter(F.array(F.when(dy <= dx * 1.25, True), F.when(dx <= dy * 1.25, False)), lambda v: v.isNotNull())))
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    reach = F.col("thickness") + length * (PARALLEL_SIN / 2)
    near = crossed_cells(walls, ("x1", "y1", "x2", "y2"), CELL_MM, reach).select(*keys, "flat", "cx", "cy", F.struct("id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "thickness")]).alias("w"))
    own = crossed_cells(places, ("x1", "y1", "x2", "y2"), CELL_MM)
    met = own.join(near, [*keys, "flat", "cx", "cy"])
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    ux, uy = (F.col("x2") - F.col("x1")) / size, (F.col("y2") - F.col("y1")) / size
    wx, wy = F.col("w.x2") - F.col("w.x1"), F.col("w.y2") - F.col("w.y1")
    beside = F.abs(ux * wy - uy * wx) <= PARALLEL_SIN * F.hypot(wx, wy)
    mid = F.abs(ux * ((F.col("w.y1") + F.col("w.y2")) / 2 - F.col("y1")) - uy * ((F.col("w.x1") + F.col("w.x2")) / 2 - F.col("x1")))
    along = lambda i: ux * (F.col(f"w.x{i}") - F.col("x1")) + uy * (F.col(f"w.y{i}") - F.col("y1"))
    overlap = F.least(F.greatest(along(1), along(2)), size) - F.greatest(F.least(along(1), along(2)), F.lit(0.0))
    found = met.where((size > 0) & beside & (mid <= F.col("w.thickness"))).withColumn("overlap", overlap).where("overlap > 0")
    best = F.min(F.struct((-F.col("overlap")).alias("o"), F.col("w.id").alias("id"), (F.col("w.thickness") / 2).alias("half"))).alias("best")
    halves = found.groupBy(*keys, *ends).agg(best).select(*keys, *ends, "best.half")
    return edges.join(halves, [*keys, *ends]).select(*keys, "room", "edge", "half")


def clear_areas(rooms: DataFrame, walls: DataFrame, keys: list[str]) -> DataFrame:
    """keys, room, gross, clear in square metres of rooms (keys, room, outline): clear is the area within the faces of the walls, null where it can't be told.

    Edges without a wall move by half the median thickness of the walls of the same keys, not at all where there are none. An outline without an
    area has clear 0; null outlines, fewer than three corners and results that are not positive or larger than the gross area give null. Walls with a null
    stand nowhere."""
    known = walls.where("x1 is not null and y1 is not null and x2 is not null and y2 is not null and thickness is not null")
    middle = known.groupBy(*keys).agg((F.percentile(F.col("thickness"), F.lit(0.5)) / 2).alias("usual"))  # counts of distinct thicknesses
    rings = rooms.select(*keys, "room", "outline", doubled_area(F.col("outline")).cast("double").alias("doubled")).withColumn("ring", F.when(F.col("doubled") != 0, joined_corners(F.col("outline"))))
    follow = F.transform(F.col("ring"), lambda p, i: F.struct(i.alias("edge"), p.alias("p"), _at(F.col("ring"), i + 1).alias("q")))
    edges = rings.where("doubled <> 0").select(*keys, "room", "doubled", F.inline(follow))
    edges = edges.select(*keys, "room", "doubled", "edge", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))
    found = half_thicknesses(edges, known, keys)
    lined = edges.join(found, [*keys, "room", "edge"], "left").join(middle, keys, "left")
    half = F.coalesce("half", "usual", F.lit(0.0))
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    ux, uy, sign = F.try_divide(F.col("x2") - F.col("x1"), size), F.try_divide(F.col("y2") - F.col("y1"), size), F.signum("doubled")
    line = F.struct("edge", (F.col("x1") - sign * uy * half).alias("x"), (F.col("y1") + sign * ux * half).alias("y"), ux.alias("ux"), uy.alias("uy"))
    lines = lined.groupBy(*keys, "room").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # of one outline
    inner = rings.join(lines, [*keys, "room"], "left").withColumn("inner", inner_ring(F.col("lines")))
    cross = lambda ring, i: _at(ring, i)["x"] * _at(ring, i + 1)["y"] - _at(ring, i + 1)["x"] * _at(ring, i)["y"]
    doubled = lambda ring: F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), F.lit(0.0), lambda n, i: n + cross(ring, i))
    net = _let(F.col("inner"), lambda ring: F.when(ring.isNotNull(), doubled(ring))) / 2 * F.signum("doubled")
    whole = F.abs("doubled") / 2
    m2 = lambda v: js_round(v / 1e6 * 100) / 100
    # corners are computed, so an area that is the whole one may come out a little larger
    clear = F.when(F.col("doubled") == 0, F.lit(0.0)).otherwise(_let(net, lambda n: F.when((n > 0) & (n <= whole * (1 + 1e-9)), m2(n))))
    return inner.select(*keys, "room", m2(whole).alias("gross"), clear.alias("clear"))
