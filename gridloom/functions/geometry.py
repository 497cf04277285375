"""Plane geometry as column expressions. Outlines are arrays of struct<x, y>; lengths are whole millimetres."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Usual wall thicknesses in mm; fixed values.
THICKNESSES = (100, 150, 200, 220, 300, 400)


def js_round(x: Column) -> Column:
    """Half up, towards positive infinity."""
    return F.floor(x) + F.when(x - F.floor(x) >= 0.5, 1).otherwise(0)


def _edges(outline: Column) -> Column:
    """Each point with the next; the last with the first."""
    follow = F.concat(F.slice(outline, 2, F.greatest(F.size(outline) - 1, F.lit(0))), F.slice(outline, 1, 1))
    return F.arrays_zip(outline.alias("p"), follow.alias("q"))


def doubled_area(outline: Column) -> Column:
    """Twice the signed area, exact; 0 for fewer than 3 points."""
    wide = lambda c: c.cast("decimal(16,0)")
    cross = lambda e: wide(e["p"]["x"]) * wide(e["q"]["y"]) - wide(e["q"]["x"]) * wide(e["p"]["y"])
    total = F.aggregate(_edges(outline), F.lit(0).cast("decimal(38,0)"), lambda n, e: (n + cross(e)).cast("decimal(38,0)"))
    return F.when(F.size(outline) < 3, F.lit(0).cast("decimal(38,0)")).otherwise(total)


def area_m2(outline: Column) -> Column:
    """Square metres, rounded once to two places."""
    return js_round(F.abs(doubled_area(outline)).cast("double") / 2 / 1e6 * 100) / 100


def contains(outline: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the east crosses the outline an odd number of times."""
    def crosses(e: Column) -> Column:
        (x1, y1), (x2, y2) = ((e[k]["x"].cast("double"), e[k]["y"].cast("double")) for k in ("p", "q"))
        return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)

    return F.size(F.filter(_edges(outline), crosses)) % 2 == 1


def bounds(outline: Column) -> Column:
    xs, ys = F.transform(outline, lambda p: p["x"]), F.transform(outline, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Overlap over union of boxes x1, y1, x2, y2; 0 for an empty union."""
    side = lambda k: F.greatest(F.least(a[f"{k}2"], b[f"{k}2"]) - F.greatest(a[f"{k}1"], b[f"{k}1"]), F.lit(0))
    size = lambda o: (o["x2"] - o["x1"]) * (o["y2"] - o["y1"])
    both = side("x") * side("y")
    union = size(a) + size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def iou_of(a: tuple, b: tuple) -> float:
    """The same for two tuples in a Python worker."""
    both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def usual_thickness(mm: Column) -> Column:
    """The nearest usual thickness, the smaller of two as near."""
    near = F.array(*[F.struct(F.abs(mm - t).alias("off"), F.lit(t).alias("t")) for t in THICKNESSES])
    return F.when(mm.isNotNull(), F.array_min(near)["t"])


def foot_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / length))).otherwise(0.0)
    return F.hypot(x - x1 - t * dx, y - y1 - t * dy)


#: Sums of doubled areas beyond this are not exact in a double; fixed value.
EXACT = (1 << 53) - 1
#: Points closer than this many pixels are one, and how far beside a wall its sides are probed, in mm; fixed values.
MERGE_PX, PROBE_MM = 3.0, 150


def exact_area(outline: Column) -> Column:
    """The doubled signed area, or null where it is too large to be exact in a double."""
    n = doubled_area(outline)
    return F.when(F.abs(n) <= EXACT, n)


def centroid(outline: Column) -> Column:
    """The centre of area as struct<x, y>, or the mean of the points where the area is next to nothing."""
    cross = lambda e: e["p"]["x"].cast("double") * e["q"]["y"] - e["q"]["x"].cast("double") * e["p"]["y"]
    total = lambda k: F.aggregate(_edges(outline), F.lit(0.0), lambda n, e: n + (e["p"][k] + e["q"][k]) * cross(e))
    mean = lambda k: F.aggregate(outline, F.lit(0.0), lambda n, p: n + p[k]) / F.size(outline)
    area = F.aggregate(_edges(outline), F.lit(0.0), lambda n, e: n + cross(e))
    return F.struct(*[F.when(F.abs(area) > 0.001, total(k) / (3 * area)).otherwise(mean(k)).alias(k) for k in ("x", "y")])


def chord(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def arc_sweep(x1: Column, y1: Column, x2: Column, y2: Column, sagitta: Column) -> Column:
    """The angle of an arc over a chord, in radians; a sagitta beyond half the chord counts as half."""
    length = chord(x1, y1, x2, y2)
    return 4 * F.atan(2 * F.least(F.abs(sagitta), length / 2) / length)


def arc_shape(x1: Column, y1: Column, x2: Column, y2: Column, sagitta: Column, step_deg: float | Column = 5.0) -> Column:
    """cx, cy, radius, begin, turn (the signed sweep) and count (an even number of equal steps) of an arc; for on_arc()."""
    length, sign = chord(x1, y1, x2, y2), F.signum(sagitta)
    depth = F.least(F.abs(sagitta), length / 2)
    radius = length * length / (8 * depth) + depth / 2
    cx, cy = (x1 + x2) / 2 - (y2 - y1) / length * (radius - depth) * sign, (y1 + y2) / 2 + (x2 - x1) / length * (radius - depth) * sign
    begin, sweep = F.atan2(y1 - cy, x1 - cx), arc_sweep(x1, y1, x2, y2, sagitta)
    count = 2 * F.greatest(F.lit(1), F.ceil(F.degrees(sweep) / (2 * step_deg))).cast("int")
    return F.struct(cx.alias("cx"), cy.alias("cy"), radius.alias("radius"), begin.alias("begin"), (sign * sweep).alias("turn"), count.alias("count"))


def on_arc(arc: Column, k: Column) -> Column:
    """The point after k of the steps of an arc_shape()."""
    angle = arc["begin"] + arc["turn"] * k / arc["count"]
    return F.struct((arc["cx"] + arc["radius"] * F.cos(angle)).alias("x"), (arc["cy"] + arc["radius"] * F.sin(angle)).alias("y"))


def arc_points(x1: Column, y1: Column, x2: Column, y2: Column, sagitta: Column, step_deg: float = 5.0) -> Column:
    """Points at equal angles on the arc with both ends, an even number of steps; the two ends of a straight wall."""
    end = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    straight = (sagitta == 0) | ((x1 == x2) & (y1 == y2))
    # the shape as an array of one, so that it is reckoned once and not again for every point
    inner = F.flatten(F.transform(F.array(arc_shape(x1, y1, x2, y2, sagitta, step_deg)), lambda a: F.transform(F.sequence(F.lit(1), a["count"] - 1), lambda k: on_arc(a, k))))
    return F.when(straight, F.array(end(x1, y1), end(x2, y2))).otherwise(F.concat(F.array(end(x1, y1)), inner, F.array(end(x2, y2))))


def sagitta_through(x1: Column, y1: Column, ax: Column, ay: Column, x2: Column, y2: Column) -> Column:
    """The signed sagitta of the chord whose arc has its middle at (ax, ay)."""
    length = chord(x1, y1, x2, y2)
    return -((ax - (x1 + x2) / 2) * -(y2 - y1) / length + (ay - (y1 + y2) / 2) * (x2 - x1) / length)


def crossing_shares(a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column, Column]:
    """How far along each of two segments (x1, y1, x2, y2) their lines meet, and the product of their vectors, next to 0 for parallel ones."""
    rx, ry, sx, sy = a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]
    across = rx * sy - ry * sx
    t = F.try_divide((b["x1"] - a["x1"]) * sy - (b["y1"] - a["y1"]) * sx, across)
    u = F.try_divide((b["x1"] - a["x1"]) * ry - (b["y1"] - a["y1"]) * rx, across)
    return t, u, across


def within_slack(v: Column, of: dict[str, Column], slack: float = MERGE_PX) -> Column:
    """Whether a share of a segment lies on it or misses its ends by slack at most."""
    length = F.greatest(F.hypot(of["x2"] - of["x1"], of["y2"] - of["y1"]), F.lit(1e-9))
    return (v >= -slack / length) & (v <= 1 + slack / length)


def crossing_place(a: dict[str, Column], t: Column) -> Column:
    return F.struct((a["x1"] + t * (a["x2"] - a["x1"])).alias("x"), (a["y1"] + t * (a["y2"] - a["y1"])).alias("y"))


def crossing(a: dict[str, Column], b: dict[str, Column], slack: float = MERGE_PX) -> Column:
    """Where two segments (x1, y1, x2, y2) meet, ends that miss by slack at most included; null for parallel ones."""
    t, u, across = crossing_shares(a, b)
    return F.when(F.abs(across) >= 1e-9, F.when(within_slack(t, a, slack) & within_slack(u, b, slack), crossing_place(a, t)))


def world_box(x1: Column, y1: Column, x2: Column, y2: Column, rotation: Column) -> Column:
    """A box of whole numbers in the world: a quarter turn swaps its sides around the centre."""
    w, d = x2 - x1, y2 - y1
    x, y = F.floor((x1 + x2 - d) / 2), F.floor((y1 + y2 - w) / 2)
    turned = F.struct(x.alias("x1"), y.alias("y1"), (x + d).alias("x2"), (y + w).alias("y2"))
    plain = F.struct(*[c.cast("long").alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])
    return F.when(F.pmod(rotation, F.lit(180)) == 90, turned).otherwise(plain)


def box_gap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The distance between two boxes, 0 where they overlap."""
    side = lambda k: F.greatest(F.lit(0.0), b[f"{k}1"] - a[f"{k}2"], a[f"{k}1"] - b[f"{k}2"])
    return F.hypot(side("x"), side("y"))


def box_iom(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Overlap over the smaller box; 0 where that is empty."""
    side = lambda k: F.greatest(F.least(a[f"{k}2"], b[f"{k}2"]) - F.greatest(a[f"{k}1"], b[f"{k}1"]), F.lit(0))
    size = lambda o: (o["x2"] - o["x1"]) * (o["y2"] - o["y1"])
    least = F.least(size(a), size(b))
    return F.when(least > 0, side("x") * side("y") / least).otherwise(0.0)


def wall_probes(x1: Column, y1: Column, x2: Column, y2: Column, thickness: Column, bulge: Column) -> Column:
    """Two points beside the middle of a wall (or of its arc), one on each side, PROBE_MM beyond its faces."""
    dx, dy, length = x2 - x1, y2 - y1, chord(x1, y1, x2, y2)
    mx, my = (x1 + x2) / 2 + dy * bulge / length, (y1 + y2) / 2 - dx * bulge / length
    reach = thickness / 2 + PROBE_MM
    return F.array(*[F.struct((mx - s * dy / length * reach).alias("x"), (my + s * dx / length * reach).alias("y")) for s in (1, -1)])


def wall_side(inside: Column) -> Column:
    """What the number of probes inside a room tells of a wall."""
    return F.when(inside == 0, "unknown").when(inside == 1, "exterior").otherwise("interior")


def mask_overlap(a: Column, b: Column) -> Column:
    """Cells set in both and in either of two arrays of booleans, as struct<both, either>."""
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: x & y), lambda x: x))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: x | y), lambda x: x))
    return F.struct(both.cast("long").alias("both"), either.cast("long").alias("either"))


def tile_windows(width: Column, height: Column, tile: int, overlap: int) -> Column:
    """Corners (x, y) of windows that cover a picture: steps of tile less overlap, the last moved back to the edge."""
    starts = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((n - tile) / (tile - overlap)), F.lit(0)).cast("int")), lambda i: F.greatest(F.least(i * (tile - overlap), n - tile), F.lit(0))))
    return F.flatten(F.transform(starts(height), lambda y: F.transform(starts(width), lambda x: F.struct(x.alias("x"), y.alias("y")))))
