"""Curved walls as chords, and chords of one arc as a curved wall again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.geometry import arc_shape, chord, js_round, on_arc, sagitta_through
from ..sources.tables import kept

#: Degrees of a chord at least, and how many thicknesses it is long at least; fixed values.
STEP_DEG, LEAST_CHORD = 5.0, 1.5
ENDS = ("x1", "y1", "x2", "y2")


def exploded(walls: DataFrame, keys: list[str]) -> DataFrame:
    """keys, arc (the wall's id), number, count, ends: the chords, an even number, of each curved wall (keys, id, ends, thickness, sagitta), and straight walls as
    they are, with count 1. A null sagitta is straight; a wall with a null end has null ends."""
    rows = walls.withColumn("sagitta", F.coalesce(F.col("sagitta").cast("double"), F.lit(0.0)))
    length, depth = chord(*[F.col(c) for c in ENDS]), F.abs("sagitta")
    radius = length * length / (8 * depth) + depth / 2
    step = F.greatest(F.lit(STEP_DEG), F.degrees(LEAST_CHORD * F.col("thickness") / radius))
    ends = [F.col(c).cast("double") for c in ENDS]
    # reckoned once a wall; then each chord is a row of its own, so nothing is reckoned again for every point
    curved = (F.col("sagitta") != 0) & (length > 0)
    rows = rows.select(*keys, "id", *ENDS, F.explode(F.array(F.when(curved, arc_shape(*ends, F.col("sagitta"), step)))).alias("arc"))
    rows = rows.withColumn("number", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("arc.count") - 1, F.lit(0)))))
    n = F.col("number")
    first, last = F.struct(ends[0].alias("x"), ends[1].alias("y")), F.struct(ends[2].alias("x"), ends[3].alias("y"))
    point = lambda k: F.when(k == 0, first).when(k == F.col("arc.count"), last).otherwise(on_arc(F.col("arc"), k))
    put = rows.withColumns({"p": point(n), "q": point(n + 1)})
    tips = zip(ENDS, (F.col("p.x"), F.col("p.y"), F.col("q.x"), F.col("q.y")), ends)
    return put.select(*keys, F.col("id").alias("arc"), "number", F.coalesce("arc.count", F.lit(1)).alias("count"), *[F.when(F.col("arc").isNotNull(), F.greatest(F.lit(0.0), made)).otherwise(own).alias(c) for c, made, own in tips])


def joined(pieces: DataFrame, openings: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """walls (keys, id, ends, curve, thickness, confidence), openings (keys, id, wall, offset) and alias (keys, id, into) after chords of one arc became a wall.

    pieces: keys, arc, number, count, id, ends in whole mm, thickness, confidence. An arc becomes one wall where all its chords, an even number, are still there once each and
    every one begins where the one before ends; else its chords stay. The first chord gives id and thickness, the middle point the curve, of half the chord at most, lengths
    weigh the confidence, and offsets count from the arc's begin. Rows with a null arc, number or end stay as they are."""
    pieces, openings = kept(pieces), kept(openings)
    known = pieces.where("arc is not null and number is not null and count > 1 and x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    row = F.struct("number", "id", *[F.col(c).cast("double").alias(c) for c in ENDS], "thickness", F.coalesce("confidence", F.lit(0.0)).cast("double").alias("confidence"), chord(*[F.col(c).cast("double") for c in ENDS]).alias("size"))
    arcs = known.groupBy(*keys, "arc").agg(F.max("count").alias("count"), F.count("*").alias("there")).where("there = count and count % 2 = 0")
    held = known.join(arcs.select(*keys, "arc"), [*keys, "arc"], "left_semi").groupBy(*keys, "arc").agg(F.array_sort(F.collect_list(row)).alias("p"), F.count_distinct("number").alias("numbers"))  # as many chords as an arc has degrees, at most
    p = F.col("p")
    follows = F.forall(F.sequence(F.lit(1), F.size(p) - 1), lambda i: (p[i]["x1"] == p[i - 1]["x2"]) & (p[i]["y1"] == p[i - 1]["y2"]))
    held = kept(held.where((F.col("numbers") == F.size(p)) & follows))
    first, last, middle = p[0], F.element_at(p, -1), F.element_at(p, F.floor(F.size(p) / 2).cast("int") + 1)
    half = F.floor(chord(first["x1"], first["y1"], last["x2"], last["y2"]) / 2)
    bend = js_round(sagitta_through(first["x1"], first["y1"], middle["x1"], middle["y1"], last["x2"], last["y2"]))
    total = lambda f: F.aggregate(p, F.lit(0.0), lambda n, x: n + f(x))
    sure = F.round(total(lambda x: x["confidence"] * x["size"]) / total(lambda x: x["size"]), 3)
    new = held.select(*keys, first["id"].alias("id"), first["x1"].alias("x1"), first["y1"].alias("y1"), last["x2"].alias("x2"), last["y2"].alias("y2"), F.greatest(-half, F.least(half, bend)).cast("double").alias("curve"), first["thickness"].alias("thickness"), sure.alias("confidence"))
    chords = held.select(*keys, first["id"].alias("into"), F.inline("p")).select(*keys, "into", "id", "number", "size")
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*keys, "into").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    chords = kept(chords.withColumn("before", before))
    rest = pieces.join(chords.select(*keys, "id"), [*keys, "id"], "left_anti")
    stay = rest.select(*keys, "id", *[F.col(c).cast("double").alias(c) for c in ENDS], F.lit(0.0).alias("curve"), "thickness", F.col("confidence").cast("double").alias("confidence"))
    moved = openings.join(chords.select(*keys, F.col("id").alias("wall"), "into", "before"), [*keys, "wall"], "left")
    offset = F.when(F.col("into").isNotNull(), js_round(F.col("offset") + F.col("before"))).otherwise(F.col("offset")).cast("long")
    put = moved.select(*keys, "id", F.coalesce("into", "wall").alias("wall"), offset.alias("offset"))
    return stay.unionByName(new), put, chords.select(*keys, "id", "into")
