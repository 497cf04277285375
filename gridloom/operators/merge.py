"""A machine's walls merged into what people keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: How far both ends of a wall may be from those of a kept one, in mm; fixed value.
SAME_END_MM = 50


def twins(current: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, twin: walls (keys, id, x1, y1, x2, y2) of other that have the id of a wall of current, or both ends within SAME_END_MM of its ends,
    either way round; the least id of several. Both ends of a kept wall go to a grid of that width, those of the others to the cells around."""
    cell = lambda c: F.floor(F.col(c) / SAME_END_MM)
    ends = lambda a, b: F.struct(*[F.col(f"{c}{n}").alias(f"{c}{i}") for i, n in ((1, a), (2, b)) for c in "xy"])
    kept = current.select(*keys, F.col("id").alias("twin"), F.inline(F.array(ends(1, 2), ends(2, 1)))).withColumns({"cx": cell("x1"), "cy": cell("y1")})
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    own = other.select(*keys, "id", "x1", "y1", "x2", "y2", F.explode(F.transform(step, lambda i: cell("x1") + i)).alias("cx"), F.transform(step, lambda i: cell("y1") + i).alias("cy"))
    own = own.withColumn("cy", F.explode("cy")).withColumnsRenamed({c: f"o_{c}" for c in ("x1", "y1", "x2", "y2")})
    far = lambda n: (F.col(f"o_x{n}") - F.col(f"x{n}")) * (F.col(f"o_x{n}") - F.col(f"x{n}")) + (F.col(f"o_y{n}") - F.col(f"y{n}")) * (F.col(f"o_y{n}") - F.col(f"y{n}"))
    most = SAME_END_MM * SAME_END_MM
    near = own.join(kept, [*keys, "cx", "cy"]).where((far(1) <= most) & (far(2) <= most)).select(*keys, "id", "twin")
    same = other.join(current.select(*keys, "id"), [*keys, "id"], "left_semi").select(*keys, "id", F.col("id").alias("twin"))
    return near.unionByName(same).groupBy(*keys, "id").agg(F.min("twin").alias("twin"))


def merged(current: DataFrame, other: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, origin, twin: all of current (kept), and of other what is a duplicate of a kept wall (with its twin, to which references to it go),
    was removed by people (removed: keys, id; an id that is alive again does not count), or is added."""
    dead = removed.join(current.select(*keys, "id"), [*keys, "id"], "left_anti").select(*keys, "id").distinct().withColumn("_dead", F.lit(True))
    rows = other.select(*keys, "id").join(twins(current, other, keys), [*keys, "id"], "left").join(dead, [*keys, "id"], "left")
    origin = F.when(F.col("twin").isNotNull(), "duplicate").when(F.col("_dead"), "removed").otherwise("added")
    stay = current.select(*keys, "id", F.lit("kept").alias("origin"), F.lit(None).cast("long").alias("twin"))
    return stay.unionByName(rows.select(*keys, "id", origin.alias("origin"), "twin"))
