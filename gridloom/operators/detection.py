"""Measures of detectors: one-to-one matches by overlap, average precision, suppression, decoding of character scores.

Greedy rules run in rounds of Spark joins: what is best for both sides is settled, then the rest again, each round written."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import box_iou
from ..sources.tables import dropped, kept
from .graph import ROUNDS, beaten, in_order, named
from .keyed import running
from .spatial import SUPPRESS_IOU, parts_of

#: A match needs this overlap; recall is read at so many points; fixed values.
MATCH_IOU, POINTS = 0.5, 101
SIDES = ("x1", "y1", "x2", "y2")


def _solid(boxes: DataFrame) -> DataFrame:
    """Boxes with an area, and the level of their longer side: the next power of two."""
    size = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return boxes.where("x1 < x2 and y1 < y2").withColumn("_level", F.ceil(F.log2(size)).cast("int"))


def centred(small: DataFrame, big: DataFrame, keys: list[str], names: tuple[str, str] = ("l", "r")) -> DataFrame:
    """keys and both rows as structs of boxes of the same keys where the middle of one of small lies in one of big, and on its border by rounding. A box that shares half of
    its area or more with another has its middle there, so these are all pairs of which the smaller one does. Boxes of big cover cells of a quarter of their level (see
    overlaps), and a middle goes to one cell of each level that a box sharing half of each side may have."""
    small, big = _solid(small), _solid(big)
    levels = [r[0] for r in big.select("_level").distinct().collect()]  # powers of two of doubles, some hundred at most
    every = F.array(*[F.lit(n) for n in levels]) if levels else F.array().cast("array<int>")
    cell = lambda n: F.pow(F.lit(2.0), n - 2)
    row = lambda df, name: F.struct(*[c for c in df.columns if c != "_level"]).alias(name)
    middle = lambda c: (F.col(f"{c}1") + F.col(f"{c}2")) / 2
    points = small.select(*keys, row(small, names[0]), middle("x").alias("_mx"), middle("y").alias("_my"), F.explode(F.filter(every, lambda n: n >= F.col("_level") - 1)).alias("_at"))
    points = points.withColumns({f"_c{c}": F.floor(F.col(f"_m{c}") / cell(F.col("_at"))) for c in "xy"})
    pad = 1e-6 * cell(F.col("_level"))
    edge = [(F.col(c) + (pad if c.endswith("2") else -pad)).alias(f"_{c}") for c in SIDES]
    covers = big.select(*keys, row(big, names[1]), F.col("_level").alias("_at"), *edge)
    at = lambda c: F.floor(F.col(c) / cell(F.col("_at")))
    covers = covers.withColumn("_cx", F.explode(F.sequence(at("_x1"), at("_x2")))).withColumn("_cy", F.explode(F.sequence(at("_y1"), at("_y2"))))
    # few bytes make many pairs, so the cells are dealt whatever their size
    cells = [*keys, "_at", "_cx", "_cy"]
    met = points.repartition(parts_of(points), *cells).join(covers, cells).where("_mx >= _x1 and _mx <= _x2 and _my >= _y1 and _my <= _y2")
    return met.select(*keys, *names)


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], iou: float) -> DataFrame:
    """keys, l and r (their rows as structs) and iou of boxes of the same keys that share an area and overlap as much. Each box has the level of
    its own longer side, a power of two, and covers at most four cells of that level; the smaller of two also goes to the cells of the larger one's
    level, so that a box as large as a page doesn't make one cell of all others. From an iou of a half on the smaller one's middle is in the other, and only such pairs
    are looked at (see centred). Boxes with a null or an empty area overlap nothing."""
    found = box_iou({s: F.col(f"l.{s}") for s in SIDES}, {s: F.col(f"r.{s}") for s in SIDES})
    if iou >= 0.5:
        area = lambda x: (F.col(f"{x}.x2") - F.col(f"{x}.x1")) * (F.col(f"{x}.y2") - F.col(f"{x}.y1"))
        met = centred(left, right, keys).where(area("l") <= area("r")).unionByName(centred(right, left, keys, ("r", "l")).where(area("r") < area("l")))
        return met.withColumn("iou", found).where(F.col("iou") >= iou).select(*keys, "l", "r", "iou")
    left, right = _solid(left), _solid(right)
    levels = [r[0] for r in left.select("_level").unionByName(right.select("_level")).distinct().collect()]  # powers of two of doubles, some hundred at most
    every = F.array(*[F.lit(n) for n in levels]) if levels else F.array().cast("array<int>")
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "_at"))

    def dealt(df: DataFrame, name: str, own: bool | None) -> DataFrame:
        """The cells of a box's own level, of the coarser ones, or (None) of all."""
        row = F.struct(*[c for c in df.columns if c != "_level"]).alias(name)
        deep = {True: F.array("_level"), False: F.filter(every, lambda n: n > F.col("_level")), None: F.filter(every, lambda n: n >= F.col("_level"))}[own]
        rows = df.select(*keys, row, *SIDES, F.explode(deep).alias("_at"))
        rows = rows.select(*keys, name, "_at", F.explode(F.sequence(at("x1"), at("x2"))).alias("_cx"), F.sequence(at("y1"), at("y2")).alias("_cy"))
        return rows.withColumn("_cy", F.explode("_cy"))

    cell = [*keys, "_at", "_cx", "_cy"]
    met = dealt(left, "l", True).join(dealt(right, "r", None), cell).unionByName(dealt(left, "l", False).join(dealt(right, "r", True), cell))
    corner = lambda c: F.floor(F.greatest(f"l.{c}", f"r.{c}") / F.pow(F.lit(2.0), "_at"))
    met = met.where((corner("x1") == F.col("_cx")) & (corner("y1") == F.col("_cy"))).withColumn("iou", found)
    return met.where((F.col("iou") >= iou) & (F.col("iou") > 0)).select(*keys, "l", "r", "iou")


def _first_free() -> Callable:
    """Pairs (a, b) by rank and falling worth: each a takes its first free b. Gives the pair's number."""
    taken, served = set(), set()

    def step(a: int, b: int, pair: int) -> int | None:
        if a in served or b in taken:
            return None
        served.add(a)
        taken.add(b)
        return pair

    return step


def one_to_one(pairs: DataFrame) -> DataFrame:
    """a, b of the pairs (a, b, rank, worth) that a greedy pass takes: a by rising rank, each the free b of most worth, the smaller b of
    two. rank and b are unique. In each of the first rounds every a that no earlier one competes with for its best b takes it; then components are
    settled, large ones by more rounds. A round writes what is taken and deletes the pairs before it."""
    rows = kept(pairs.select("a", "b", "rank", "worth").withColumn("pair", F.monotonically_increasing_id()))
    open_, ids = named(rows.select("a", F.col("b").alias("which"), "b", "rank", "worth", "pair"), ("a", "b"))
    taken, rounds = [], 0
    while not open_.isEmpty():
        if rounds == ROUNDS:
            done, open_ = in_order(open_, ("a", "b"), ["rank", F.desc("worth"), "which"], ["a", "b", "pair"], _first_free, "pair")
            taken.append(done)
        rounds = (rounds + 1) % (4 * ROUNDS)
        first = open_.groupBy("b").agg(F.min("rank").alias("first"))  # the earliest that may want b
        best = open_.groupBy("a", "rank").agg(F.min(F.struct((-F.col("worth")).alias("worth"), "which", "b", "pair")).alias("best"))
        won = kept(best.select("a", "rank", "best.b", "best.pair").join(first, "b").where("rank = first").select("a", "b", "pair"))
        taken.append(won.select("pair"))
        rest = kept(open_.join(won.select("a"), "a", "left_anti").join(won.select("b"), "b", "left_anti"))
        dropped(open_)
        open_ = rest
    return rows.join(reduce(DataFrame.unionByName, taken), "pair", "left_semi").select("a", "b") if taken else rows.select("a", "b")


def precision_at(hits: DataFrame, keys: list[str], bucket: Column, order: list[Column], hit: str, positives: str) -> DataFrame:
    """hits with rank, tp, recall and precision along order; bucket must not fall along it."""
    rows = hits.withColumn("_at", bucket)
    rows = running(rows, keys, F.col("_at"), order, F.lit(1).cast("long"), "sum", "_rank")
    rows = running(rows, keys, F.col("_at"), order, F.col(hit).cast("long"), "sum", "_tp")
    rows = rows.withColumn("rank", F.coalesce("_rank", F.lit(0)) + 1).withColumn("tp", F.coalesce("_tp", F.lit(0)) + F.col(hit))
    return rows.withColumn("recall", F.col("tp") / F.col(positives)).withColumn("precision", F.col("tp") / F.col("rank")).drop("_at", "_rank", "_tp")


def interpolated_ap(curve: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ap: the area under the envelope of precision over recall, read at POINTS points between the curve's corners and summed by
    trapezoids. A curve begins at recall 0 with precision 1 and falls to 0 at its end.

    Of each recall only the largest precision matters, and a curve has as many recalls as positives; one row for each of the hundred
    points meets the corners around it."""
    corners = curve.groupBy(*keys, "recall").agg(F.max("precision").alias("high"), F.min_by("precision", "rank").alias("first"), F.max_by("precision", "rank").alias("last"))
    at = F.floor(F.col("recall") * 1000)
    corners = running(corners, keys, at, [F.asc("recall")], F.col("high"), "max", "after", reverse=True).withColumn("after", F.coalesce("after", F.lit(0.0)))
    # the envelope where this recall begins and where it ends
    corners = corners.select(*keys, "recall", F.greatest("high", "after").alias("y"), F.greatest("last", "after").alias("out"))
    # the one before has the largest recall of all before
    corners = running(corners, keys, at, [F.asc("recall")], F.struct("recall", "out"), "max", "before")
    corners = corners.withColumn("x0", F.coalesce("before.recall", F.lit(0.0))).withColumn("y0", F.coalesce("before.out", F.lit(1.0)))
    spans = corners.select(*keys, "x0", "y0", F.col("recall").alias("x1"), F.col("y").alias("y1"))
    end = corners.groupBy(*keys).agg(F.max("recall").alias("x0")).select(*keys, "x0", F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(0.0).alias("y1"))
    spans = spans.unionByName(end)
    low, high = F.ceil(F.col("x0") * (POINTS - 1) - 1e-9).cast("int"), F.floor(F.col("x1") * (POINTS - 1) + 1e-9).cast("int")
    at = spans.where(high >= low).select("*", F.explode(F.sequence(low, high)).alias("i")).withColumn("x", F.col("i") / (POINTS - 1))
    y = F.when(F.col("x1") > F.col("x0"), F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0"))).otherwise(F.col("y1"))
    read = at.select(*keys, "i", y.alias("y")).groupBy(*keys, "i").agg(F.min("y").alias("y"))  # where two meet the later one is lower
    weight = F.when((F.col("i") == 0) | (F.col("i") == POINTS - 1), 0.5).otherwise(1.0)
    return read.groupBy(*keys).agg((F.sum(F.col("y") * weight) / (POINTS - 1)).alias("ap"))


def suppressed(boxes: DataFrame, keys: list[str], iou: float = SUPPRESS_IOU) -> DataFrame:
    """Greedy suppression within keys: boxes (id, score, x1, y1, x2, y2) by falling score, then x1, y1 and id; what overlaps a kept one
    as much as iou goes. Returns the kept rows."""
    boxes = kept(boxes)
    pairs = overlaps(boxes, boxes, keys, iou).where("l.id <> r.id")
    place = lambda c: F.struct(F.col(f"{c}.score"), -F.col(f"{c}.x1"), -F.col(f"{c}.y1"), -F.col(f"{c}.id"))
    first = F.struct((-F.col("l.score")).alias("s"), F.col("l.x1").alias("x"), F.col("l.y1").alias("y"), F.col("l.id").alias("id"))
    worse = pairs.where(place("l") > place("r")).select(F.col("l.id").alias("better"), F.col("r.id").alias("worse"), first.alias("rank"))
    return boxes.join(beaten(worse), "id", "left_anti")


def decoded(scores: Column, characters: str) -> Column:
    """The text of a row of character scores at each step: the best at each, repeats once, the blank (number 0) dropped. Of equal scores
    the first counts."""
    best = F.transform(scores, lambda row: F.array_position(row, F.array_max(row)).cast("int") - 1)
    step = lambda x, i: F.when((x > 0) & ((i == 0) | (F.get(best, i - 1) != x)), F.substring(F.lit(characters), x, F.lit(1))).otherwise("")
    return F.array_join(F.transform(best, step), "")
