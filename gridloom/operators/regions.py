"""Clusters of walls that touch, and regions of boxes that grow from the longest one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import crossing, foot_distance
from ..sources.tables import dropped, kept
from .detection import overlaps
from .graph import components
from .spatial import crossed_cells, parts_of

#: How far walls that touch are apart beyond their faces, and how far a box may be from its region, in mm; fixed values.
JOIN_MM, FAR_MM = 150, 1500
#: Boxes of one group that one task grows.
LOCAL = 20_000
CELL_MM = 2000.0
#: Side of the cells in which two ends are no further apart than JOIN_MM.
END_MM = JOIN_MM * 0.7
SIDES = ("x1", "y1", "x2", "y2")


def _apart(a: str, b: str) -> Column:
    """The distance of two segments in structs, 0 where they cross."""
    col = lambda s, c: F.col(f"{s}.{c}")
    foot = lambda s, i, o: foot_distance(col(s, f"x{i}"), col(s, f"y{i}"), *[col(o, c) for c in SIDES])
    cross = crossing(*[{c: col(s, c) for c in SIDES} for s in (a, b)], 0.0)
    return F.when(cross.isNotNull(), 0.0).otherwise(F.least(foot(a, 1, b), foot(a, 2, b), foot(b, 1, a), foot(b, 2, a)))


def _one_where_ends_meet(keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """root for the walls of each batch: the least n of those that its ends lead to over cells so small that all within one touch. Walls of other batches
    are linked by the caller."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            group = batch.groupby(keys, sort=False).ngroup().to_numpy()
            at = lambda c: np.floor(batch[c].to_numpy(float) / END_MM)
            ends = pd.DataFrame({"g": np.tile(group, 2), "x": np.r_[at("x1"), at("x2")], "y": np.r_[at("y1"), at("y2")]})
            one, two = ends.groupby(["g", "x", "y"], sort=False, dropna=False).ngroup().to_numpy().reshape(2, -1)
            bare = ~(batch["thickness"].to_numpy(float) >= 0) | batch[list(SIDES)].isna().any(axis=1).to_numpy()
            many = max(one.max(initial=-1), two.max(initial=-1)) + 1
            own = many + np.arange(len(batch))  # cells that nobody shares
            one, two = np.where(bare, own, one), np.where(bare, own, two)
            label = np.arange(len(batch))
            while True:
                low = np.full(many + len(batch), len(batch))
                np.minimum.at(low, one, label)
                np.minimum.at(low, two, label)
                new = np.minimum(low[one], low[two])
                more = new.copy()
                np.minimum.at(more, label, new)
                while (more[more] != more).any():
                    more = more[more]
                if (more == label).all():
                    break
                label = more
            yield batch.assign(root=batch["n"].to_numpy()[label])

    return run


def wall_clusters(walls: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, cluster (the least id) of walls (keys, id, x1, y1, x2, y2, thickness) that touch, over others too: their lines are no further apart than half
    of both thicknesses and JOIN_MM. Walls with a null are left out, one with a null key is alone.

    Walls with ends in one cell of END_MM touch, so they are one first: in batches of walls that lie near each other, then over all. Only walls that are still in
    different clusters meet after that, by the cells that they pass or come near, and only in cells that hold two clusters."""
    walls = walls.where(" and ".join(f"{c} is not null" for c in (*SIDES, "thickness"))).select(*keys, "id", *[F.col(c).cast("double").alias(c) for c in (*SIDES, "thickness")])
    known = " and ".join(f"`{k}` is not null" for k in keys)
    place = [F.floor(F.least(f"{c}1", f"{c}2") / (4 * CELL_MM)) for c in "xy"]
    dealt = walls.where(known).repartition(parts_of(walls), *keys, *place).sortWithinPartitions(*keys, *place).withColumn("n", F.monotonically_increasing_id())
    kind = walls.schema["id"].dataType
    dealt = dealt.withColumn("id", F.col("id").cast("string"))  # pandas would make floats of whole numbers beside a null
    kinds = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes)
    rows = kept(dealt.mapInPandas(_one_where_ends_meet(keys), f"{kinds}, root long").withColumn("id", F.col("id").cast(kind)))
    whole = rows.where(" and ".join(f"not isnan({c})" for c in SIDES)).where("thickness >= 0")
    tips = kept(whole.select(*keys, "root", F.inline(F.array(*[F.struct(*[F.floor(F.col(f"{c}{i}") / END_MM).alias(f"c{c}") for c in "xy"]) for i in (1, 2)]))).distinct())
    shared = tips.groupBy(*keys, "cx", "cy").agg(F.min("root").alias("a"), F.max("root").alias("most")).where("a < most").drop("most")
    edges = kept(tips.join(shared, [*keys, "cx", "cy"]).where("a < root").select("a", F.col("root").alias("b")).distinct())
    first = kept(components(rows.select(F.col("root").alias("id")).distinct(), edges).select(F.col("id").alias("root"), F.col("component").alias("c")))
    wall = F.struct("c", *SIDES, "thickness")
    passed = kept(crossed_cells(rows.join(first, "root").select(*keys, "c", *SIDES, "thickness").distinct(), SIDES, CELL_MM, (F.col("thickness") + JOIN_MM) / 2).select(*keys, "cx", "cy", wall.alias("w")))
    mixed = passed.groupBy(*keys, "cx", "cy").agg(F.min("w.c").alias("l"), F.max("w.c").alias("m")).where("l < m").select(*keys, "cx", "cy")
    passed_too = kept(passed.join(mixed, [*keys, "cx", "cy"], "left_semi").repartition(parts_of(walls), *keys, "cx", "cy"))
    limit = (F.col("a.thickness") + F.col("b.thickness")) / 2 + JOIN_MM
    beside = lambda c: (F.least(f"a.{c}1", f"a.{c}2") - F.greatest(f"b.{c}1", f"b.{c}2") <= limit) & (F.least(f"b.{c}1", f"b.{c}2") - F.greatest(f"a.{c}1", f"a.{c}2") <= limit)
    met = passed_too.withColumnRenamed("w", "a").join(passed_too.withColumnRenamed("w", "b"), [*keys, "cx", "cy"]).where("a.c < b.c")
    near = kept(met.where(beside("x") & beside("y") & (_apart("a", "b") <= limit)).select(F.col("a.c").alias("a"), F.col("b.c").alias("b")).distinct())
    last = components(first.select(F.col("c").alias("id")).distinct(), near).select(F.col("id").alias("c"), "component")
    found = kept(rows.join(first, "root").join(last, "c").select(*keys, "id", "component"))
    dropped(tips, edges, passed, passed_too, near)
    out = found.join(found.groupBy("component").agg(F.min("id").alias("cluster")), "component").select(*keys, "id", "cluster")
    return out.unionByName(walls.where(f"not ({known})").select(*keys, "id", F.col("id").alias("cluster")))


def _union(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[(F.min if c.endswith("1") else F.max)(c).alias(c) for c in SIDES])


def _groups(boxes: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """keys, id, group: boxes whose unions, made one where they are within reach, come to one. Regions never leave a group, as a region lies within its union."""
    labels = kept(boxes.select(*keys, "id", F.struct(*keys, "id").alias("group")))
    state = kept(boxes.select(*keys, F.struct(*keys, "id").alias("id"), *SIDES))
    wide = reach / 2 * (1 + 1e-9) + 1e-6
    while True:
        grown = state.select(*keys, "id", *[F.col(c).alias(f"o_{c}") for c in SIDES], *[(F.col(c) + (wide if c.endswith("2") else -wide)).alias(c) for c in SIDES])
        axis = lambda c: F.greatest(F.lit(0.0), F.col(f"l.o_{c}1") - F.col(f"r.o_{c}2"), F.col(f"r.o_{c}1") - F.col(f"l.o_{c}2"))
        pairs = overlaps(grown, grown, keys, 0.0).where("l.id < r.id").where(F.hypot(axis("x"), axis("y")) <= reach)
        edges = kept(pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")))
        if edges.isEmpty():
            dropped(state, edges)
            return labels.select(*keys, "id", "group")
        into = kept(components(state.select("id"), edges))
        more = kept(_union(state.join(into, "id").drop("id").withColumnRenamed("component", "id"), [*keys, "id"]).select(*keys, "id", *SIDES))
        named = kept(labels.withColumnRenamed("group", "was").join(into.withColumnsRenamed({"id": "was", "component": "group"}), "was").select(*keys, "id", "group"))
        dropped(state, edges, into, labels)
        state, labels = more, named


def _grown(rows: pd.DataFrame, reach: float) -> np.ndarray:
    """For each box the number of the row that its region began with; rows come by falling length."""
    low, high = rows[["x1", "y1"]].to_numpy(float), rows[["x2", "y2"]].to_numpy(float)
    seed = np.full(len(rows), -1)
    for i in range(len(rows)):
        if seed[i] >= 0:
            continue
        new, begin, end = np.array([i]), low[i], high[i]
        while len(new):
            seed[new] = i
            begin, end = np.minimum(begin, low[new].min(axis=0)), np.maximum(end, high[new].max(axis=0))
            apart = np.maximum(np.maximum(low - end, begin - high), 0)
            new = np.flatnonzero((seed < 0) & (np.hypot(apart[:, 0], apart[:, 1]) <= reach))
    return seed


def _grown_in_rounds(rows: DataFrame, reach: float) -> DataFrame:
    """group, node, seed of groups of any size: each round all groups' regions take what is near, and one that finds nothing ends."""
    free, parts = kept(rows), []
    active = None
    while not free.isEmpty():
        first = free.groupBy("group").agg(F.min_by(F.struct("node", *SIDES), F.col("rank")).alias("s")).select("group", F.col("s.node").alias("seed"), *[F.col(f"s.{c}").alias(f"r_{c}") for c in SIDES])
        active = kept(first if active is None else active.unionByName(first.join(active, "group", "left_anti")))
        axis = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}1") - F.col(f"r_{c}2"), F.col(f"r_{c}1") - F.col(f"{c}2"))
        new = kept(free.join(active, "group").where(F.hypot(axis("x"), axis("y")) <= reach))
        parts.append(kept(new.select("group", "node", "seed")))
        bounds = [(F.min if c.endswith("1") else F.max)(c).alias(f"n_{c}") for c in SIDES]
        grown = active.join(new.groupBy("group").agg(*bounds), "group")  # those that found nothing end
        active = kept(grown.select("group", "seed", *[(F.least if c.endswith("1") else F.greatest)(f"r_{c}", f"n_{c}").alias(f"r_{c}") for c in SIDES]))
        rest = kept(free.join(new.select("node"), "node", "left_anti"))
        dropped(free, new)
        free = rest
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def regions(boxes: DataFrame, keys: list[str], reach: float = FAR_MM) -> DataFrame:
    """keys, id, region of boxes (keys, id, x1, y1, x2, y2, length): region 0 grows from the longest box (the least id of two), taking every box within reach
    of the region's own box until none is left so near; then the longest of the others begins region 1, and so on.

    Boxes with a null side belong to none and are left out; a null length is 0. Growth depends on what came before it, so boxes of keys with more than LOCAL first fall in
    groups that can't reach each other; groups, or keys, of at most LOCAL boxes are grown by one task each, larger groups in rounds."""
    boxes = kept(boxes.where(" and ".join(f"{c} is not null" for c in SIDES)).select(*keys, "id", *[F.col(c).cast("double").alias(c) for c in SIDES], F.coalesce(F.col("length").cast("double"), F.lit(0.0)).alias("length")))
    counts = kept(boxes.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("_least")))
    grouped = boxes.join(counts.where(f"n <= {LOCAL}").drop("n"), keys).withColumn("group", F.struct(*keys, F.col("_least").alias("id"))).drop("_least")
    if not counts.where(f"n > {LOCAL}").isEmpty():
        crowded = kept(boxes.join(counts.where(f"n > {LOCAL}").select(*keys), keys, "left_semi"))
        grouped = grouped.unionByName(crowded.join(_groups(crowded, keys, reach), [*keys, "id"]))
    rows = kept(grouped.select("group", F.struct(*keys, "id").alias("node"), *SIDES, F.struct((-F.col("length")).alias("l"), "id").alias("rank")))
    sizes = kept(rows.groupBy("group").agg(F.count("*").alias("n")))
    few, many = (rows.join(sizes.where(f"n {sign} {LOCAL}").select("group"), "group", "left_semi") for sign in ("<=", ">"))
    numbered = few.withColumn("i", F.row_number().over(Window.partitionBy("group").orderBy("rank")) - 1)  # LOCAL rows a group at most
    numbered = kept(numbered.select("group", "i", "node", *SIDES, F.xxhash64("group").alias("g")))
    kind = numbered.schema["group"].dataType.simpleString()

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            cut = int(np.flatnonzero(held["i"].to_numpy() == 0)[-1])  # the last group may go on in the next batch
            if cut:
                yield from settled(held.iloc[:cut])
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield from settled(held)

    def settled(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        begin = np.flatnonzero(rows["i"].to_numpy() == 0)
        for a, b in zip(begin, [*begin[1:], len(rows)]):
            part = rows.iloc[a:b]
            yield pd.DataFrame({"code": part["code"], "seed_i": _grown(part, reach)})

    parts = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = kept(numbered.withColumn("code", F.monotonically_increasing_id()))
    dealt = coded.repartition(parts, "group").sortWithinPartitions("group", "i")
    grown = dealt.select("code", "i", *SIDES).mapInPandas(grow, "code long, seed_i long").join(coded.select("code", "group", "node"), "code")
    seeds = coded.select("group", F.col("i").cast("long").alias("seed_i"), F.col("node").alias("seed"))
    done = grown.join(seeds, ["group", "seed_i"]).select("node", "seed")
    if not many.isEmpty():
        done = done.unionByName(_grown_in_rounds(many, reach).select("node", "seed"))
    done = kept(done)
    began = done.select("seed").distinct().join(rows.select(F.col("node").alias("seed"), "rank"), "seed")
    number = Window.partitionBy(*[F.col(f"seed.{k}") for k in keys]).orderBy("rank")  # a row for each region
    named = began.withColumn("region", (F.row_number().over(number) - 1).cast("long")).select("seed", "region")
    return done.join(named, "seed").select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.id").alias("id"), "region")
