"""Robust statistics and measures of models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import kept
from .keyed import numbered, running

#: Fixed values of the outlier rule: MAD and mean deviation of a normal distribution, and the threshold.
MAD_TO_SPREAD, MEAN_TO_SPREAD, FAR = 0.6745, 1.2533, 3


#: Rows of a table with one row a key that is broadcast; a larger one is built into hash tables, so that what it is joined to isn't sorted.
FEW_KEYS = 200_000


def with_keyed(df: DataFrame, by_key: DataFrame, on: list[str]) -> DataFrame:
    """df joined with a written table that has one row, or two, for each of its keys; the rows of df stream by, whatever their number."""
    return df.join(F.broadcast(by_key) if by_key.limit(FEW_KEYS + 1).count() <= FEW_KEYS else by_key.hint("shuffle_hash"), on)


def middle(df: DataFrame, keys: list[str], value: str, bucket: Callable[[Column], Column] | None, name: str) -> DataFrame:
    """keys and the exact median of value, nulls left out. bucket(value) must not fall along value: rows are only counted by it, and those of the
    bucket that holds a key's median, or of the two, are put in order. Without bucket, a key's different values meet in one task."""
    if bucket is None:
        return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.median(value).alias(name))
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")).withColumn("_b", bucket(F.col("_v")))
    counts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"_upto": F.sum("_c").over(upto), "_n": F.sum("_c").over(whole)})
    held = kept(counts.where("_upto > (_n - 1) div 2 and _upto - _c <= _n div 2").select(*keys, "_b", (F.col("_upto") - F.col("_c")).alias("_before"), "_n"))
    found = with_keyed(rows, held, [*keys, "_b"]).groupBy(*keys, "_b", "_before", "_n", "_v").agg(F.count("*").alias("_c"))
    inner = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("_upto", F.col("_before") + F.sum("_c").over(inner))
    return found.where("_upto > (_n - 1) div 2 and _upto - _c <= _n div 2").groupBy(*keys).agg(F.avg("_v").alias(name))


def outliers(df: DataFrame, keys: list[str], value: str, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """df with median, spread and is_outlier: more than FAR spreads from its group's median. The spread is the MAD / 0.6745, or
    where that is 0 the mean deviation x 1.2533; where that is 0 too, nothing is an outlier. bucket: see middle()."""
    off = with_keyed(df, kept(middle(df, keys, value, bucket, "median")), keys).withColumn("_off", F.abs(F.col(value) - F.col("median")))
    spread = middle(off, keys, "_off", bucket, "mad").join(off.groupBy(*keys).agg(F.avg("_off").alias("mean")), keys)
    spread = kept(spread.select(*keys, F.when(F.col("mad") > 0, F.col("mad") / MAD_TO_SPREAD).otherwise(F.col("mean") * MEAN_TO_SPREAD).alias("spread")))
    return with_keyed(off, spread, keys).withColumn("is_outlier", (F.col("spread") > 0) & (F.col("_off") > F.col("spread") * FAR)).drop("_off")


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """The least value whose weight and that of all lesser ones reach half of its group's."""
    by_value = df.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = by_value.withColumns({"upto": F.sum("w").over(upto), "all": F.sum("w").over(whole)}).where("2 * upto >= all")
    return found.groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, percent: int, bucket: Column, name: str) -> DataFrame:
    """The value of rank ceil(percent / 100 * n) in its group, nulls left out; bucket must not fall along value."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    ranked = numbered(rows, keys, bucket, [F.asc(value)], "_before").join(n, keys)
    return ranked.where(f"_before + 1 = ({percent} * _n + 99) div 100").select(*keys, F.col(value).alias(name))


def precision_recall(df: DataFrame, keys: list[str], score: str, tie: str, positive: Column, bucket: Column) -> DataFrame:
    """keys, tie, rank, tp, precision, envelope, recall along falling scores (ties by the smaller tie). bucket must not fall
    along that order. Groups without positives have recall null."""
    order = [F.desc(score), F.asc(tie)]
    rows = df.withColumns({"_hit": F.when(positive, 1).otherwise(0).cast("long"), "_at": bucket})
    rows = numbered(rows, keys, F.col("_at"), order, "_rank").withColumn("rank", F.col("_rank") + 1).drop("_rank")
    rows = running(rows, keys, F.col("_at"), order, F.col("_hit"), "sum", "_tp")
    rows = rows.withColumn("tp", F.coalesce("_tp", F.lit(0)) + F.col("_hit")).withColumn("precision", F.col("tp") / F.col("rank"))
    rows = running(rows, keys, F.col("_at"), order, F.col("precision"), "max", "_next", reverse=True)
    rows = rows.withColumn("envelope", F.greatest("precision", "_next"))
    all_hits = df.groupBy(*keys).agg(F.sum(F.when(positive, 1).otherwise(0)).alias("_all"))
    out = rows.join(all_hits, keys).withColumn("recall", F.expr("tp / nullif(_all, 0)"))
    return out.select(*keys, tie, "rank", "tp", "precision", "envelope", "recall", F.col("_hit").alias("hit"), F.col("_all").alias("positives"))


def share(inside: Column, either: Column) -> Column:
    """Sum over sum, 1 where the lower one is 0."""
    return F.when(F.sum(either) == 0, 1.0).otherwise(F.sum(inside) / F.sum(either))


def error_rate(distance: Column, length: Column) -> Column:
    """Edits over characters, 1 character at least."""
    return F.sum(distance) / F.greatest(F.sum(length), F.lit(1))


#: Directions are told apart by tenths of a degree and come round after a right angle; a family reaches as many tenths to both sides; fixed values.
AXIS_BINS, AXIS_HALF = 900, 40


def axis_shares(bins: DataFrame, keys: list[str], direction: str, weight: str) -> DataFrame:
    """keys, share: the largest part of the weight that two families of directions hold, each of AXIS_HALF bins to both sides of its middle; 1 where
    there is no weight. bins has a row for each direction from 0 to AXIS_BINS - 1 at most (null: no direction). Two families that touch or overlap are one arc, of
    which no bin counts twice; of two apart, the best partner of each is a maximum over the ring."""
    wide = 2 * AXIS_HALF + 1
    kinds = ", ".join(f"`{k}` {bins.schema[k].dataType.simpleString()}" for k in keys)

    def share(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ring = np.bincount(rows["_b"], rows["_w"], AXIS_BINS)
        upto = np.r_[0.0, np.cumsum(np.tile(ring, 3))]
        arcs = lambda n: upto[n : n + AXIS_BINS] - upto[:AXIS_BINS]
        one = arcs(wide)
        apart = np.lib.stride_tricks.sliding_window_view(np.tile(one, 2), AXIS_BINS - 2 * wide + 1)[wide : wide + AXIS_BINS].max(axis=1)
        best = max(float(arcs(2 * wide - 1).max()), float((one + apart).max()))  # a longer arc holds all shorter ones
        return pd.DataFrame([(*key, best / ring.sum() if ring.sum() > 0 else 1.0)])

    rows = bins.where(F.col(direction).isNotNull()).groupBy(*keys, F.col(direction).cast("int").alias("_b")).agg(F.sum(F.coalesce(F.col(weight), F.lit(0.0))).cast("double").alias("_w"))
    return rows.groupBy(*keys).applyInPandas(share, f"{kinds}, share double")  # AXIS_BINS rows a group at most
