"""Scales from samples of two lengths: the densest cluster of ratios, and a scale with its confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import js_round
from ..sources.tables import kept
from .keyed import running
from .stats import middle, outliers, with_keyed

#: Rules of the scale: samples needed, least confidence, samples for full weight, their share of it, spread that leaves no
#: confidence; and of two samples alone, least millimetres and relative difference. Fixed values.
MIN_SAMPLES, MIN_CONFIDENCE, FULL_SAMPLES, COUNT_SHARE, NO_CONFIDENCE = 3, 0.6, 5, 0.5, 0.05
PAIR_MM, PAIR_OFF = 1000, 0.01


def densest_cluster(df: DataFrame, keys: list[str], value: str, reach: Callable[[Column], Column], bucket: float) -> DataFrame:
    """keys, centre, members: the value with the most values within reach(value) of it. Of several, the
    smallest where all of them share a member; no row where they don't. Nulls are left out.

    Counts below both ends of each reach come from running sums dealt by ranges as wide as bucket, so no pairs are made."""
    v = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("centre")).agg(F.count("*").alias("n"))
    v = v.withColumns({"lo": F.col("centre") - reach(F.col("centre")), "hi": F.col("centre") + reach(F.col("centre"))})
    ends = F.array(
        F.struct(F.col("lo").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n")),
        F.struct(F.col("centre").alias("at"), F.lit(1).alias("kind"), F.col("n").alias("n")),
        F.struct(F.col("hi").alias("at"), F.lit(2).alias("kind"), F.lit(0).cast("long").alias("n")),
    )
    rows = v.select(*keys, "centre", "lo", F.inline(ends))
    order, part = [F.asc("at"), F.asc("kind")], F.floor(F.col("at") / bucket)
    rows = running(rows, keys, part, order, F.col("n"), "sum", "below")
    rows = running(rows, keys, part, order, F.when(F.col("kind") == 1, F.col("at")), "max", "last")
    signed = F.when(F.col("kind") == 2, F.col("below")).when(F.col("kind") == 0, -F.coalesce("below", F.lit(0))).otherwise(0)
    found = rows.groupBy(*keys, "centre", "lo").agg(F.sum(signed).alias("members"), F.max(F.when(F.col("kind") == 2, F.col("last"))).alias("last"))
    first = F.max(F.struct("members", (-F.col("centre")).alias("back"), "last")).alias("first")
    final = F.max(F.struct("members", "centre", "lo")).alias("final")
    best = found.groupBy(*keys).agg(first, final).where("first.last >= final.lo")
    return best.select(*keys, (-F.col("first.back")).alias("centre"), F.col("first.members").alias("members"))


def inferred(samples: DataFrame, keys: list[str], pixels: str, millimetres: str) -> DataFrame:
    """keys, n_samples, confidence, suggested, mm_per_px, reason for each group of samples. Ratios far from the others go first.
    mm_per_px is null with a reason: tooFewSamples or lowConfidence. Two samples alone do where they agree and differ in length."""
    px, mm = F.col(pixels), F.col(millimetres)
    ratio = F.when((px > 0) & (mm > 0), mm / px)
    all_of = samples.select(*keys, mm.alias("_mm"), ratio.alias("_ratio"))
    two = (F.count("_ratio") == 2) & (F.min("_of") != F.max("_of")) & (F.min("_of") >= PAIR_MM) & (F.max("_ratio") - F.min("_ratio") <= PAIR_OFF * F.min("_ratio"))
    groups = all_of.withColumn("_of", F.when(F.col("_ratio").isNotNull(), F.col("_mm"))).groupBy(*keys).agg(F.coalesce(two, F.lit(False)).alias("_pair"))
    bucket = lambda r: F.coalesce(F.floor(F.log2(r) * 16), F.lit(-(1 << 20)))  # noqa: E731, 0 has no logarithm
    held = outliers(all_of.where("_ratio is not null"), keys, "_ratio", bucket).where("not is_outlier").select(*keys, "_ratio")
    suggested = kept(middle(held, keys, "_ratio", bucket, "suggested").join(held.groupBy(*keys).agg(F.count("*").alias("n_samples")), keys))
    off = with_keyed(held, suggested, keys).withColumn("_off", F.abs(F.col("_ratio") - F.col("suggested")))
    spread = suggested.join(middle(off, keys, "_off", bucket, "_spread"), keys)
    fit = F.greatest(F.lit(0.0), 1 - F.col("_spread") / F.col("suggested") / NO_CONFIDENCE)
    weight = 1 - COUNT_SHARE + COUNT_SHARE * F.least(F.lit(1.0), F.col("n_samples") / FULL_SAMPLES)
    out = groups.join(spread, keys, "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))
    out = out.withColumn("confidence", F.coalesce(js_round(fit * weight * 1e6) / 1e6, F.lit(0.0)))
    few = F.when(F.col("_pair"), F.lit(None)).otherwise("tooFewSamples")
    reason = F.when(F.col("n_samples") < MIN_SAMPLES, few).when(F.col("confidence") < MIN_CONFIDENCE, "lowConfidence")
    out = out.withColumn("reason", reason.cast("string"))
    return out.select(*keys, "n_samples", "confidence", "suggested", F.when(F.col("reason").isNull(), F.col("suggested")).alias("mm_per_px"), "reason")
