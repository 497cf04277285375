"""Rows by key: newest, top, numbered, running, pages, retention, compaction.

Keys may be hot: what comes before a shuffle is aggregated or limited map-side, and numbers and running values go in two
levels, within ranges of the order and over sums of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by order (nulls first); rows alike in order go by the other columns."""
    rest = [c for c in df.columns if c not in keys + order]
    row = F.max(F.struct(*order, *rest)).alias("row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"row.{c}").alias(c) for c in order + rest])


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, and rank; each task passes on n of a key at most."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def overflow(df: DataFrame, keys: list[str], order: list[Column], n: int, unique: list[str]) -> DataFrame:
    """What is not among the first n rows of its key. unique: columns that name a row."""
    return df.join(first_rows(df, keys, order, n).select(*unique), unique, "left_anti")


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, how: str, name: str, reverse: bool = False) -> DataFrame:
    """df with name: the sum or max of value over the rows before in order (reverse: after), null where none is.

    bucket must not fall along order; a key's rows are dealt by bucket, and only one row a bucket meets in one place."""
    add, both = (F.sum, lambda a, b: a + b) if how == "sum" else (F.max, F.greatest)
    rows = df.withColumns({"_bucket": bucket, "_value": value})
    span = (Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_bucket").agg(add("_value").alias("_total"))
    outer = Window.partitionBy(*keys).orderBy(F.desc("_bucket") if reverse else "_bucket").rowsBetween(*span)
    totals = totals.withColumn("_outer", add("_total").over(outer)).drop("_total")
    inner = Window.partitionBy(*keys, "_bucket")
    if reverse:  # from the end: a frame up to a partition's end is reckoned again for every row, with the square of their number
        rows = rows.withColumn("_place", F.row_number().over(inner.orderBy(*order)))
        order = [F.desc("_place")]
    rows = rows.withColumn("_inner", add("_value").over(inner.orderBy(*order).rowsBetween(*span))).drop("_place").join(totals, [*keys, "_bucket"])
    whole = F.when(F.col("_inner").isNull(), F.col("_outer")).when(F.col("_outer").isNull(), F.col("_inner")).otherwise(both(F.col("_inner"), F.col("_outer")))
    return rows.withColumn(name, whole).drop("_bucket", "_value", "_inner", "_outer")


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """df with the number of rows of its key before each, from 0."""
    out = running(df, keys, bucket, order, F.lit(1).cast("long"), "sum", name)
    return out.withColumn(name, F.coalesce(name, F.lit(0)))


def page_after(df: DataFrame, order: list[tuple[str, str]], cursor: dict[str, Column] | None, n: int) -> DataFrame:
    """n + 1 rows after the cursor by order of (column, 'asc' | 'desc'); the last tells that more follow."""
    after = F.lit(cursor is None)
    if cursor is not None:
        same = F.lit(True)
        for c, way in order:
            after = after | (same & (F.col(c) > cursor[c] if way == "asc" else F.col(c) < cursor[c]))
            same = same & (F.col(c) == cursor[c])
    return df.where(after).orderBy(*[getattr(F, way)(c) for c, way in order]).limit(n + 1)


def complete_last(df: DataFrame, group: str, n: int) -> DataFrame:
    """The first n rows by group, and the rest of the last one's group."""
    last = df.select(group).orderBy(group).limit(n).agg(F.max(group)).first()[0]  # one value, so that it prunes the scan
    return df.where(F.col(group) <= F.lit(last)) if last is not None else df.limit(0)


def compacted(df: DataFrame, keys: list[str], order: list[str], old: Column) -> DataFrame:
    """The rows that compaction deletes: old ones with a later row of their key."""
    row = F.struct(*order)
    newest = df.groupBy(*keys).agg(F.max(row).alias("_newest"))
    return df.where(old).join(newest, keys).where(row < F.col("_newest")).drop("_newest")


def retained(df: DataFrame, keys: list[str], order: list[Column], n: int, unique: list[str], payload: list[str]) -> DataFrame:
    """All rows, with payload null in those that are not among the first n of their key."""
    newest = first_rows(df, keys, order, n).select(*unique, F.lit(True).alias("_new"))
    out = df.join(newest, unique, "left")
    return out.select(*[F.when(F.col("_new"), F.col(c)).alias(c) if c in payload else F.col(c) for c in df.columns])


def zero_filled(requested: DataFrame, found: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """Every requested key, with 0 where found has none."""
    return requested.join(found, key, "left").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
