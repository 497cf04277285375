"""Changes of tables: merges of two versions, field-level differences, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key it lacks, the first of each key by the other columns."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("row")).select(*keys, "row.*")
    return old.unionByName(one.join(old, keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], when: Column | None = None) -> DataFrame:
    """Rows of old, new's where both have the key (and when holds, of columns old.* and new.*), and rows only in new."""
    o, n = old.withColumn("_in", F.lit(True)).alias("old"), new.withColumn("_in", F.lit(True)).alias("new")
    both = o.join(n, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys], "full")
    take = F.col("new._in").isNotNull() & (F.col("old._in").isNull() | (F.lit(True) if when is None else F.coalesce(when, F.lit(False))))
    return both.select(*[F.when(take, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in old.columns])


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, old_value, new_value: changed fields as strings; a new row has one line for each field that isn't null, a
    missing row one line with field __deleted__."""
    o = old.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("o"))
    n = new.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("n"))
    line = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").alias("old_value"), F.col(f"n.{f}").alias("new_value"))
    nothing = F.lit(None).cast("string")
    gone = F.array(F.struct(F.lit("__deleted__").alias("field"), nothing.alias("old_value"), nothing.alias("new_value")))
    lines = F.filter(F.array(*[line(f) for f in fields]), lambda x: ~x["old_value"].eqNullSafe(x["new_value"]))
    return o.join(n, key, "full").select(key, F.inline(F.when(F.col("n").isNull(), gone).otherwise(lines)))


def dangling(rules: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """rule, n_rows, n_bad: rows whose reference (child, column) has no parent (table, column); nulls refer to nothing."""
    parts = []
    for rule, (child, column, parent, key) in rules.items():
        known = parent.select(F.col(key).alias("_key"), F.lit(1).alias("_there")).dropDuplicates(["_key"])
        found = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).join(known, F.col(column) == F.col("_key"), "left")
        parts.append(found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("_there").isNull(), F.col("n"))), F.lit(0)).alias("n_bad")).select(F.lit(rule).alias("rule"), "n_rows", "n_bad"))
    return reduce(DataFrame.unionByName, parts)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of several rows, and how many they have."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
