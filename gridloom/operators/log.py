"""Logs and steps: changes since a revision, tombstones, open intervals, steps done in a row, rows with siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .keyed import latest, running


def changes_since(log: DataFrame, keys: list[str], revision: str, base: Column, n: int) -> DataFrame:
    """The newest change of each key after base, of these the n newest, in ascending order of (revision, keys)."""
    newest = latest(log.where(F.col(revision) > base), keys, [revision])
    return newest.orderBy(F.desc(revision), *[F.desc(k) for k in keys]).limit(n).orderBy(revision, *keys)


def tombstones(log: DataFrame, keys: list[str], order: list[str], removed: Column, automatic: Column) -> DataFrame:
    """Keys whose newest row is a removal that nobody but a person made."""
    state = log.select(*keys, *order, F.coalesce(removed, F.lit(False)).alias("_removed"), F.coalesce(automatic, F.lit(False)).alias("_automatic"))
    return latest(state, keys, order).where("_removed and not _automatic").select(*keys)


def open_at_start(df: DataFrame, keys: list[str], start: str, end: Column, unique: str, bucket: Column) -> DataFrame:
    """unique, n_open: how many intervals [start, end) of the key are open when each starts, itself and those before it in
    (start, unique) counted. bucket is an expression of a column named at, the time, and must not fall along it."""
    marks = F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).alias("kind"), F.lit(1).cast("long").alias("step")),
        F.struct(end.alias("at"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("step")),  # what ends now is closed
    )
    rows = df.where(end > F.col(start)).select(*keys, F.col(unique).alias("_id"), F.inline(marks))
    rows = running(rows, keys, bucket, [F.asc("at"), F.asc("kind"), F.asc("_id")], F.col("step"), "sum", "before")
    return rows.where("kind = 1").select(F.col("_id").alias(unique), (F.coalesce("before", F.lit(0)) + 1).alias("n_open"))


def next_step(steps: DataFrame, keys: list[str], step: str, done: Column) -> DataFrame:
    """keys, next_step: the first step that is not done, or the one after the last; later ones don't count while it lacks."""
    lacking = F.min(F.when(~F.coalesce(done, F.lit(False)), F.col(step)))
    return steps.groupBy(*keys).agg(F.coalesce(lacking, F.max(step) + 1).cast("long").alias("next_step"))


def with_siblings(df: DataFrame, keys: list[str], wanted: Column) -> DataFrame:
    """The wanted rows, and has_sibling: another row of df, wanted or not, has the same keys."""
    n = df.groupBy(*keys).agg((F.count("*") > 1).alias("has_sibling"))
    return df.where(wanted).join(n, keys)


def updated(df: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of values in the rows whose keys values has (once each); other rows stay, none are added."""
    new = [c for c in values.columns if c not in keys]
    found = values.select(*keys, F.struct(*new).alias("_new"))
    return df.join(found, keys, "left").select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """The names of the rules that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules]))
