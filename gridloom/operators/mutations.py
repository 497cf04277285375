"""Tables after a change: guarded states, soft deletion, expected revisions, expiry, counters with a lock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def moved(df: DataFrame, state: str, moves: list[tuple[str, Column, str]]) -> DataFrame:
    """df with state after the first of moves (from, when, to) that holds; rows without one stay, a null guard does not hold."""
    out = None
    for was, when, to in moves:
        guard = (F.col(state) == was) & F.coalesce(when, F.lit(False))
        out = F.when(guard, to) if out is None else out.when(guard, to)
    return df.withColumn(state, out.otherwise(F.col(state)))


def revised(df: DataFrame, changes: DataFrame, key: str, revision: str) -> DataFrame:
    """df with the columns of changes where its revision is the expected one (once a key), one revision on; and is_stale of changes that
    expected another. Rows without a change: is_stale null."""
    new = [c for c in changes.columns if c not in (key, revision)]
    asked = changes.select(key, F.struct(F.col(revision).alias("_expected"), *new).alias("_new"))
    rows = df.join(asked, key, "left")
    fits = F.coalesce(F.col("_new._expected") == F.col(revision), F.lit(False))
    out = [F.when(fits, F.col(revision) + 1).otherwise(F.col(revision)).alias(c) if c == revision else F.when(fits, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns]
    return rows.select(*out, F.when(F.col("_new").isNotNull(), ~fits).alias("is_stale"))


def soft_deleted(df: DataFrame, deleted_at: str, removed: Column, restored: Column, now: Column, window: str) -> DataFrame:
    """df with deleted_at set where removed, and cleared where restored within the window after it; is_gone tells what is past it."""
    at = F.when(F.col(deleted_at).isNull() & F.coalesce(removed, F.lit(False)), now).when(F.coalesce(restored, F.lit(False)) & (F.col(deleted_at) + F.expr(f"interval {window}") > now), None).otherwise(F.col(deleted_at))
    return df.withColumn(deleted_at, at).withColumn("is_gone", F.coalesce(F.col(deleted_at) + F.expr(f"interval {window}") <= now, F.lit(False)))


def locked(failures: DataFrame, keys: list[str], most: int, within: str) -> DataFrame:
    """Failures (keys, ts, event_id) with the number of the key's failures in the time before, itself and those of its very moment included, and is_locked beyond
    most. The time before begins at a whole second; what comes later in a failure's own second doesn't count."""
    by, second = Window.partitionBy(*keys), F.col("ts").cast("timestamp").cast("long")
    upto = by.orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    old = by.orderBy(second).rangeBetween(Window.unboundedPreceding, -int(within) - 1)
    return failures.withColumn("recent", F.count("*").over(upto) - F.count("*").over(old)).withColumn("is_locked", F.col("recent") > most)


def sweep(df: DataFrame, at: str, older: Column, newer: Column, order: list[Column], n: int) -> DataFrame:
    """The first n rows in order whose time is in (older, newer]."""
    return df.where((F.col(at) > older) & (F.col(at) <= newer)).orderBy(*order).limit(n)


#: What a job that has used up its attempts is closed with; fixed value.
EXHAUSTED = "RETRY_EXHAUSTED"


def requeued(df: DataFrame, key: str, now: Column, after_s: int, most: int, n: int) -> DataFrame:
    """df (key, status, attempts, requested_at, created_at, error) after a sweep: of the pending and running jobs that were never sent, or longer ago than
    after_s, doubled with each attempt after the first, the n oldest are sent again (one attempt more, requested now), or failed where they have had most.
    Null attempts are none; from 31 on they wait as long as 31. Jobs as old go by key; a job without a created_at comes first."""
    tries = F.coalesce("attempts", F.lit(0))
    wait = F.make_dt_interval(secs=(after_s * F.pow(F.lit(2), F.least(F.greatest(tries - 1, F.lit(0)), F.lit(30)))).cast("decimal(18,6)"))
    due = F.col("status").isin("pending", "running") & (F.col("requested_at").isNull() | (F.col("requested_at") < now - wait))
    taken = df.where(due).orderBy("created_at", key).limit(n).select(key, F.lit(True).alias("_taken"))
    sent, failed = F.col("_taken") & (tries < most), F.col("_taken") & (tries >= most)
    new = {"status": F.when(failed, "failed").otherwise(F.col("status")), "attempts": F.when(sent, tries + 1).otherwise(F.col("attempts")), "requested_at": F.when(sent, now).otherwise(F.col("requested_at")), "error": F.when(failed, EXHAUSTED).otherwise(F.col("error"))}
    return df.join(taken, key, "left").withColumns(new).drop("_taken")
