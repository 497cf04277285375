"""Operators that keep a state for each key of a stream. The state goes when a key has been quiet for a time of the watermark, so it is bounded by
the keys seen in that time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_state(rows: DataFrame, keys: list[str], order: list[str], out: str, state: str, step: Callable, quiet_ms: int, delay: str) -> DataFrame:
    """Runs step(row, state or None) -> (state, output row or None) over the rows (with a column ts) of each key in order; a state that has been quiet
    for quiet_ms is dropped. state must begin with the long last_ms, the latest time of the key."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now = held.get if held.exists else None
        done = []
        for r in pd.concat(list(parts)).sort_values(order, kind="stable").itertuples(index=False):  # a key's rows of one batch
            now, made = step(r, now)
            if made is not None:
                done.append(made)
        held.update(now)
        held.setTimeoutTimestamp(max(int(now[0]), held.getCurrentWatermarkMs()) + quiet_ms)
        if done:
            yield pd.DataFrame(done, columns=[c.split()[0] for c in out.split(", ")])

    return rows.withWatermark("ts", delay).groupBy(*keys).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def ms(ts: pd.Timestamp) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)
