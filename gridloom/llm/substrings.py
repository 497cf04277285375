"""Suffix-array dedup by anchor hashing, in place of prefix doubling in rounds.

The name of a position for a length is a 64-bit hash of the bytes that follow; names of doubled lengths come from pairs of
names at growing offsets, within a text. Sorting every byte position in Spark would move some 16 bytes a byte and round, so
only a sample that no repeat can miss is grouped: of each THRESHOLD-byte string, the place with the smallest name of
length ANCHOR. Positions whose name is unique leave; those that stay are grouped by their whole neighbourhood, and only
then compared byte by byte at the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import discard, documents, mapped, partitions, small, texts, written

THRESHOLD, ANCHOR = 200, 32
#: Ranks with more different neighbourhoods than this are resolved position by position in Spark, not within one task.
WIDE = 5_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = np.uint64((1 << 31) - 1)


def _pair(a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """The name of a string from the names of its two parts."""
    x = (a * _ODD + b + np.uint64(length)) * _MORE
    x ^= x >> np.uint64(31)
    return x


def names(raw: np.ndarray, length: int) -> np.ndarray:
    """A name for each string of that length, by doubling: ranks of 1, 2, 4, ... bytes, then the rest of the length."""
    if len(raw) < length:
        return np.zeros(0, np.uint64)
    rank, span, out, done = (raw.astype(np.uint64) + np.uint64(1)) * _MORE, 1, None, 0
    while True:
        if length & span:
            out = rank if out is None else _pair(out[: len(rank) - done], rank[done:], span)
            done += span
        if done == length:
            return out[: len(raw) - length + 1]
        rank = _pair(rank[:-span], rank[span:], span)
        span *= 2


def sample(raw: np.ndarray, threshold: int = THRESHOLD, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name and place of the sampled positions, and the first and last start of the strings that each stands for."""
    found = names(raw, anchor)
    n = len(raw) - threshold + 1
    if n < 1:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    low = (found & ~_PLACE) | np.arange(len(found), dtype=np.uint64)  # the leftmost of equal names
    width, span = threshold - anchor + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[width - span : width - span + n])
    place = (low & _PLACE).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return found[place[starts]], place[starts], starts, np.r_[starts[1:], n] - 1


def sampled_rows(docs: DataFrame, threshold: int) -> DataFrame:
    """rank, around (the name of the whole neighbourhood), doc_id, mark, low, high (first and last start) of sampled positions."""
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, parts = [], []
            for key, mark, t in zip(batch["doc_id"], batch["mark"], batch["text"]):
                raw = t.encode("utf-8", "surrogatepass")
                rank, place, low, high = sample(np.frombuffer(raw, np.uint8), threshold)
                if len(rank):
                    around = [xxhash.xxh3_64_intdigest(raw[a : b + threshold], int(p - a)) for p, a, b in zip(place, low.tolist(), high.tolist())]
                    keys.append((key, mark, len(rank)))
                    parts.append((rank.view(np.int64), np.array(around, np.uint64).view(np.int64), low, high))
            if parts:
                rank, around, low, high = (np.concatenate(x) for x in zip(*parts))
                yield pd.DataFrame({"rank": rank, "around": around, "doc_id": np.repeat([k for k, _, _ in keys], [n for _, _, n in keys]), "mark": np.repeat([m for _, m, _ in keys], [n for _, _, n in keys]), "low": low.astype(np.int32), "high": high.astype(np.int32)})

    return docs.mapInPandas(run, "rank long, around long, doc_id long, mark long, low int, high int")


def _neighbourhoods(docs: DataFrame, wanted: DataFrame, threshold: int) -> DataFrame:
    """wanted (rank, doc_id, mark, low, high, lone, wide) with the bytes of these strings' union."""
    by_doc = written(wanted.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("rank", "low", "high", "lone", "wide")).alias("its")))
    names_ = ("rank", "low", "high", "lone", "wide")
    there = docs.join(by_doc.hint("shuffle_merge"), ["doc_id", "mark"]).select("doc_id", "mark", "text", *[F.col(f"its.{c}").alias(c) for c in names_])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, mark, t, *its in zip(batch["doc_id"], batch["mark"], batch["text"], *[batch[c] for c in names_]):
                raw = t.encode("utf-8", "surrogatepass")
                for rank, low, high, lone, wide in zip(*its):
                    out.append((rank, key, mark, low, lone, wide, raw[low : high + threshold]))
                    if len(out) == 2000:
                        yield pd.DataFrame(out, columns=["rank", "doc_id", "mark", "low", "lone", "wide", "data"])
                        out = []
            yield pd.DataFrame(out, columns=["rank", "doc_id", "mark", "low", "lone", "wide", "data"])

    return there.mapInPandas(run, "rank long, doc_id long, mark long, low int, lone boolean, wide boolean, data binary")


def _starts(data: list[bytes], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all strings in the data: name, row, start in the row."""
    raw = np.frombuffer(b"".join(data), np.uint8)
    size = np.array([len(d) for d in data])
    n = size - threshold + 1
    row = np.repeat(np.arange(len(data)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return names(raw, threshold)[np.repeat(np.cumsum(size) - size, n) + start], row, start


def _resolve(rows: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """Runs of repeated starts among rows, which hold all rows of their ranks: doc_id, mark, low, high."""
    name, row, start = _starts(rows["data"].tolist(), threshold)
    by = np.argsort(name, kind="stable")
    same = name[by][1:] == name[by][:-1]
    again = np.zeros(len(name), bool)
    again[by[1:][same]] = True
    again[by[:-1][same]] = True
    again &= rows["lone"].to_numpy(bool)[row]
    at = np.flatnonzero(again)
    if not len(at):
        return pd.DataFrame({"doc_id": np.zeros(0, np.int64), "mark": np.zeros(0, np.int64), "low": np.zeros(0, np.int32), "high": np.zeros(0, np.int32)})
    first = np.r_[True, (np.diff(at) != 1) | (row[at][1:] != row[at][:-1])]
    last = np.r_[first[1:], True]
    base = rows["low"].to_numpy()[row[at]]
    return pd.DataFrame({**{c: rows[c].to_numpy()[row[at][first]] for c in ("doc_id", "mark")}, "low": (base + start[at])[first].astype(np.int32), "high": (base + start[at])[last].astype(np.int32)})


def repeated_starts(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, mark, low, high: runs of starts of strings of threshold bytes that also start elsewhere. docs: doc_id, mark (with it, they name a text), text."""
    rows = written(sampled_rows(docs, threshold))
    ranks = written(rows.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank"))  # written, so that Spark can split a frequent rank
    live = written(rows.join(ranks, "rank"))  # past this round: equal for ANCHOR bytes
    discard(rows, ranks)
    whole = live.groupBy("rank", "around").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min_by("mark", "doc_id").alias("mark"))
    whole = written(whole)
    equal = live.join(whole.where("n > 1").select("rank", "around"), ["rank", "around"], "left_semi").select("doc_id", "mark", "low", "high")
    several = written(whole.groupBy("rank").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    # a row for each kind of neighbourhood: for equal ones those of its smallest document, which are settled (not lone)
    one = whole.join(several, "rank")
    wanted = live.join(one, ["rank", "around", "doc_id", "mark"]).groupBy("rank", "around", "doc_id", "mark", "n", "kinds").agg(F.min(F.struct("low", "high")).alias("at"))
    wanted = written(wanted.select("rank", "doc_id", "mark", "at.low", "at.high", (F.col("n") == 1).alias("lone"), (F.col("kinds") > WIDE).alias("wide")))

    there = written(_neighbourhoods(docs, wanted, threshold))  # once, for both ways to resolve them
    found = there.where("not wide").repartition(2 * partitions(docs.sparkSession), "rank").sortWithinPartitions("rank")

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held) < 4000:
                continue
            ended = held["rank"] != held["rank"].iloc[-1]
            if ended.any():
                yield _resolve(held[ended], threshold)
                held = held[~ended]
        if held is not None and len(held):
            yield _resolve(held, threshold)

    parts = [equal, found.select("rank", "doc_id", "mark", "low", "lone", "data").mapInPandas(resolve, "doc_id long, mark long, low int, high int")]
    if not wanted.where("wide").isEmpty():
        parts.append(_wide(there.where("wide"), threshold))
    out = written(parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0].unionByName(parts[1]).unionByName(parts[2]))
    discard(live, whole, several, wanted, there)
    return out


def _wide(found: DataFrame, threshold: int) -> DataFrame:
    """The same for ranks of any number of neighbourhoods: a row for each start, counted by name before it moves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 1000):
                part = batch.iloc[k : k + 1000]
                name, row, start = _starts(part["data"].tolist(), threshold)
                yield pd.DataFrame({"name": name.view(np.int64), **{c: part[c].to_numpy()[row] for c in ("doc_id", "mark")}, "low": (part["low"].to_numpy()[row] + start).astype(np.int32), "lone": part["lone"].to_numpy()[row]})

    starts = written(found.mapInPandas(run, "name long, doc_id long, mark long, low int, lone boolean"))
    again = starts.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    return starts.where("lone").join(again, "name").select("doc_id", "mark", "low", F.col("low").alias("high"))


def cut_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_bytes, kept (binary: what stays), n_removed, n_spans. Every byte goes that a string of threshold bytes covers
    which also starts anywhere else, in the same or any other document, first places included.

    Null and empty texts: no bytes. Rows that share a doc_id, or have none, are told apart by their texts: each is judged and cut by
    its own. Equal rows repeat each other."""
    source = texts(docs).select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("mark"), "text", F.col("doc_id").isNull().alias("unknown"))
    starts = repeated_starts(source.drop("unknown"), threshold)

    @F.pandas_udf("array<int>")
    def joined(lows: pd.Series, highs: pd.Series) -> pd.Series:
        out = []
        for low, high in zip(lows, highs):
            by = np.argsort(low, kind="stable")
            low, end = np.asarray(low)[by], np.maximum.accumulate(np.asarray(high)[by]) + threshold
            first = np.r_[True, low[1:] > end[:-1]]
            out.append(np.stack([low[first], end[np.r_[first[1:], True]]], axis=1).reshape(-1).tolist())
        return pd.Series(out)

    spans = written(starts.groupBy("doc_id", "mark").agg(F.collect_list("low").alias("l"), F.collect_list("high").alias("h")).select("doc_id", "mark", joined("l", "h").alias("spans")))
    discard(starts)
    n = spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("n")).first()["n"]
    fits = n * 4 < 16_000_000 and small(spans, 48)
    both = source.join(F.broadcast(spans) if fits else spans.hint("shuffle_merge"), ["doc_id", "mark"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, t, cut in zip(batch["doc_id"], batch["text"], batch["spans"]):
                raw = t.encode("utf-8", "surrogatepass")
                cut = [min(int(x), len(raw)) for x in cut] if cut is not None else []
                edges = [0, *cut, len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((key, len(raw), kept, len(raw) - len(kept), len(cut) // 2))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "kept", "n_removed", "n_spans"])

    named = both.select(F.when(~F.col("unknown"), F.col("doc_id")).alias("doc_id"), "text", "spans")
    return mapped(named, run, "n_bytes long, kept binary, n_removed long, n_spans long")


def op6_suffixes(spark, sf_dir: str) -> DataFrame:
    return cut_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
