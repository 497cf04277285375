"""Document fingerprints: bottom-k sketches of shingle hashes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import documents, mapped, partitions, texts

K = 128
WIDTH = 9  # code points in a shingle
SPACE = 1 << 48  # hashes are below
#: Bytes of text in a range of ids, about, so that a task's share does not grow with the input.
BUCKET_BYTES = 32_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * _MORE
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """A 48-bit hash for each run of width code points; of the whole text where it is shorter; none for an empty one."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(h):
        return h
    width = min(width, len(h))
    h = _mix((h + np.uint64(1)) * _ODD)
    out, length, power, span = None, 0, h, 1
    while True:  # binary decomposition of the width: names of 1, 2, 4, ... code points
        if width & span:
            out = power if out is None else _mix(out[: len(power) - length] * _ODD + power[length:] + np.uint64(span))
            length += span
        if length == width:
            return out[: len(h) - width + 1] >> np.uint64(16)
        power = _mix(power[:-span] * _ODD + power[span:])
        span *= 2


def bottom(values: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    if len(values) > 8 * k:
        few = values[values <= np.partition(values, 2 * k)[2 * k]]
        found = np.unique(few)
        if len(found) >= k:
            return found[:k]
    return np.unique(values)[:k]


def sketch(text: str, k: int = K, width: int = WIDTH) -> np.ndarray:
    return bottom(shingle_hashes(text, width), k)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of both sets."""
    return np.unique(np.concatenate([a, b]))[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * SPACE / float(a[k - 1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two empty sets are alike, an empty one and another are not."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, common, assume_unique=True).mean())


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    union = distinct(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct(a, k))


def pack(a: np.ndarray) -> str:
    """Six bytes a hash, base64."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def fingerprints(df: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint, shingles (estimated distinct count); a null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [sketch(t, k, width) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fingerprint": [pack(x) for x in made], "shingles": [distinct(x, k) for x in made]})

    return mapped(texts(df), run, "fingerprint string, shingles double")


def merged_fingerprints(df: DataFrame, by: str, k: int = K) -> DataFrame:
    """One fingerprint for each value of by (nulls are a group): every task merges what it reads, so that a group
    of any size reaches the last merge as one sketch a task."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for key, text in zip(batch["key"], batch["fingerprint"]):
                new = unpack(text)
                held[key] = merge(held[key], new, k) if key in held else new
            if len(held) > 20_000:
                yield pd.DataFrame({"key": list(held), "fingerprint": [pack(x) for x in held.values()]})
                held = {}
        yield pd.DataFrame({"key": list(held), "fingerprint": [pack(x) for x in held.values()]}, dtype=object)

    parts = mapped(df.select(F.col(by).alias("key"), "fingerprint").where("fingerprint is not null"), partial, "fingerprint string", ("key",)).withColumn("key", F.col("key").cast("string"))

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(0, np.uint64)
        for text in pdf["fingerprint"]:
            out = merge(out, unpack(text), k)
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "fingerprint": [pack(out)], "shingles": [distinct(out, k)]})

    done = parts.groupBy("key").applyInPandas(last, "key string, fingerprint string, shingles double")
    return done.select(F.col("key").cast(df.schema[by].dataType).alias(by), "fingerprint", "shingles")


EDITED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_LOW = -(1 << 63)


def edited_pairs(df: DataFrame, k: int = K, width: int = WIDTH, buckets: int | None = None) -> DataFrame:
    """For each text its fingerprint and that of its edited text: the last quarter of its code points gives way to the
    first as many of the next document by doc_id (after the last: the first).

    Ranges of ids make buckets; the first document of each bucket also goes to the bucket before it, so every task finds
    the next document beside each of its own. Null texts are empty, null ids come first, equal ids go by their texts."""
    spark = df.sparkSession
    rows = texts(df).withColumn("at", F.coalesce(F.col("doc_id"), F.lit(_LOW)))
    if buckets is None:
        held = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
        buckets = max(3 * partitions(spark), int(held // BUCKET_BYTES))
    n = buckets
    cuts = np.unique(np.array(rows.select(F.col("at").cast("double").alias("at")).approxQuantile("at", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else [], float))

    def bucket_of(at: pd.Series) -> np.ndarray:
        return np.searchsorted(cuts, at.to_numpy(float), side="right").astype(np.int32)

    bucket = F.pandas_udf(lambda at: pd.Series(bucket_of(at)), "int")
    firsts = sorted((r["b"], r["at"]) for r in rows.groupBy(bucket("at").alias("b")).agg(F.min("at").alias("at")).collect())  # a row a bucket
    also = {at: firsts[i - 1][0] for i, (_, at) in enumerate(firsts)}

    def goes(at: pd.Series) -> pd.Series:
        own = bucket_of(at)
        return pd.Series([[int(b)] if a not in also else [int(b), also[a]] for a, b in zip(at.tolist(), own)])

    both = F.posexplode(F.pandas_udf(goes, "array<int>")("at")).alias("after", "bucket")
    dealt = rows.select("*", both).repartition(n, "bucket").sortWithinPartitions("bucket", "after", "at", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            out = []
            for key, text, after, b in zip(batch["doc_id"], batch["text"], batch["after"], batch["bucket"]):
                here = sketch(text, k, width)
                if held is not None and held[3] == b and not held[4]:
                    m = len(held[1]) // 4
                    edited = held[1][: len(held[1]) - m] + text[:m]
                    changed = sketch(edited, k, width)
                    out.append((held[0], len(held[1]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), pack(held[2]), pack(changed), resemblance(held[2], changed, k), resemblance(held[2], here, k)))
                held = (key, text, here, b, after)
            yield pd.DataFrame(out, columns=["doc_id", *[c.split()[0] for c in EDITED.split(", ")]])

    return mapped(dealt.select("doc_id", "text", "after", "bucket"), run, EDITED)


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_pairs(documents(spark, sf_dir))
