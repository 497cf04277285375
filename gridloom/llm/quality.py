"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import documents, mapped, texts

CHUNK, OVERLAP = 512, 64
STRIDE = 4  # a filter sees two strides
DIM, FILTERS = 8, 24
#: Training sees the whole texts of at most so many labelled documents, and of at most so many bytes together.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 24_000_000
#: Texts of a batch that are Python's at once in accepted().
TEXTS = 256
#: Chunks that are worked on at once.
ROWS = 512
#: Passes over the sample, and steps at least, so that a small sample is learned as well.
EPOCHS, STEPS, BATCH, RATE = 10, 800, 32, 0.004


def chunks(text: str) -> np.ndarray:
    """Overlapping rows of CHUNK bytes over the whole text, zeros after its end; one row at least."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


class ByteConvNet:
    """Byte embeddings, filters over 2 x STRIDE bytes, the maximum over each chunk, then over and across a document's
    chunks the maximum and the mean, and a logistic unit."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.p = {
            "embed": draw.normal(0, 0.5, (256, DIM)),
            "filters": draw.normal(0, 1 / np.sqrt(2 * STRIDE * DIM), (2 * STRIDE * DIM, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": draw.normal(0, 0.1, 2 * FILTERS),
            "out_bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def pooled(self, x: np.ndarray, places: bool = False):
        """Each filter's largest response in each row, cut at 0; with places, where it is."""
        p, half = self.p, STRIDE * DIM
        seen = p["embed"][x].reshape(len(x), -1, half)
        found = seen[:, :-1] @ p["filters"][:half]
        found += seen[:, 1:] @ p["filters"][half:]
        top = np.maximum(found.max(axis=1) + p["bias"], 0)
        return (top, found.argmax(axis=1)) if places else top

    def combine(self, top: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Documents' features from their chunks, which begin at starts."""
        n = np.diff(np.r_[starts, len(top)])[:, None]
        return np.hstack([np.maximum.reduceat(top, starts), np.add.reduceat(top, starts) / n]).astype(top.dtype)

    def scores(self, batch: list[str]) -> np.ndarray:
        """Probabilities of label 1, chunk rows in blocks of about a megabyte."""
        out, rows, held = [], [], 0
        for i, text in enumerate(batch):
            rows.append(chunks(text))
            held += len(rows[-1])
            if held >= 2048 or i == len(batch) - 1:
                x = np.concatenate(rows)
                top = np.concatenate([self.pooled(x[k : k + 256]) for k in range(0, len(x), 256)])
                starts = np.r_[0, np.cumsum([len(r) for r in rows])[:-1]]
                out.append(self.combine(top, starts) @ self.p["out"] + self.p["out_bias"])
                rows, held = [], 0
        z = np.concatenate(out).astype(np.float64) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        blocks = range(0, len(x), ROWS)  # long texts have many chunks
        top, at = (np.concatenate(p) for p in zip(*[self.pooled(x[k : k + ROWS], places=True) for k in blocks]))
        feats = self.combine(top, starts)
        prob = 1 / (1 + np.exp(-np.clip(feats @ p["out"] + p["out_bias"], -30, 30)))
        d = ((prob - y) / len(y)).astype(np.float32)
        n = np.diff(np.r_[starts, len(x)])
        doc = np.repeat(np.arange(len(y)), n)
        d_feats = d[:, None] * p["out"]
        d_top = d_feats[doc, FILTERS:] / n[doc][:, None]
        is_max = top == feats[doc, :FILTERS]
        ties = np.add.reduceat(is_max, starts, dtype=top.dtype)[doc]  # chunks overlap, so two may have the same maximum
        d_top += np.where(is_max, d_feats[doc, :FILTERS] / ties, 0)
        d_top *= top > 0
        out = {"embed": 0, "filters": 0, "bias": d_top.sum(0), "out": feats.T @ d, "out_bias": d.sum(keepdims=True)}
        for k in blocks:
            part, its = x[k : k + ROWS], d_top[k : k + ROWS]
            window = part[np.arange(len(part))[:, None, None], (at[k : k + ROWS] * STRIDE)[:, :, None] + np.arange(2 * STRIDE)]  # rows, filters, bytes
            d_seen = (its[:, :, None] * p["filters"].T).reshape(-1, DIM)
            bytes_at = window.reshape(-1)
            out["embed"] = out["embed"] + np.stack([np.bincount(bytes_at, d_seen[:, j], 256) for j in range(DIM)], axis=1)
            out["filters"] = out["filters"] + np.einsum("nf,nfk->kf", its, p["embed"][window].reshape(len(part), FILTERS, -1))
        return out

    def fit(self, docs: list[np.ndarray], y: np.ndarray, seed: int = 7) -> "ByteConvNet":
        draw = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(docs)))):
            order = draw.permutation(len(docs))
            for lo in range(0, len(order), BATCH):
                part = [docs[i] for i in order[lo : lo + BATCH]]
                starts = np.r_[0, np.cumsum([len(r) for r in part])[:-1]]
                step += 1
                for k, g in self._gradients(np.concatenate(part), starts, y[order[lo : lo + BATCH]]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.p[k] -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> ByteConvNet | float:
    """Fits on whole texts of labelled rows that aren't held out: the sample_docs first by a hash of their ids, and of those the first
    that have no more than sample_bytes of UTF-8 together, a bounded sample. Of several labels of an id the smaller counts, of several
    texts the first in order; rows without an id or label take no part.

    With labels of one class only, returns that class, and 0.5 without any, as the score for all texts."""
    kept = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("y"))
    kept = kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    found = texts(docs).join(F.broadcast(kept), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # sample_docs rows at most
    rows = found.withColumn("upto", upto).where(F.col("upto") <= sample_bytes).select("doc_id", "y", "text").collect()
    rows = sorted((r["doc_id"], r["y"], r["text"]) for r in rows)
    y = np.array([r[1] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.5
    return ByteConvNet().fit([chunks(r[2]) for r in rows], y)


def quality_scores(docs: DataFrame, model: ByteConvNet | float) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text; null and empty texts are scored as one chunk of zeros. One row per
    row of docs, whether its doc_id is null or repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = model.scores(batch["text"].tolist()) if isinstance(model, ByteConvNet) else np.full(len(batch), model)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    return mapped(texts(docs).withColumn("held_out", held_out()), run, "held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: ByteConvNet | float) -> DataFrame:
    """The rows of docs that the model accepts, all their columns unchanged."""

    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            few = (batch.slice(k, TEXTS).to_pylist() for k in range(0, len(batch), TEXTS))  # a batch has no further copy
            found = [model.scores(x) >= 0.5 if isinstance(model, ByteConvNet) else np.full(len(x), model >= 0.5) for x in few]
            yield pa.array(np.concatenate(found) if found else [], pa.bool_())

    return docs.where(F.arrow_udf(good, "boolean")(F.coalesce("text", F.lit(""))))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
