"""Substring dedup by sliding spans of sentences."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import discard, documents, texts, written
from .shingles import _BLANK, _BYTE, _R, _mix

#: Non-blank bytes that count as a word, for scripts without spaces.
WORD_BYTES = 8


class Rule(NamedTuple):
    """A span is the shortest run from its first sentence that has at least so many sentences and words (or WORD_BYTES bytes for each
    word). With cut, a sentence also ends after each word whose hash is a multiple of cut or that repeats the word before it: a passage
    that begins or ends inside a sentence then has whole sentences of its own, the same in every text, whatever stands around it."""

    sentences: int
    words: int
    cut: int


#: drop_spans' default: three whole sentences. The queries use PASSAGES.
SENTENCES, PASSAGES = Rule(3, 0, 0), Rule(3, 24, 4)
_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_LETTER = np.zeros(256, np.int64)  # letters and digits, and all bytes of other scripts
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_MARK = np.zeros(256, bool)
_MARK[[*b".!?"]] = True
_WIDE = (0xE280A6, 0xE38082, 0xEFBC81, 0xEFBC9F)  # … 。 ！ ？


class Spans(NamedTuple):
    """starts: the byte where each sentence begins, and the end. at: those with words. keys: a hash for each span, which begins at sentence
    at[i] and ends before at[ends[i]]."""

    starts: np.ndarray
    at: np.ndarray
    keys: np.ndarray
    ends: np.ndarray


def _wide_marks(raw: np.ndarray) -> np.ndarray:
    """Where a sentence mark of three bytes ends that no other one follows."""
    out = np.zeros(len(raw), bool)
    if len(raw) > 2 and (raw >= 0xE2).any():
        three = (raw[:-2].astype(np.uint32) << 16) | (raw[1:-1].astype(np.uint32) << 8) | raw[2:]
        found = np.isin(three, _WIDE)
        out[2:] = found
        out[2:-3] &= ~found[3:]
    return out


def spans_of(raw: bytes, rule: Rule) -> Spans:
    """Sentences join to the whole text: each ends with its marks and the white space after, or with a line. White space and the case
    of A-Z don't count."""
    raw = np.frombuffer(raw, np.uint8)
    inner = ~_BLANK[raw]
    wide = _wide_marks(raw)
    first = np.flatnonzero(inner & np.r_[True, (~inner | wide)[:-1]]) if len(raw) else np.zeros(0, np.int64)
    if not len(first):
        none = np.zeros(0, np.int64)
        return Spans(np.array([0, len(raw)]) if len(raw) else np.zeros(1, np.int64), none, none, none)
    last = np.flatnonzero(inner & np.r_[(~inner | wide)[1:] & ~wide[:-1] & ~inner[1:] | wide[:-1], True])
    size = last + 1 - first
    offset = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(offset, size)
    power = np.cumprod(np.full(int(size.max()), _R, np.uint64))
    solid = raw[inner]
    words = _mix(np.add.reduceat(_BYTE[solid] * power[place], offset) + size.astype(np.uint64))
    lines = np.cumsum(raw == 10)
    ends = _MARK[raw[last]] | wide[last]
    ends[:-1] |= lines[first[1:]] > lines[last[:-1]]
    if rule.cut:
        ends |= (words >> np.uint64(33)) % np.uint64(rule.cut) == 0
        ends[1:] |= words[1:] == words[:-1]
    ends[-1] = True
    head = np.r_[0, np.flatnonzero(ends)[:-1] + 1]  # the first word of each sentence
    spoken = np.add.reduceat(np.add.reduceat(_LETTER[solid], offset), head) > 0
    at = np.flatnonzero(spoken)
    count = np.diff(np.r_[head, len(words)])
    words = words[np.repeat(spoken, count)]
    n_words, n_bytes = np.r_[0, np.cumsum(count[at])], np.r_[0, np.cumsum(np.add.reduceat(size, head)[at])]
    enough = np.minimum(np.searchsorted(n_words, n_words[:-1] + rule.words), np.searchsorted(n_bytes, n_bytes[:-1] + WORD_BYTES * rule.words))
    until = np.maximum(np.arange(len(at)) + rule.sentences, enough)
    until = until[until <= len(at)]
    factor = np.cumprod(np.full(len(words) + 1, _R, np.uint64))
    sums = np.r_[np.uint64(0), np.cumsum(words * factor[:-1], dtype=np.uint64)]
    low, high = n_words[: len(until)], n_words[until]
    back = np.cumprod(np.full(len(words) + 1, _INVERSE, np.uint64))
    keys = _mix((sums[high] - sums[low]) * back[low] + (high - low).astype(np.uint64))
    return Spans(np.r_[0, first[head[1:]], len(raw)], at, keys.view(np.int64), until)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def sentences(text: str, rule: Rule = SENTENCES) -> list[str]:
    """The sentences of a text."""
    raw = _bytes(text)
    edges = spans_of(raw, rule).starts.tolist()
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(edges, edges[1:])]


def without(text: str, places: list[int], rule: Rule) -> tuple[str, int]:
    """The text without the sentences of the spans at these places, and how many they are."""
    raw = _bytes(text)
    found = spans_of(raw, rule)
    gone = np.zeros(len(found.starts), np.int64)
    low, high = np.asarray(places), found.ends[places]
    np.add.at(gone, low, 1)
    np.add.at(gone, high, -1)
    cut = found.at[np.flatnonzero(np.cumsum(gone)[: len(found.at)] > 0)]
    keep = np.ones(len(found.starts) - 1, bool)
    keep[cut] = False
    edges = found.starts.tolist()
    return b"".join(raw[edges[i] : edges[i + 1]] for i in np.flatnonzero(keep).tolist()).decode("utf-8", "surrogatepass"), len(cut)


def _row_key(docs: DataFrame) -> list:
    """A row by its id, null as the highest, and its text: rows that share an id are told apart by their texts."""
    zero = F.lit(0).cast(docs.schema["doc_id"].dataType)
    return [F.col("doc_id").isNull().alias("unknown"), F.coalesce("doc_id", zero).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]


def span_rows(docs: DataFrame, rule: Rule) -> DataFrame:
    """unknown, doc_id and text_hash of a row with h and at, the hash and number of each span that the row does not have before, or with
    again, the numbers of those that it has."""
    key = ["unknown", "doc_id", "text_hash"]

    def table(of: pd.DataFrame, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        n = [len(x[1]) for x in found]
        rows = np.repeat([x[0] for x in found], n)
        return pd.DataFrame({c: of[c].to_numpy()[rows] for c in key} | {"h": np.concatenate([x[1] for x in found]), "at": np.concatenate([x[2] for x in found]), "again": None})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new, held, rows = [], 0, []
            for i, text in enumerate(batch["text"]):
                keys = spans_of(_bytes(text), rule).keys
                by = np.argsort(keys, kind="stable")
                first = np.ones(len(keys), bool)
                first[by[1:]] = keys[by[1:]] != keys[by[:-1]]
                if len(keys):
                    new.append((i, keys[first], np.flatnonzero(first).astype(np.int32)))
                    held += len(keys)
                if held > 100_000:
                    yield table(batch, new)
                    new, held = [], 0
                if not first.all():
                    rows.append((i, np.flatnonzero(~first).astype(np.int32)))
            if new:
                yield table(batch, new)
            if rows:
                own = batch.loc[[i for i, _ in rows], key].reset_index(drop=True)
                yield own.assign(h=pd.array([None] * len(rows), "Int64"), at=pd.array([None] * len(rows), "Int32"), again=[x for _, x in rows])

    rows = texts(docs).select(*_row_key(docs), "text")
    return rows.mapInPandas(run, f"unknown boolean, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, h long, at int, again array<int>")


def repeated_spans(docs: DataFrame, rule: Rule = SENTENCES) -> DataFrame:
    """key (unknown, doc_id, text_hash), cut: the numbers of a row's spans that occur before, by (key, number). What a row has before is
    known without a join; of the others, counts are summed before they move, so a span of any frequency is one row a task."""
    rows = written(span_rows(docs, rule).select(F.struct("unknown", "doc_id", "text_hash").alias("key"), "h", "at", "again"))
    new = rows.where("h is not null").select("h", "key", "at")
    first = new.groupBy("h").agg(F.count("*").alias("n"), F.min("key").alias("first_key")).where("n > 1")
    first = written(first.select("h", "first_key"))
    later = new.join(first.hint("shuffle_merge"), "h").where("key <> first_key").select("key", F.array("at").alias("at"))
    found = later.unionByName(rows.where("h is null").select("key", F.col("again").alias("at")))
    out = written(found.groupBy("key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("at")))).alias("cut")))  # of one document each
    discard(rows, first)
    return out


def drop_spans(docs: DataFrame, rule: Rule = SENTENCES) -> DataFrame:
    """The rows and columns of docs, with the sentences gone from text that a repeated span covers, and n_removed, the
    number of those sentences. The first span of a kind, by (doc_id, text hash, place) and null ids last, keeps its sentences.

    A document may end up empty; its row stays. Null texts stay null. Rows that share a doc_id and the whole text count as one
    row: they can't be told apart, so they are not compared with each other and lose the same places. A column n_removed of docs
    gives way; all other columns are passed through, whatever their names."""
    cut = repeated_spans(docs, rule)
    names = [c for c in docs.columns if c != "n_removed"]
    rows = docs.select(F.struct(*_row_key(docs)).alias("key"), F.struct(*names).alias("row"))
    rest = rows.join(cut, "key", "left").select("row", "cut")

    def clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, cuts in batches:
            done = [(t, 0) if c is None or t is None or not len(c) else without(t, list(c), rule) for t, c in zip(text, cuts)]
            yield pd.DataFrame(done, columns=["text", "n_removed"])

    done = rest.withColumn("done", F.pandas_udf(clean, "text string, n_removed int")("row.text", "cut"))
    return done.select(*[F.col("done.text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names], F.col("done.n_removed").alias("n_removed"))


def op10_substrings(spark, sf_dir: str) -> DataFrame:
    return drop_spans(documents(spark, sf_dir), PASSAGES).select("doc_id", "n_removed", "text")
