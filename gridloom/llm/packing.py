"""Best-fit packing of token sequences by exact complements."""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import documents, mapped, texts, written

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: White-space-free parts of texts that a Python worker remembers the ids of.
CACHE_WORDS = 700_000
#: Letters up to here are letters to every version of Unicode.
LAST_LATIN = "\u024f"
#: The bytes of an id.
ID = struct.Struct("<I").pack


class _Known(dict):
    """Ids of words; one that isn't there counts as a miss, is noted and has none."""

    def __init__(self, known=()):
        super().__init__(known)
        self.missing: set[str] = set()
        self.misses = 0

    def __missing__(self, word: str) -> bytes:
        self.missing.add(word)
        self.misses += 1
        return b""


class WordEncoder:
    """Ids by the tokenizers library, which a white space always splits, so each part between spaces is encoded once.

    It also splits letters from marks after them and ignores case, so "Word," is "word" and ","; plain lower-case letters
    need neither its normaliser nor its splitter and go to its model at once. A text that may hold the string of an added
    token, in any case, is encoded by the library as a whole, as such a string is one id wherever it stands."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)", re.IGNORECASE)
        self.model = self.tokenizer.model
        self._check()
        self.cache = _Known()

    def _check(self) -> None:
        """That this vocabulary splits and normalises as said above; ValueError where it doesn't."""
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        for a, b in (("Word", ","), ("one", " two"), ("x\n", "y z"), ("Abc", "!?"), ("wörd", ".")):
            if ids(a + b) != ids(a) + ids(b) or ids(a) != ids(a.lower()):
                raise ValueError("this vocabulary joins parts that WordEncoder encodes apart")

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.cache) > CACHE_WORDS:
            self.cache = _Known((w, x) for w, x in self.cache.items() if len(w) < 8)  # short words are the frequent ones
            if len(self.cache) > CACHE_WORDS // 2:
                self.cache.clear()
        whole = {i for i, t in enumerate(batch) if self.added.search(t)}
        parts = [[] if i in whole else t.replace("\n", " ").split(" ") for i, t in enumerate(batch)]
        cache, out, later = self.cache, [], []
        for i, words in enumerate(parts):
            before = cache.misses
            out.append(b"".join(map(ID, self.tokenizer.encode(batch[i], add_special_tokens=False).ids)) if i in whole else b"".join(map(cache.__getitem__, words)))
            if cache.misses > before:
                later.append(i)
        if later:
            new, cache.missing = cache.missing, set()
            self._learn(new)
            for i in later:
                out[i] = b"".join(map(cache.__getitem__, parts[i]))
        return out

    def _learn(self, words: set[str]) -> None:
        """Adds words to the cache."""
        cache, later, others = self.cache, [], set()
        for w in words:
            stem = w.rstrip(string.punctuation)
            if not stem or not stem[-1].isalpha() or stem[-1] > LAST_LATIN or stem[-1] == "İ":  # which ends in a mark in lower case
                stem = w
            marks = w[len(stem) :]
            if stem.isascii():
                stem = stem.lower()
                if stem not in cache and stem.isalpha():
                    cache[stem] = b"".join([ID(t.id) for t in self.model.tokenize(stem)])
            if stem in cache and marks in cache:
                cache[w] = cache[stem] + cache[marks]
            else:
                later += (w, stem, marks)
                others |= {stem, marks}
        others = [x for x in others if x not in cache]
        for x, found in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            cache[x] = b"".join(map(ID, found.ids))
        for w, stem, marks in zip(later[::3], later[1::3], later[2::3]):
            cache[w] = cache[stem] + cache[marks]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each whole text's ids and end_id, only longer ones cut: doc_id, piece, start, length, ids_crc32, task.

    Null and empty texts are the end id alone; task tells which task made the row."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                for key, ids in zip(part["doc_id"], encoder(path).encode(part["text"].tolist())):
                    ids += end
                    for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        out.append((key, i, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    made = mapped(texts(docs), run, "piece int, start long, length long, ids_crc32 long")
    return made.withColumn("task", F.spark_partition_id())


class Plan:
    """Slots for every piece of a histogram of lengths: pieces of one length are numbered from 0, and those from `first`
    on go to the sequences from `sequence` on at `offset`. Holds some slots a length, however many pieces there are."""

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.free = counts.astype(np.int64).copy()
        self.used = np.zeros_like(self.free)
        self.sequences = 0
        self.slots: list[tuple[int, int, int, int]] = []  # length, first, sequence, offset
        self._exact()
        self._best_fit()
        order = sorted(self.slots)
        self.slots_by_length = np.array(order, np.int64).reshape(-1, 4)

    def _place(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.slots.append((length, int(self.used[length]), sequence, offset))
        self.used[length] += n
        self.free[length] -= n

    def _fill(self, lengths: list[int]) -> None:
        """As many sequences of exactly these pieces as there are pieces for."""
        n = min(int(self.free[x]) // lengths.count(x) for x in lengths)
        offset = 0
        for x in lengths:
            self._place(x, n, self.sequences, offset)
            offset += x
        self.sequences += n

    def _complement(self, gap: int, length: int) -> list[int] | None:
        """One, two or three free pieces of just that sum, apart from one of length; large pieces first."""
        have = self.free.copy()
        have[length] -= 1
        if gap == 0:
            return []
        if have[gap] > 0:
            return [gap]
        there = have > 0
        if pair := self._pair(gap, have, there):
            return pair
        for a in np.flatnonzero(there[1:gap])[::-1] + 1:
            have[a] -= 1
            kept, there[a] = there[a], have[a] > 0
            pair = self._pair(gap - int(a), have, there, int(a))
            have[a] += 1
            there[a] = kept
            if pair:
                return [int(a), *pair]
            if 3 * a < gap:  # a is the largest of the three
                return None
        return None

    @staticmethod
    def _pair(total: int, have: np.ndarray, there: np.ndarray, most: int | None = None) -> list[int] | None:
        low, high = (total + 1) // 2, min(total - 1, most or total)
        if high < low:
            return None
        both = there[low : high + 1] & there[total - high : total - low + 1][::-1]
        if total % 2 == 0 and have[total // 2] < 2:
            both[0] = False
        found = np.flatnonzero(both)
        return [low + int(found[-1]), total - low - int(found[-1])] if len(found) else None

    def _exact(self) -> None:
        for length in range(self.capacity, 0, -1):
            while self.free[length] > 0:
                found = self._complement(self.capacity - length, length)
                if found is None:
                    break
                self._fill([length, *found])

    def _best_fit(self) -> None:
        """The rest, longest first, each into the fullest open sequences that have room."""
        gaps: dict[int, list[tuple[int, int]]] = {}  # free room: runs of sequences (first, number)
        for length in range(self.capacity, 0, -1):
            while self.free[length] > 0:
                n = int(self.free[length])
                gap = min((g for g in gaps if g >= length), default=None)
                if gap is None:
                    each = self.capacity // length
                    full, over = divmod(n, each)
                    for count, number in ((each, full), (over, 1)):
                        if count and number:
                            for i in range(count):
                                self._place(length, number, self.sequences, i * length)
                            gaps.setdefault(self.capacity - count * length, []).append((self.sequences, number))
                            self.sequences += number
                    continue
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                take = min(n, number)
                self._place(length, take, first, self.capacity - gap)
                gaps.setdefault(gap - length, []).append((first, take))
                if number > take:
                    gaps.setdefault(gap, []).append((first + take, number - take))


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Gives a written table of pieces() sequence_id and offset.

    The driver holds one count a length and plans with those; pieces are numbered within their task and length, and tasks
    by the sums of the counts before them, so that a length of any frequency is spread over all tasks. Every row gets a place of its
    own, whether its doc_id is null or repeated; no rows give no sequences."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in found.groupBy("length").count().collect():  # capacity rows at most
        counts[r["length"]] = r["count"]
    slots = Plan(counts).slots_by_length
    width = int(counts.max()) + 1
    keys, sequence, first, offset = slots[:, 0] * width + slots[:, 1], slots[:, 2], slots[:, 1], slots[:, 3]

    by_task = found.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("task", "length").orderBy("doc_id", "piece", "ids_crc32")
    numbered = found.withColumn("own", F.row_number().over(own)).join(by_task, ["task", "length"]).withColumn("number", F.col("before") + F.col("own") - 1).drop("own", "before", "task")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number = batch.pop("number").to_numpy()
            at = np.searchsorted(keys, batch["length"].to_numpy() * width + number, side="right") - 1
            batch["sequence_id"], batch["offset"] = sequence[at] + number - first[at], offset[at]
            yield batch

    return mapped(numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number"), run, "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """Pieces of all rows of docs and their places: a null text counts as empty, repeated rows are packed each, and other columns
    than doc_id and text, whatever their names, take no part."""
    return packed(written(pieces(docs, path)))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary_path())
