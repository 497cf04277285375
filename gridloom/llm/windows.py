"""Packing of token sequences into windows by non-negative least squares over a histogram of lengths.

The driver holds one count a length, whatever the corpus: it enumerates the combinations of up to DEPTH bins of lengths that fill a
window, solves for how often each is repeated, rounds, and lays what is left greedily, cutting pieces where a window would stay
open. Its plan is runs of equal pieces, which tasks look their own pieces up in."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import documents, mapped, sized_join, texts, written
from .packing import END_ID, encoder, vocabulary_path

CAPACITY = 2048
#: Tokens of a bin of lengths, and pieces of a combination at most.
BIN, DEPTH = 8, 3


def combinations(bins: int, there: np.ndarray) -> np.ndarray:
    """Rows of three bin numbers, falling, 0 for none, that add up to bins; of those in there only."""
    a, b = np.meshgrid(np.arange(1, bins + 1), np.arange(bins + 1), indexing="ij")
    c = bins - a - b
    fits = (a >= b) & (b >= c) & (c >= 0)
    rows = np.stack([a[fits], b[fits], c[fits]], axis=1)
    known = np.r_[True, there[1:]]
    return rows[known[rows].all(axis=1)]


def non_negative_least_squares(matrix: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |matrix x - goal|, by active sets: a column enters where the residual asks for it, and the line from the last
    solution to the unbounded one ends where an entry would fall below 0."""
    n = matrix.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    small = 1e-9 * max(1.0, float(np.abs(goal).max(initial=0)))
    for _ in range(3 * len(goal) + 10):
        slope = np.where(free, -np.inf, matrix.T @ (goal - matrix @ x))
        best = int(np.argmax(slope)) if n else -1
        if best < 0 or slope[best] <= small:
            break
        free[best] = True
        while True:
            own = np.flatnonzero(free)
            full = np.linalg.lstsq(matrix[:, own], goal, rcond=None)[0]
            if (full > 0).all():
                x[:] = 0
                x[own] = full
                break
            low = full <= 0
            step = float(np.min(x[own][low] / (x[own][low] - full[low]))) if (x[own][low] > full[low]).any() else 0.0
            moved = x[own] + step * (full - x[own])
            moved[low & (moved <= small * 1e-3)] = 0
            x[:] = 0
            x[own] = moved
            free[own[moved <= 0]] = False
            if not free.any():
                break
    return x


class WindowPlan:
    """Where every piece of a histogram of lengths goes, as rows of slots: length, start, first, count, size, sequence, offset. Pieces of
    a length are numbered from 0; of those from first on, as many as count, the size tokens from start on go to the sequences from
    sequence on, at offset. Holds some slots a length, however many pieces there are."""

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.there = counts.astype(np.int64).copy()  # pieces by what is left of them
        #: By what is left: runs of (length, first, start, count).
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {n: [(n, 0, 0, int(counts[n]))] for n in np.flatnonzero(counts).tolist()}
        self.left = int((np.arange(len(counts)) * self.there).sum())
        self.sequences = 0
        self.slots: list[tuple[int, int, int, int, int, int, int]] = []
        opened = self._by_squares()
        for used, sequence, count in opened:
            self._fill(self.capacity, used, sequence, count)
        while self.left:
            room = min(self.capacity, 1 << self.left.bit_length() - 1)  # the last tokens go to sequences of powers of two
            count = self.left // room
            self.sequences += self._fill(room, 0, self.sequences, count, once=True)
        self.slots_by_length = np.array(sorted(self.slots), np.int64).reshape(-1, 7)

    def _take(self, left: int, n: int) -> list[tuple[int, int, int, int]]:
        """n pieces of which as much is left, as runs."""
        out, runs = [], self.runs[left]
        self.there[left] -= n
        self.left -= left * n
        while n:
            length, first, start, count = runs.pop()
            if count > n:
                runs.append((length, first + n, start, count - n))
                count = n
            out.append((length, first, start, count))
            n -= count
        return out

    def _give(self, left: int, run: tuple[int, int, int, int]) -> None:
        self.runs.setdefault(left, []).append(run)
        self.there[left] += run[3]
        self.left += left * run[3]

    def _place(self, runs: list[tuple[int, int, int, int]], size: int, sequence: int, offset: int) -> None:
        for length, first, start, count in runs:
            self.slots.append((length, start, first, count, size, sequence, offset))
            sequence += count

    def _by_squares(self) -> list[tuple[int, int, int]]:
        """Lays combinations of bins as often as least squares say, as long as the rest can fill what they leave open: runs of
        windows (used, sequence, count)."""
        bins = self.capacity // BIN
        of = -(-np.arange(self.capacity + 1) // BIN)
        histogram = np.bincount(of, self.there, bins + 1)
        rows = combinations(bins, histogram > 0)
        if not len(rows):
            return []
        matrix = np.zeros((bins + 1, len(rows)))
        for k in range(DEPTH):
            np.add.at(matrix, (rows[:, k], np.arange(len(rows))), 1)
        top = histogram.max()
        often = non_negative_least_squares(matrix[1:], histogram[1:] / top) * top
        opened, gaps = [], 0
        most = DEPTH * (BIN - 1)
        for i in np.argsort(-often, kind="stable").tolist():
            parts = rows[i][rows[i] > 0].tolist()
            n = min(int(round(often[i])), *[int(histogram[p]) // parts.count(p) for p in parts], (self.left - gaps) // (self.capacity + most))
            if n <= 0:
                continue
            for p in parts:
                histogram[p] -= n
            members = [self._of_bin(p, n) for p in parts]
            at = 0
            while at < n:
                step = min(m[0][1] for m in members)
                offset = 0
                for m in members:
                    size, count, runs = m[0]
                    own, rest = _split(runs, step)
                    self._place(own, size, self.sequences, offset)
                    offset += size
                    m[:1] = [(size, count - step, rest)] if count > step else []
                if offset < self.capacity:
                    opened.append((offset, self.sequences, step))
                    gaps += (self.capacity - offset) * step
                self.sequences += step
                at += step
        return opened

    def _of_bin(self, number: int, n: int) -> list[tuple[int, int, list]]:
        """n pieces of a bin, the longest first: size, count, runs."""
        out = []
        for size in range(number * BIN, (number - 1) * BIN, -1):
            take = min(n, int(self.there[size]))
            if take:
                out.append((size, take, self._take(size, take)))
                n -= take
        return out

    def _fill(self, room: int, used: int, sequence: int, count: int, once: bool = False) -> int:
        """Fills count windows of room tokens from used on with the longest pieces that fit, and at last with the head of the longest left,
        whose tail stays. With once, ends after one pattern. Returns how many windows are full."""
        done = 0
        while done < count and self.left:
            gap, pattern, n = room - used, [], count - done
            for size in (np.flatnonzero(self.there[1 : gap + 1])[::-1] + 1).tolist():
                k = min(gap // size, int(self.there[size]))
                if k:
                    pattern.append((size, k))
                    n = min(n, int(self.there[size]) // k)
                    gap -= k * size
                if not gap:
                    break
            cut = 0
            if gap:
                in_use = dict(pattern)
                longer = (np.flatnonzero(self.there[gap + 1 :])[::-1] + gap + 1).tolist()
                cut = next((x for x in longer if self.there[x] > in_use.get(x, 0)), 0)
                if cut:
                    n = min(n, int(self.there[cut]) // (in_use.get(cut, 0) + 1))
            offset = used
            for size, k in pattern:
                for _ in range(k):
                    self._place(self._take(size, n), size, sequence + done, offset)
                    offset += size
            if cut:
                heads = self._take(cut, n)
                self._place(heads, gap, sequence + done, offset)
                for length, first, start, m in heads:
                    self._give(cut - gap, (length, first, start + gap, m))
            done += n
            if once:
                break
        return done


def _split(runs: list, n: int) -> tuple[list, list]:
    """The first n pieces of runs, and the others."""
    own, rest = [], []
    for length, first, start, count in runs:
        take = min(n, count)
        if take:
            own.append((length, first, start, take))
        if count > take:
            rest.append((length, first + take, start, count - take))
        n -= take
    return own, rest


def window_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each whole text's ids and end_id in pieces of capacity tokens, the last one shorter: doc_id, doc_tokens, start, length, own (the number among the task's
    pieces of that length), ids (16 bits each, or 32 where the vocabulary needs them), task. Null and empty texts are the end id alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [0] * (capacity + 1)
        known = encoder(path)
        kind = id_kind(known.tokenizer.get_vocab_size())
        width, end = np.dtype(kind).itemsize, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part, out, first = batch.iloc[lo : lo + 256], [], 0
                found = known.encode(part["text"].tolist())
                ids = memoryview(np.frombuffer(end.join([*found, b""]), "<u4").astype(kind).tobytes())
                for key, raw in zip(part["doc_id"], found):
                    n = len(raw) // 4 + 1
                    for at in range(0, n, capacity):
                        size = min(capacity, n - at)
                        out.append((key, n, at, size, seen[size], bytes(ids[(first + at) * width : (first + at + size) * width])))
                        seen[size] += 1
                    first += n
                yield pd.DataFrame(out, columns=["doc_id", "doc_tokens", "start", "length", "own", "ids"])

    made = mapped(texts(docs), run, "doc_tokens long, start long, length long, own long, ids binary")
    return made.withColumn("task", F.spark_partition_id())


def id_kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def in_windows(found: DataFrame, kind: str, capacity: int = CAPACITY) -> DataFrame:
    """Places of the pieces of a written table of window_pieces(): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Each id of
    every row lies in one piece, whether the row's doc_id is null or repeated; no rows give no sequences."""
    counts = np.zeros(capacity + 1, np.int64)
    by_task = written(found.groupBy("task", "length").agg(F.count("*").alias("n")))
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[r["length"]] = r["n"]
    slots = WindowPlan(counts).slots_by_length
    shared = found.sparkSession.sparkContext.broadcast(slots)  # some slots a length, whatever the input's size
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = sized_join(found, written(by_task), ["task", "length"], "inner", 40).withColumn("number", F.col("before") + F.col("own"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = shared.value
        wide = int((slots[:, 2] + slots[:, 3]).max(initial=0)) + 1
        keys = (slots[:, 0] * (capacity + 1) + slots[:, 1]) * wide + slots[:, 2] if len(slots) else slots[:, 0]
        for batch in batches:
            row, length, number = np.arange(len(batch)), batch["length"].to_numpy(), batch["number"].to_numpy()
            start = np.zeros(len(batch), np.int64)
            ids = memoryview(np.frombuffer(b"".join(batch["ids"].tolist()), kind).astype("<u4").tobytes())
            first, out = np.cumsum(length) - length, []
            while len(row):  # a round for each cut of the piece that is cut most often
                at = np.searchsorted(keys, (length[row] * (capacity + 1) + start[row]) * wide + number[row], side="right") - 1
                size = slots[at, 4]
                begin = 4 * (first[row] + start[row])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * size).tolist())]
                own = batch.iloc[row]
                out.append(pd.DataFrame({"doc_id": own["doc_id"].to_numpy(), "start": own["start"].to_numpy() + start[row], "length": size, "ids_crc32": crc, "doc_tokens": own["doc_tokens"].to_numpy(), "sequence_id": slots[at, 5] + number[row] - slots[at, 2], "offset": slots[at, 6]}))
                start[row] += size
                row = row[start[row] < length[row]]
            if out:
                yield pd.concat(out, ignore_index=True)

    columns = ["doc_id", "doc_tokens", "start", "length", "number", "ids"]
    return mapped(numbered.select(*columns), run, "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_windows(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all rows of docs in windows of capacity tokens, and at last in sequences of powers of two: none needs padding. A null text counts
    as empty, repeated rows are packed each, and other columns than doc_id and text, whatever their names, take no part."""
    kind = id_kind(encoder(path).tokenizer.get_vocab_size())
    return in_windows(written(window_pieces(docs, path, capacity), codec="zstd"), kind, capacity)


def op12_windows(spark, sf_dir: str) -> DataFrame:
    return pack_windows(documents(spark, sf_dir), vocabulary_path())
