"""SentencePiece BPE: vectorised merge rounds over flat symbol arrays, and decoding."""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import documents, mapped, texts

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Distinct words that a Python worker remembers; beyond it forgets the longer ones.
CACHE_WORDS = 700_000
_SHIFT = 21
_NONE = np.iinfo(np.int64).max

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class PieceCodec:
    """Encodes and decodes as the sentencepiece library does for an identity-normalised BPE model with byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.end = sp.eos_id()
        self.byte_ids = np.zeros(256, np.int64)
        plain: dict[str, int] = {}
        self.shown: list[bytes] = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.shown.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i):
                self.shown.append(b"")
            elif sp.is_unknown(i):
                self.shown.append(" ⁇ ".encode())
            else:
                plain[p] = i
                self.shown.append(p.replace(SPACE, " ").encode())
        self.opens_with_space = {i for p, i in plain.items() if p.startswith(SPACE)}
        self._merges(plain, {i: sp.get_score(i) for i in plain.values()}, n)
        self._boundaries([p for p in plain if len(p) > 1], {p: sp.get_score(i) for p, i in plain.items()})
        self.cache: dict[str, tuple[bytes, str]] = {}

    def _merges(self, plain: dict[str, int], scores: dict[int, float], n: int) -> None:
        """The table of pairs: key of both symbols, rank of the score, merged id. A symbol is an id, or n + code point."""
        self.n = n
        self.of_char = np.arange(0x110000, dtype=np.int64) + n
        for p, i in plain.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        symbol = lambda s: plain[s] if s in plain else n + ord(s) if len(s) == 1 else None
        order = {s: k for k, s in enumerate(sorted({scores[i] for p, i in plain.items() if len(p) > 1}, reverse=True))}
        rows, alone = {}, np.ones(len(order), bool)
        uses = np.zeros(len(order), np.int64)
        for p, i in plain.items():
            if len(p) < 2:
                continue
            rank = order[scores[i]]
            uses[rank] += 1
            for cut in range(1, len(p)):
                a, b = symbol(p[:cut]), symbol(p[cut:])
                if a is not None and b is not None:
                    rows[a << _SHIFT | b] = (rank, i)
                for part in (p[:cut], p[cut:]):  # a part that ranks after its whole may meet a better pair once merged
                    if len(part) > 1 and part in plain and order[scores[plain[part]]] >= rank:
                        alone[order[scores[plain[part]]]] = False
        alone[uses > 1] = False
        self.keys = np.array(sorted(rows) or [-1], np.int64)
        self.ranks = np.array([rows[k][0] if rows else 0 for k in self.keys.tolist()], np.int64)
        self.merged = np.array([rows[k][1] if rows else 0 for k in self.keys.tolist()], np.int64)
        self.together = np.append(alone, False)  # by rank: all its pairs in a word may merge in one round

    def _boundaries(self, long: list[str], scores: dict[str, float]) -> None:
        """Where a text can be cut without changing its pieces: no piece crosses such a place."""
        assert not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in long), "pieces with inner spaces aren't supported"
        line = "" if any("\n" in p for p in long) else "\n"
        marks = "".join(c for c in ",.;:!?" if not any(re.search(f"[^{SPACE},.;:!?]{re.escape(c)}", p) for p in long))
        marks = re.escape(marks)
        stop = f"{SPACE}{line}{marks}"
        mark = f"[{marks}]*" if marks else ""
        self.word = re.compile(f"{SPACE}+{mark}[^{stop}]*" + (f"|{line}+" if line else "") + (f"|[{marks}]+[^{stop}]*" if marks else "") + f"|[^{stop}]+")
        runs = sorted(len(p) for p in long if not p.strip(SPACE))
        others = min((scores[p] for p in long if p.strip(SPACE)), default=0)
        same = {scores[SPACE * k] for k in runs}
        #: Runs of spaces merge from the left up to the longest run piece, after all else, if every length is a piece of one low score.
        self.run = runs[-1] if runs and runs == list(range(2, runs[-1] + 1)) and len(same) == 1 and min(same) < others else 0

    def _words(self, text: str) -> list[str]:
        return self.word.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _cut(self, word: str) -> list[str]:
        """Long runs of spaces in blocks, so that no word needs more rounds than its pieces."""
        n = len(word) - len(word.lstrip(SPACE))
        if not self.run or n <= 2 * self.run:
            return [word]
        at = (n - 1) // self.run * self.run
        return [SPACE * self.run] * (at // self.run) + [word[at:]]

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word. Each round finds every word's best-ranked pair and merges it: all its leftmost
        non-overlapping places at once where that can't let a better pair in, else the leftmost one."""
        if not words:
            return []
        sym = self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        seg = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_sym, done_seg = [], []
        while len(sym):
            key = (sym[:-1] << _SHIFT) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(sym), _NONE)
            hit = np.flatnonzero((self.keys[at] == key) & (seg[:-1] == seg[1:]))
            rank[hit] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            best = np.minimum.reduceat(rank, starts)
            local = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(sym)]))
            live = best[local] < _NONE
            done_sym.append(sym[~live])
            done_seg.append(seg[~live])
            if not live.any():
                break
            place = np.flatnonzero(live & (rank == best[local]))
            first = np.r_[True, local[place][1:] != local[place][:-1]]
            joined = np.r_[False, (np.diff(place) == 1)] & ~first
            begin = np.maximum.accumulate(np.where(joined, 0, np.arange(len(place))))
            even = (np.arange(len(place)) - begin) % 2 == 0
            place = place[first | (even & self.together[rank[place]])]
            sym[place] = self.merged[at[place]]
            live[place + 1] = False
            sym, seg = sym[live], seg[live]
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        by = np.argsort(seg, kind="stable")
        sym, seg = sym[by], seg[by]
        return np.split(sym, np.searchsorted(seg, np.arange(1, len(words))))

    def _bytes(self, ids: np.ndarray) -> np.ndarray:
        """Characters without a piece become the pieces of their UTF-8 bytes."""
        if (ids < self.n).all():
            return ids
        return np.concatenate([[i] if i < self.n else self.byte_ids[list(chr(i - self.n).encode("utf-8", "surrogatepass"))] for i in ids.tolist()]).astype(np.int64)

    def learn(self, words: set[str]) -> None:
        """Adds words to the cache."""
        words = list(words)
        parts = [self._cut(w) for w in words]
        ids = [self._bytes(x) for x in self.merge([p for c in parts for p in c])]
        k = 0
        for w, c in zip(words, parts):
            x = ids[k] if len(c) == 1 else np.concatenate(ids[k : k + len(c)])
            k += len(c)
            self.cache[w] = (x.astype(np.int32).tobytes(), " ".join(map(str, x.tolist())))

    def split(self, batch: list[str]) -> list[list[str]]:
        """Words of each text, all of them in the cache."""
        if len(self.cache) > CACHE_WORDS:
            self.cache = {w: x for w, x in self.cache.items() if len(w) < 8}  # short words are the frequent ones
            if len(self.cache) > CACHE_WORDS // 2:
                self.cache.clear()
        out = [self._words(t) for t in batch]
        missing = {w for words in out for w in words if w not in self.cache}
        if missing:
            self.learn(missing)
        return out

    def encode(self, batch: list[str], end: bool = False) -> list[np.ndarray]:
        tail = np.array([self.end] * end, np.int32)
        return [np.concatenate([np.frombuffer(b"".join([self.cache[w][0] for w in words]), np.int32), tail]) for words in self.split(batch)]

    def decode(self, ids: list[int]) -> str:
        first = next((i for i in ids if self.shown[i]), None)
        cuts = [k for k, i in enumerate(ids) if not self.shown[i]]  # a control id ends a run of bytes
        runs = [ids] if not cuts or cuts == [len(ids) - 1] else [ids[a:b] for a, b in zip([0, *cuts], [*cuts, len(ids)])]
        text = "".join([b"".join([self.shown[i] for i in run]).decode("utf-8", "each_byte") for run in runs])
        return text[1:] if first in self.opens_with_space else text


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One for each Python worker."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def encode_pieces(df: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids: every whole text's ids with the end id last. A null text counts as empty and gives the end id alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": codec(model_file).encode(batch["text"].tolist(), end=True)})

    return mapped(texts(df), run, "ids array<int>")


def decode_pieces(df: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [None if x is None else codec(model_file).decode(list(x)) for x in batch["ids"]]})

    return mapped(df.select("doc_id", "ids"), run, "text string")


def piece_digests(df: DataFrame, model_file: str) -> DataFrame:
    """Encodes and decodes every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256. Rows as in the input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model_file)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                n, ids_sha, text_sha = [], [], []
                for words in c.split(part["text"].tolist()):
                    ids = [*np.frombuffer(b"".join([c.cache[w][0] for w in words]), np.int32).tolist(), c.end]
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join([*[c.cache[w][1] for w in words], str(c.end)]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    return mapped(texts(df), run, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir), model_path())
