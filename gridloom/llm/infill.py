"""Fill-in-middle: texts cut into prefix, middle and suffix at token ranks drawn from their ids, by overlapping chunks.

A token ends at each code point but between two letters of A-Z in either case, so whether one ends is a predicate of a code point and the next.
Chunks that overlap by one code point therefore count their ends alone, all chunks of a batch at once; prefix sums of the counts
tell the chunk that owns the token of a rank, and only those chunks are scanned again for its place."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import documents, mapped, texts

#: Code points of a chunk, without the one that it shares with the next; and code points that are looked at together.
CHUNK, BLOCK = 4096, 2_000_000
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts as many stay plain, and of a hundred others as many put the suffix first; SEED begins what ids are hashed with.
PLAIN, SUFFIX_FIRST, SEED = 10, 20, "1:"


def _ends(chunks: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens end in chunks laid end to end, and where each chunk begins. A chunk is its text with the first code point of the next one,
    or with True its text's last."""
    points = np.frombuffer("".join([t for t, _ in chunks]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lower = points | 32
    letter = (lower >= 97) & (lower <= 122)
    ends = np.r_[~(letter[:-1] & letter[1:]), True]
    size = np.array([len(t) for t, _ in chunks])
    after = np.cumsum(size)
    last = np.array([x for _, x in chunks], bool)
    ends[after - 1] = last  # the code point of the next chunk is counted there
    return ends, after - size


def _blocks(sizes: list[int]) -> Iterator[slice]:
    """Runs of chunks of some BLOCK code points together."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= BLOCK or i + 1 == len(sizes):
            yield slice(begin, i + 1)
            begin, held = i + 1, 0


def _chunk(text: str, at: int) -> tuple[str, bool]:
    return text[at : at + CHUNK + 1], at + CHUNK >= len(text)


def token_cuts(batch: list[str], ranks: callable) -> tuple[np.ndarray, np.ndarray]:
    """The number of tokens of each text, and the code points before the ends of as many tokens as ranks(numbers), an array of (texts, ranks), asks for."""
    places = [(i, at) for i, t in enumerate(batch) for at in range(0, len(t), CHUNK)]
    counts = np.zeros(len(places), np.int64)
    for part in _blocks([min(CHUNK, len(batch[i]) - at) for i, at in places]):
        ends, begin = _ends([_chunk(batch[i], at) for i, at in places[part]])
        counts[part] = np.add.reduceat(ends, begin, dtype=np.int64)
    row = np.array([i for i, _ in places], np.int64)
    n = np.bincount(row, counts, len(batch)).astype(np.int64) if len(places) else np.zeros(len(batch), np.int64)
    upto = np.cumsum(counts)
    asked = ranks(n)
    cuts = np.zeros(asked.shape, np.int64)
    r, k = np.nonzero(asked > 0)
    if not len(r):
        return n, cuts
    rank = (np.cumsum(n) - n)[r] + asked[r, k]  # among the tokens of all texts
    owner = np.searchsorted(upto, rank)
    scanned, of = np.unique(owner, return_inverse=True)
    local = rank - (upto - counts)[owner]
    for part in _blocks([CHUNK] * len(scanned)):
        ends, begin = _ends([_chunk(batch[places[c][0]], places[c][1]) for c in scanned[part]])
        found = np.flatnonzero(ends)
        before = np.searchsorted(found, begin)
        mine = np.flatnonzero((of >= part.start) & (of < part.stop))
        chunk = of[mine] - part.start
        start = np.array([places[c][1] for c in scanned[part]])
        cuts[r[mine], k[mine]] = start[chunk] + found[before[chunk] + local[mine] - 1] - begin[chunk] + 1
    return n, cuts


def draws(key: str | None, seed: str = SEED) -> list[int]:
    """Four numbers of 32 bits of an id; a null one is as an empty one."""
    found = hashlib.sha256(f"{seed}{key or ''}".encode()).hexdigest()
    return [int(found[i : i + 8], 16) for i in (0, 8, 16, 24)]


def infilled(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm, spm), prefix_chars, middle_chars (null where plain), output: the text of each row, cut
    after two ranks that its id draws.

    A null text counts as empty; empty texts, and those that hold one of the marks, stay plain. Rows of one id are cut at the same ranks, each of its own text; a
    null id is drawn as an empty one. Other columns take no part, whatever their names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = batch["text"].tolist()
            h = np.array([draws(k, seed) for k in batch["doc_id"]], np.int64).reshape(-1, 4)
            n, cuts = token_cuts(found, lambda n: h[:, :2] % (n[:, None] + 1))
            out = []
            for key, t, size, own, (_, _, h3, h4) in zip(batch["doc_id"], found, n.tolist(), cuts.tolist(), h.tolist()):
                low, high = sorted(own)
                if not t or h3 % 100 >= 100 - PLAIN or any(x in t for x in (PREFIX, SUFFIX, MIDDLE)):
                    out.append((key, size, "plain", None, None, t))
                elif h4 % 100 < SUFFIX_FIRST:
                    out.append((key, size, "spm", low, high - low, f"{SUFFIX}{t[high:]}{PREFIX}{t[:low]}{MIDDLE}{t[low:high]}"))
                else:
                    out.append((key, size, "psm", low, high - low, f"{PREFIX}{t[:low]}{SUFFIX}{t[high:]}{MIDDLE}{t[low:high]}"))
            yield pd.DataFrame(out, columns=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return mapped(texts(docs), run, "n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that infilled() was given, from its output and form. Its parts hold none of the marks, and no mark can arise between
    them, as all begin with the sign that no other one has inside."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.element_at(parts, i)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)


def op11_infill(spark, sf_dir: str) -> DataFrame:
    made = infilled(documents(spark, sf_dir))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


_H = "(('0x' || substr(h, {0}, 8))::bigint)"
OP11_SQL = f"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as t, sha256('{SEED}' || coalesce(doc_id::varchar, '')) as h
  from documents
), e as (
  select doc_id, text, t, len(t) as n, {_H.format(1)} % (len(t) + 1) as a, {_H.format(9)} % (len(t) + 1) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or {_H.format(17)} % 100 >= 90 then 'plain'
      when {_H.format(25)} % 100 < 20 then 'spm' else 'psm' end as form
  from d
), f as (
  select doc_id, text, n, form, array_to_string(t[1:least(a, b)], '') as p, array_to_string(t[least(a, b) + 1:greatest(a, b)], '') as m,
    array_to_string(t[greatest(a, b) + 1:n], '') as s
  from e
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from f
"""
