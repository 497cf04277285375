"""Rows without an id, repeated rows and ids, in the operators that compare texts."""

import hashlib
from collections import Counter

import numpy as np

from gridloom.llm import shingles, substrings


def test_suffixes_by_each_row(spark):
    rng = np.random.default_rng(2)
    text = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    shared, own = text(260), text(500)
    rows = [(1, own), (1, text(80) + shared + text(90)), (2, shared), (None, "x" + shared), (None, text(300)), (3, own[:150]), (4, None), (4, shared), (4, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as mark", "2 as unknown")
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in substrings.cut_repeats(docs).collect())
    seen = Counter((t or "")[i : i + 200] for _, t in rows for i in range(len(t or "") - 199))
    want = Counter()
    for k, t in rows:
        t = t or ""
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = "".join(c for c, g in zip(t, gone) if not g)
        want[(k, len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert got == want


def test_wide_ranks(spark, monkeypatch):
    """Ranks of many neighbourhoods are resolved position by position with the same result."""
    rng = np.random.default_rng(3)
    text = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    core = text(230)
    docs = spark.createDataFrame([(i, text(300) + core + text(300)) for i in range(12)], "doc_id long, text string")
    narrow = sorted((r["doc_id"], r["n_removed"]) for r in substrings.cut_repeats(docs).collect())
    monkeypatch.setattr(substrings, "WIDE", 2)
    assert sorted((r["doc_id"], r["n_removed"]) for r in substrings.cut_repeats(docs).collect()) == narrow and all(n >= 230 for _, n in narrow)


def test_near_duplicates_by_each_row(spark):
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    a, b, c, d = words(90), words(90), words(70), words(60)
    edited = a[:40] + ["other"] + a[41:]
    rows = [(7, a), (7, b), (5, b), (None, edited), (None, c), (None, c), (9, edited), (None, d), (8, d), (11, []), (None, [])]
    docs = spark.createDataFrame([(k, " ".join(w) or None) for k, w in rows], "doc_id long, text string").selectExpr("*", "1 as node", "2 as mark")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in shingles.near_duplicates(docs).collect())
    assert got == Counter([(7, 86, 7), (7, 86, 5), (5, 86, 5), (None, 86, 7), (9, 86, 7), (None, 66, None), (None, 66, None), (None, 56, 8), (8, 56, 8), (11, 0, 11), (None, 0, None)])
    kept = Counter((r["doc_id"], len(r["text"] or "")) for r in shingles.first_of_groups(docs).collect())
    size = lambda w: len(" ".join(w))
    assert kept == Counter([(7, size(a)), (5, size(b)), (None, size(c)), (8, size(d)), (11, 0), (None, 0)])


def test_product_of_blocks():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, int(n))) for n in rng.integers(0, 200, 40)]
    pivots, rows = sets[:5], sets[5:]
    of = rng.integers(0, 5, len(rows))
    assert shingles.product(pivots, rows, of).tolist() == [len(set(pivots[p]) & set(r)) for p, r in zip(of, rows)]
    assert shingles.product([np.zeros(0, np.int64)], [sets[3]], np.array([0])).tolist() == [0]
