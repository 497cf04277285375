"""Fill-in-middle against a loop over regular-expression tokens."""

import hashlib
import re

import numpy as np
import pytest

from gridloom.llm import infill

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(key, text, seed="1:"):
    """n, form, prefix_chars, middle_chars, output."""
    tokens = TOKEN.findall(text)
    hexed = sha(f"{seed}{'' if key is None else key}")
    h = [int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = np.random.default_rng(4)
    found = [None, "", "a", "1", "ab<P>c", "x<S", "<", "><S<P", "<M", "Grüße, 世界! \n\t😀 end", "é" * 40, "long" * 30_000, "a1" * 9000, "zz " * 5000 + "<M>"]
    found += ["".join(rng.choice(list("abZ[`{@ \n<PSM>é9"), int(n))) for n in rng.integers(0, 300, 60)]
    return found


@pytest.mark.parametrize("chunk, block", [(4096, 2_000_000), (7, 50), (1, 1)])
def test_cuts(monkeypatch, chunk, block):
    """Chunks of any size give the same cuts, in the first and last place as well."""
    monkeypatch.setattr(infill, "CHUNK", chunk)
    monkeypatch.setattr(infill, "BLOCK", block)
    found = [t for t in odd_texts() if t is not None and len(t) < 2000]
    rng = np.random.default_rng(5)
    ranks = {}

    def asked(n):
        ranks["k"] = np.stack([rng.integers(0, n + 1), n, np.zeros_like(n), np.minimum(n, 1)], axis=1)
        return ranks["k"]

    n, cuts = infill.token_cuts(found, asked)
    for t, size, its, own in zip(found, n, ranks["k"], cuts):
        tokens = TOKEN.findall(t)
        assert size == len(tokens) and own.tolist() == [len("".join(tokens[:k])) for k in its]
    assert infill.token_cuts([], lambda n: np.zeros((0, 2), np.int64))[0].size == 0


def test_odd_rows(spark):
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as form", "2 as output")
    from pyspark.sql import functions as F

    made = infill.infilled(docs)
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(((k, *brute(k, t or ""), t or "") for k, t in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in infill.op11_infill(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        n, form, prefix, middle, output = brute(k, t or "")
        r = got[k]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, prefix, middle, sha(output), sha(t or ""))
