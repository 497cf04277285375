"""Fingerprints of parts merged, and documents with null and equal ids."""

import numpy as np

from gridloom.llm import packing, sketches


def plain_sketch(text):
    """The smallest 128 of all distinct hashes, each shingle hashed alone."""
    width = min(9, len(text))
    return np.array(sorted({int(sketches.shingle_hashes(text[i : i + width], width)[0]) for i in range(len(text) - width + 1)} if text else [])[:128], np.uint64)


def test_merged_parts(spark):
    rng = np.random.default_rng(9)
    words = [f"word{x}" for x in rng.integers(0, 900, 1500)]
    rows = [(i % 3 if i % 4 else None, " ".join(words[i * 30 : i * 30 + 40]) if i != 7 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, "part long, text string").selectExpr("part as doc_id", "text", "'k' as key").repartition(5)
    made = sketches.fingerprints(docs)
    assert sorted(r["fingerprint"] for r in made.collect()) == sorted(sketches.pack(plain_sketch(t or "")) for _, t in rows)
    got = {r["doc_id"]: r for r in sketches.merged_fingerprints(made, "doc_id").collect()}
    for part in (None, 0, 1, 2):
        hashes = {int(x) for k, t in rows if k == part and t for x in sketches.shingle_hashes(t)}
        assert got[part]["fingerprint"] == sketches.pack(np.array(sorted(hashes)[:128], np.uint64))
        assert abs(got[part]["shingles"] / len(hashes) - 1) < 0.35
    assert sketches.merged_fingerprints(made.limit(0), "doc_id").count() == 0


def test_next_of_null_and_equal_ids(spark):
    rows = [(None, "first of all texts here"), (None, None), (4, "b text of four"), (4, "a text of four"), (4, "a text of four"), (9, "the last of them"), (-5, "")]
    got = sketches.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    order = sorted(((k is not None, k or 0, t or "") for k, t in rows))
    want = sorted((len(t), sketches.pack(plain_sketch(t[: len(t) - len(t) // 4] + u[: len(t) // 4]))) for (_, _, t), (_, _, u) in zip(order, order[1:] + order[:1]))
    assert sorted((r["n_chars"], r["edited_fingerprint"]) for r in got) == want and sorted(str(r["doc_id"]) for r in got) == sorted(str(k) for k, _ in rows)


def test_packing_rows(spark):
    rows = [(None, "a b c"), (None, None), (1, "x " * 5000), (1, "x " * 5000), (1, "y")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as task", "2 as length"), packing.vocabulary_path()).toPandas()
    assert got["length"].sum() == 4 + 1 + 2 * 5001 + 2 and len(got) == 3 + 2 * 2
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 4096
