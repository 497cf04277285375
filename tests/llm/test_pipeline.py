"""The pipeline stage by stage: each against a plain version of its rule on its own input."""

import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from gridloom.llm import common, lines, packing, quality, shingles, spans

DATA = "/root/testdata/sf0.001"


def table(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def test_stages(spark):
    docs = common.documents(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = table(docs)
        out = common.written(stage(spark, docs, DATA))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS
            after = table(out)
            assert set(after) <= set(before) and all(r["n_chars"] == len(r["text"] or "") for r in out.collect())
        if name == "quality":  # the same training gives the same model, asked document by document
            model = quality.train(docs, labels)
            assert after == {k: t for k, t in before.items() if model.scores([t])[0] >= 0.5} and len(after) < len(before)
        if name == "lines":  # what is left are lines of the text in order, and no two of all that are left are equal
            norm = lambda x: x.strip(" ").lower()
            spoken = lambda x: any(c.isalnum() for c in x)
            assert set(after) == set(before)
            kept = [norm(x) for t in after.values() for x in t.split("\n") if spoken(x)]
            assert len(kept) == len(set(kept))
            for k in sorted(before):
                rest = iter(before[k].split("\n"))
                assert all(any(x == y for y in rest) for x in after[k].split("\n") if x)
            gone = {norm(x) for t in before.values() for x in t.split("\n") if spoken(x)} - set(kept)
            pairs = [(a, b) for a in gone for b in kept if abs(len(a) - len(b)) * 5 <= max(len(a), len(b)) and len(set(a.split()) & set(b.split())) > 2]
            linked = spark.createDataFrame(pairs, "a string, b string") if pairs else None
            near = {r["a"] for r in lines.similar(linked, "a", "b").collect()} if pairs else set()
            assert len(gone - near) <= 0.1 * len(gone) + 1  # some are near another removed line only
        if name == "near_duplicates":  # all pairs of all sets
            sets = {}
            for k, t in before.items():
                w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
                sets[k] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
            low = {k: k for k in sets}
            while True:
                was = dict(low)
                for a in sets:
                    for b in sets:
                        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                            low[a] = low[b] = min(low[a], low[b])
                if was == low:
                    break
            assert after == {k: t for k, t in before.items() if low[k] == k}
        if name == "sentences":  # spans seen before, document by document
            seen, want = set(), {}
            for k in sorted(before):
                found = spans.spans_of(before[k].encode(), spans.PASSAGES)
                places = []
                for at, h in enumerate(found.keys.tolist()):
                    if h in seen:
                        places.append(at)
                    seen.add(h)
                want[k] = spans.without(before[k], places, spans.PASSAGES)[0] if places else before[k]
            assert after == want
        if name == "packing":
            from tokenizers import Tokenizer

            plain, size = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)), {}
            for r in out.collect():
                size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["length"]
            assert size == {k: len(plain.encode(t, add_special_tokens=False).ids) + 1 for k, t in before.items()}
            got = out.toPandas()
            for _, g in got.sort_values("offset").groupby("sequence_id"):
                assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 4096
            assert got["sequence_id"].nunique() <= np.ceil(got["length"].sum() / 4096) * 1.05 + 1
        docs = out


def test_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, no labels that help: every stage keeps to its columns."""
    rows = [(1, None, "en", "s", 0), (1, "some text here", "en", "s", 14), (None, "", None, "s", 0), (None, "some text here", "en", None, None), (2, "some text here", "en", "s", 14)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as row", "2 as cut", "3 as mark").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = common.documents(spark, str(tmp_path))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(stage(spark, docs, str(tmp_path)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert docs.count() >= 1


def test_empty(spark, tmp_path):
    common.documents(spark, DATA).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
