"""Passages that begin and end inside a sentence, planted at random places."""

import numpy as np

from gridloom.llm import spans


def planted(seed):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(3000)]

    def prose(n):
        words = [vocabulary[x] for x in rng.integers(0, 3000, n)]
        return [w + "." if rng.random() < 0.06 else w for w in words]

    passages = [prose(int(n)) for n in rng.integers(51, 81, 40)] + [["of"] * 90]
    docs, place = [], []
    for p in passages:
        for _ in range(3):
            own = prose(200)
            at = int(rng.integers(0, 200))
            docs.append(" ".join(own[:at] + p + own[at:]))
            place.append((" ".join(own[:at]), " ".join(p), " ".join(own[at:])))
    clean = [" ".join(prose(150)) for _ in range(60)]
    return docs, place, clean


def test_passages_inside_sentences(spark):
    docs, place, clean = planted(4)
    rows = spark.createDataFrame(list(enumerate(docs + clean)), "doc_id long, text string").selectExpr("*", "1 as gridloom_cut", "2 as key", "3 as row", "4 as done", "5 as n_removed")
    got = spans.drop_spans(rows, spans.PASSAGES)
    assert sorted(got.columns) == sorted(rows.columns)
    left = {r["doc_id"]: r["text"] for r in got.collect()}
    shares = []
    for i, (_, passage, _) in enumerate(place):
        gone = len(docs[i]) - len(left[i])
        if i % 3 == 0:
            assert gone == 0 or " of of " in passage  # a word said again and again repeats itself
        else:
            shares.append(gone / len(passage))
            assert gone <= len(passage) + 2
    assert min(shares) > 0.6 and np.mean(shares) > 0.87
    assert all(left[len(docs) + i] == t for i, t in enumerate(clean))


def test_long_and_odd_texts(spark):
    far = "word" * 300_000
    rows = [(1, far), (2, far), (3, "a " * 100_000), (4, "。" * 500), (5, "." * 500), (6, "中文句子没有空格。" * 40), (7, "\n" * 100), (None, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in spans.drop_spans(docs, spans.PASSAGES).collect()]
    left = {k: (t, n) for k, t, n in got if k}
    assert left[1] == (far, 0) and left[4] == ("。" * 500, 0) and left[7] == ("\n" * 100, 0)
    assert left[3][0] == "a a " and 0 < len(left[6][0]) < 9 * 40 and len(got) == len(rows)
