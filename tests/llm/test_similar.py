"""Edit similarity of pairs against a plain distance table."""

import numpy as np

from gridloom.llm import lines


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_similar_by_distance(spark):
    rng = np.random.default_rng(8)
    pairs = [("a", "a"), ("", "a"), ("a b", "a"), ("a  b", "a b"), ("x", "y"), ("one two three four five", "one two four five"), ("é ü", "é u")]
    for _ in range(150):
        a = ["".join("abcde "[x] for x in rng.integers(0, 6, rng.integers(1, 7))) for _ in range(int(rng.integers(1, 40)))]
        b = list(a)
        for _ in range(int(rng.integers(0, 9))):
            at = int(rng.integers(0, len(b)))
            b[at : at + int(rng.integers(0, 2))] = ["".join("abcde"[x] for x in rng.integers(0, 5, int(rng.integers(0, 6))))]
            b = b or ["z"]
        pairs.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "n long, x string, y string")
    got = {r["n"] for r in lines.similar(df, "x", "y").collect()}
    assert got == {i for i, (a, b) in enumerate(pairs) if edit(a, b) <= max(len(a), len(b)) * 20 // 100} and 40 < len(got) < 140
