"""The candidates of fuzzy lines against edit similarity alone."""

import numpy as np

from gridloom.llm import common, lines


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def groups(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, norm string").selectExpr("n as id", "norm")
    return {int(r["node"]): int(r["component"]) for r in lines.line_groups(rows).collect()}


def typos(rng, line, n):
    words = line.split(" ")
    for at in rng.choice(len(words), min(n, len(words)), replace=False):
        words[at] = words[at] + "qzxjvk"[rng.integers(6)]
    return " ".join(words)


def other_words(rng, line, n):
    words = line.split(" ")
    for at in rng.choice(len(words), min(n, len(words)), replace=False):
        words[at] = "".join("abcdefghij"[x] for x in rng.integers(0, 10, len(words[at])))
    return " ".join(words)


def test_every_pair_by_brute_force(spark):
    """All pairs of a few hundred lines: short ones are all linked, of longer ones nine tenths, and nothing is linked that is not alike."""
    rng = np.random.default_rng(11)
    words = ["".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(400)]
    base = [" ".join(words[x] for x in rng.integers(0, 400, n)) for n in (12, 20, 28, 40, 60) for _ in range(12)]
    texts = base + [typos(rng, x, 1) for x in base]
    texts += ["page 12", "page 13", "chapter", "chaptre", "figure ten", "figure tens", "fig. 3 left", "fig 3 right", "abcdefghijklmn", "abXdefghYjklmn".lower(), "ab", "ac", "12345", "12346", "abcd", "abcde", "abcdefgh", "abcdefghij", "abcdef", "bcdefg"]
    texts = list(dict.fromkeys(texts))
    low = groups(spark, texts)
    alike = lambda a, b: abs(len(a) - len(b)) * 5 <= max(len(a), len(b)) and edit(a, b) * 5 <= max(len(a), len(b))
    real = [(i, j) for j in range(len(texts)) for i in range(j) if alike(texts[i], texts[j])]
    joined = lambda i, j: low.get(i, i) == low.get(j, -j)
    short = [(i, j) for i, j in real if max(len(texts[i]), len(texts[j])) <= lines.SHORT]
    longer = [p for p in real if p not in short]
    assert len(short) == 7 and all(joined(*p) for p in short)
    assert len(longer) >= 60 and sum(joined(*p) for p in longer) >= 0.9 * len(longer)
    near = set(real)
    for g in {low[k] for k in low}:
        members = sorted(k for k in low if low[k] == g)
        assert all(any((min(i, j), max(i, j)) in near for j in members if i != j) for i in members)


#: Least share of copies that must link, by words touched: a letter more in each, or other words of their length.
LEAST = {(typos, 1): 0.97, (other_words, 1): 0.93, (typos, 2): 0.95, (other_words, 2): 0.9, (typos, 3): 0.85, (other_words, 3): 0.87}


def test_recall_on_real_lines(spark):
    """Copies of real lines with words touched, of those that stay within the edit similarity."""
    rng = np.random.default_rng(1)
    docs = common.documents(spark, "/root/testdata/sf0.01")
    real = sorted({r["norm"] for r in lines.line_rows(docs).select("norm").collect() if 14 < len(r["norm"]) < 2000})
    real = [real[i] for i in rng.permutation(len(real))]
    pairs = {}
    for i, (change, n) in enumerate(LEAST):
        made = [(x, change(rng, x, n)) for x in real[i * 250 : i * 250 + 250]]
        pairs[change, n] = [(a, b) for a, b in made if a != b and edit(a, b) * 5 <= max(len(a), len(b))]
    number = {t: i for i, t in enumerate(dict.fromkeys(t for found in pairs.values() for p in found for t in p))}
    low = groups(spark, list(number))
    shares = {k: np.mean([low.get(number[a], -1) == low.get(number[b], -2) for a, b in found]) for k, found in pairs.items()}
    print({(k[0].__name__, k[1]): (len(pairs[k]), round(float(v), 3)) for k, v in shares.items()})
    assert all(shares[k] >= LEAST[k] for k in LEAST)


def test_rows_of_one_id(spark):
    """Rows that share an id, or have none, lose their own repeats only; a line that is found once stays whatever stands at its place elsewhere."""
    said = "one line which several of these documents have in common"
    rows = [(1, f"{said}\nalpha beta gamma"), (2, f"{said}\nsecond only text"), (2, "a line which is found nowhere else at all in here\nsecond row"), (None, f"{said}\nfirst without an id"), (None, "another line which no other document has at all\nx y"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as mark", "6 as spot")
    got = sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in lines.dedup_lines(docs).collect())
    want = [("1", "alpha beta gamma", 1), ("2", "second only text", 1), ("2", rows[2][1], 0), ("None", rows[3][1], 0), ("None", rows[4][1], 0), ("3", "", 0)]
    assert got == sorted(want)


def test_white_space(spark):
    """Lines are alike whatever white space stands at their ends."""
    same = "the very same line but for its ends"
    docs = spark.createDataFrame([(1, same), (2, f"\t{same}\r"), (3, f"\u3000{same.upper()}\u00a0 \n\r")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()} == {1: same, 2: "", 3: "\r"}


def test_long_lines(spark):
    """Lines of thousands of characters, settled by their parts or by the whole table."""
    rng = np.random.default_rng(7)
    words = [" ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(400)) for _ in range(2)]
    moved = words[0].split(" ")
    near = " ".join(["new", "ones"] + moved[:200] + moved[215:])
    half = " ".join(w if i % 10 < 7 else w[::-1] for i, w in enumerate(moved))
    pairs = [(words[0], near), (words[0], half), (words[0], words[1]), (words[0], words[0] + " end")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    want = {i for i, (a, b) in enumerate(pairs) if edit(a, b) * 5 <= max(len(a), len(b))}
    assert {r["i"] for r in lines.similar(df, "a", "b").collect()} == want and 0 < len(want) < 4
