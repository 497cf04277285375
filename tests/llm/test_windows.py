"""Windows by least squares: every id once, gapless, without padding; plans of histograms of all kinds."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import common, queries, windows

ROWS = [(1, None), (2, ""), (None, "a few words"), (2, "again " * 700), (3, "one two three " * 3000), (3, "one two three " * 3000), (4, "Ünïcode 😀 <|endoftext|> x"), (5, "word")]


def padding(used):
    return sum(0 if n & (n - 1) == 0 else 2048 - n for n in used)


def placed(rows):
    """Tokens of each sequence; every offset must follow the piece before."""
    used = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used[r["sequence_id"]] and r["length"] > 0
        used[r["sequence_id"]] += r["length"]
    assert max(used.values(), default=0) <= 2048
    return used


@pytest.fixture(scope="module", params=["odd", "sf0.001", "empty"])
def folder(request, spark, tmp_path_factory):
    if request.param == "sf0.001":
        return "/root/testdata/sf0.001"
    found = str(tmp_path_factory.mktemp(request.param))
    spark.createDataFrame(ROWS if request.param == "odd" else [], "doc_id long, text string").selectExpr("*", "1 as start", "'x' as length", "3 as task", "4 as own").write.parquet(f"{found}/documents.parquet")
    return found


def test_every_id(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = queries.QUERIES["op12_windows"](spark, folder).collect()
    used = placed(rows)
    texts = [(r["doc_id"], [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in common.documents(spark, folder).select("doc_id", "text").collect()]
    assert sum(used.values()) == sum(len(ids) for _, ids in texts)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    by_id = defaultdict(list)
    for k, ids in texts:
        by_id[k].append(ids)
    assert pieces.keys() == by_id.keys()
    for k, found in by_id.items():
        covered = Counter((n, at) for start, size, _, n in pieces[k] for at in range(start, start + size))
        assert covered == Counter((len(ids), at) for ids in found for at in range(len(ids)))
        for start, size, crc, n in pieces[k]:
            assert crc in {zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes()) for ids in found if len(ids) == n}
    assert padding(used.values()) == 0 and len(used) <= -(-sum(used.values()) // 2048) + 12


def histograms():
    rng = np.random.default_rng(1)
    yield np.zeros(2049, np.int64)
    for lengths in ([5] * 3, [2048] * 7, [1] * 5000, [1500] * 40, [2041, 7, 1024, 1024, 1000, 700, 348, 2047, 1]):
        yield np.bincount(lengths, minlength=2049)
    for mean in (3, 5.3, 7):
        yield np.bincount(np.clip(rng.lognormal(mean, 1.0, 4000).astype(int), 1, 2048), minlength=2049)


@pytest.mark.parametrize("counts", [*histograms()], ids=str)
def test_plans(counts):
    plan = windows.WindowPlan(counts)
    used, seen = defaultdict(int), Counter()
    for length, start, first, count, size, sequence, offset in sorted(plan.slots_by_length.tolist(), key=lambda s: s[6]):
        for i in range(count):
            assert used[sequence + i] == offset
            used[sequence + i] += size
            seen.update((length, first + i, at) for at in (start, start + size - 1))
    total = int((counts * np.arange(2049)).sum())
    assert sum(used.values()) == total and len(used) == plan.sequences and padding(used.values()) == 0
    assert len({k[:2] for k in seen}) == counts.sum() and plan.sequences <= -(-total // 2048) + 12


def test_plans_of_any_size():
    """A thousand times the corpus makes a plan of about the same size."""
    rng = np.random.default_rng(2)
    few = np.bincount(np.clip(rng.lognormal(5.3, 1.0, 40_000).astype(int), 1, 2048), minlength=2049)
    small, large = windows.WindowPlan(few), windows.WindowPlan(few * 1_000_000)
    assert len(large.slots_by_length) < 3 * len(small.slots_by_length) and large.left == 0
    tokens = int((few * np.arange(2049)).sum()) * 1_000_000
    assert large.sequences <= tokens // 2048 + 12


def test_least_squares():
    rng = np.random.default_rng(3)
    a = rng.random((12, 30))
    for goal in (a @ np.maximum(rng.normal(size=30), 0), rng.normal(size=12)):
        x = windows.non_negative_least_squares(a, goal)
        slope = a.T @ (goal - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-6 and np.abs(slope[x > 0]).max(initial=0) < 1e-6  # no better one exists
    rows = windows.combinations(16, np.ones(17, bool))
    assert {tuple(r) for r in rows} == {(a, b, c) for a in range(17) for b in range(a + 1) for c in range(b + 1) if a + b + c == 16}
