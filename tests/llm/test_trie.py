"""The trie of rebuilt conversations against a loop over prefixes."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridloom.llm import trie


def brute(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [x[2:] for x in sorted(own)] for c, own in talks.items()}
    built = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(talks.get(c - c % 20, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, its in members.items():
        own = (len(its) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += not children[node]
    out = []
    for node, its in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in its if built[c] == node))
        out.append((min(its), len(node), min(members[node[:-1]]) if node else None, len(its), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows():
    rng = np.random.default_rng(8)
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a b"), (1, 1, "assistant", "a b"), (2, None, None, ""), (2, 0, "user", "x"), (None, 0, "user", "nobody's"), (40, 0, "user", " \t"), (45, 5, "user", "far"), (46, 1, "user", "b"), (46, 1, "user", "é"), (46, 1, "user", "a"), (46, 1, "assistant", "z")]
    for c in range(60, 190):  # many share their first turns
        n = int(rng.integers(0, 7)) if c % 20 else 6
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"w{rng.integers(0, 3)} " * int(rng.integers(1, 3))) for t in range(n)]
    rows += [(400 + c, t, "user", f"turn {min(t, 30)}") for c in (0, 1, 2) for t in range(40)]
    return rows


@pytest.mark.parametrize("segment, ends", [(512, 2000), (3, 2)])
def test_odd_rows(spark, monkeypatch, segment, ends):
    """Long conversations and paths in many segments, ids of a node in many strings."""
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "ENDS", ends)
    rows = odd_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as pos", "2 as d", "3 as k1", "'x' as depth")
    got = sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=str)
    assert got == brute(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in trie.op13_trie(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(rows)


def test_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_turnless(spark):
    """Conversations that have no turn left are members of the root alone."""
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "gone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in trie.prefix_trie(df).collect()] == brute(rows) and brute(rows)[0][:6] == (c, 0, None, 1, 0, 1)
