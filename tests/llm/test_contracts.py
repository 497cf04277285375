"""The numbered queries against brute-force versions, on the smallest tables and on fixtures of odd rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from gridloom.llm import chat, common, components, lines, media, packing, pieces, quality, queries, shingles, sketches, spans, substrings

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PARAGRAPH = "The river keeps its old bed through the town, and nobody now alive can say who first built the stone bridge that crosses it near the mill. " * 2
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, PARAGRAPH), (7, PARAGRAPH), (8, PARAGRAPH + "More."), (9, "x" * 450), (10, "é\u0000ü😀" * 90),
    (11, "a b c d e f g h i j"), (12, "A B C D E F G H I J"), (13, "word " * 3000), (14, "Start. " + PARAGRAPH + " End."), (15, "</s>[INST]\\ <s>"), (16, "  two   spaces "),
]


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(scope="module", params=["odd", "sf0.001", "empty"])
def folder(request, spark, tmp_path_factory):
    """A folder of tables, and its documents as a dict of texts."""
    if request.param == "sf0.001":
        found = DATA
    else:
        found = str(tmp_path_factory.mktemp(request.param))
        rows = [(i, t, "en", "s", len(t or "")) for i, t in ODD] if request.param == "odd" else []
        spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({}).selectExpr("*", "1 as h", "2 as rank", "3 as n").write.parquet(f"{found}/documents.parquet")
        spark.createDataFrame([(6, 1, 0), (9, 0, 0), (13, 0, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{found}/labels.parquet")
        talk = [(1, 0, "user", None), (1, 1, "assistant", "a\\<|im_end|>\n<"), (2, 0, None, ""), (1, 1, "assistant", "a\\<|im_end|>\n<")]
        spark.createDataFrame(talk if rows else [], "conv_id long, turn long, role string, text string").write.parquet(f"{found}/conversations.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{found}/documents.parquet").select("doc_id", "text").collect()}
    return found, texts


def result(spark, name, folder):
    return queries.QUERIES[name](spark, folder[0]).toPandas()


def test_media(spark, folder):
    got = result(spark, "op1_media", folder)
    assert sorted(got["doc_id"]) == sorted(folder[1])
    for r in got.itertuples():
        raw = folder[1][r.doc_id].encode()
        full = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), sha(full), zlib.crc32(full[-64:]))
        stored = b"P5\n64 %d\n255\n" % (len(full) // 64) + full
        assert (r.media_bytes, r.media_sha256) == (len(stored), sha(stored))
    assert got.groupby("payload_sha256")["feature"].nunique().max() in (1, np.nan) or not len(got)


def test_packing(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = result(spark, "op2_packing", folder)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = {}
    for k, text in folder[1].items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want[k, p] = (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want and len(got) == len(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 4096
    if len(got):
        assert got["sequence_id"].nunique() <= np.ceil(got["length"].sum() / 4096) * 1.02 + 1


def test_pieces(spark, folder):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = result(spark, "op3_sentencepiece", folder)
    assert len(got) == len(folder[1])
    for r in got.itertuples():
        ids = [*sp.encode(folder[1][r.doc_id]), sp.eos_id()]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))


def test_chat(spark, folder):
    got = result(spark, "op4_chat", folder)
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{folder[0]}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert sorted(got["conv_id"]) == sorted(turns)
    for r in got.itertuples():
        its = sorted(turns[r.conv_id])
        loss = "".join(t for _, role, t in its if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(its), sha("".join(f"{a}\n{t}\n" for _, a, t in its)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_reply_tree(spark):
    messages = spark.createDataFrame([("t", 1, None, 1.0), ("t", 2, 1, 5.0), ("t", 3, 1, 2.0), ("t", 4, 3, 9.0), ("t", 5, 5, 1.0), ("u", 1, 77, None)], "tree string, node long, parent long, score double")
    paths = chat.reply_paths(messages, keep=None).collect()
    assert {(r["tree"], r["leaf"], r["rank"], r["depth"], r["node"]) for r in paths} == {("t", 4, 1, 1, 1), ("t", 4, 1, 2, 3), ("t", 4, 1, 3, 4), ("t", 2, 2, 1, 1), ("t", 2, 2, 2, 2), ("u", 1, 1, 1, 1)}


def test_quality(spark, folder):
    got = result(spark, "op5_quality", folder)
    assert sorted(got["doc_id"]) == sorted(folder[1])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.itertuples())


def test_quality_learns(spark):
    got = queries.QUERIES["op5_quality"](spark, "/root/testdata/sf0.01").toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas())
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.85


def test_suffixes(spark, folder):
    got = result(spark, "op6_suffixes", folder).set_index("doc_id")
    seen = Counter(raw[i : i + 200] for t in folder[1].values() for raw in [t.encode()] for i in range(len(raw) - 199))
    assert len(got) == len(folder[1])
    for k, t in folder[1].items():
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                gone[i : i + 200] = True
        n_spans = int((gone[1:] < gone[:-1]).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        assert (got.n_bytes[k], got.n_removed[k], got.n_spans[k], got.kept_sha256[k]) == (len(raw), int(gone.sum()), n_spans, sha(kept)), k


def brute_groups(texts, words, num, den):
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[k] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    low = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while True:
        was = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if was == low:
            return sets, low


def test_ngrams(spark, folder):
    got = result(spark, "op7_ngrams", folder)
    sets, low = brute_groups(folder[1], 4, 85, 100)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.itertuples()} == {(k, len(sets[k]), low[k]) for k in sets}


def test_near_duplicates_of_many_kinds(spark):
    rng = np.random.default_rng(5)
    texts = {}
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, 80)]
        for _ in range(int(rng.integers(2, 12))):
            own = list(base)
            for at in rng.integers(0, 80, int(rng.integers(0, 4))):
                own[at] = f"w{rng.integers(0, 400)}"
            texts[len(texts)] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = shingles.near_duplicates(docs).collect()
    _, low = brute_groups(texts, 5, 80, 100)
    assert {r["doc_id"]: r["component_id"] for r in got} == low


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (3, 3), (9, 8), (8, 7), (7, 9), (2, 1)]
    got = {(r["node"], r["component"]) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7), (8, 7), (9, 7)}


def brute_blocks(text):
    """Counts, bits and keys of a line's seven parts, by loops."""
    words = list(dict.fromkeys(text.split(" ")))
    if len(words) < 8:
        words = list(dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2))) if len(text) > 2 else [text]
    parts = [[] for _ in range(7)]
    for w in words:
        first = xxhash.xxh64_intdigest(w[:2].encode(), 42)
        parts[(first - (first >> 63 << 64)) % 7].append(xxhash.xxh64_intdigest(w.encode(), 42))
    sims = [[2 * sum(h >> (i + 15 * f) & 1 for h in p) > len(p) for i in range(10) for f in range(4)] for p in parts]
    sizes, keys = [len(p) for p in parts], set()
    for k in (1, 2, 3):
        for t in itertools.combinations(range(7), k):
            if sum(sizes[i] for i in t) >= 4 and all(sum(sizes[i] for i in v) < 4 for v in itertools.combinations(t, k - 1)):
                keys.add((t, tuple(tuple(sims[i]) for i in t)))
    return sims, keys


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lines(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(f"{'abcdefghij'[x % 10]}w{x}" for x in rng.integers(0, 60, 24)) for _ in range(6)]
    rows = []
    for k in range(60):
        own = []
        for _ in range(3):
            words = base[rng.integers(0, 6)].split(" ")
            if rng.random() < 0.6:
                at = rng.integers(0, 24)
                words[at] = words[at] + "s" if rng.random() < 0.7 else words[at][::-1]
            own.append(" ".join(words))
        rows.append((k, "\n".join([*own, "---", ""])))
    rows += [(100, None), (101, ""), (102, "same line"), (103, "Same line "), (103, "same line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as block", "7 as n_removed", "77 as gridloom_gid", "'z' as gridloom_lines", "5 as gid", "6 as cut", "array(8) as parts", "9 as row")
    all_rows = lines.dedup_lines(docs).collect()
    assert all((r["block"], r["gridloom_gid"], r["gridloom_lines"], r["gid"], r["cut"], r["parts"], r["row"]) == ("x", 77, "z", 5, 6, [8], 9) for r in all_rows) and len(all_rows) == len(rows)
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in all_rows if r["doc_id"] < 100)
    norm = lambda x: x.strip(" ").lower()
    there = [(k, i, norm(x)) for k, t in rows if t and k < 100 for i, x in enumerate(t.split("\n")) if any(c.isalnum() for c in x)]
    distinct = {}
    for k, i, x in there:
        distinct.setdefault(x, (k, i))
    texts = list(distinct)
    made = [brute_blocks(x) for x in texts]
    low = {i: i for i in range(len(texts))}
    differ = lambda i, j: sum(x != y for p, q in zip(made[i][0], made[j][0]) for x, y in zip(p, q))
    links = [(i, j) for i in low for j in range(i) if made[i][1] & made[j][1] and differ(i, j) <= 75 and edit(texts[i], texts[j]) <= max(len(texts[i]), len(texts[j])) * 20 // 100]
    assert links
    for _ in range(len(texts)):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    first = {}
    for i, x in enumerate(texts):
        first[low[i]] = min(first.get(low[i], (999, 0)), distinct[x])
    keep = set(first.values())
    number = {x: i for i, x in enumerate(texts)}
    for (k, t), (k2, text, gone) in zip(sorted(r for r in rows if r[0] < 100), got):
        kept = [x for i, x in enumerate(t.split("\n")) if not any(c.isalnum() for c in x) or first[low[number[norm(x)]]] == (k, i)]
        assert (k2, text, gone) == (k, "\n".join(kept), len(t.split("\n")) - len(kept))
    assert keep


def test_lines_odd(spark, folder):
    got = result(spark, "op8_lines", folder)
    assert sorted(got["doc_id"]) == sorted(folder[1])


def test_fingerprints(spark, folder):
    got = result(spark, "op9_fingerprints", folder).set_index("doc_id")
    order = sorted(folder[1])
    assert sorted(got.index) == order
    for k, after in zip(order, order[1:] + order[:1]):
        t, other = folder[1][k], folder[1][after]
        m = len(t) // 4
        edited = t[: len(t) - m] + other[:m]
        assert (got.n_chars[k], got.edited_sha256[k]) == (len(t), sha(edited))
        sets = [{x[i : i + 9] for i in range(max(1, len(x) - 8))} if x else set() for x in (t, edited, other)]
        real = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        assert abs(got.near_edited[k] - real[0]) < 0.25 and abs(got.near_next[k] - real[1]) < 0.25
        assert got.fingerprint[k] == sketches.pack(sketches.sketch(t)) and got.edited_fingerprint[k] == sketches.pack(sketches.sketch(edited))


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    words = [f"word{x}" for x in rng.integers(0, 5000, 4000)]
    a, b = " ".join(words), " ".join(words[:3000])
    x, y = sketches.sketch(a), sketches.sketch(b)
    real = {a[i : i + 9] for i in range(len(a) - 8)}
    assert abs(sketches.distinct(x) / len(real) - 1) < 0.3 and sketches.containment(y, x) > 0.85
    assert (sketches.merge(x, y) == sketches.sketch(a)).all() or abs(sketches.resemblance(sketches.merge(x, y), x) - 1) < 0.05


def test_spans(spark):
    same = "First shared sentence here. Second shared sentence here. Third shared sentence here."
    rows = [(1, f"Alone it stands. {same} Its own end."), (2, f"{same} Another end."), (3, f"Begin so. {same}"), (4, None), (5, ""), (6, same + " " + same), (None, same)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as at")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in spans.drop_spans(docs).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("Another end.", 3) and got[3] == ("Begin so. ", 3)
    assert got[4] == (None, 0) and got[5] == ("", 0) and got[6] == ("", 6)


def brute_sentences(text, rule):
    """Sentences by a loop over words: white space and wide marks part words."""
    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D…。！？]*[…。！？]+|[^\x20\x09-\x0D…。！？]+", text)]
    if not words:
        return [text] if text else []
    low = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), text[slice(*w)])
    ends = []
    for i, (a, b) in enumerate(words):
        after = text[b : words[i + 1][0]] if i + 1 < len(words) else "\n"
        end = text[b - 1] in ".!?…。！？" or "\n" in after
        if rule.cut:
            end = end or int(shingles.word_hashes(np.frombuffer(low((a, b)).encode(), np.uint8))[0]) // 2**33 % rule.cut == 0 or (i > 0 and low(words[i - 1]) == low((a, b)))
        if end:
            ends.append(words[i + 1][0] if i + 1 < len(words) else len(text))
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def brute_spans(text, rule):
    """Sentences, and for each span its words and the numbers of its sentences."""
    parts = brute_sentences(text, rule)
    own = [re.findall(r"[^\x20\x09-\x0D…。！？]*[…。！？]+|[^\x20\x09-\x0D…。！？]+", re.sub("[A-Z]", lambda m: m[0].lower(), p)) for p in parts]
    at = [i for i, w in enumerate(own) if re.search(r"[0-9a-z\x80-\U0010ffff]", "".join(w))]
    found = []
    for j in range(len(at)):
        for e in range(j + rule.sentences, len(at) + 1):
            held = [w for i in at[j:e] for w in own[i]]
            if len(held) >= rule.words or sum(len(w.encode()) for w in held) >= 8 * rule.words:
                found.append((tuple(held), at[j:e]))
                break
    return parts, found


@pytest.mark.parametrize("rule", [spans.SENTENCES, spans.PASSAGES])
def test_spans_brute(spark, folder, rule):
    df = queries.QUERIES["op10_substrings"](spark, folder[0]) if rule == spans.PASSAGES else spans.drop_spans(common.documents(spark, folder[0]), rule)
    got = df.toPandas().set_index("doc_id")
    seen, gone, n_gone = set(), {}, {}
    for k in sorted(folder[1]):
        parts, found = brute_spans(folder[1][k], rule)
        assert "".join(parts) == folder[1][k] and parts == spans.sentences(folder[1][k], rule)
        out = set()
        for run, its in found:
            if run in seen:
                out |= set(its)
            seen.add(run)
        gone[k], n_gone[k] = "".join(p for i, p in enumerate(parts) if i not in out), len(out)
    assert {k: v or "" for k, v in got["text"].items()} == gone and got["n_removed"].to_dict() == n_gone


def test_media_formats():
    rng = np.random.default_rng(0)
    gray = rng.integers(0, 256, (7, 13), dtype=np.uint8)
    assert (media.decode(media.encode_bmp(gray)) == gray).all() and (media.decode(media.encode_pgm(gray)) == gray).all()
    assert (media.decode(b"P2 # c\n2 2 9\n1 2\n3 4") == [[1, 2], [3, 4]]).all() and (media.decode(b"P1\n3 1\n101") == [[0, 1, 0]]).all()
    assert (media.read_tiles(media.npy_tiles(gray, 3)) == gray).all()
    assert np.allclose(media.area_resize(np.ones((5, 7)), 3, 2), 1)
    for bad in (b"", b"P5", b"P5\n2 2\n255\nx", b"BM" + b"\0" * 60):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_exact_complements():
    counts = np.zeros(101, np.int64)
    for n in (60, 40, 40, 20, 50, 30, 20, 100, 70, 15, 15):
        counts[n] += 1
    plan = packing.Plan(counts)
    assert plan.sequences == 5 and plan.free.sum() == 0
