"""Near-duplicate documents: a blocked sparse product of documents by word n-grams.

The incidence is first cut to the n-grams that any linked pair must share one of, which gives the cells of the product that may reach the bound;
only those are then summed over all n-grams, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import discard, documents, sized_join, texts, written
from .components import components

WORDS, SIMILARITY = 5, (80, 100)
#: The n-grams known to be in most documents come last in the order of n-grams, so many at most (8 bytes each).
COMMON = 200_000
COMMON_IN_TASK, COMMON_IN_ALL = 4, 32
#: Rows of one pivot that a task multiplies at once, on average.
BLOCK = 256
#: Parity bits of a set: bit i tells whether an odd number of its n-grams fall on i. Two sets differ in as many n-grams
#: at least as their parities differ in bits.
PARITY = 4096

_rng = np.random.default_rng(20240)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_R = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MORE
    return x ^ (x >> np.uint64(29))


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each word, a run of bytes other than white space, without regard to the case of A-Z."""
    blank = _BLANK[raw]
    inner = ~blank
    starts = np.flatnonzero(inner & np.r_[True, blank[:-1]]) if len(raw) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(inner & np.r_[blank[1:], True]) + 1
    n = ends - starts
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    power = np.cumprod(np.full(int(n.max()), _R, np.uint64))
    return _mix(np.add.reduceat(_BYTE[raw[inner]] * power[at], np.cumsum(n) - n) + n.astype(np.uint64))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted 62-bit hashes of the distinct runs of so many words; of all words where they are fewer; empty without words."""
    w = word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
    if not len(w):
        return np.zeros(0, np.int64)
    words = min(words, len(w))
    h = w[: len(w) - words + 1].copy()
    for i in range(1, words):
        h = _mix(h * _R + w[i : len(w) - words + 1 + i])
    return np.unique(h >> np.uint64(2)).astype(np.int64)


_LATE = np.int64(1) << np.int64(62)


def ordered(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A set in the order of n-grams: by hash, the common ones after all others."""
    if not len(common) or not len(found):
        return found
    late = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
    return np.r_[found[~late], found[late] | _LATE]


def need(n, ratio: tuple[int, int]):
    """The overlap that a set of n needs with any set it links with."""
    return -(-ratio[0] * n // ratio[1])


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """The hashes of the n-grams in most documents, COMMON at most, of all documents. They only settle an order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def counted() -> pd.DataFrame:
            h, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            often = c >= COMMON_IN_TASK
            return pd.DataFrame({"h": h[often], "n": c[often]})

        for batch in batches:
            for t in batch["text"]:
                held.append(shingle_set(t, words))
                n += len(held[-1])
                if n > 4_000_000:
                    yield counted()
                    held, n = [], 0
        yield counted()

    found = texts(docs).mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_IN_ALL)
    return np.sort(np.array([r["h"] for r in found.orderBy(F.desc("n"), "h").limit(COMMON).select("h").collect()], np.int64))


def marked(docs: DataFrame) -> DataFrame:
    """doc_id (null: the highest number), mark and text: equal texts have equal marks."""
    return texts(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def set_rows(docs: DataFrame, words: int, ratio: tuple[int, int], common: np.ndarray) -> DataFrame:
    """doc_id, mark, n (set size), node and k2 (equal for equal sets), the first n-grams in order, of which linked sets share one,
    and the set's parity bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch["text"]:
                found = shingle_set(t, words)
                n, wide = len(found), found.astype(np.uint64)
                node = int(_mix(wide * _R).sum(dtype=np.uint64))
                k2 = int(np.bitwise_xor.reduce(_mix(wide + _R))) if n else 0
                odd = np.bincount(found & (PARITY - 1), minlength=PARITY).astype(np.uint8) & 1
                out.append((n, node - (1 << 63), k2 - (1 << 63), ordered(found, common)[: n - need(n, ratio) + 1] if n else found, np.packbits(odd).view(np.int64)))
            rows = pd.DataFrame(out, columns=["n", "node", "k2", "first", "parity"])
            yield pd.concat([batch[["doc_id", "mark"]].reset_index(drop=True), rows], axis=1)

    return marked(docs).mapInPandas(run, "doc_id long, mark long, n long, node long, k2 long, first array<long>, parity array<long>")


def close(x: str, y: str, ratio: tuple[int, int]) -> str:
    """SQL: whether sizes n and parities of the rows x and y leave a link possible."""
    size = f"({x}.n + {y}.n)"
    differ = " + ".join(f"bit_count({x}.parity[{i}] ^ {y}.parity[{i}])" for i in range(PARITY // 64))
    return f"least({x}.n, {y}.n) * {ratio[1]} >= greatest({x}.n, {y}.n) * {ratio[0]} and {differ} <= {size} - 2 * (({ratio[0]} * {size} + {sum(ratio) - 1}) div {sum(ratio)})"


def near_sizes(pairs: DataFrame, nodes: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that close() leaves."""
    x, y = nodes.select(F.col("node").alias("a"), "n", "parity").alias("x"), nodes.select(F.col("node").alias("b"), "n", "parity").alias("y")
    return pairs.join(x, "a").join(y, "b").where(close("x", "y", ratio)).select("a", "b")


def possible(pairs: DataFrame, nodes: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose first n-grams leave a link possible: all differences up to the earlier of both ends count
    against the number of differences that the sizes allow."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("first").alias(f"first_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for na, nb, a, b in zip(batch["n_a"], batch["n_b"], batch["first_a"], batch["first_b"]):
                last = min(a[-1], b[-1])
                low_a, low_b = np.searchsorted(a, last, "right"), np.searchsorted(b, last, "right")
                same = len(np.intersect1d(a[:low_a], b[:low_b], assume_unique=True))
                overlap = -(-ratio[0] * (na + nb) // (ratio[0] + ratio[1]))
                keep.append(low_a + low_b - 2 * same <= na + nb - 2 * overlap)
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def product(pivots: list[np.ndarray], rows: list[np.ndarray], of: np.ndarray) -> np.ndarray:
    """The overlap of each row with its pivot (of: the pivots' numbers): a block of the product of the sparse incidence of rows and
    n-grams with that of n-grams and pivots, of which only the cells asked for are summed. Both are coordinate lists; entries that meet in
    an n-gram add one to their cell."""
    row_size = np.array([len(x) for x in rows])
    grams, columns = np.unique(np.concatenate([*pivots, *rows]), return_inverse=True)
    cut = sum(len(x) for x in pivots)
    wide = np.int64(len(grams))
    there = np.sort(np.repeat(np.arange(len(pivots)), [len(x) for x in pivots]) * wide + columns[:cut])
    asked = np.repeat(of, row_size) * wide + columns[cut:]
    if not len(there):
        return np.zeros(len(rows), np.int64)
    met = there[np.minimum(np.searchsorted(there, asked), len(there) - 1)] == asked
    return np.bincount(np.repeat(np.arange(len(rows)), row_size), weights=met, minlength=len(rows)).astype(np.int64)


def overlaps(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, words: int, ratio: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of nodes that link: rows of the incidence of documents and n-grams, in blocks of a pivot a and some BLOCK
    others, are multiplied blocks by blocks, and counts below the bound that both sizes give are dropped at once."""
    many = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
    salted = written(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block")))
    roles = salted.select(F.col("b").alias("node"), "a", "block", F.lit(1).alias("role")).unionByName(salted.select(F.col("a").alias("node"), "a", "block", F.lit(0).alias("role")).distinct())
    roles = roles.groupBy("node").agg(F.collect_list(F.struct("a", "block", "role")).alias("roles"))
    roles = written(nodes.select("node", "doc_id", "mark").join(roles, "node"))
    n = roles.agg(F.coalesce(F.sum(F.size("roles")), F.lit(0)).alias("n")).first()["n"]
    there = marked(docs).join(F.broadcast(roles) if n * 40 < 24_000_000 else roles.hint("shuffle_merge"), ["doc_id", "mark"])

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, t, its in zip(batch["node"], batch["text"], batch["roles"]):
                raw = shingle_set(t, words).tobytes()
                out += [(r["a"], r["block"], r["role"], key, raw) for r in its]
                if len(out) > 500:
                    yield pd.DataFrame(out, columns=["a", "block", "role", "node", "found"])
                    out = []
            yield pd.DataFrame(out, columns=["a", "block", "role", "node", "found"])

    dealt = there.mapInPandas(sets, "a long, block long, role int, node long, found binary").repartition("a", "block").sortWithinPartitions("a", "block", "role", "node")

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, names, at = [], [], None  # the last pivot goes on in the next batch
        for batch in batches:
            rows, of, b = [], [], []
            held = 0
            for a, block, role, node, raw in zip(batch["a"], batch["block"], batch["role"], batch["node"], batch["found"]):
                found = np.frombuffer(raw, np.int64)
                if role == 0:
                    if (a, block) != at:
                        pivots.append(found)
                        names.append(a)
                        at = (a, block)
                    continue
                assert at == (a, block)
                rows.append(found)
                of.append(len(pivots) - 1)
                b.append(node)
                held += len(found)
                if held > 1_000_000:
                    yield linked(pivots, names, rows, of, b)
                    rows, of, b, held = [], [], [], 0
                    pivots, names = pivots[-1:], names[-1:]
            if rows:
                yield linked(pivots, names, rows, of, b)
            pivots, names = pivots[-1:], names[-1:]

    def linked(pivots, names, rows, of, b) -> pd.DataFrame:
        of = np.array(of)
        same = product(pivots, rows, of)
        union = np.array([len(x) for x in pivots])[of] + np.array([len(x) for x in rows]) - same
        keep = same * ratio[1] >= union * ratio[0]
        return pd.DataFrame({"a": np.array(names, np.int64)[of][keep], "b": np.array(b, np.int64)[keep]})

    done = written(dealt.mapInPandas(multiply, "a long, b long"))
    discard(many, salted, roles)
    return done


def components_of(docs: DataFrame, words: int, ratio: tuple[int, int]) -> DataFrame:
    """doc_id and mark as marked() gives them, n (set size) and component of each row. No pair that may link is left out:
    equal sets are one node; linked sets share one of their first n-grams; each such list first links its members with
    the one of the smallest id; then only members that aren't yet in one component are compared."""
    common = common_shingles(docs, words)
    rows = written(set_rows(docs, words, ratio, common))
    one = rows.where("n > 0").groupBy("node", "k2").agg(F.min("doc_id").alias("doc_id"), F.min_by("mark", "doc_id").alias("mark"))
    nodes = written(rows.join(one, ["node", "k2", "doc_id", "mark"], "left_semi").select("node", "doc_id", "mark", "n", "first", "parity").dropDuplicates(["node"]))
    # the pivot is the row of the smallest id, as copies that differ from each other are often both near the one that they were made from
    posts = nodes.select(F.explode("first").alias("h"), F.col("node").alias("rep"), "n", "doc_id")
    lists = posts.groupBy("h").agg(F.count("*").alias("many"), F.min_by("rep", "doc_id").alias("pivot")).where("many > 1").drop("many")
    shared = written(posts.drop("doc_id").join(lists, "h"))

    star = written(near_sizes(shared.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), nodes, ratio))
    star = written(possible(star, nodes, ratio))
    links = overlaps(docs, star, nodes, words, ratio)
    labels = written(components(links))

    known = sized_join(shared.select("h", "rep", "n"), labels.withColumnRenamed("node", "rep"), "rep", "left", 32).withColumn("component", F.coalesce("component", "rep"))
    known = written(known)
    open_lists = known.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("h")
    known = known.join(open_lists, "h", "left_semi").join(nodes.select(F.col("node").alias("rep"), "parity"), "rep")
    x, y = known.alias("x"), known.alias("y")
    apart = F.expr(f"x.h = y.h and x.rep < y.rep and x.component <> y.component and {close('x', 'y', ratio)}")
    rest = written(x.join(y, apart).selectExpr("x.rep as a", "y.rep as b").distinct())
    rest = written(possible(rest.join(star, ["a", "b"], "left_anti"), nodes, ratio))
    if not rest.isEmpty():
        labels = written(components(links.unionByName(overlaps(docs, rest, nodes, words, ratio))))
    discard(shared, star, rest, nodes)
    return rows.select("doc_id", "mark", "n", "node").join(labels, "node", "left").select("doc_id", "mark", "n", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, words: int = WORDS, ratio: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: texts link when ratio[1] * |A and B| >= ratio[0] * |A or B| for their sets
    of word n-grams, and a component takes its smallest doc_id.

    Null, empty and blank texts have an empty set and link with nothing: their component is their doc_id. Every row is judged by its own
    text, whether its doc_id is null or others have it too; a component of rows without ids has none."""
    of = components_of(docs, words, ratio)
    least = of.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    known = lambda c: F.when(c < (1 << 63) - 1, c)
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return of.join(least, "component", "left").select(known(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), known(component).alias("component_id"))


def first_of_groups(docs: DataFrame, words: int = WORDS, ratio: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows and columns of docs but those that are near duplicates of another: of each component of near_duplicates() the first row by
    (doc_id, hash of the text) stays, null ids last, and of rows alike in both any one. Rows without words all stay."""
    of = written(components_of(docs, words, ratio))
    spoken = of.where("n > 0")
    best = spoken.groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("best")).select("best.*").withColumn("best", F.lit(True))
    gone = written(spoken.select("doc_id", "mark").distinct().join(best, ["doc_id", "mark"], "left_anti"))
    again = written(spoken.groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark").join(gone, ["doc_id", "mark"], "left_anti"))
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id")
    rows = docs.select(F.struct("*").alias("row"), id_, F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    kept = sized_join(rows, gone, ["doc_id", "mark"], "left_anti", 24)
    if not again.isEmpty():
        once = sized_join(kept, again, ["doc_id", "mark"], "left_semi", 24).dropDuplicates(["doc_id", "mark"])
        kept = sized_join(kept, again, ["doc_id", "mark"], "left_anti", 24).unionByName(once)
    return kept.select("row.*")


def op7_ngrams(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), 4, (85, 100))
