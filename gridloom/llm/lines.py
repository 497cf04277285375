"""Line dedup, fuzzy: SimHash of normalised lines, pigeonhole blocks, edit similarity, one kept of each group.

A line's features are dealt to PARTS parts by a hash of their first two letters, and each part has its own SimHash, a block of the whole
one. A changed word is a feature gone and a feature more, so it touches two blocks at most, or one where the change comes after its first
letters, and leaves all others as they were, however long the line is: that is the pigeonhole. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, documents, sized_join, small, written
from .components import components

#: Linked lines have an edit similarity of at least SIMILARITY percent.
SIMILARITY = 80
#: Features are distinct words; in lines of fewer than FEW of them, runs of GRAM characters.
FEW, GRAM = 8, 3
#: Blocks of a SimHash, and the features that a key of blocks has at least: one block, or two or three of those with too few each.
PARTS, NEED = 7, 4
#: Each sum counts four of a block's bits in 15-bit fields.
SUMS, FIELDS = 10, sum(1 << 15 * f for f in range(4))
#: Lines that share a key are compared where at most so many of their 280 bits differ: some 57 do where a fifth of the words is
#: other, 93 where half is, 120 of unrelated lines.
DISTANCE = 75
#: In lines of at most so many characters every pair that the edit similarity allows is found, by deletions.
SHORT = 14
#: Rounds of comparing the lines of each block of more than CROWD with one of them, before pairs.
ROUNDS, CROWD = 2, 8
#: Of longer lines, so many words at a time are compared to see whether the edit similarity can be told from sums.
CHUNK = 24
#: White space that is cut from the ends of lines: Unicode's.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_LOW = -(1 << 63)


def normal(line: Column) -> Column:
    """Lower case, without white space of any kind at the ends."""
    return F.lower(F.btrim(line, F.lit(SPACES)))


def row_key() -> list[Column]:
    """gid (doc_id, null as the lowest) and mark (a hash of the text): rows that share an id, or have none, are told apart by their texts."""
    return [F.coalesce(F.col("doc_id"), F.lit(_LOW)).alias("gid"), F.xxhash64("text").alias("mark")]


def line_rows(docs: DataFrame) -> DataFrame:
    """gid and mark of a row, line_no, norm and its keys k1, k2 (96 bits, by which lines count as equal), of each line with a letter or digit."""
    rows = docs.select(*row_key(), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("gid", "mark", "line_no", normal(F.col("line")).alias("norm"))
    return rows.where(F.col("norm").rlike(r"[\p{L}\p{N}]")).withColumns({"k1": F.xxhash64("norm"), "k2": F.hash("norm")})


def place() -> Column:
    """(gid, 31 bits of mark, line_no) as one ordered number."""
    of = lambda c, bits: F.col(c).cast(f"decimal({bits},0)")
    mark = F.shiftrightunsigned("mark", 33).cast("decimal(10,0)")
    return of("gid", 19) * F.lit(1 << 62).cast("decimal(19,0)") + mark * F.lit(1 << 31).cast("decimal(10,0)") + of("line_no", 10)


def simhashes(lines: DataFrame, by: list[str]) -> DataFrame:
    """id, and n0, s0 and so on of a line's parts: how many features each has, and its bits, set where most features' hashes have them.
    Counters hold 16,383 features of a part; beyond, they run over, alike for equal parts. by: the columns that name a line, and by which
    it may be dealt already, so that its features stay in its task."""
    few = f"if(char_length(norm) < {GRAM}, array(norm), array_distinct(regexp_extract_all(norm, '(?s)(?=(.{{{GRAM}}}))', 1)))"
    rows = lines.selectExpr(*by, "norm", "array_distinct(split(norm, ' ')) as words")
    rows = rows.selectExpr(*by, f"explode_outer(if(size(words) >= {FEW}, words, {few})) as w")
    rows = rows.select(*by, F.xxhash64("w").alias("h"), F.pmod(F.xxhash64(F.left("w", F.lit(2))), F.lit(PARTS)).cast("int").alias("part"))
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(FIELDS))).alias(f"s{i}") for i in range(SUMS)]
    parts = rows.groupBy(*by, "part").agg(F.count("*").cast("int").alias("n"), *sums)
    # a field and 16383 less half the features reach its highest bit where the field is more than half
    most = lambda i: f"shiftleft(shiftrightunsigned(s{i} + greatest(16383 - n div 2, 0) * {FIELDS}L, 14) & {FIELDS}L, {i})"
    parts = parts.selectExpr(*by, "part", "n", f"{' | '.join(most(i) for i in range(SUMS))} as sim")
    of = lambda c, p: F.coalesce(F.max(F.when(F.col("part") == p, F.col(c))), F.lit(0).cast("int" if c == "n" else "long"))
    found = parts.groupBy(*by).agg(*[of("n", p).alias(f"n{p}") for p in range(PARTS)], *[of("sim", p).alias(f"s{p}") for p in range(PARTS)])
    return found.select("id", *[f"{c}{p}" for c in "ns" for p in range(PARTS)])


def blocks(sims: DataFrame) -> DataFrame:
    """id, block: each line under a key for every part of at least NEED features, and for every two or three parts that have
    as many only together."""
    one, more = [], []
    for k in (1, 2, 3):
        for t in combinations(range(PARTS), k):
            count = lambda v: " + ".join(f"n{i}" for i in v)
            fewer = "".join(f" and {count(v)} < {NEED}" for v in combinations(t, k - 1) if v)
            key = f"if({count(t)} >= {NEED}{fewer}, xxhash64({sum(1 << i for i in t)}, {', '.join(f's{i}' for i in t)}), null)"
            (one if k == 1 else more).append(key)
    under = lambda rows, keys: rows.select("id", F.explode_outer(F.expr(f"array({', '.join(keys)})")).alias("block")).where("block is not null")
    small = sims.where(" or ".join(f"n{i} < {NEED}" for i in range(PARTS)))
    return reduce(DataFrame.unionByName, [under(sims, one), *[under(small, more[i : i + 14]) for i in range(0, len(more), 14)]])  # in parts that compile


def short_blocks(lines: DataFrame, short: int = SHORT) -> DataFrame:
    """Short lines under each string that deleting up to as many characters leaves as an allowed edit distance has: two lines
    within that distance have such a string in common. A SimHash of few features says little of them."""
    most = lambda size: f"int(floor({size} * {100 - SIMILARITY} / 100))"
    # the longer line of a pair has at most size + deletions characters
    deep = reduce(lambda was, k: f"if(size + {k} <= {short} and {most(f'(size + {k})')} >= {k}, {most(f'(size + {k})')}, {was})", range(1, short * (100 - SIMILARITY) // 100 + 1), "0")
    deep = f"greatest({deep}, {most('size')})"
    without = lambda x: f"transform(sequence(1, char_length({x})), i -> concat(substring({x}, 1, i - 1), substring({x}, i + 1)))"
    sized = lines.select("id", "norm", F.char_length("norm").alias("size"))
    found = sized.where(f"size <= {short}").selectExpr("id", "size", f"{deep} as deep", f"array(left(norm, {short})) as level", f"array(left(norm, {short})) as every")  # left: Spark may work on all lines before it filters
    for k in range(1, short * (100 - SIMILARITY) // 100 + 1):
        found = found.withColumn("level", F.expr(f"if(deep >= {k}, array_distinct(flatten(transform(level, s -> {without('s')}))), array())"))
        found = found.withColumn("every", F.concat("every", "level"))
    rows = found.where("deep > 0").select("id", F.explode_outer("every").alias("s"))
    return rows.select("id", F.xxhash64("s").alias("block"))


def _let(value: str, name: str, then: str) -> str:
    """SQL: then, a condition, with name for value, which is computed once."""
    return f"exists(array({value}), {name} -> {then})"


def similar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The rows whose lines a and b have an edit similarity of at least SIMILARITY percent of the longer one. Words that both begin or end
    with don't change the distance and are left out. The distances of words one by one, where both have as many, then of FEW words each, and of long lines of
    CHUNK words each are summed: the whole distance is no more, and only where that doesn't settle it is it computed."""
    most = f"cast(floor(greatest(char_length({a}), char_length({b})) * {100 - SIMILARITY} / 100) as int)"
    rows = pairs.select("*", F.expr(most).alias("most_edits")).where(f"abs(char_length({a}) - char_length({b})) <= most_edits")
    rest = lambda x, n: f"slice({x}, {n} + 1, greatest(size({x}) - {n}, 0))"
    closed = lambda x: f"array_join({x}, ' ') || if(size({x}) > 0, ' ', '')"
    longer = "greatest(char_length(r.u), char_length(r.v))"
    by_word = "aggregate(zip_with(w.u, w.v, (u, v) -> if(u = v, 0, levenshtein(u, v))), 0, (sum, n) -> sum + n)"
    part = lambda x, n: closed(f"slice({x}, i * {n} + 1, {n})")
    chunks = lambda n: f"aggregate(sequence(0, greatest(size(w.u), size(w.v)) div {n}), 0, (sum, i) -> sum + levenshtein({part('w.u', n)}, {part('w.v', n)}))"
    alike = f"case when {longer} <= most_edits then true when size(w.u) = size(w.v) and {by_word} <= most_edits then true when {chunks(FEW)} <= most_edits then true when most_edits > 192 and {chunks(CHUNK)} <= most_edits then true else levenshtein(r.u, r.v, most_edits) >= 0 end"
    alike = _let(f"struct({closed('w.u')} as u, {closed('w.v')} as v)", "r", alike)
    for _ in range(2):  # from the front, then from the back
        cut = f"struct(reverse({rest('w.u', 'n')}) as u, reverse({rest('w.v', 'n')}) as v)"
        same = "if(w.u = w.v, size(w.u), cast(array_position(zip_with(w.u, w.v, (u, v) -> u <=> v), false) - 1 as int))"
        alike = _let(same, "n", _let(cut, "w", alike))
    return rows.where(_let(f"struct(split({a}, ' ') as u, split({b}, ' ') as v)", "w", alike)).select(*pairs.columns)


def verified(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Of rows with ids a and b of lines (id, norm) those whose lines are similar."""
    both = pairs.join(named.selectExpr("id as b", "norm as b_norm"), "b").join(named.selectExpr("id as a", "norm as a_norm"), "a")
    return written(similar(both, "a_norm", "b_norm").drop("a_norm", "b_norm"))


def joined(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """labels (node, component) with the components linked by edges (a, b) of components made one."""
    moved = written(components(edges))
    if labels is None:
        return moved
    new = moved.join(labels.select("node"), "node", "left_anti")
    mid = labels.select("node", F.col("component").alias("mid"))
    known = sized_join(mid, moved.select(F.col("node").alias("mid"), "component"), "mid", "left", 40).select("node", F.coalesce("component", "mid").alias("component"))
    out = written(known.unionByName(new))
    discard(moved, labels)
    return out


def line_groups(lines: DataFrame, by: list[str] | None = None, some: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """node, component: ids of linked lines among distinct lines (norm, id and the columns by), each with its group's smallest id. some gives
    the lines (id, norm) of a table of ids.

    No pair of a block is left out, but pairs within what is already one group are not made: ROUNDS times each crowded block that
    holds several groups compares its lines with one of them (another each time), and only then are lines of different groups
    that still share a block compared pair by pair."""
    some = some or (lambda ids: sized_join(lines.select("id", "norm"), ids, "id", "left_semi", 16))
    sims = written(simhashes(lines, by or ["id"]))
    dealt = blocks(sims)
    dealt = written(dealt.unionByName(short_blocks(lines)))
    crowded = written(dealt.groupBy("block").agg(F.count("*").alias("n")).where("n > 1"))
    met = written(sized_join(dealt, crowded, "block", "inner", 24, 24))
    member = written(met.select("id").distinct())
    named = written(some(member).withColumn("size", F.char_length("norm")))
    there = sized_join(sims.select("id", F.array(*[f"s{p}" for p in range(PARTS)]).alias("sims")), member, "id", "left_semi", 16, 24).join(named.select("id", "size"), "id")
    shared = written(met.join(there, "id"))
    discard(sims, dealt, crowded, met, member)
    labels, known = None, shared.where(f"n > {CROWD}").withColumn("component", F.col("id"))
    apart = " + ".join(f"bit_count(x.sims[{p}] ^ y.sims[{p}])" for p in range(PARTS))
    same = " + ".join(f"if(x.sims[{p}] = y.sims[{p}], 1, 0)" for p in range(PARTS))
    close = f"abs(x.size - y.size) * 100 <= greatest(x.size, y.size) * {100 - SIMILARITY} and (greatest(x.size, y.size) <= {SHORT} or {apart} <= {DISTANCE})"
    for r in range(ROUNDS + 1):
        pivot = F.min(F.struct(F.xxhash64("id", F.lit(r)).alias("order"), "id", "sims", "size", "component")).alias("y")
        open_blocks = known.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high"), pivot).where("low <> high")
        if r < ROUNDS:
            tried = known.alias("x").join(open_blocks.select("block", "y"), "block").where(f"x.component <> y.component and {close}")
        else:
            left = written(known.join(open_blocks.select("block"), "block", "left_semi"))
            tried = left.alias("x").join(left.alias("y"), F.expr(f"x.block = y.block and x.id < y.id and x.component <> y.component and {close}"))
        tried = written(tried.selectExpr("x.id as a", "y.id as b", "x.component as own", "y.component as other").distinct())
        found = verified(tried, named)
        edges = found.select(F.col("own").alias("a"), F.col("other").alias("b"))
        labels = joined(labels, edges)
        discard(tried, found, known)
        if r < ROUNDS:
            rows = shared.where(f"n > {CROWD}") if r + 1 < ROUNDS else shared
            known = written(sized_join(rows, labels.withColumnRenamed("node", "id"), "id", "left", 40).withColumn("component", F.coalesce("component", "id")))
    discard(shared, left, named)
    return labels


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs, with only the first line of each group of linked or equal lines left in text, by
    (doc_id, line), and n_removed, the number of lines removed.

    Lines without a letter or digit stay. Null texts stay null, null ids come first; rows that share a doc_id, or have none, go by a hash
    of their texts, and of rows alike in both each keeps what one keeps. A document may end up empty; its row stays. A column n_removed of docs gives way; all others are
    passed through, whatever their names."""
    rows = line_rows(docs)
    keyed = written(rows.drop("norm"))  # what all but one of the passes over the lines need
    lines = keyed.select("k1", "k2", place().alias("place")).groupBy("k1", "k2").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    lines = written(lines.select("*", F.monotonically_increasing_id().alias("id"), F.xxhash64("place").alias("spot")))
    # texts meet their line's number at its first place; all others of a line said often meet nothing, each in some other task
    placed, key = rows.select("k1", "k2", F.xxhash64(place()).alias("spot"), "norm"), ["k1", "k2", "spot"]
    first = lambda some: sized_join(placed, some, key, "inner", 56).select("id", "norm").dropDuplicates(["id"])
    numbers = lines.select(*key, "id")
    groups = line_groups(placed.join(numbers.hint("shuffle_merge"), key), [*key, "id"], lambda ids: first(written(numbers.join(ids, "id"))))
    member = written(lines.select("id", "place").join(groups.withColumnRenamed("node", "id"), "id"))
    member = member.join(member.groupBy("component").agg(F.min("place").alias("kept")), "component").select("id", "kept")
    known = sized_join(lines.select("id", "k1", "k2", "place", "n"), written(member), "id", "left", 40)
    gone = written(known.where("n > 1 or place <> kept").select("k1", "k2", F.coalesce("kept", "place").alias("kept")))
    hits = sized_join(keyed, gone, ["k1", "k2"], "inner", 40, 24)
    cut = written(hits.where(place() != F.col("kept")).groupBy("gid", "mark").agg(F.collect_set("line_no").alias("cut")))
    discard(lines, groups, gone, keyed)
    names = [c for c in docs.columns if c != "n_removed"]
    left = docs.select(*row_key(), F.struct(*names).alias("row"))
    size = cut.agg(F.coalesce(F.sum(F.size("cut")), F.lit(0)).alias("n")).first()["n"]
    fits = size * 4 < 24_000_000 and small(cut, 56, 24)
    out = left.join(F.broadcast(cut) if fits else cut.hint("shuffle_merge"), ["gid", "mark"], "left").withColumn("parts", F.split("row.text", "\n"))
    kept = F.expr(r"array_join(transform(array_except(sequence(0, size(parts) - 1), cut), i -> parts[i]), '\n')")
    text = F.when(F.col("cut").isNull(), F.col("row.text")).otherwise(kept)
    return out.select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names], F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut")).alias("n_removed"))


def op8_lines(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_removed", "text")
