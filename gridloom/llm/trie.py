"""Conversation prefix trie by heavy-path decomposition, in DataFrame functions but for one digest.

A node is named by the exclusive or of two 64-bit hashes of each turn with its depth, so a parent's name follows from the child's, and texts move
only to find their turn's place. The child with most members is its parent's heavy one; chains of heavy children are paths. A child that isn't
heavy has at most half of its parent's members, so after as many rounds as their count has bits each path has met all light ones below it: sums
run up a path at once, and the path's top is then added to its parent."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, mapped, spread_join, written

#: Rebuilt conversations take up to HEADS - 1 turns from the first of each GROUP.
GROUP, HEADS = 20, 4
#: Turns or nodes of one conversation or path that a task orders at once.
SEGMENT = 512
#: Conversation ids that are joined to one string before they move to their digest.
ENDS = 2000


def _prefix(rows: DataFrame, keys: list[str], segment: Column, order: list, values: dict[str, Column], add, upto: int = 0, falling: bool = False) -> DataFrame:
    """rows with the columns in values: the running aggregate add of each over a key's rows in order up to each row (upto = -1: before it). Orders
    within segments of a key, then over one row a segment, so that a key of any size is dealt to many tasks."""
    span = (Window.unboundedPreceding, upto)
    rows = rows.withColumns({"_segment": segment} | {f"_v_{c}": v for c, v in values.items()})
    whole = rows.groupBy(*keys, "_segment").agg(*[add(f"_v_{c}").alias(f"_t_{c}") for c in values])
    outer = Window.partitionBy(*keys).orderBy(F.desc("_segment") if falling else F.asc("_segment")).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*keys, "_segment", *[add(f"_t_{c}").over(outer).alias(f"_o_{c}") for c in values])
    inner = Window.partitionBy(*keys, "_segment").orderBy(*order).rowsBetween(*span)
    rows = rows.withColumns({f"_i_{c}": add(f"_v_{c}").over(inner) for c in values}).join(whole, [*keys, "_segment"])
    both = lambda c: F.array(F.coalesce(f"_o_{c}", F.lit(0)), F.coalesce(f"_i_{c}", F.lit(0)))
    joined = (lambda c: both(c)[0].bitwiseXOR(both(c)[1])) if add is F.bit_xor else (lambda c: both(c)[0] + both(c)[1])
    kept = [c for c in rows.columns if c[:3] not in ("_v_", "_o_", "_i_") and c != "_segment"]
    return rows.select(*kept, *[joined(c).alias(c) for c in values])


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0, by turn, null first, then role and text), u1 and u2 (hashes of role and text) and words (of the text) of each turn; null roles
    and texts are empty. Rows without a conv_id belong to no conversation."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),  # it settles the order of rows of one turn and role, and goes no further
        F.xxhash64(F.lit(1), role, text).alias("u1"),
        F.xxhash64(F.lit(2), role, text).alias("u2"),
        F.size(F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)")).cast("long").alias("words"),
    )
    segment = F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62)))
    order = [F.asc_nulls_first("turn"), "role", "text"]
    return _prefix(written(rows), ["conv_id"], segment, order, {"pos": F.lit(1).cast("long")}, F.sum, -1).select("conv_id", "pos", "u1", "u2", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of hashed_turns(), all conversations c (conv_id, n: rebuilt turns), and their rebuilt turns (conv_id, d from 1, u1, u2, words): the first h of conversation
    c - c % GROUP and those of c after its first h, where h is crc32 of c's decimal digits mod HEADS. % takes the sign of c."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    size = turns.groupBy("conv_id").agg(F.count("*").alias("size"))
    convs = size.select("conv_id", "size", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    bases = size.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("n")))
    heads = turns.where((F.col("pos") < HEADS - 1) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    first = convs.select("conv_id", "base", "taken").join(heads, "base").where("pos < taken").select("conv_id", (F.col("pos") + 1).alias("d"), "u1", "u2", "words")
    own = turns.where(F.col("pos") >= h)
    own = spread_join(own, convs.select("conv_id", "h", "taken"), ["conv_id"], "inner")
    own = own.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("d"), "u1", "u2", "words")
    return convs.select("conv_id", "n"), first.unionByName(own)


def named_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, d, k1, k2 (the name of the first d turns), p1, p2 (of the first d - 1), words."""
    rows = turns.select("conv_id", "d", "words", F.xxhash64(F.lit(1), "d", "u1", "u2").alias("t1"), F.xxhash64(F.lit(2), "d", "u2", "u1").alias("t2"))
    rows = _prefix(written(rows), ["conv_id"], F.floor(F.col("d") / SEGMENT), ["d"], {"k1": F.col("t1"), "k2": F.col("t2")}, F.bit_xor)
    return rows.select("conv_id", "d", "k1", "k2", F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"), "words")


def ends_digests(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of rows k1, k2, conv_id: SHA-256 of a node's decimal conv_ids in numerical order, joined by commas. The digest must read them in
    order, so ids are sorted over all tasks and joined to strings of some ENDS first, which a node's task reads one after the other."""
    spark = ends.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.select("k1", "k2", "conv_id").repartitionByRange(parts, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = (batch["k1"].ne(batch["k1"].shift()) | batch["k2"].ne(batch["k2"].shift())).cumsum()
            piece = batch.groupby(at).cumcount() // ENDS
            grouped = batch.assign(text=batch["conv_id"].astype(str)).groupby([at, piece], sort=False)
            yield grouped.agg(k1=("k1", "first"), k2=("k2", "first"), first=("conv_id", "first"), text=("text", ",".join))

    pieces = written(dealt.mapInPandas(join, "k1 long, k2 long, first long, text string"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for batch in batches:
            out = []
            for k1, k2, text in zip(batch["k1"], batch["k2"], batch["text"]):
                if (k1, k2) != name:
                    if name is not None:
                        out.append((*name, state.hexdigest()))
                    name, state = (k1, k2), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
        if name is not None:
            yield pd.DataFrame([(*name, state.hexdigest())], columns=["k1", "k2", "ends_sha256"])

    return pieces.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInPandas(digest, "k1 long, k2 long, ends_sha256 string")


def path_tops(nodes: DataFrame) -> DataFrame:
    """k1, k2 and top1, top2, the node where its path begins, of nodes k1, k2, p1, p2, heavy. Each heavy node knows the one above it on its path; a round
    doubles the distance, so paths of n nodes take log2(n) rounds. One child of a node is heavy, so no two rows on their way meet the same one."""
    of = lambda c: F.when(F.col("heavy"), F.col(f"p{c}")).otherwise(F.col(f"k{c}")).alias(f"top{c}")
    parts = [written(nodes.select("k1", "k2", of(1), of(2), (~F.col("heavy")).alias("there")))]
    while not (left := parts[-1].where("not there")).isEmpty():
        known = reduce(DataFrame.unionByName, [x.where("there") for x in parts] + [left])
        far = known.select(F.col("k1").alias("top1"), F.col("k2").alias("top2"), F.col("top1").alias("far1"), F.col("top2").alias("far2"), "there")
        moved = left.drop("there").join(far, ["top1", "top2"])
        parts.append(written(moved.select("k1", "k2", F.col("far1").alias("top1"), F.col("far2").alias("top2"), "there")))
    out = written(reduce(DataFrame.unionByName, [x.where("there") for x in parts]).drop("there"))
    discard(*parts)
    return out


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """k1, k2, saved, leaves: the sums over each node's subtree of nodes k1, k2, p1, p2, depth, top1, top2, heavy, own (what it saves) and n_children.

    A path is summed once all its light children have ended: they are added to the node they hang from, where a task first sums its own."""
    lone = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    missing = F.col("n_children") - F.when(F.col("n_children") > 0, 1).otherwise(0)
    live = written(nodes.select("k1", "k2", "p1", "p2", "depth", "top1", "top2", F.col("own").alias("saved"), lone.alias("leaves"), missing.alias("missing")))
    segment, path = F.floor(F.col("depth") / SEGMENT), ["top1", "top2"]
    parts = []
    while not live.isEmpty():
        waiting = live.withColumn("segment", segment).groupBy(*path, "segment").agg(F.sum("missing").alias("missing"))
        whole = waiting.withColumn("all_missing", F.sum("missing").over(Window.partitionBy(*path)))  # a row a segment
        ready = written(whole.where("all_missing = 0").select(*path, "segment"))
        rows = live.withColumn("segment", segment).join(ready, [*path, "segment"], "left_semi").drop("segment")
        sums = _prefix(rows.withColumnsRenamed({"saved": "own", "leaves": "lone"}), path, segment, [F.desc("depth")], {"saved": F.col("own"), "leaves": F.col("lone")}, F.sum, falling=True)
        found = written(sums.select("k1", "k2", "p1", "p2", "top1", "top2", "saved", "leaves"))
        parts.append(found)
        tops = found.where("k1 = top1 and k2 = top2").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("ends"), F.count("*").alias("met"))
        rest = live.withColumn("segment", segment).join(ready, [*path, "segment"], "left_anti").drop("segment").join(tops, ["k1", "k2"], "left")
        more = lambda c, by, sign=1: (F.col(c) + sign * F.coalesce(by, F.lit(0))).alias(c)
        after = written(rest.select("k1", "k2", "p1", "p2", "depth", "top1", "top2", more("saved", "more"), more("leaves", "ends"), more("missing", "met", -1)))
        discard(live, ready)
        live = after
    discard(live)
    return reduce(DataFrame.unionByName, parts).select("k1", "k2", "saved", "leaves") if parts else nodes.select("k1", "k2", F.col("own").alias("saved"), lone.alias("leaves"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (see rebuilt()): conv_id (its smallest member), depth, parent_conv_id (null: the root), n_convs, n_children,
    n_leaves and saved_tokens (over its subtree), ends_sha256 (of the members that end there).

    Null roles and texts are empty; equal turns stay turns of their own; rows without a conv_id take no part, nor do other columns, whatever their
    names. Without conversations there is no node."""
    convs, turns = rebuilt(written(hashed_turns(conversations)))
    rows = written(named_prefixes(turns))
    key = ["k1", "k2"]
    below = rows.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.max("d").alias("depth"), F.count("*").alias("n_convs"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("words").alias("words"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), "conv_id", zero.alias("depth"), "n_convs", F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("words"))
    nodes = written(below.withColumn("depth", F.col("depth").cast("long")).unionByName(root))
    # of children with as many members the one of the smallest conv_id is heavy; a member follows one child, so no two tie
    best = F.max(F.struct("n_convs", (-F.col("conv_id")).alias("first"), F.col("k1").alias("h1"), F.col("k2").alias("h2"))).alias("best")
    kids = written(nodes.where("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children"), best).select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children", "best.h1", "best.h2"))
    heavy = kids.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.lit(True).alias("heavy"))
    known = nodes.join(kids.select("k1", "k2", "n_children"), key, "left").join(heavy, key, "left")
    known = known.select(*nodes.columns, F.coalesce("n_children", zero).alias("n_children"), F.coalesce("heavy", F.lit(False)).alias("heavy"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    known = written(known)
    sums = subtree_sums(written(known.join(path_tops(known), key)))
    above = known.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    parents = spread_join(known.where("depth > 0").select("k1", "k2", "p1", "p2"), above, ["p1", "p2"], "inner").select("k1", "k2", "parent_conv_id")
    last = rows.groupBy("conv_id").agg(F.max(F.struct("d", "k1", "k2")).alias("last")).select("conv_id", "last.k1", "last.k2")
    ends = convs.join(last, "conv_id", "left").select(F.coalesce("k1", zero).alias("k1"), F.coalesce("k2", zero).alias("k2"), "conv_id")
    out = known.join(sums, key).join(parents, key, "left").join(ends_digests(ends), key, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op13_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = r"""
with recursive t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null
), steps as (
  select range as b, range as x, 0 as i from range(256) union all
  select b, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, i + 1 from steps where i < 8
), crc_table as (
  select list(x order by b) as of from steps where i = 8
), convs as (
  select conv_id, conv_id - conv_id % 20 as base, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)),
    lambda crc, s: xor(crc >> 8, any_value(crc_table.of)[(xor(crc, s) & 255) + 1])) as crc, count(*) as size
  from t, crc_table group by conv_id
), c as (
  select conv_id, base, size, xor(crc, 4294967295) % 4 as h from convs
), counted as (
  select c.conv_id, c.base, c.h, c.size, least(c.h, coalesce(b.size, 0)) as taken from c left join c b on b.conv_id = c.base
), r as (
  select c.conv_id, t.pos + 1 as d, t.role, t.text from counted c join t on t.conv_id = c.base and t.pos < c.taken
  union all
  select c.conv_id, c.taken + t.pos - c.h + 1, t.role, t.text from counted c join t on t.conv_id = c.conv_id and t.pos >= c.h
), p as (
  select conv_id, d, len(regexp_extract_all(text, '[^ 	-
]+')) as words,
    list(sha256(role || chr(0) || text)) over (partition by conv_id order by d rows between unbounded preceding and current row)::varchar as name,
    coalesce(list(sha256(role || chr(0) || text)) over (partition by conv_id order by d rows between unbounded preceding and 1 preceding)::varchar, '') as above
  from r
), n as (
  select d as depth, name, any_value(above) as above, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words from p group by d, name
  union all select 0, '', null, min(conv_id), count(*), 0 from counted having count(*) > 0
), kids as (
  select above as name, count(*) as n_children from n where depth > 0 group by above
), e as (
  select n.*, coalesce(n_children, 0) as n_children from n left join kids using (name)
), up as (
  select name as of, name, above, (n_convs - 1) * words as saved, (n_children = 0)::bigint as leaves from e
  union all
  select e.name, up.name, e.above, up.saved, up.leaves from up join e on e.name = up.above
), sums as (
  select of as name, sum(saved)::bigint as saved_tokens, sum(leaves)::bigint as n_leaves from up group by of
), last as (
  select counted.conv_id, coalesce(max_by(name, d), '') as name from counted left join p using (conv_id) group by counted.conv_id
), ends as (
  select name, string_agg(conv_id::varchar, ',' order by conv_id) as ids from last group by name
)
select e.conv_id, e.depth::bigint as depth, a.conv_id as parent_conv_id, e.n_convs::bigint as n_convs, e.n_children::bigint as n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from e join sums using (name) left join e a on a.name = e.above left join ends on ends.name = e.name
"""
