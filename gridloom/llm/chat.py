"""Chat formatting: reply trees to conversations, with a reversible template and a loss mask. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of this and other templates; fixed values.
CONTROLS = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_HEADS = r"(\\|<(?=\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>)|\[(?=/?INST\]))"
_TURN = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"


def escape(text: Column) -> Column:
    """A backslash after each backslash and after the first character of each control string."""
    return F.regexp_replace(text, _HEADS, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def reply_paths(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees: tree, leaf, rank, depth, node, one row for each message of a chosen path.

    messages has tree, node, parent (null: a root), score. A path's score is the sum of its messages' (null: 0); the best
    keep of each tree stay (None: all), ties by the smaller leaf. An unknown parent makes a root. Messages on a cycle of
    replies have no root and are left out. (tree, node) must be unique. Self-joins double the distance to the known
    ancestor, so chains of d messages take log2(d) rounds."""
    m = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = m.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    up = written(m.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("depth")))
    levels = [up]
    left = up.where("up is not null").count()
    most = left.bit_length() + 1
    while left and len(levels) <= most:
        far = up.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("depth").alias("depth2"))
        moved = up.where("up is not null").join(far, ["tree", "up"], "left").select("tree", "node", F.col("up2").alias("up"), (F.col("sum") + F.coalesce("sum2", F.lit(0.0))).alias("sum"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"))
        up = written(moved.unionByName(up.where("up is null")))  # only those that have not met their root move
        levels.append(up)
        left = up.where("up is not null").count()
    inner = m.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = up.where("up is null").join(inner, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("sum"), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(best))
    if keep is not None:
        leaves = leaves.where(F.col("rank") <= keep)
    paths = written(leaves.select("tree", F.col("node").alias("leaf"), "rank", "node"))
    for level in levels[:-1]:  # a path's last 2^k messages and their ancestors 2^k above are its last 2^(k+1)
        step = level.where("up is not null").select("tree", "node", F.col("up").alias("above"))
        longer = written(paths.unionByName(paths.join(step, ["tree", "node"]).select("tree", "leaf", "rank", F.col("above").alias("node"))))
        discard(paths)  # written at each level: its plan holds the level before twice
        paths = longer
    out = written(paths.join(up.select("tree", "node", "depth"), ["tree", "node"]))
    discard(paths)
    discard(*levels)
    return out


def formatted(turns: DataFrame) -> DataFrame:
    """One string for each conversation of conv_id, pos, role, text: conv_id, formatted, spans of (start, length), in code
    points, that count for the loss: the assistant's texts. Null texts and roles are empty; line breaks in roles are spaces."""
    return format_rows(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("rows")))


def format_rows(conversations: DataFrame) -> DataFrame:
    """What formatted() returns, from conv_id and rows, an array of (pos, role, text) in order."""

    def parts(x: Column) -> Column:
        role = F.regexp_replace(F.coalesce(x["role"], F.lit("")), "[\n]", " ")
        head = F.concat(F.lit(OPEN), escape(role), F.lit("\n"))
        return F.struct(head.alias("head"), escape(F.coalesce(x["text"], F.lit(""))).alias("body"), (role == "assistant").alias("loss"))

    g = conversations.select("conv_id", F.transform("rows", parts).alias("rows"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        body = acc["at"] + F.char_length(x["head"])
        span = F.array(F.struct(body.alias("start"), F.char_length(x["body"]).alias("length")))
        after = body + F.char_length(x["body"]) + len(CLOSE + "\n")
        return F.struct(after.alias("at"), F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    whole = F.array_join(F.transform("rows", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE + "\n"))), "")
    return g.select("conv_id", whole.alias("formatted"), F.aggregate("rows", start, add, lambda acc: acc["spans"]).alias("spans"))


def read_back(df: DataFrame) -> DataFrame:
    """What formatted() wrote, from its output alone: conv_id, roles, texts, loss_texts."""
    part = lambda i: F.transform(F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(i)), unescape)
    loss = F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return df.select("conv_id", "formatted", part(1).alias("roles"), part(2).alias("texts"), loss.alias("loss_texts"))


#: Conversation -1 of the query: texts that hold the control strings of a template.
CONTROL_TURNS = ((-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"))


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """Conversations of chosen paths, conv_id and rows, an array of (pos, role, text): a conversation's rows by (turn, role,
    text) are a chain of replies, scored by their turns. Texts are shuffled once, to their conversation."""
    c = conversations.select("conv_id", "turn", "role", "text").withColumn("tree", F.coalesce("conv_id", F.lit(-(1 << 62))))
    order = Window.partitionBy("tree").orderBy("turn", "role")  # rows of one turn and role are alike but for their texts
    nodes = written(c.select("tree", "turn", F.row_number().over(order).cast("long").alias("node")))
    messages = nodes.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.col("turn").alias("score"))
    paths = reply_paths(messages, keep=1)
    discard(nodes)
    paths = paths.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("path"))
    own = c.groupBy("tree").agg(F.max("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("own"))

    def chosen(x: Column) -> Column:
        row = F.element_at(F.col("own"), x["node"].cast("int"))
        return F.struct(x["depth"].alias("pos"), row["role"].alias("role"), row["text"].alias("text"))

    return own.join(paths, "tree").select("conv_id", F.transform("path", chosen).alias("rows"))


def op4_chat(spark, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([*CONTROL_TURNS], "conv_id long, turn long, role string, text string")
    back = read_back(format_rows(conversation_turns(c.unionByName(extra))))
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("texts").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_ADDED = r"length(regexp_replace({0}, '(\\|<(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>)|\[/?INST\])', '\1#', 'g')) "
OP4_SQL = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  sum({_ADDED.format('role')} + {_ADDED.format('text')} + {len(OPEN) + len(CLOSE) + 2})::bigint as formatted_chars
from c group by conv_id
"""
