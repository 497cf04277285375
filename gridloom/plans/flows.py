"""Event flows and detector measures over the driver's tables; SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import unicode
from ..operators import detection
from ..sources.tables import kept, table
from ..streaming import events as streams
from .relational import NTZ

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""with recursive e as (select user_id, ts, event_id, row_number() over (partition by user_id order by ts, event_id) as r from events),
 g(user_id, r, since, first_id, event_id) as (select user_id, r, ts, event_id, event_id from e where r = 1 union all
  select e.user_id, e.r, case when e.ts >= g.since + interval 2 day then e.ts else g.since end, case when e.ts >= g.since + interval 2 day then e.event_id else g.first_id end, e.event_id from g join e on e.user_id = g.user_id and e.r = g.r + 1)
 select event_id, first_id from g""")
def publish_within_ttl(spark, d):
    return streams.published(table(spark, d, "events"), ["user_id"], 2 * 86_400).select("event_id", "first_id")


_POINTS = "p as (select event_id, user_id, event_type, cast(floor(value) as bigint) % 40 as step, ts + to_minutes(event_id % 3000) as sent from events where event_type <> 'error' and event_id % 8 <> 0)"


@query(f"""with {_POINTS}, o as (select * from (select *, row_number() over (partition by user_id, event_type, step order by event_id) as a from p) where a = 1), c as (select * from (select *, row_number() over (partition by user_id order by event_id) as b from o) where b <= 30)
 select event_id, step, least(sent, timestamp '2024-01-20') as recorded_at, coalesce(step <= max(step) over (partition by user_id, event_type order by event_id rows between unbounded preceding and 1 preceding), false) as is_late from c""")
def metric_points(spark, d):
    e = table(spark, d, "events")
    sent = F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 3000).cast("int"))
    p = e.select("event_id", "user_id", "event_type", (F.floor("value") % 40).alias("step"), sent.alias("sent"))
    own = (F.col("event_type") != "error") & (F.col("event_id") % 8 != 0)
    return streams.metric_points(p, "user_id", "event_type", "step", "sent", NTZ("2024-01-20 00:00:00"), own, 30).select("event_id", "step", "recorded_at", "is_late")


@query("""with b as (select user_id, count(*) as n from events group by user_id), e as (select user_id, case when event_id % 10 = 0 then 'malformed' when event_type in ('click', 'view') then 'accepted' else 'unknown' end as outcome from events)
 select user_id as batch, case when user_id % 10 = 0 then 'not_an_envelope' when user_id % 10 = 1 then 'version' else 'too_many' end as outcome, cast(1 as bigint) as n from b where user_id % 10 in (0, 1) or n > 20
 union all select e.user_id, outcome, count(*) from e join b on b.user_id = e.user_id where e.user_id % 10 not in (0, 1) and n <= 20 group by all""")
def telemetry_batches(spark, d):
    """Envelopes of all events of a user: some are cut short, some of another version, and those of more than twenty events are too large."""
    e, u = table(spark, d, "events"), F.col("user_id")
    event = F.struct(F.when(F.col("event_id") % 10 != 0, F.col("event_id")).alias("sequence"), F.unix_millis(F.col("ts").cast("timestamp")).alias("atMs"), F.struct(F.col("event_type").alias("name")).alias("event"))
    sent = e.groupBy("user_id").agg(F.collect_list(event).alias("events"))
    body = F.to_json(F.struct(F.when(u % 10 == 1, 2).otherwise(1).alias("schemaVersion"), F.concat(F.lit("s"), u).alias("sessionId"), "events"))
    bodies = sent.select(u.alias("batch"), F.when(u % 10 == 0, F.substring(body, 1, 20)).otherwise(body).alias("body"))
    return streams.envelopes(bodies, ["click", "view"])


def boxes(spark, d):
    """Truth and predictions: boxes at the first two values of each vector, of a label on a page; predictions lie beside, and odd ones are guesses."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 5).alias("page"), (F.col("label") % 3).alias("label"), *[F.floor(F.col("embedding")[i].cast("double") * 400).alias(c) for i, c in ((0, "x1"), (1, "y1"))])
    sized = lambda df: df.withColumns({"x2": F.col("x1") + 40, "y2": F.col("y1") + 40})
    truth = sized(e.where("id % 2 = 0"))
    guess = e.withColumns({"x1": F.col("x1") + F.col("id") % 7 * 3, "score": (F.col("id") * 37 % 101) / 101})
    return kept(truth), kept(sized(guess))


def ranked(df, keys):
    """A number for each prediction by falling score, then id: its greedy turn."""
    from ..operators.keyed import numbered

    return numbered(df, keys, -F.floor(F.col("score") * 20), [F.desc("score"), F.asc("id")], "turn")


@query(None)
def iou_matching(spark, d):
    """Predictions by falling score take the free box of their page and label that they overlap most."""
    truth, guess = boxes(spark, d)
    pairs = detection.overlaps(ranked(guess, ["page", "label"]), truth, ["page", "label"], detection.MATCH_IOU)
    pairs = pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.struct(F.col("l.turn").alias("t"), F.col("l.id").alias("i")).alias("rank"), F.col("iou").alias("worth"))
    return detection.one_to_one(pairs).select(F.col("a").alias("guess"), F.col("b").alias("truth"))


@query(None)
def detection_ap(spark, d):
    """Average precision of each label that has boxes, and how many predictions and boxes it has."""
    truth, guess = boxes(spark, d)
    pairs = detection.overlaps(guess, truth, ["page", "label"], detection.MATCH_IOU)
    pairs = pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.struct((-F.col("l.score")).alias("s"), F.col("l.id").alias("i")).alias("rank"), F.col("iou").alias("worth"))
    hit = detection.one_to_one(pairs).select(F.col("a").alias("id"), F.lit(1).alias("hit"))
    n = truth.groupBy("label").agg(F.count("*").alias("positives"))
    rows = guess.join(hit, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(0))).join(n, "label")
    curve = detection.precision_at(rows, ["label"], -F.floor(F.col("score") * 20), [F.desc("score"), F.asc("page"), F.asc("id")], "hit", "positives")
    ap = detection.interpolated_ap(curve, ["label"])
    return n.join(ap, "label", "left").select("label", "positives", F.round(F.coalesce("ap", F.lit(0.0)) * 1000000).cast("long").alias("ap_millionths"))


@query(None)
def suppressed_boxes(spark, d):
    _, guess = boxes(spark, d)
    return detection.suppressed(guess, ["page", "label"]).select("id", "page", "label")


@query(None)
def matched_cer(spark, d):
    """Read texts against true ones: each true text, from above, takes the free reading whose box overlaps its own most; edits over characters of
    plain forms, readings without a true text counting whole."""
    words = table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 60).alias("text"))
    k = F.col("item_id")
    at = {"page": k % 4, "x1": k * 13 % 90, "y1": k * 29 % 70}
    truth = words.withColumns(at).withColumns({"x2": F.col("x1") + 30, "y2": F.col("y1") + 12}).withColumnRenamed("item_id", "id")
    read = truth.where("id % 6 <> 0").withColumns({"x1": F.col("x1") + F.col("id") % 5, "x2": F.col("x2") + F.col("id") % 5, "text": F.regexp_replace("text", "e", "c")})
    truth, read = kept(truth.withColumn("text", unicode.read_text(F.col("text")))), kept(read.withColumn("text", unicode.read_text(F.col("text"))))
    pairs = detection.overlaps(truth, read, ["page"], detection.MATCH_IOU)
    rank = F.struct(F.col("l.y1").alias("y"), F.col("l.x1").alias("x"), F.col("l.id").alias("i"))
    taken = detection.one_to_one(pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), rank.alias("rank"), F.col("iou").alias("worth")))
    got = truth.select("id", "text").join(taken.select(F.col("a").alias("id"), "b"), "id", "left").join(read.select(F.col("id").alias("b"), F.col("text").alias("read")), "b", "full")
    edits = F.levenshtein(F.coalesce("text", F.lit("")), F.coalesce("read", F.lit("")))
    return got.agg(F.sum(edits).alias("edits"), F.greatest(F.sum(F.char_length("text")), F.lit(1)).cast("long").alias("chars"))
