"""Queries on logs, steps, nested rows, scales and boxes over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes, log, scale
from ..sources.tables import table
from .relational import CUTOFF, NTZ, cents

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as r from events where event_id > 300) where r = 1 order by event_id desc limit 200")
def remote_changes_since(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return log.changes_since(e, ["user_id", "event_type"], "event_id", F.lit(300), 200)


@query("select user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1 and value > 100 and event_type <> 'signup'")
def human_removals(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return log.tombstones(e, ["user_id", "event_type"], ["ts", "event_id"], F.col("value") > 100, F.col("event_type") == "signup")


@query("select e.event_id, count(*) as n_open from events e join events n on n.user_id = e.user_id and n.ts > e.ts - interval 2 day and (n.ts < e.ts or (n.ts = e.ts and n.event_id <= e.event_id)) group by e.event_id")
def open_connections(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return log.open_at_start(e, ["user_id"], "ts", F.col("ts") + F.expr("interval 2 days"), "event_id", F.to_date("at"))


@query("select l_orderkey, cast(coalesce(min(case when l_linestatus <> 'F' then l_linenumber end), max(l_linenumber) + 1) as bigint) as next_step from lineitem group by l_orderkey")
def ordered_fan_in(spark, d):
    return log.next_step(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", F.col("l_linestatus") == "F")


@query(f"select o_orderkey, exists (select 1 from orders s where s.o_custkey = o.o_custkey and s.o_orderpriority = o.o_orderpriority and s.o_orderkey <> o.o_orderkey) as has_sibling from orders o where o_orderstatus = 'P' and o_orderdate < timestamp '{CUTOFF}'")
def retention_with_sibling(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    return log.with_siblings(o, ["o_custkey", "o_orderpriority"], (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < NTZ(CUTOFF))).select("o_orderkey", "has_sibling")


@query("select s_suppkey, s_name, case when n_regionkey = 2 then 24 - s_nationkey else s_nationkey end as s_nationkey from supplier join nation on n_nationkey = s_nationkey")
def keyed_update(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    moved = s.join(table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey")), "s_nationkey", "left_semi")
    return log.updated(s, moved.select("s_suppkey", (24 - F.col("s_nationkey")).alias("s_nationkey")), ["s_suppkey"])


@query(f"select o_orderkey, concat_ws(',', case when o_totalprice < 50000 then 'small' end, case when o_orderstatus = 'P' then 'pending' end, case when o_orderdate >= timestamp '{CUTOFF}' then 'recent' end) as reasons from orders")
def readiness_reasons(spark, d):
    rules = [("small", F.col("o_totalprice") < 50000), ("pending", F.col("o_orderstatus") == "P"), ("recent", F.col("o_orderdate") >= NTZ(CUTOFF))]
    return table(spark, d, "orders").select("o_orderkey", F.array_join(log.reasons(rules), ",").alias("reasons"))


@query("select l_orderkey, count(*) as n_items, count(*) filter (where l_linestatus = 'F') as n_reviewed, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as total, max(cast(round(l_extendedprice * 100) as bigint)) as largest from lineitem group by l_orderkey")
def layer_counts(spark, d):
    size = cents("l_extendedprice")
    counts = [F.count("*").alias("n_items"), F.count_if(F.col("l_linestatus") == "F").alias("n_reviewed"), F.sum(size).alias("total"), F.max(size).alias("largest")]
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(*counts)


@query("""with v as (select p_brand, cast(round(p_retailprice * 100) as bigint) as c from part),
 m as (select a.p_brand, a.c, count(*) as n, max(b.c) as last from (select distinct p_brand, c from v) a join v b on a.p_brand = b.p_brand and abs(b.c - a.c) <= a.c // 50 group by all),
 t as (select *, max(n) over (partition by p_brand) as best from m)
 select p_brand, min(c) as centre, max(best) as members from t where n = best group by p_brand having arg_min(last, c) >= max(c) - max(c) // 50""")
def densest_cluster(spark, d):
    p = table(spark, d, "part").select("p_brand", cents("p_retailprice").alias("v"))
    return scale.densest_cluster(p, ["p_brand"], "v", lambda c: F.floor(c / 50), 10_000)


@query("""with s as (select l_suppkey, l_quantity as px, l_extendedprice as mm, l_extendedprice / l_quantity as r from lineitem),
 m as (select l_suppkey, median(r) as med from s group by all), o as (select *, abs(r - med) as off from s join m using (l_suppkey)),
 p as (select l_suppkey, case when median(off) > 0 then median(off) / 0.6745 else avg(off) * 1.2533 end as spread from o group by all),
 k as (select l_suppkey, r from o join p using (l_suppkey) where not (spread > 0 and off > spread * 3)),
 c as (select l_suppkey, median(r) as suggested, count(*) as n from k group by all),
 f as (select l_suppkey, suggested, n, median(abs(r - suggested)) as spread from k join c using (l_suppkey) group by all),
 g as (select l_suppkey, coalesce(count(r) = 2 and min(mm) <> max(mm) and min(mm) >= 1000 and max(r) - min(r) <= 0.01 * min(r), false) as pair from s group by all),
 x as (select l_suppkey, pair, coalesce(n, 0) as n, coalesce(floor(greatest(0.0, 1 - spread / suggested / 0.05) * (0.5 + 0.5 * least(1.0, n / 5)) * 1000000 + 0.5) / 1000000, 0) as confidence, suggested from g left join f using (l_suppkey))
 select l_suppkey, n as n_samples, cast(round(confidence * 10000) as bigint) as confidence, cast(round(suggested * 1000) as bigint) as suggested, case when n < 3 then case when not pair then 'tooFewSamples' end when confidence < 0.6 then 'lowConfidence' end as reason from x""")
def scale_inference(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")
    found = scale.inferred(li, ["l_suppkey"], "l_quantity", "l_extendedprice")
    return found.select("l_suppkey", "n_samples", F.round(F.col("confidence") * 10000).cast("long").alias("confidence"), F.round(F.col("suggested") * 1000).cast("long").alias("suggested"), "reason")


_REACH, _HALF = 0.05, 0.01
_POINTS = "p as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y from embeddings)"


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query(f"with {_POINTS} select id, near from (select a.id, b.id as near, row_number() over (partition by a.id order by (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) as r from p a join p b on a.id <> b.id and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {_REACH * _REACH}) where r = 1")
def nearest_within_reach(spark, d):
    return boxes.nearest(_points(spark, d), _REACH).select("id", "near")


@query(f"with {_POINTS} select a.id as a, b.id as b from p a join p b on a.id < b.id and a.x - {_HALF} <= b.x + {_HALF} and b.x - {_HALF} <= a.x + {_HALF} and a.y - {_HALF} <= b.y + {_HALF} and b.y - {_HALF} <= a.y + {_HALF}")
def boxes_meeting(spark, d):
    side = {f"{c}{i}": F.col(c) + w for c in ("x", "y") for i, w in ((1, -_HALF), (2, _HALF))}
    return boxes.meeting(_points(spark, d).withColumns(side), 2 * _HALF)
