"""Predicates, joins, pages, mutations and sweeps over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, values
from ..operators import keyed, mutations, samples, stats
from ..sources.tables import table
from .relational import CUTOFF, NTZ, cents

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STATUS = "case when o_orderkey % 5 = 0 then null else o_orderstatus end"


@query(f"select o_orderkey, coalesce(s in ('F', 'P'), false) as listed, coalesce(s not in ('F', 'P'), false) as unlisted, s is null as unknown from (select o_orderkey, {_STATUS} as s from orders)")
def in_list_with_nulls(spark, d):
    s = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))
    found = s.isin("F", "P")
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(found, F.lit(False)).alias("listed"), F.coalesce(~found, F.lit(False)).alias("unlisted"), s.isNull().alias("unknown"))


@query("select p_partkey from part where starts_with(p_type, 'STANDARD') or starts_with(p_brand, 'Brand#1')")
def prefix_match(spark, d):
    return table(spark, d, "part").where(F.col("p_type").startswith("STANDARD") | F.col("p_brand").startswith("Brand#1")).select("p_partkey")


@query("select event_id from (select event_id, ts from events where ts > timestamp '2024-01-05' and ts <= timestamp '2024-01-12' order by ts, event_id limit 300)")
def resend_batch(spark, d):
    """A half-open window of age, oldest first, one batch."""
    e = table(spark, d, "events").select("event_id", "ts")
    return mutations.sweep(e, "ts", NTZ("2024-01-05 00:00:00"), NTZ("2024-01-12 00:00:00"), [F.asc("ts"), F.asc("event_id")], 300).select("event_id")


@query("select l_orderkey, bool_or(l_returnflag = 'R' or l_linestatus = 'F') as touched, bool_and(l_returnflag = 'R' or l_linestatus = 'F') as approved from lineitem group by l_orderkey")
def touched_layers(spark, d):
    """Whether any thing in a document's lists was reviewed or made by a person, and whether all were."""
    item = F.struct((F.col("l_returnflag") == "R").alias("reviewed"), F.when(F.col("l_linestatus") == "F", "human").otherwise("ai").alias("source"))
    docs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") < 4, item)).alias("walls"), F.collect_list(F.when(F.col("l_linenumber") >= 4, item)).alias("rooms"))
    own = lambda x: x["reviewed"] | (x["source"] == "human")
    return docs.select("l_orderkey", values.any_of([F.exists(c, own) for c in ("walls", "rooms")]).alias("touched"), (F.forall("walls", own) & F.forall("rooms", own)).alias("approved"))


@query("select s_suppkey, case when s_suppkey % 3 = 0 then 'old' else 'v' || s_nationkey end as model, s_suppkey % 3 <> 0 as is_new from supplier")
def pinned_once(spark, d):
    """A key of a map is set where it is missing and never changed."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 3 == 0, F.create_map(F.lit("wall"), F.lit("old"))).otherwise(F.create_map(F.lit("text"), F.lit("x"))).alias("used"))
    absent = ~F.map_contains_key("used", "wall")
    used = F.when(absent, F.map_concat("used", F.create_map(F.lit("wall"), F.concat(F.lit("v"), "s_nationkey")))).otherwise(F.col("used"))
    return s.select("s_suppkey", used["wall"].alias("model"), absent.alias("is_new"))


@query("select c_custkey, action from customer join (values ('BUILDING', 'edit'), ('BUILDING', 'view'), ('MACHINERY', 'view'), ('AUTOMOBILE', 'view'), ('AUTOMOBILE', 'delete')) m(role, action) on role = c_mktsegment")
def role_permissions(spark, d):
    rights = [("BUILDING", "edit"), ("BUILDING", "view"), ("MACHINERY", "view"), ("AUTOMOBILE", "view"), ("AUTOMOBILE", "delete")]
    matrix = spark.createDataFrame(rights, "c_mktsegment string, action string")
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(F.broadcast(matrix), "c_mktsegment").select("c_custkey", "action")


@query("select o_orderkey, o_custkey, n from orders left join (select l_orderkey, l_suppkey % 20 as s, count(*) as n from lineitem where l_quantity > 40 group by all) l on l_orderkey = o_orderkey and s = o_custkey % 20")
def left_composite(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 20).alias("s")).agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 20).alias("s"))
    return o.join(li, ["o_orderkey", "s"], "left").select("o_orderkey", "o_custkey", "n")


@query("select s_suppkey, n_name, o_orderkey from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey left join orders on o_custkey = s_suppkey and o_orderstatus = 'P' where r_regionkey < 3")
def inner_inner_left(spark, d):
    s, n, r = table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "nation"), table(spark, d, "region").where("r_regionkey < 3")
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("s_suppkey"), "o_orderkey")
    j = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    return j.select("s_suppkey", "n_name").join(o, "s_suppkey", "left")


@query("select o_orderkey from orders where o_orderdate > (select max(l_shipdate) - interval 400 day from lineitem where l_linenumber = 1)")
def newer_than_current(spark, d):
    last = table(spark, d, "lineitem").where("l_linenumber = 1").agg(F.max("l_shipdate")).first()[0]  # one value, which prunes the scan
    return table(spark, d, "orders").where(F.col("o_orderdate") > F.lit(last).cast("timestamp_ntz") - F.expr("interval 400 days")).select("o_orderkey")


_POINTS = "p as (select vec_id, embedding[1]::double * 1000 as x, embedding[2]::double * 1000 as y from embeddings)"


@query(f"with {_POINTS}, r as (select i, j, i * 100 - 400 as x1, j * 100 - 400 as y1 from range(8) a(i), range(8) b(j) where (i + j) % 3 <> 0) select vec_id, cast(i * 8 + j as bigint) as room from p join r on x > x1 and x < x1 + 100 and y > y1 and y < y1 + 100 and y - y1 <= 100 - (x - x1) / 2")
def point_in_polygon(spark, d):
    """Points in rooms with one slanted side: rooms are dealt to the cells their bounds cover, then a ray is cast."""
    from ..operators.boxes import points_inside

    p = table(spark, d, "embeddings").select("vec_id", *[(F.col("embedding")[i].cast("double") * 1000).alias(c) for i, c in enumerate("xy")])
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    i, j = F.col("id") % 8, F.floor(F.col("id") / 8)
    x, y = i * 100 - 400, j * 100 - 400
    rooms = spark.range(64).where((i + j) % 3 != 0).select((i * 8 + j).alias("room"), F.array(at(x, y), at(x + 100, y), at(x + 100, y + 50), at(x, y + 100)).alias("outline"))
    return points_inside(p, rooms, "outline", 100.0).select("vec_id", "room")


@query(f"with {_POINTS}, a as (select * from p where vec_id % 2 = 0), b as (select * from p where vec_id % 2 = 1) select vec_id, near from (select a.vec_id, b.vec_id as near, row_number() over (partition by a.vec_id order by b.vec_id) as r from a join b on (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2500) where r = 1")
def endpoint_match(spark, d):
    """For each even point the first odd one within 50, by cells of 50."""
    from ..operators.spatial import pairs_within

    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[(F.col("embedding")[i].cast("double") * 1000).alias(c) for i, c in enumerate("xy")])
    pairs = pairs_within(p, 50.0).where("a % 2 <> b % 2")
    even = F.col("a") % 2 == 0
    ends = pairs.select(F.when(even, F.col("a")).otherwise(F.col("b")).alias("vec_id"), F.when(even, F.col("b")).otherwise(F.col("a")).alias("near"))
    return ends.groupBy("vec_id").agg(F.min("near").alias("near"))


@query("with s as (select l_orderkey as w, l_linenumber as n, l_partkey as k, l_suppkey as q, l_quantity as x, l_quantity + 4 as e from lineitem), o as (select *, max(e) over (partition by w order by x, n, k, q, e rows between unbounded preceding and 1 preceding) as before from s) select w, n, k, q, cast(greatest(x, before) as bigint) as start from o where before > x")
def interval_overlap(spark, d):
    """Openings of a wall that begin before an earlier one has ended, and where they may begin."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("w"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("q"), F.col("l_quantity").alias("x"), (F.col("l_quantity") + 4).alias("e"))
    out = keyed.running(li, ["w"], F.floor(F.col("x") / 10), [F.asc(c) for c in ("x", "n", "k", "q", "e")], F.col("e"), "max", "before")
    return out.where("before > x").select("w", "n", "k", "q", F.greatest("x", "before").cast("long").alias("start"))


@query("with t as (select o_custkey, count(*) as n, count(*) filter (where o_orderstatus = 'F') as done from orders group by all), s as (select o_custkey, n + case when o_custkey % 7 = 0 then 1 else 0 end as n, done from t where o_custkey % 11 <> 0) select coalesce(s.o_custkey, t.o_custkey) as o_custkey, s.n as stored, t.n as counted, s.n is distinct from t.n or s.done is distinct from t.done as is_wrong from s full join t on s.o_custkey = t.o_custkey where s.n is distinct from t.n or s.done is distinct from t.done")
def reconcile_counts(spark, d):
    """Stored counts against those of the rows: what differs, lacks or is too much."""
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    stored = t.where("o_custkey % 11 <> 0").select("o_custkey", (F.col("n") + F.when(F.col("o_custkey") % 7 == 0, 1).otherwise(0)).alias("stored"), F.col("done").alias("stored_done"))
    both = stored.join(t, "o_custkey", "full")
    wrong = ~(F.col("stored").eqNullSafe(F.col("n")) & F.col("stored_done").eqNullSafe(F.col("done")))
    return both.where(wrong).select("o_custkey", "stored", F.col("n").alias("counted"), wrong.alias("is_wrong"))


@query("select l_partkey, count(*) as n, min(l_orderkey * 10 + l_linenumber) as first_seen from lineitem group by l_partkey having count(*) > 25")
def first_seen_frequency(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_seen")).where("n > 25")


@query("select reason, count(*) as n from (select case when length(text) = 0 then 'empty' when length(text) < 200 then 'short' when l.doc_id is null then 'no_label' when toxic = 1 then 'toxic' when quality = 0 then 'low_quality' else 'kept' end as reason from documents d left join labels l on l.doc_id = d.doc_id) group by reason")
def skip_reason_counts(spark, d):
    from .documents import candidate_cascade

    return candidate_cascade(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@query("select o_custkey, o_orderkey as largest, o_orderpriority from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r = 1")
def largest_row(spark, d):
    """The row of the largest size of each key, the first of several."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    return keyed.first_rows(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 1).select("o_custkey", F.col("o_orderkey").alias("largest"), "o_orderpriority")


@query(f"with {_POINTS} select label, cast(floor(min(x)) as bigint) as x1, cast(floor(min(y)) as bigint) as y1, cast(ceil(max(x)) as bigint) as x2, cast(ceil(max(y)) as bigint) as y2 from p join embeddings using (vec_id) group by label")
def outer_boxes(spark, d):
    e = table(spark, d, "embeddings").select("label", *[(F.col("embedding")[i].cast("double") * 1000).alias(c) for i, c in enumerate("xy")])
    return e.groupBy("label").agg(*[f(g(c)).cast("long").alias(f"{c}{n}") for c in "xy" for f, g, n in ((F.floor, F.min, 1), (F.ceil, F.max, 2))])


_EDGE = "select label, sqrt(power(embedding[1]::double, 2) + power(embedding[2]::double, 2)) as w, (degrees(atan2(embedding[2]::double, embedding[1]::double)) + 360) % 90 as a from embeddings"


@query(f"""with e as (select label, cast(floor(a * 10) as bigint) as b, w from ({_EDGE})), h as (select label, b, sum(w) as w from e group by all), t as (select label, sum(w) as w from h group by label),
 g as (select t.label, r.range as b, coalesce(h.w, 0) as w from t cross join range(1800) r left join h on h.label = t.label and h.b = r.range % 900), p as (select label, b, sum(w) over (partition by label order by b) as upto from g),
 a as (select x.label, x.b - 80 as first, x.upto - coalesce(y.upto, 0) as near from p x left join p y on y.label = x.label and y.b = x.b - 81 where x.b between 80 and 979),
 o as (select x.label, x.b - 80 - s.range as first, s.range as gap, x.upto - coalesce(y.upto, 0) as near from p x cross join range(81) s left join p y on y.label = x.label and y.b = x.b - 81 - s.range where x.b between 80 + s.range and 979 + s.range),
 best as (select label, max(near) as near from o group by label union all select x.label, max(x.near + y.near) from a x join a y on x.label = y.label and (y.first - x.first + 900) % 900 between 81 and 819 group by x.label)
 select best.label, cast(floor(max(near) / any_value(t.w) * 1000 + 1e-6) as bigint) as share from best join t using (label) group by best.label""")
def axis_share(spark, d):
    """The largest share of length within 4 degrees of one of two directions or their right angles: lengths summed in tenths of a degree first."""
    e = table(spark, d, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xy")])
    e = e.select("label", F.hypot("x", "y").alias("w"), F.floor((F.degrees(F.atan2("y", "x")) + 360) % 90 * 10).alias("b"))
    return stats.axis_shares(e.groupBy("label", "b").agg(F.sum("w").alias("w")), ["label"], "b", "w").select("label", F.floor(F.col("share") * 1000 + 1e-6).alias("share"))


@query("with e as (select *, case event_type when 'click' then 0 else 1 end as k from events), s as (select event_type, count(*) as n, cast(round(sum(cast(round(value * 100) as bigint))) as bigint) as total from events group by event_type), r as (select event_type, n, total, dense_rank() over (order by event_type) as place from s) select case when place <= 3 then event_type else 'other' end as series, cast(sum(n) as bigint) as n, cast(sum(total) as bigint) as total, cast(sum(b10) as bigint) as b10, cast(sum(b100) as bigint) as b100, cast(sum(n) as bigint) as b_inf from r join (select event_type, count(*) filter (where value <= 10) as b10, count(*) filter (where value <= 100) as b100 from events group by event_type) b using (event_type) group by all")
def histogram_series(spark, d):
    """Buckets up to +Inf with sum and count; series beyond the first three by name fall into one."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(cents("value")).alias("total"), *[F.count_if(F.col("value") <= b).alias(f"b{b}") for b in (10, 100)])
    known = [r[0] for r in e.select("event_type").orderBy("event_type").limit(3).collect()]
    return e.groupBy(F.when(F.col("event_type").isin(known), F.col("event_type")).otherwise("other").alias("series")).agg(*[F.sum(c).alias(c) for c in ("n", "total", "b10", "b100")], F.sum("n").alias("b_inf"))


@query("select 'events_total{type=\"' || event_type || '\"} ' || count(*) as line from events group by event_type")
def metrics_text(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return e.select(F.format_string('events_total{type="%s"} %d', "event_type", "n").alias("line"))


@query("select o_orderkey, s from (select o_orderkey, case when o_orderkey % 4 = 0 then null else o_totalprice end as s from orders) order by s desc nulls last, o_orderkey limit 100")
def nulls_last_page(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("s"))
    return o.orderBy(F.desc_nulls_last("s"), "o_orderkey").limit(100)


@query("select l_orderkey, l_partkey, l_linenumber, l_suppkey from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_partkey, l_linenumber, l_quantity, l_tax) as r from lineitem where l_discount >= 0.03) where r <= 20")
def capped_detections(spark, d):
    li = table(spark, d, "lineitem").where("l_discount >= 0.03").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax")
    order = [F.desc("l_extendedprice"), *[F.asc(c) for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax")]]
    return keyed.first_rows(li, ["l_suppkey"], order, 20).select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")


@query(f"select o_orderkey, case when o_orderstatus = 'O' and o_orderdate < timestamp '{CUTOFF}' then 'failed' when o_orderstatus = 'P' and o_totalprice > 100000 then 'F' else o_orderstatus end as state from orders")
def state_transitions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", F.col("o_orderstatus").alias("state"))
    return mutations.moved(o, "state", [("O", F.col("o_orderdate") < NTZ(CUTOFF), "failed"), ("P", F.col("o_totalprice") > 100000, "F")]).select("o_orderkey", "state")


@query("select p_partkey, p_size + case when p_partkey % 3 = 0 and p_partkey % 2 = 0 then 1 else 0 end as revision, case when p_partkey % 3 = 0 and p_partkey % 2 = 0 then 'new' else p_brand end as p_brand, case when p_partkey % 3 = 0 then p_partkey % 2 <> 0 end as is_stale from part")
def optimistic_update(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("revision"), "p_brand")
    asked = p.where("p_partkey % 3 = 0").select("p_partkey", (F.col("revision") + F.col("p_partkey") % 2).alias("revision"), F.lit("new").alias("p_brand"))
    return mutations.revised(p, asked, "p_partkey", "revision")


@query("select o_orderkey, case when gone is null and o_orderstatus = 'P' then timestamp '1999-01-01' when o_orderkey % 2 = 0 and gone + interval 30 day > timestamp '1999-01-01' then null else gone end as deleted_at, coalesce(case when gone is null and o_orderstatus = 'P' then timestamp '1999-01-01' when o_orderkey % 2 = 0 and gone + interval 30 day > timestamp '1999-01-01' then null else gone end + interval 30 day <= timestamp '1999-01-01', false) as is_gone from (select *, case when o_orderstatus = 'F' then o_orderdate end as gone from orders)")
def soft_delete(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"))
    out = mutations.soft_deleted(o, "deleted_at", F.col("o_orderstatus") == "P", F.col("o_orderkey") % 2 == 0, NTZ(CUTOFF), "30 days")
    return out.select("o_orderkey", "deleted_at", "is_gone")


@query("select event_id, event_type from events where not (ts < timestamp '2024-01-10' and event_type in (select event_type from events where value > 400))")
def delete_expired(spark, d):
    """One rewrite without the rows that a deletion in batches would take."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    gone = e.where(F.col("ts") < NTZ("2024-01-10 00:00:00")).join(e.where("value > 400").select("event_type").distinct(), "event_type", "left_semi")
    return e.join(gone.select("event_id"), "event_id", "left_anti").select("event_id", "event_type")


@query("select e.event_id, count(*) as recent, count(*) > 2 as is_locked from events e join events b on b.user_id = e.user_id and b.event_type = 'click' and b.ts <= e.ts and epoch(date_trunc('second', b.ts)) >= epoch(date_trunc('second', e.ts)) - 864000 where e.event_type = 'click' group by e.event_id")
def login_locks(spark, d):
    e = table(spark, d, "events").where("event_type = 'click' and user_id is not null and ts is not null").select("event_id", "user_id", "ts")
    return mutations.locked(e, ["user_id"], 2, "864000").select("event_id", "recent", "is_locked")


@query("select user_id, max(ts) as last, max(ts) < timestamp '2024-01-28' as is_expired from events group by user_id")
def expired_streams(spark, d):
    """Streams without anything since a time are dropped whole."""
    last = F.max("ts")
    return table(spark, d, "events").groupBy("user_id").agg(last.alias("last"), (last < NTZ("2024-01-28 00:00:00")).alias("is_expired"))


@query(f"select o_orderkey, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'O') as pending, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate > o_orderdate + interval 60 day) as after_review from orders where o_orderstatus <> 'P'")
def pending_flags(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderdate")
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_linestatus") == "O").alias("open"), F.max("l_shipdate").alias("last"))
    none = F.lit(False)
    return o.join(li, "o_orderkey", "left").select("o_orderkey", F.coalesce("open", none).alias("pending"), F.coalesce(F.col("last") > F.col("o_orderdate") + F.expr("interval 60 days"), none).alias("after_review"))


@query("select event_id, event_type, case event_type when 'click' then 'iou' when 'view' then 'map50' else 'cer' end as measure, case when event_id % 3 = 0 then 'iou' when event_id % 3 = 1 then 'map50' else 'cer' end = case event_type when 'click' then 'iou' when 'view' then 'map50' else 'cer' end as of_family from events")
def family_points(spark, d):
    """Points carry the one measure of their family; others are dropped."""
    n = F.col("event_id") % 3
    sent = F.when(n == 0, "iou").when(n == 1, "map50").otherwise("cer")
    own = F.coalesce(F.create_map(*[F.lit(x) for x in ("click", "iou", "view", "map50")])[F.col("event_type")], F.lit("cer"))
    return table(spark, d, "events").select("event_id", "event_type", own.alias("measure"), (sent == own).alias("of_family"))


@query("with r as (select event_id, user_id, try_cast(json_extract_string(line, '$.k') as bigint) as k, line like 'oops%' as broken from (select event_id, user_id, case when event_id % 9 = 0 then 'oops' || props else props end as line from events)) select user_id, event_id, case when event_id % 9 = 0 then 'malformed' when row_number() over (partition by user_id, event_id % 9 = 0 order by event_id) > 1 then 'repeated' end as reason from r")
def profile_lines(spark, d):
    """JSON lines: broken ones are skipped with a reason, and of each id the first whole one counts."""
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("oops"), "props")).otherwise(F.col("props")).alias("line"))
    e = e.withColumn("broken", F.col("line").isNull() | F.expr("try_parse_json(line) is null"))
    first = e.where("not broken").groupBy("user_id").agg(F.min("event_id").alias("first"))
    reason = F.when(F.col("broken"), "malformed").when(F.col("event_id") != F.col("first"), "repeated")
    return e.join(first, "user_id", "left").select("user_id", "event_id", reason.alias("reason"))


@query("select o_custkey, bool_or(o_orderstatus = 'P') as provisional, max(case when o_orderstatus = 'F' then o_totalprice > 200000 end) as any_large from orders group by o_custkey having count(*) filter (where o_orderstatus = 'F') > 0")
def override_filter(spark, d):
    """Entries of a map whose keys are in the catalogue; the rest is dropped, and rows left without any."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("p"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 200000)).alias("f"))
    given = o.select("o_custkey", F.create_map(F.lit("provisional"), F.col("p"), F.lit("any_large"), F.col("f"), F.lit("unknown_rule"), F.lit(True)).alias("rules"))
    known = given.select("o_custkey", F.map_filter("rules", lambda k, v: k.isin("provisional", "any_large")).alias("rules"))
    return known.where("rules['any_large'] is not null").select("o_custkey", F.col("rules")["provisional"].alias("provisional"), F.col("rules")["any_large"].alias("any_large"))


@query(f"""with o as (select o_orderkey, case o_orderstatus when 'P' then 'pending' when 'O' then 'running' else 'completed' end as status, o_orderkey % 5 as attempts, case when o_orderkey % 7 > 0 then o_orderdate end as requested_at, o_orderdate as created_at from orders),
 due as (select o_orderkey from o where status in ('pending', 'running') and (requested_at is null or requested_at < timestamp '{CUTOFF}' - to_seconds(cast(5184000 * power(2, greatest(attempts - 1, 0)) as bigint))) order by created_at, o_orderkey limit 200)
 select o_orderkey, case when d.o_orderkey is not null and attempts >= 3 then 'failed' else status end as status, cast(case when d.o_orderkey is not null and attempts < 3 then attempts + 1 else attempts end as bigint) as attempts,
  cast(case when d.o_orderkey is not null and attempts < 3 then timestamp '{CUTOFF}' else requested_at end as timestamp) as requested_at, case when d.o_orderkey is not null and attempts >= 3 then 'RETRY_EXHAUSTED' end as error from o left join due d using (o_orderkey)""")
def evaluation_requeue(spark, d):
    """Jobs after a sweep that sends the 200 oldest overdue ones again or gives them up."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"), (k % 5).cast("long").alias("attempts"), F.when(k % 7 > 0, F.col("o_orderdate")).alias("requested_at"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("string").alias("error"))
    return mutations.requeued(o, "o_orderkey", NTZ(CUTOFF), 5184000, 3, 200).drop("created_at")


_SAMPLES = """with s as (select 'd' || d.doc_id as sample, ('0x' || substr(sha256(source), 1, 16))::ubigint % 100 as b, d.text, d.lang, l.quality from documents d left join labels l on l.doc_id = d.doc_id where source <> ''),
 f as (select case when b < 80 then 'train' when b < 90 then 'validation' else 'test' end as split, sample, unnest([{'name': 'image.png', 'data': text}, {'name': 'objects.json', 'data': '{"quality":' || quality || '}'}, {'name': 'meta.json', 'data': '{"lang":"' || lang || '"}'}]) as x from s),
 files as (select split, sample, split || '/' || sample || '/' || x.name as path, sha256(x.data) as sha256, octet_length(encode(x.data)) as bytes from f where x.data is not null)"""


def _samples(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    said = lambda name, v: F.concat(F.lit(f'{{"{name}":'), v, F.lit("}"))
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("sample"), F.col("source").alias("group"), F.col("text").alias("image_png"), F.lit(None).cast("binary").alias("walls_png"), said("quality", F.col("quality")).alias("objects_json"), said("lang", F.concat(F.lit('"'), "lang", F.lit('"'))).alias("meta_json"))
    return samples.files(named)


@query(f"{_SAMPLES} select path, sha256, bytes from files")
def sample_files(spark, d):
    """The manifest of documents as samples: their text, their label where they have one, and what they are."""
    return _samples(spark, d).select("path", "sha256", "bytes")


@query(f"{_SAMPLES} select t.split, count(distinct sample) as n_samples, count(path) as n_files, cast(coalesce(sum(bytes), 0) as bigint) as bytes from (values ('train'), ('validation'), ('test')) t(split) left join files using (split) group by t.split")
def sample_counts(spark, d):
    """Samples, files and bytes of each split."""
    return samples.counts(_samples(spark, d))
