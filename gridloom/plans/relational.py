"""Relational queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keyed
from ..sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


CUTOFF = "1999-01-01 00:00:00"
NTZ = lambda s: F.lit(s).cast("timestamp_ntz")


@query("select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1")
def latest_per_key(spark, d):
    return keyed.latest(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("select c.c_custkey, l.o_orderkey, l.o_orderdate from customer c left join lateral (select o_orderkey, o_orderdate from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'P' and o.o_totalprice > 300000 order by o_orderdate desc nulls last, o_orderkey desc limit 1) l on true")
def latest_lateral(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P' and o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey")
    return table(spark, d, "customer").select("c_custkey").join(keyed.latest(o, ["c_custkey"], ["o_orderdate", "o_orderkey"]), "c_custkey", "left").select("c_custkey", "o_orderkey", "o_orderdate")


@query("select c_custkey, (select o_orderkey from orders where o_custkey = c_custkey order by o_orderdate desc, o_orderkey desc limit 1) as latest_order from customer")
def latest_scalar(spark, d):
    newest = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_order"))
    return table(spark, d, "customer").select("c_custkey").join(newest, "c_custkey", "left")


@query("select o_orderkey, o_orderdate from (select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 50) order by o_orderdate, o_orderkey")
def newest_n_ascending(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).orderBy("o_orderdate", "o_orderkey")


ROLLUP = """select o_custkey, count(*) as n_orders, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as total_cents, cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as n_final,
  bool_or(o_orderstatus = 'F') as any_final, bool_or(o_orderstatus = 'O') as any_open, bool_or(o_orderstatus = 'P') as any_pending, bool_or(o_orderpriority = '1-URGENT') as any_urgent,
  (array_agg(o_orderkey order by (o_orderstatus = 'F')::int, o_orderdate, o_orderkey))[1] as first_order from orders group by o_custkey"""


@query(ROLLUP)
def project_rollup(spark, d):
    is_ = lambda s: F.col("o_orderstatus") == s
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"), F.sum(cents("o_totalprice")).alias("total_cents"), F.sum(is_("F").cast("long")).alias("n_final"),
        F.bool_or(is_("F")).alias("any_final"), F.bool_or(is_("O")).alias("any_open"), F.bool_or(is_("P")).alias("any_pending"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"),
        F.min_by("o_orderkey", F.struct(is_("F").cast("int").alias("f"), "o_orderdate", "o_orderkey")).alias("first_order"),
    )


@query(f"select c_custkey, coalesce(n_orders, 0) as n_orders, case when n_orders is null then 'empty' when any_pending then 'processing' when any_open then 'review' when any_final then 'done' else 'draft' end as status from customer left join ({ROLLUP}) r on o_custkey = c_custkey")
def rollup_status(spark, d):
    r = project_rollup(spark, d).withColumnRenamed("o_custkey", "c_custkey")
    status = F.when(F.col("n_orders").isNull(), "empty").when(F.col("any_pending"), "processing").when(F.col("any_open"), "review").when(F.col("any_final"), "done").otherwise("draft")
    return table(spark, d, "customer").select("c_custkey").join(r, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), status.alias("status"))


@query("select c_custkey, coalesce(n, 0) as n from customer left join (select o_custkey, count(*) as n from orders where o_orderstatus = 'P' group by o_custkey) on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
def requested_ids_zero_fill(spark, d):
    wanted = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    n = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return keyed.zero_filled(wanted, n, "c_custkey", ["n"])


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r > 10")
def count_having_rank_overflow(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return keyed.overflow(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 10, ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("select event_id from events e where ts < timestamp '2024-01-20' and exists (select 1 from events n where n.user_id = e.user_id and n.event_type = e.event_type and (n.ts > e.ts or (n.ts = e.ts and n.event_id > e.event_id)))")
def log_compaction(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return keyed.compacted(e, ["user_id", "event_type"], ["ts", "event_id"], F.col("ts") < NTZ("2024-01-20 00:00:00")).select("event_id")


LARGE = "o_totalprice > 400000 and o_orderstatus = 'F'"


@query(f"select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and {LARGE})")
def semi_visible(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").join(table(spark, d, "orders").where(LARGE), F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query(f"select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and {LARGE})")
def anti_invisible(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").join(table(spark, d, "orders").where(LARGE), F.col("o_custkey") == F.col("c_custkey"), "left_anti")


@query("select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity >= 49)")
def anti_orphans(spark, d):
    return table(spark, d, "part").select("p_partkey").join(table(spark, d, "lineitem").where("l_quantity >= 49"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")


@query("select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'P'")
def on_clause_left_join(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")


SWEEP = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"


@query(f"select {SWEEP}, c_name, n_name from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where l_shipdate < timestamp '{CUTOFF}' order by {SWEEP} limit 200")
def four_way_join_sweep(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") < NTZ(CUTOFF)).select(*SWEEP.split(", "))
    j = li.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    j = j.join(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.select(*SWEEP.split(", "), "c_name", "n_name").orderBy(*SWEEP.split(", ")).limit(200)


@query(f"select o_orderkey, o_orderdate from orders where (o_orderdate, o_orderkey) < (timestamp '{CUTOFF}', 5000) order by o_orderdate desc, o_orderkey desc limit 51")
def keyset_page(spark, d):
    cursor = {"o_orderdate": NTZ(CUTOFF), "o_orderkey": F.lit(5000)}
    return keyed.page_after(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [("o_orderdate", "desc"), ("o_orderkey", "desc")], cursor, 50)


@query("select l_orderkey, l_partkey, l_linenumber, l_quantity from lineitem where l_orderkey <= (select max(l_orderkey) from (select l_orderkey from lineitem order by l_orderkey limit 500))")
def complete_last_group(spark, d):
    return keyed.complete_last(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity"), "l_orderkey", 500)


@query("select l_orderkey, count(*) as n from lineitem group by l_orderkey having bool_or(l_linestatus = 'O') and bool_or(l_linestatus = 'F')")
def hold_incomplete_group(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.bool_or(F.col("l_linestatus") == "O").alias("o"), F.bool_or(F.col("l_linestatus") == "F").alias("f"))
    return g.where("o and f").select("l_orderkey", "n")


@query("select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as ahead from orders where o_orderstatus = 'O'")
def queue_ahead(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate").withColumn("queue", F.lit(1))
    return keyed.numbered(o, ["queue"], F.to_date("o_orderdate"), [F.asc("o_orderdate"), F.asc("o_orderkey")], "ahead").select("o_orderkey", "ahead")


@query("select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as seq from events")
def max_plus_one_seq(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return keyed.numbered(e, ["user_id"], F.to_date("ts"), [F.asc("ts"), F.asc("event_id")], "before").select("event_id", "user_id", (F.col("before") + 1).alias("seq"))


@query(f"select o_orderkey, n from (select o_orderkey, o_orderdate, count(*) as n, max(l_shipdate) as last from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'O' group by all) where greatest(o_orderdate, last) + to_hours(24 * cast(power(2, n) as bigint)) < timestamp '{CUTOFF}'")
def backoff_due(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last"))
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate").join(n, "o_orderkey")
    due = F.greatest("o_orderdate", "last") + F.make_dt_interval(F.lit(0), (24 * F.pow(F.lit(2), F.col("n"))).cast("int"))
    return o.where(due < NTZ(CUTOFF)).select("o_orderkey", "n")


@query("select o_custkey, o_orderkey, case when row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) <= 3 then o_orderpriority end as o_orderpriority from orders")
def version_retention(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    return keyed.retained(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, ["o_orderkey"], ["o_orderpriority"]).drop("o_orderdate")


@query("select p_name, length(p_name) as n_chars, count(*) as n from part group by all order by n_chars, p_name")
def natural_id_order(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).select("p_name", F.char_length("p_name").cast("long").alias("n_chars"), "n").orderBy("n_chars", "p_name")


@query("select label, count(*) as n_rows, cast(sum(len(embedding)) as bigint) as n_values from embeddings group by label")
def nested_size_sum(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("n_values"))


@query("select vec_id, cast(unnest(range(len(embedding))) as int) as pos, unnest(embedding) as value from embeddings")
def unnest_ordinality(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value"))


@query("select p_partkey, p_brand, p_retailprice from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as r from part where p_size <= 20) where r = 1 order by p_retailprice desc, p_partkey limit 10")
def ranked_candidates(spark, d):
    p = table(spark, d, "part").where("p_size <= 20").select("p_partkey", "p_brand", "p_retailprice")
    return keyed.first_rows(p, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 1).drop("rank").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)
