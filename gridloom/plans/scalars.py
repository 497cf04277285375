"""Scalar rules over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, text, unicode, values
from ..operators.spatial import parts_of
from ..sources.tables import table
from .relational import NTZ, cents

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LEVEL = "case when {0} then 'good' when {1} then 'attention' else 'poor' end"
_SHEETS = "s as (select p_partkey, p_size * 60 as edge, (p_size - 25) / 4.0 as skew, (p_size % 21) / 20.0 as contrast, (p_size % 11) / 20.0 as noise, case when p_size % 7 = 0 then null else p_size / 8.0 end as spread from part)"


@query(f"""with {_SHEETS}, l as (select p_partkey, {_LEVEL.format('edge >= 2000', 'edge >= 1200')} as resolution, {_LEVEL.format('abs(skew) <= 0.5', 'abs(skew) < 5')} as skew, {_LEVEL.format('contrast >= 0.75', 'contrast >= 0.45')} as contrast,
 {_LEVEL.format('noise <= 0.2', 'noise <= 0.4')} as noise, {_LEVEL.format('spread is null or spread <= 1.0', 'spread < 5.0')} as perspective from s)
 select *, case when 'poor' in (resolution, skew, contrast, noise, perspective) then 'poor' when 'attention' in (resolution, skew, contrast, noise, perspective) then 'attention' else 'good' end as worst from l""")
def quality_levels(spark, d):
    size = F.col("p_size")
    s = table(spark, d, "part").select("p_partkey", (size * 60).alias("edge"), ((size - 25) / 4).alias("skew"), (size % 21 / 20).alias("contrast"), (size % 11 / 20).alias("noise"), F.when(size % 7 != 0, size / 8).alias("spread"))
    of = {"resolution": values.resolution_level(F.col("edge")), "skew": values.skew_level(F.col("skew")), "contrast": values.contrast_level(F.col("contrast")), "noise": values.noise_level(F.col("noise")), "perspective": values.perspective_level(F.col("spread"))}
    s = s.select("p_partkey", *[v.alias(k) for k, v in of.items()])
    return s.withColumn("worst", values.worst_level(F.array(*of)))


@query("select p_partkey, case when p_retailprice / 6 < 1 then 'belowRange' when p_retailprice / 6 > 200 then 'aboveRange' else 'inRange' end as scale_range, cast(round(case when p_size > 5 then (p_retailprice / 30 - (p_size - 5)) / (p_size - 5) else 0 end * 10000) as bigint) as deviation, abs(case when p_size > 5 then (p_retailprice / 30 - (p_size - 5)) / (p_size - 5) else 0 end) > 0.15 as exceeds from part")
def scale_checks(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    off = values.scale_deviation(F.col("p_retailprice") / 30, F.col("p_size") - 5)
    return p.select("p_partkey", values.scale_range(F.col("p_retailprice") / 6).alias("scale_range"), F.round(off * 10000).cast("long").alias("deviation"), (F.abs(off) > values.SCALE_DEVIATION).alias("exceeds"))


@query("select l_orderkey, l_linenumber, cast(count(*) as bigint) as n, case min(l_linenumber) - 1 when 0 then 60 when 1 then 300 when 2 then 900 when 3 then 3600 end as wait, list_extract([0, 5, 35, 55, 70, 90, 100], least(min(l_linenumber), 6) + 1) as percent from lineitem group by l_orderkey, l_linenumber")
def backoff_and_progress(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    step = F.col("l_linenumber")
    return li.select("l_orderkey", "l_linenumber", "n", values.backoff_step(step - 1).alias("wait"), values.progress_percent(step).alias("percent"))


_FIT = "abs({0} - {1}) <= 0.15 * greatest({1}, 1.0)"


@query(f"""select p_partkey, ({_FIT.format('w', 't')} and {_FIT.format('h', 'u')}) or ({_FIT.format('w', 'u')} and {_FIT.format('h', 't')}) as fits,
 cast(round((case when list_contains(styles, 'TIN') then 10 else 0 end + case when styles[1] = 'TIN' then 1 else 0 end - coalesce(abs(light - 70.0) + abs(warm - 12.0), 100)) * 100) as bigint) as score from (select p_partkey, p_size * 10.0 as w, (p_partkey % 40) * 10.0 as h, 250.0 as t, 150.0 as u, string_split(p_type, ' ') as styles, case when p_size % 9 = 0 then null else p_size * 2.0 end as light, (p_partkey % 30) * 1.0 as warm from part)""")
def fit_scores(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    fits = values.fits_size(size * 10.0, key % 40 * 10.0, F.lit(250.0), F.lit(150.0))
    score = values.style_score(F.split("p_type", " "), F.lit("TIN"), F.when(size % 9 != 0, size * 2.0), key % 30 * 1.0, (70.0, 12.0))
    return table(spark, d, "part").select("p_partkey", fits.alias("fits"), F.round(score * 100).cast("long").alias("score"))


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as wire, date_trunc('hour', o_orderdate)::timestamp as hour, o_orderkey % 3 <> 0 as is_wire from orders""")
def wire_instants(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", text.instant(F.col("o_orderdate")).alias("wire"), F.date_trunc("hour", "o_orderdate").cast("timestamp_ntz").alias("hour"))
    given = F.when(F.col("o_orderkey") % 3 == 0, F.regexp_replace("wire", "T", " ")).otherwise(F.col("wire"))
    return o.withColumn("is_wire", text.parsed_instant(given).isNotNull())


@query("select event_id, regexp_full_match(id, 'up_[0-9A-HJKMNP-TV-Z]{26}') as is_upload, regexp_full_match(s, 'W-[0-9A-Z]{10,64}') as is_wall from (select event_id, case when event_id % 4 = 0 then 'dr_' else 'up_' end || upper(substr(sha256(event_type || event_id), 1, 26)) as id, 'W-' || case when event_id % 5 = 0 then lower(substr(sha256(event_type || event_id), 1, 12)) else upper(substr(sha256(event_type || event_id), 1, 6 + event_id % 9)) end as s from events)")
def id_checks(spark, d):
    e, n = table(spark, d, "events").select("event_id", F.sha2(F.concat("event_type", "event_id"), 256).alias("h")), F.col("event_id")
    whole = F.concat(F.when(n % 4 == 0, "dr_").otherwise("up_"), F.upper(F.substring("h", 1, 26)))
    spatial = F.concat(F.lit("W-"), F.when(n % 5 == 0, F.lower(F.substring("h", 1, 12))).otherwise(F.upper(F.substring(F.col("h"), F.lit(1), (6 + n % 9).cast("int")))))
    return e.select("event_id", values.has_id("up", whole).alias("is_upload"), values.has_spatial_id("W", spatial).alias("is_wall"))


@query("""select event_id, sha256('{"kind":"' || event_type || '","part":' || case when event_id % 6 = 0 then 'null' else (event_id % 6)::varchar end || ',"user":' || user_id || '}') as sha from events""")
def canonical_sha(spark, d):
    e = table(spark, d, "events")
    part = F.when(F.col("event_id") % 6 != 0, F.col("event_id") % 6)
    return e.select("event_id", text.canonical_sha(user=F.col("user_id"), part=part, kind=F.col("event_type")).alias("sha"))


@query("select doc_id, trim(regexp_replace(lower(replace(strip_accents(nfc_normalize(text)), 'ß', 'ss')), '\\s+', ' ', 'g')) as plain from documents")
def read_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", unicode.read_text(F.col("text")).alias("plain"))


@query("select c_custkey, lower(c_name) || case c_custkey % 3 when 0 then chr(233) || 'ss' when 1 then '' else chr(7885) end || '@example.com' as email from customer")
def email_keys(spark, d):
    """Addresses with accents as signs of their own, capitals, a letter that folds to two, and white space of several kinds around."""
    n = F.col("c_custkey") % 3
    mark = F.when(n == 0, "E\u0301ß").when(n == 1, "").otherwise("o\u0323")
    return table(spark, d, "customer").select("c_custkey", unicode.email_key(F.concat(F.lit(" \u3000"), "c_name", mark, F.lit("@Example.COM\t "))).alias("email"))


@query("select event_id, case event_id % 5 when 0 then '0007' when 1 then '202E' when 2 then '000A' end as code, case event_id % 5 when 0 then '0007' when 1 then '202E' end as code_with_lines from events")
def forbidden_chars(spark, d):
    n = F.col("event_id") % 5
    t = F.concat("event_type", F.when(n == 0, "\x07").when(n == 1, "‮").when(n == 2, "\n").otherwise("é"), F.lit(" end"))
    return table(spark, d, "events").select("event_id", unicode.forbidden(t).alias("code"), unicode.forbidden(t, "\n\t").alias("code_with_lines"))


@query("""select event_id, case event_id % 5 when 0 then 'GET /x?id=' || event_id || ' Bearer ***' when 1 then 'db://app:***@host/' || event_id when 2 then 'api_key=***, n=' || event_id when 3 then '{"password": "***", "n": ' || event_id || '}' else 'user ' || user_id || ' said hello' end as line from events""")
def masked_secrets(spark, d):
    n = F.col("event_id")
    line = F.when(n % 5 == 0, F.format_string("GET /x?id=%d Bearer %s", n, F.hex("user_id"))).when(n % 5 == 1, F.format_string("db://app:p%d@w@host/%d", "user_id", n)).when(n % 5 == 2, F.format_string("api_key=k%d, n=%d", "user_id", n))
    line = line.when(n % 5 == 3, F.format_string('{"password": "p%d", "n": %d}', "user_id", n)).otherwise(F.format_string("user %d said hello", "user_id"))
    return table(spark, d, "events").select("event_id", unicode.masked(line).alias("line"))


@query("select user_id, case user_id % 3 when 0 then '10.0.0.' || (user_id % 256) when 1 then '2001:db8:0:' || printf('%x', user_id % 4096 + 1) || '::/64' else 'host' || user_id end as bucket, count(*) as n from events group by all")
def ip_buckets(spark, d):
    u = F.col("user_id")
    host = F.when(u % 3 == 0, F.format_string("10.0.0.%d", u % 256)).when(u % 3 == 1, F.format_string("2001:db8:0:%x:0:0:0:%x", u % 4096 + 1, u % 7 + 1)).otherwise(F.format_string("host%d", u))
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return e.select("user_id", unicode.ip_bucket(host).alias("bucket"), "n")


@query("select p_brand, case when count(*) filter (where r = 1) = 1 then max(note) filter (where r = 1) end as note from (select p_brand, note, rank() over (partition by p_brand order by count(*) desc) as r from (select p_brand, cast((p_size % 6) * 50 as bigint) as note from part) where note between 10 and 2000 group by p_brand, note) group by p_brand")
def scale_note_vote(spark, d):
    p = table(spark, d, "part").select("p_brand", F.format_string("TL 1 : %d drawn", F.col("p_size") % 6 * 50).alias("said"))
    n = p.select("p_brand", F.explode(text.scale_notes(F.col("said"))).alias("note")).groupBy("p_brand", "note").agg(F.count("*").alias("n"))
    best = n.groupBy("p_brand").agg(F.max("n").alias("n"))
    top = n.join(best, ["p_brand", "n"])
    return top.groupBy("p_brand").agg(F.when(F.count("*") == 1, F.max("note")).alias("note"))


_SIDES = "select p_partkey, p_size * 10 as x1, p_partkey % 50 as y1, p_size * 10 + 5 + p_partkey % 9 as x2, p_partkey % 50 + 3 + p_size % 8 as y2 from part"


def _boxes(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", (s * 10).cast("long").alias("x1"), (k % 50).alias("y1"), (s * 10 + 5 + k % 9).alias("x2"), (k % 50 + 3 + s % 8).alias("y2"))


_W = "greatest(least(x2, 260) - greatest(x1, 240), 0) * greatest(least(y2, 30) - greatest(y1, 10), 0)"


@query(f"""select p_partkey, cast(round({_W} / ((x2 - x1) * (y2 - y1) + 400 - {_W})::double * 1000000) as bigint) as iou, cast(round({_W} / least((x2 - x1) * (y2 - y1), 400)::double * 1000000) as bigint) as iom,
 cast(round(sqrt(power(greatest(0, 240 - x2, x1 - 260), 2) + power(greatest(0, 10 - y2, y1 - 30), 2)) * 1000) as bigint) as gap, case p_partkey % 4 when 1 then x1 when 3 then x1 else cast(floor((x1 + x2 - case when p_partkey % 2 = 0 then y2 - y1 else x2 - x1 end) / 2.0) as bigint) end as wx1,
 case when p_partkey % 2 = 0 then cast(floor((y1 + y2 - (x2 - x1)) / 2.0) as bigint) else y1 end as wy1 from ({_SIDES})""")
def box_measures(spark, d):
    own, fixed = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}, {"x1": F.lit(240), "y1": F.lit(10), "x2": F.lit(260), "y2": F.lit(30)}
    turned = geometry.world_box(*own.values(), F.when(F.col("p_partkey") % 2 == 0, 90).otherwise(180))
    whole = lambda c, n: F.round(c * n).cast("long")
    return _boxes(spark, d).select("p_partkey", whole(geometry.box_iou(own, fixed), 1000000).alias("iou"), whole(geometry.box_iom(own, fixed), 1000000).alias("iom"), whole(geometry.box_gap(own, fixed), 1000).alias("gap"), turned["x1"].alias("wx1"), turned["y1"].alias("wy1"))


def _dealt(spark, d):
    """Keys and sizes of parts dealt to all tasks: a few bytes of a row make much work, and a small file would be one task's."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return p.repartition(parts_of(p))


_TRI = "select p_partkey, p_size as a, p_partkey % 37 as b, p_partkey % 11 + 1 as c from part"


@query(f"""select p_partkey, cast(4 * a * c as bigint) as doubled, cast(round(2 * a * c / 1e4) as bigint) as area_e4, cast(round((b + a) * 1000) as bigint) as cx, cast(round((c / 2.0 + b) * 1000) as bigint) as cy, b as x_min, 2 * a + b as x_max, (15 > b and 15 < 2 * a + b) and (15 > b and 15 < c + b) as has_15 from ({_TRI}) where true""")
def outlines(spark, d):
    """Rectangles of 2a by c at (b, b): area, centre of area, bounds and whether the point (15, 15) is inside."""
    a, b, c = F.col("p_size").cast("long"), F.col("p_partkey") % 37, F.col("p_partkey") % 11 + 1
    at = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    p = _dealt(spark, d).select("p_partkey", F.array(at(b, b), at(b + 2 * a, b), at(b + 2 * a, b + c), at(b, b + c)).alias("outline"))
    o, x = F.col("outline"), lambda c, n: F.round(c * n).cast("long")
    inside = geometry.contains(o, F.lit(15.0), F.lit(15.0)) & (geometry.bounds(o)["x1"] != 15) & (geometry.bounds(o)["y2"] != 15) & (geometry.bounds(o)["y1"] != 15)
    return p.select("p_partkey", geometry.exact_area(o).cast("long").alias("doubled"), x(F.abs(geometry.doubled_area(o)).cast("double") / 2, 1e-4).alias("area_e4"), x(geometry.centroid(o)["x"], 1000).alias("cx"), x(geometry.centroid(o)["y"], 1000).alias("cy"), geometry.bounds(o)["x1"].alias("x_min"), geometry.bounds(o)["x2"].alias("x_max"), inside.alias("has_15"))


@query("""with w as (select p_partkey, p_size * 1.0 as s, 100.0 + p_partkey % 200 as l from part), a as (select *, case when s = 0 then 0 else 4 * atan(2 * least(s, l / 2) / l) end as sweep from w)
 select p_partkey, cast(round(degrees(sweep) * 1000) as bigint) as sweep, case when s = 0 then 2 else 2 * greatest(1, cast(ceil(degrees(sweep) / 10) as bigint)) + 1 end as n_points, cast(round(l / 2 * 1000) as bigint) as apex_x, cast(round(-least(s, l / 2) * 1000) as bigint) as apex_y, cast(round(least(s, l / 2) * 1000) as bigint) as back from a""")
def arcs(spark, d):
    """Arcs over a chord on the x axis: sweep, number of points, the point in the middle, and the sagitta through it."""
    s, l = F.col("p_size") * 1.0, 100.0 + F.col("p_partkey") % 200
    o = F.lit(0.0)
    p = _dealt(spark, d).select("p_partkey", "p_size", l.alias("l"), geometry.arc_points(o, o, l, o, s).alias("points"))
    mid = F.col("points")[F.expr("size(points) div 2")]
    whole = lambda c: F.round(c * 1000).cast("long")
    return p.select("p_partkey", whole(F.degrees(geometry.arc_sweep(o, o, F.col("l"), o, s))).alias("sweep"), F.size("points").cast("long").alias("n_points"), whole(mid["x"]).alias("apex_x"), whole(mid["y"]).alias("apex_y"), whole(geometry.sagitta_through(o, o, mid["x"], mid["y"], F.col("l"), o)).alias("back"))


@query("select p_partkey, list_extract(list_sort(list_transform([100, 150, 200, 220, 300, 400], lambda t: [abs(p_size * 8 - t), t])), 1)[2] as thickness, cast(round(case when p_size < 10 then sqrt(power(10 - p_size, 2) + power(p_partkey % 20, 2)) when p_size > 30 then sqrt(power(p_size - 30, 2) + power(p_partkey % 20, 2)) else p_partkey % 20 end * 1000) as bigint) as distance from part")
def walls_near(spark, d):
    """The usual thickness nearest to a measured one, and the distance from the segment (10, 0) to (30, 0)."""
    far = geometry.foot_distance(F.col("p_size") * 1.0, F.col("p_partkey") % 20 * 1.0, F.lit(10.0), F.lit(0.0), F.lit(30.0), F.lit(0.0))
    return table(spark, d, "part").select("p_partkey", geometry.usual_thickness(F.col("p_size") * 8).alias("thickness"), F.round(far * 1000).cast("long").alias("distance"))


_PX = "a as (select vec_id, label, embedding[1]::double * 300 as x1, embedding[2]::double * 300 as y1, embedding[3]::double * 300 as x2, embedding[4]::double * 300 as y2 from embeddings)"


@query(f"""with {_PX}, p as (select a.vec_id as a, b.vec_id as b, a.x2 - a.x1 as rx, a.y2 - a.y1 as ry, b.x2 - b.x1 as sx, b.y2 - b.y1 as sy, b.x1 - a.x1 as dx, b.y1 - a.y1 as dy, a.x1 as x, a.y1 as y from a join a b on a.label = b.label and a.vec_id < b.vec_id),
 q as (select *, (dx * sy - dy * sx) / (rx * sy - ry * sx) as t, (dx * ry - dy * rx) / (rx * sy - ry * sx) as u, 3 / greatest(sqrt(rx * rx + ry * ry), 1e-9) as et, 3 / greatest(sqrt(sx * sx + sy * sy), 1e-9) as eu from p where abs(rx * sy - ry * sx) >= 1e-9)
 select a, b, cast(round((x + t * rx) * 100) as bigint) as px, cast(round((y + t * ry) * 100) as bigint) as py from q where t between -et and 1 + et and u between -eu and 1 + eu""")
def segment_crossings(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", *[(F.col("embedding")[i].cast("double") * 300).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])
    from ..operators.boxes import segments_meeting

    met = segments_meeting(e.withColumnRenamed("vec_id", "id"), ["label"], 10.0)
    return met.select("a", "b", F.round(F.col("at.x") * 100).cast("long").alias("px"), F.round(F.col("at.y") * 100).cast("long").alias("py"))


@query("with t as (select event_id, value as v, case when event_id % 3 = 0 then null else ts end as a, case when event_id % 4 = 0 then null else ts + interval 1 hour end as b from events) select event_id, greatest(a, b) as later, coalesce(b, a, timestamp '2000-01-01') as first_known from t")
def greatest_with_nulls(spark, d):
    n = F.col("event_id")
    e = table(spark, d, "events").select("event_id", F.when(n % 3 != 0, F.col("ts")).alias("a"), F.when(n % 4 != 0, F.col("ts") + F.expr("interval 1 hour")).alias("b"))
    return e.select("event_id", F.greatest("a", "b").alias("later"), F.coalesce("b", "a", NTZ("2000-01-01 00:00:00")).alias("first_known"))


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, cast(v as bigint) as value_mm, case when l_quantity >= 25 then 'horizontal' else 'vertical' end as orientation from (select *, cast(round(l_extendedprice) as bigint) as v from lineitem where l_tax < 0.05) where v between 300 and 30000")
def dimension_strings(spark, d):
    """Texts of digits, points, commas and blanks alone, read as whole millimetres within 300 to 30000."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", F.when(F.col("l_tax") < 0.05, F.regexp_replace(F.format_number(F.round("l_extendedprice").cast("long"), 0), ",", ". ")).otherwise(F.concat(F.col("l_extendedprice").cast("string"), F.lit(" m"))).alias("said"))
    digits = F.regexp_replace("said", r"[.,\s]", "")
    found = li.where(digits.rlike("^[0-9]{1,9}$")).withColumn("value_mm", digits.cast("long")).where("value_mm between 300 and 30000")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "value_mm", F.when(F.col("l_quantity") >= 25, "horizontal").otherwise("vertical").alias("orientation"))


@query("select p_partkey, cast(count(*) as bigint) as n_windows, max(x) as last_x, max(y) as last_y, cast(sum(x) as bigint) as sum_x from (select distinct p_partkey, greatest(least(i * 70, w - 100), 0) as x, greatest(least(j * 70, h - 100), 0) as y from (select p_partkey, p_size * 12 as w, 150 + p_partkey % 90 as h from part), range(12) a(i), range(5) b(j) where i <= greatest(cast(ceil((w - 100) / 70.0) as bigint), 0) and j <= greatest(cast(ceil((h - 100) / 70.0) as bigint), 0)) group by p_partkey")
def tile_windows(spark, d):
    p = table(spark, d, "part").select("p_partkey", geometry.tile_windows(F.col("p_size").cast("long") * 12, 150 + F.col("p_partkey") % 90, 100, 30).alias("w"))
    p = p.select("p_partkey", F.inline("w"))
    return p.groupBy("p_partkey").agg(F.count("*").alias("n_windows"), F.max("x").alias("last_x"), F.max("y").alias("last_y"), F.sum("x").alias("sum_x"))


@query("with m as (select label, list_transform(embedding, lambda v: v > 0) as a, list_transform(embedding, lambda v: v > 0.05) as b from embeddings) select label, case when sum(o) = 0 then 1000000 else cast(round(sum(t) / sum(o) * 1000000) as bigint) end as iou from (select label, len(list_filter(list_zip(a, b), lambda z: z[1] and z[2])) as t, len(list_filter(list_zip(a, b), lambda z: z[1] or z[2])) as o from m) group by label")
def mask_iou(spark, d):
    from ..operators.stats import share

    cell = lambda least: F.transform("embedding", lambda v: v > least)
    e = table(spark, d, "embeddings").select("label", geometry.mask_overlap(cell(F.lit(0)), cell(F.lit(0.05).cast("double"))).alias("m"))
    return e.groupBy("label").agg(F.round(share(F.col("m.both"), F.col("m.either")) * 1000000).cast("long").alias("iou"))


@query("with s as (select vec_id, list_transform(range(8), lambda i: list_slice(embedding, i * 8 + 1, i * 8 + 8)) as rows from embeddings), b as (select vec_id, list_transform(rows, lambda r: list_position(r, list_max(r)) - 1) as best from s) select vec_id, array_to_string(list_transform(range(1, 9), lambda i: case when best[i] = 0 or (i > 1 and best[i] = best[i - 1]) then '' else substr('abcdefg', best[i]::int, 1) end), '') as said from b")
def ctc_texts(spark, d):
    from ..operators.detection import decoded

    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    return table(spark, d, "embeddings").select("vec_id", decoded(rows, "abcdefg").alias("said"))


@query("select p_partkey, case when p_size % 4 = 0 then 'unknown' when p_size % 4 = 1 then 'exterior' else 'interior' end as side from part")
def wall_sides(spark, d):
    """Walls along x = 0 to 1000 with rooms above (p_size mod 4 in 1 to 3) and below (2 and 3), asked by two probes each."""
    n = F.col("p_size") % 4
    o, w = F.lit(0.0), F.lit(1000.0)
    probes = geometry.wall_probes(o, o, w, o, F.lit(200.0), o)
    room = lambda y1, y2: F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in ((0, y1), (1000, y1), (1000, y2), (0, y2))])
    up, down = room(0, 3000), room(-3000, 0)
    held = F.aggregate(probes, F.lit(0), lambda k, p: k + (((n >= 1) & geometry.contains(up, p["x"], p["y"])) | ((n >= 2) & geometry.contains(down, p["x"], p["y"]))).cast("int"))
    return table(spark, d, "part").select("p_partkey", geometry.wall_side(held).alias("side"))


@query("select item_id, cast(octet_length(encode(text)) as bigint) as n_bytes, case when octet_length(encode(text)) <= 600 then sha256(text) end as sha from benchmark")
def capped_read(spark, d):
    """The bytes of what is not larger than a cap; size alone of the rest."""
    n = F.octet_length("text").cast("long")
    return table(spark, d, "benchmark").select("item_id", n.alias("n_bytes"), F.when(n <= 600, F.sha2("text", 256)).alias("sha"))


@query("select s_suppkey, cast(cast(round(s_acctbal * 100) as bigint) as bigint) as cents from supplier where s_suppkey in (select s_suppkey from supplier)")
def artifact_round_trip(spark, d):
    """Rows as JSON text and back, as artifacts are kept."""
    s = table(spark, d, "supplier").select("s_suppkey", F.to_json(F.struct(cents("s_acctbal").alias("cents"))).alias("doc"))
    return s.select("s_suppkey", F.from_json("doc", "cents long")["cents"].alias("cents"))
