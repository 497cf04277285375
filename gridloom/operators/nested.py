"""Documents of nested entities: integrity, field-level differences, edited flags, scaling, reports.

A layer row has its key and arrays of structs: walls (id, level, x1, y1, x2, y2, thickness, openings, source, reviewed, edited, confidence), openings
(id, wall, kind, width), rooms (id, level, name, usage, walls, outline), furniture (id, level, room, kind). Lists are exploded once for all rules, so
a document of any size is spread, and hot keys are counted before they move."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import js_round

#: Rules and their severities; fixed values.
DUPLICATE, MISSING_REFERENCE, LEVEL, OUTLINE = "duplicateId", "missingReference", "levelMembership", "roomOutline"
CRITICAL, WARNING = "critical", "warning"
DELETED = "__deleted__"
#: The lists of a layer by their number; fixed values.
LISTS = ("walls", "openings", "rooms", "furniture")
#: Pairs of walls of a layer that are looked up within its row.
NEAR = 40_000
#: Entities of less confidence than this, by a machine and not reviewed, are doubtful; fixed value.
DOUBTFUL = 0.7


def _inlined(layers: DataFrame, key: str, rows: list[Column]) -> DataFrame:
    """key and the structs of all these arrays: one pass over a layer, however many lists are read."""
    return layers.select(key, F.inline(F.flatten(F.filter(F.array(*rows), lambda x: x.isNotNull()))))


def _gathered(layers: DataFrame, key: str, parts: list[tuple[str, Callable[[Column, Column], Column]]]) -> DataFrame:
    """key and the structs, all of one kind, that each function gives for the entities (and their places) of its list."""
    return _inlined(layers, key, [F.transform(name, row) for name, row in parts])


def entities(layers: DataFrame, key: str) -> DataFrame:
    """key, list, place, id, level of all entities; openings have no level."""
    none = F.lit(None).cast("string")
    row = lambda n, level: lambda e, i: F.struct(F.lit(n).alias("list"), i.alias("place"), e["id"].alias("id"), (e["level"] if level else none).alias("level"))
    return _gathered(layers, key, [(name, row(n, name != "openings")) for n, name in enumerate(LISTS)])


def integrity(layers: DataFrame, key: str, level: str | None = None) -> DataFrame:
    """key, rule, severity, entity_id, ref_id: ids that occur twice, references to nothing, openings that their (first) wall does not list, entities of
    another level (than the given one, or that of the first wall, room or furniture), and outlines that repeat their first point."""
    # entities, and references under the id that they lead to: both of a layer are where its row is, so one pass without joins judges them
    text, none = F.lit(None).cast("string"), F.lit(None)
    row = lambda n, place, id_, entity=text, severity=text, listed=none.cast("array<string>"), lvl=text, closed=F.lit(False): F.struct(F.lit(n).alias("list"), place.alias("place"), id_.alias("id"), entity.alias("entity_id"), severity.alias("severity"), listed.alias("listed"), lvl.alias("level"), closed.alias("closed"))
    shut = lambda e: F.coalesce((F.size(e["outline"]) > 0) & (F.get(e["outline"], F.lit(0)) == F.try_element_at(e["outline"], F.lit(-1))), F.lit(False))
    own = [lambda e, i: row(0, i, e["id"], listed=e["openings"], lvl=e["level"]), lambda e, i: row(1, i, e["id"]), lambda e, i: row(2, i, e["id"], lvl=e["level"], closed=shut(e)), lambda e, i: row(3, i, e["id"], lvl=e["level"])]
    lead = lambda to, e, ref, severity: row(to, none.cast("int"), ref, e["id"], F.lit(severity))
    each = lambda name, refs, to, severity: F.flatten(F.filter(F.transform(name, lambda e: F.transform(e[refs], lambda r: lead(to, e, r, severity))), lambda x: x.isNotNull()))
    rows = [F.transform(name, f) for name, f in zip(LISTS, own)]
    rows += [each("walls", "openings", 1, CRITICAL), F.transform("openings", lambda e: lead(0, e, e["wall"], CRITICAL)), each("rooms", "walls", 0, WARNING)]
    rows.append(F.transform(F.filter("furniture", lambda e: e["room"].isNotNull()), lambda e: lead(2, e, e["room"], WARNING)))
    entity, member = F.col("place").isNotNull(), F.col("place").isNotNull() & (F.col("list") != 1)
    bit, at, of = F.call_function("shiftleft", F.lit(1), F.col("list")), F.struct("list", "place"), Window.partitionBy(key, "id")
    found = _inlined(layers, key, rows)
    if level is None:
        found = found.withColumn("expected", F.when(F.col(key).isNotNull(), F.min_by("level", F.when(member, at)).over(Window.partitionBy(key))))
    else:
        found = found.withColumn("expected", F.lit(level))
    found = found.withColumns({"n": F.count(F.when(entity, 1)).over(of), "begin": F.min(F.when(entity, at)).over(of), "there": F.bit_or(F.when(entity, bit)).over(of), "first": F.min_by("listed", F.when(entity & (F.col("list") == 0), F.col("place"))).over(of)})
    known = F.coalesce(F.col("there").bitwiseAND(bit) != 0, F.lit(False)) & F.col("id").isNotNull() & F.col(key).isNotNull()
    hosted = ~entity & known & (F.col("list") == 0) & (F.col("severity") == CRITICAL)  # openings
    issue = lambda when, rule, severity, entity_id, ref: F.when(when, F.struct(F.lit(rule).alias("rule"), severity.alias("severity"), entity_id.alias("entity_id"), ref.alias("ref_id")))
    id_, other = F.col("id"), F.col("entity_id")
    issues = F.array(
        issue(entity & (F.col("n") > 1) & (F.col("begin") == at), DUPLICATE, F.lit(CRITICAL), id_, text),
        issue(~entity & ~known, MISSING_REFERENCE, F.col("severity"), other, id_),
        issue(hosted & ~F.array_contains("first", other), MISSING_REFERENCE, F.lit(WARNING), id_, other),
        issue(member & (F.col("level") != F.col("expected")), LEVEL, F.lit(CRITICAL), id_, F.col("level")),
        issue(entity & F.col("closed"), OUTLINE, F.lit(WARNING), id_, text),
    )
    return found.select(key, F.inline(F.filter(issues, lambda x: x.isNotNull())))


def _field_parts() -> list[tuple[str, Callable[[Column, Column], Column]]]:
    """Of each list what gives type, id, place, owner and f, the tracked fields with their values, of an entity (see snapshot)."""
    def fields(e: Column, names: dict[str, str]) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("field"), e[c].cast("string").alias("value")) for n, c in names.items()])

    def row(type_: Column, names: dict[str, str], tail: str = "") -> Callable[[Column, Column], Column]:
        kind = lambda e: type_ if type_ is not None else e["kind"]
        return lambda e, i: F.struct(kind(e).alias("type"), (F.concat(e["id"], F.lit(tail)) if tail else e["id"]).alias("id"), i.alias("place"), e["id"].alias("owner"), fields(e, names).alias("f"))

    same = lambda *names: {n: n for n in names}
    parts = [("walls", row(F.lit("wall"), same("thickness"))), ("openings", row(None, same("width", "wall"))), ("rooms", row(F.lit("room"), same("name", "usage"))), ("furniture", row(F.lit("furniture"), same("kind", "room")))]
    return parts + [("walls", row(F.lit("vertex"), {"x": f"x{n}", "y": f"y{n}"}, f"#{end}")) for end, n in (("start", 1), ("end", 2))]


def _fields(layers: DataFrame, key: str) -> DataFrame:
    """key, type, id, owner and f of each entity: of equal ids the last."""
    return _gathered(layers, key, _field_parts()).groupBy(key, "type", "id").agg(F.max_by(F.struct("owner", "f"), "place").alias("last")).select(key, "type", "id", "last.owner", "last.f")


def _others() -> Column:
    """The fields f whose value is not that of was."""
    # entities of one type have the same fields in one order, but for an opening whose kind is the name of another type
    at = lambda e, i: F.get(F.col("was"), i)
    before = lambda e, i: F.when(at(e, i)["field"] == e["field"], at(e, i)["value"]).otherwise(F.get(F.filter("was", lambda w: w["field"] == e["field"]), F.lit(0))["value"])
    return F.filter("f", lambda e, i: ~e["value"].eqNullSafe(before(e, i)))


def snapshot(layers: DataFrame, key: str) -> DataFrame:
    """key, type, id, owner, field, value (text): the tracked fields of walls, openings, rooms and furniture; a wall's ends are vertices of their own,
    owned by it, and an opening's type is its kind. Of equal ids the last counts."""
    return _fields(layers, key).select(key, "type", "id", "owner", F.inline("f"))


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, type, id, owner, field, value of two layers of the same keys: every field whose value differs (null: taken away), every set field of a new
    entity, and one row with field __deleted__ for each that is gone."""
    a, b = _fields(old, key), _fields(new, key)
    both = a.withColumnRenamed("f", "was").drop("owner").join(b, [key, "type", "id"], "full")
    gone = F.array(F.struct(F.lit(DELETED).alias("field"), F.lit(None).cast("string").alias("value")))
    owner = F.coalesce("owner", F.substring_index("id", "#", 1))
    return both.select(key, "type", "id", owner.alias("owner"), F.inline(F.when(F.col("f").isNull(), gone).otherwise(_others())))


def edited(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, id, edited of the walls of new: new ones, those edited or made by a person before, and those with a changed field or end. A key has one layer in each."""
    side = lambda df, name: df.select(key, F.struct(*LISTS).alias(name))
    return edited_of(side(old, "old").join(side(new, "new"), key, "full"), key)


def edited_of(both: DataFrame, key: str) -> DataFrame:
    """edited() of rows (key, old, new) that hold both versions of a layer as structs of LISTS.

    Walls of one id are looked up within the row, so nothing moves; layers of more than NEAR pairs of walls, and those with openings whose kind is the name of a type that
    walls have, or without a key, go entity by entity."""
    odd = lambda v: F.exists(f"{v}.openings", lambda e: e["kind"].isin("wall", "vertex"))
    walls = {v: F.coalesce(f"{v}.walls", F.array().cast(both.schema[v].dataType["walls"].dataType)) for v in ("old", "new")}
    pairs = (F.size(walls["old"]) + F.size(walls["new"])).cast("long") * F.size(walls["new"])
    plain = F.coalesce((pairs <= NEAR) & F.col(key).isNotNull(), F.lit(False)) & ~F.coalesce(odd("old"), F.lit(False)) & ~F.coalesce(odd("new"), F.lit(False))
    place = lambda e: F.struct(*[e[c].cast("string").alias(c) for c in ("thickness", "x1", "y1", "x2", "y2")])
    by_hand = lambda e: e["edited"] | (e["source"] == "human")
    known = lambda x: F.coalesce(x, F.lit(False))

    def judged(w: Column) -> Column:
        was, now = (F.filter(walls[v], lambda e: e["id"] == w["id"]) for v in ("old", "new"))
        kept_before = F.aggregate(was, F.lit(None).cast("boolean"), lambda x, e: F.when(by_hand(e).isNull(), x).otherwise(known(x) | by_hand(e)))
        changed = ~place(F.element_at(was, -1)).eqNullSafe(place(F.element_at(now, -1)))
        mark = known(w["edited"]) | w["id"].isNull() | kept_before.isNull() | known(kept_before) | known(changed)
        return F.struct(w["id"].alias("id"), mark.alias("edited"))

    here = both.where(plain).select(key, F.inline(F.transform(walls["new"], judged)))
    return here.unionByName(_edited_by_entity(both.where(~plain), key))


def _edited_by_entity(both: DataFrame, key: str) -> DataFrame:
    """edited_of() with a row for each entity, grouped where its layer is."""
    flags = ("boolean", "boolean")
    parts = []
    for now, v in enumerate(("old", "new")):
        rows = [F.transform(f"{v}.{name}", f) for name, f in _field_parts()]
        wide = lambda e: F.struct(F.lit(now).alias("now"), F.lit(False).alias("flag"), e["type"].alias("type"), e["id"].alias("id"), e["place"].alias("place"), e["owner"].alias("owner"), e["f"].alias("f"), *[F.lit(None).cast(t).alias(c) for c, t in zip(("own", "kept"), flags)])
        parts += [F.transform(r, wide) for r in rows]
        fields = F.lit(None).cast("array<struct<field:string,value:string>>")
        hand = (lambda e: (F.lit(None).cast("boolean"), e["edited"] | (e["source"] == "human"))) if not now else (lambda e: (F.coalesce(e["edited"], F.lit(False)), F.lit(None).cast("boolean")))
        parts.append(F.transform(f"{v}.walls", lambda e, i: F.struct(F.lit(now).alias("now"), F.lit(True).alias("flag"), F.lit("wall").alias("type"), e["id"].alias("id"), i.alias("place"), e["id"].alias("owner"), fields.alias("f"), *[x.alias(c) for c, x in zip(("own", "kept"), hand(e))])))
    rows = _inlined(both, key, parts)
    # what has no key, type or id is never the same as before
    rows = rows.withColumn("bare", F.when(F.col(key).isNull() | F.col("id").isNull() | F.col("type").isNull(), F.col("now")))
    last = lambda c, now: F.max_by(c, F.when(F.col("now") == now, F.col("place")))
    each = rows.where("flag or type in ('wall', 'vertex')").groupBy(key, "bare", "flag", "type", "id").agg(last("f", 0).alias("was"), last("f", 1).alias("f"), F.coalesce(last("owner", 1), F.max("owner")).alias("owner"), F.collect_list("own").alias("own"), F.bool_or("kept").alias("kept"))
    changed = F.col("f").isNotNull() & (F.size(_others()) > 0)
    found = each.groupBy(key, "bare", "owner").agg(F.flatten(F.collect_list("own")).alias("own"), F.bool_or("kept").alias("kept"), F.bool_or(changed).alias("changed"))
    mark = F.col("own") | F.col("kept").isNull() | F.coalesce("kept", F.lit(False)) | F.coalesce("changed", F.lit(False))
    return found.select(key, "kept", "changed", F.col("owner").alias("id"), F.explode("own").alias("own")).select(key, "id", mark.alias("edited"))


def rescaled(layers: DataFrame, factor: Column, reviewed_too: bool = False) -> DataFrame:
    """layers with the plan lengths of walls and openings times factor, rounded half up; what is reviewed stays unless asked for, as
    do heights."""
    grown = lambda x: js_round(x * factor).cast("long")

    def wall(w: Column) -> Column:
        moved = reduce(lambda s, c: s.withField(c, grown(w[c])), ("x1", "y1", "x2", "y2", "thickness"), w)
        return moved if reviewed_too else F.when(w["reviewed"], w).otherwise(moved)

    return layers.withColumns({"walls": F.transform("walls", wall), "openings": F.transform("openings", lambda o: o.withField("width", grown(o["width"])))})


def report(layers: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """key, n_critical, n_doubtful: critical issues, and walls of a machine, not reviewed, of too little confidence."""
    unsure = F.size(F.filter("walls", lambda w: (w["source"] == "ai") & ~w["reviewed"] & (w["confidence"] < DOUBTFUL)))
    n = issues.where(f"severity = '{CRITICAL}'").groupBy(key).agg(F.count("*").alias("n_critical"))
    return layers.select(key, unsure.cast("long").alias("n_doubtful")).join(n, key, "left").select(key, F.coalesce("n_critical", F.lit(0)).alias("n_critical"), "n_doubtful")


def _reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key and id of what the seeds of each layer lead to over its links."""
    for batch in batches:
        keys, found = [], []
        for key, ids, seeds, start, end in zip(*(batch[c] for c in ("key", "ids", "seeds", "start", "end"))):
            there, links = set(ids), {}
            if key is not None:
                for a, b in zip(start, end):
                    if b is not None and b in there:
                        links.setdefault(a, []).append(b)
            seen, open_ = set(seeds), [x for x in seeds if x is not None]
            while open_:
                for x in links.get(open_.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        open_.append(x)
            keys += [key] * len(seen)
            found += seen
        yield pd.DataFrame({"key": pd.array(keys, "object"), "id": pd.array(found, "object")})


def kept_closure(layers: DataFrame, key: str, seed: Callable[[Column], Column]) -> DataFrame:
    """key, id of what stays in a merge: the walls for which seed is true, and all that is reached from them over openings, their walls, the walls of rooms and the rooms of
    furniture, to ids that exist. A layer is one row, and what it links stays in it, so nothing moves or is written; layers without seeds go first."""
    lead = lambda e, ref: F.struct(e["id"].alias("a"), ref.alias("b"))
    each = lambda name, refs: F.flatten(F.transform(name, lambda e: F.transform(F.coalesce(e[refs], F.array().cast("array<string>")), lambda r: lead(e, r))))
    one = lambda name, ref: F.transform(name, lambda e: lead(e, e[ref]))
    merged = lambda *lists: F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull()))
    links = merged(each("walls", "openings"), one("openings", "wall"), each("rooms", "walls"), one("furniture", "room"))
    ids = merged(*[F.transform(name, lambda e: e["id"]) for name in LISTS])
    seeds = F.transform(F.filter("walls", lambda e: F.coalesce(seed(e), F.lit(False))), lambda e: e["id"])
    rows = layers.where(F.exists("walls", lambda e: F.coalesce(seed(e), F.lit(False))))
    # keys pass as text, as pandas would make floats of whole numbers beside a null
    rows = rows.select(F.col(key).cast("string").alias("key"), ids.alias("ids"), seeds.alias("seeds"), links.alias("l")).select("key", "ids", "seeds", F.col("l.a").alias("start"), F.col("l.b").alias("end"))
    found = rows.mapInPandas(_reached, "key string, id string")
    return found.select(F.col("key").cast(layers.schema[key].dataType).alias(key), "id")
