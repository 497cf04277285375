"""Texts and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Shares of the splits in percent; fixed values.
SPLITS = (("train", 80), ("validation", 10), ("test", 10))


def hash_split(key: Column) -> Column:
    """The split of a group key: the first 8 bytes of its SHA-256, as a number, mod 100; an empty or null key has none."""
    n = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % 100
    out, upto = None, 0
    for name, percent in SPLITS:
        upto += percent
        out = F.when(n < upto, name) if out is None else out.when(n < upto, name)
    return F.when(key != "", out)


def text_key(text: Column) -> Column:
    """Lower case, with one hyphen for each run of anything but a-z and 0-9, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def instant(ts: Column) -> Column:
    """A moment as text with milliseconds and Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


#: Millimetres of units; significant digits that a length has at most; the largest length in mm; letters that look like digits; fixed values.
UNITS = {"mm": 1, "cm": 10, "dm": 100, "m": 1000}
MOST_DIGITS, MOST_MM = 15, 1_000_000
LOOKALIKES = ("OoQDIlLi|SsBZzG", "000011111558226")
#: Whole numbers, plain or in groups of three, and numbers with a decimal comma or point; a point before three last digits groups.
_WHOLE = r"^([0-9]+|[1-9][0-9]{0,2}\.[0-9]{3}|[0-9]{1,3}(\.[0-9]{3}){2,}|[0-9]{1,3}(,[0-9]{3}){2,})$"
_PARTS = r"^(?![1-9][0-9]{0,2}\.[0-9]{3}$)(?:([0-9]*|[0-9]{1,3}(?:\.[0-9]{3})+),|([0-9]*|[0-9]{1,3}(?:,[0-9]{3})+)\.)([0-9]+)$"


def length_mm(text: Column) -> Column:
    """Exact millimetres of a number with an optional sign and unit (mm, cm, dm, m): a comma or point before the last digits is decimal unless it
    groups thousands; null where the text is no length, has more than MOST_DIGITS significant digits or more than 18 of a fraction."""
    t = F.lower(F.regexp_replace(F.translate(text, "\u2212", "-"), r"(?U)\s+", ""))
    body = F.regexp_replace(t, "^[+-]", "")
    unit, number = F.regexp_extract(body, "[a-z]+$", 0), F.regexp_replace(body, "[a-z]+$", "")
    factor = F.when(unit == "", 1)
    for name, mm in UNITS.items():
        factor = factor.when(unit == name, mm)
    bare = lambda x: F.regexp_replace(x, "[.,]", "")
    whole = number.rlike(_WHOLE)
    before = F.when(whole, bare(number)).otherwise(bare(F.concat(F.regexp_extract(number, _PARTS, 1), F.regexp_extract(number, _PARTS, 2))))
    after = F.when(whole, "").otherwise(F.regexp_extract(number, _PARTS, 3))
    right = (whole | number.rlike(_PARTS)) & (F.char_length(F.ltrim(F.concat(before, after), F.lit("0"))) <= MOST_DIGITS) & (F.char_length(F.rtrim(after, F.lit("0"))) <= 18)
    value = F.concat(F.when(t.startswith("-"), "-").otherwise(""), F.lpad(before, F.greatest(F.char_length(before), F.lit(1)), "0"), F.lit("."), F.substring(F.rpad(after, 18, "0"), 1, 18))
    return (F.when(right, value).try_cast("decimal(38,18)") * factor).cast("decimal(38,18)")


def read_length(text: Column) -> Column:
    """What a dimension's text says, as struct<value_mm, suspicious>: whole millimetres from 1 to MOST_MM, or null; suspicious where letters that look like
    digits, read as those, would make it a length. Letters never count as digits in the value."""
    def known(t: Column) -> Column:
        mm = length_mm(t)
        return F.when((mm == F.floor(mm)) & (mm >= 1) & (mm <= MOST_MM), mm.cast("long"))

    other = F.translate(text, *LOOKALIKES)
    value = known(text)
    return F.struct(value.alias("value_mm"), F.coalesce(value.isNull() & (other != text) & known(other).isNotNull(), F.lit(False)).alias("suspicious"))


def parsed_instant(text: Column) -> Column:
    """The moment of a wire text, null where it is none."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def canonical_sha(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON with sorted names and no white space; nulls stay as null."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


#: Denominators of a scale note that count; fixed values.
NOTE_RANGE = (10, 2000)


def scale_notes(text: Column) -> Column:
    """All N of notes 1:N in a text, within the range."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\b1\s*:\s*([0-9]{1,6})\b"), F.lit(1)), lambda x: x.cast("long"))
    return F.filter(found, lambda n: (n >= NOTE_RANGE[0]) & (n <= NOTE_RANGE[1]))


def without_one(text: Column) -> Column:
    """The text itself and what each letter's absence leaves, each once."""
    cut = lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.char_length(text)))
    fewer = F.when(F.char_length(text) > 0, F.transform(F.sequence(F.lit(1), F.char_length(text)), cut)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(text), fewer))
