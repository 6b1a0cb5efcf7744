"""Intervals of several questions in one answer: rows of JSON by id, hint or place, and lines that name an id. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import INTERVAL, bound, interval_of_text, loose_seconds, seconds_of, strict_json, times_apart
from .answers import json_values, stripped, without_fence
from .points import NUMBER

# Names under which lists of answers, ids, and the two ends or the text of an interval stand, in order.
LISTS = ("answers", "results", "items", "predictions")
IDS = ("id", "question_id", "item_id")
ENDS = (("start", "end"), ("start_time", "end_time"))
TEXTS = ("answer", "interval", "timestamp")
LOOSE_ENDS = (*ENDS, ("from", "to"))
LOOSE_TEXTS = (*TEXTS, "time")
LOOSE = rf"({NUMBER})\s*(?:-|~|,|to|至)\s*({NUMBER})"
_ENTRY = "array<struct<id:string,start:double,end:double>>"


def _field(value: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{key}", kind)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _pair(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def _row(value: Column, ends, texts, time, said) -> Column:
    """struct(start, end) of a row: an object's ends or text, or a text; null fields if there is none."""
    out = F.when(_is(value, "STRING"), said(_text(value)))
    for a, b in ends:
        out = out.when(_field(value, a).isNotNull() & _field(value, b).isNotNull(), _pair(time(_field(value, a)), time(_field(value, b))))
    for k in texts:
        out = out.when(_field(value, k).isNotNull(), said(_field(value, k, "string")))
    none = F.lit(None).cast("double")
    return out.otherwise(_pair(none, none))


def interval_of_row(value: Column) -> Column:
    """struct(start, end) of one answer: an object with clock times or seconds, or a text; null fields for anything else."""
    said = lambda t: F.when(F.startswith(stripped(t), F.lit("{")), times_apart(t)).otherwise(interval_of_text(t))
    return F.when(_is(value, "STRING"), interval_of_text(_text(value))).otherwise(_row(value, ENDS, TEXTS, lambda v: seconds_of(stripped(_text(v))), said))


def loose_interval_of_row(value: Column) -> Column:
    """The same, leniently: numbers, units, any count of fields, more names."""

    def time(v: Column) -> Column:
        number = F.when(F.rlike(_text(v), F.lit(rf"^\s*{NUMBER}\s*$")), F.trim(_text(v)).cast("double"))
        return F.coalesce(F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double")), number, loose_seconds(_text(v)))

    number = lambda t, g: F.nullif(F.regexp_extract(t, LOOSE, g), F.lit("")).cast("double")
    return _row(value, LOOSE_ENDS, LOOSE_TEXTS, time, lambda t: _pair(number(t, 1), number(t, 2)))


def _listed(value: Column) -> Column:
    """The rows of a list, or of the first list that an object has under one of the names."""
    inside = F.coalesce(*[_field(value, k, "array<variant>") for k in LISTS])
    return F.when(_is(value, "ARRAY"), F.try_variant_get(value, "$", "array<variant>")).when(_is(value, "OBJECT"), inside)


def _own_id(row: Column) -> Column:
    return F.when(_is(row, "OBJECT"), F.coalesce(*[_field(row, k, "string") for k in IDS]))


def _by_key(value: Column, ids: Column) -> Column:
    """array of struct(id, value) of the ids that are keys of an object."""
    pairs = lambda m: F.filter(F.transform(ids, lambda i: F.struct(i.alias("id"), F.try_element_at(m, i).alias("value"))), lambda p: F.map_contains_key(m, p["id"]))
    return F.when(_is(value, "OBJECT"), bound(F.try_variant_get(value, "$", "map<string,variant>"), pairs))


def _hint(row: Column, own: Column) -> Column:
    """Which question a row says that it answers, from 1: its index, or an id of digits only."""
    said = F.when(_is(row, "OBJECT"), F.coalesce(F.when(~_is(row, "OBJECT") | (F.schema_of_variant(_field(row, "index")) == "VOID"), None).otherwise(_field(row, "index", "string")), F.when(own.rlike(r"^\d+$"), own)))
    number = F.schema_of_variant(_field(row, "index")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    whole = bound(said, lambda s: F.when(s.rlike(r"^\s*[-+]?\d{1,9}\s*$"), F.trim(s).cast("bigint")))
    return F.coalesce(F.when(number, F.try_variant_get(row, "$.index", "double").cast("bigint")), whole)


def _quoted(ids: Column) -> Column:
    """A pattern of any of the ids, longer ones first."""
    longest = F.transform(F.array_sort(F.transform(ids, lambda i, n: F.struct((-F.length(i)).alias("n"), n.alias("at"), i.alias("id")))), lambda s: s["id"])
    return F.array_join(F.transform(longest, lambda i: F.regexp_replace(i, r"([^\p{L}\p{N}_])", r"\\$1")), "|")


def _lines(text: Column, ids: Column, flags: str, numbers: str, time) -> Column:
    """Entries of what a text says after an id, in order."""
    pattern = F.concat(F.lit(f"(?{flags})("), _quoted(ids), F.lit(f").*?{numbers}"))
    groups = F.struct(*[F.regexp_extract_all(text, pattern, F.lit(g)).alias(f"g{g}") for g in (1, 2, 3)])
    found = bound(groups, lambda g: F.transform(F.arrays_zip(g["g1"], g["g2"], g["g3"]), lambda m: F.struct(m["g1"].alias("id"), time(m["g2"]).alias("start"), time(m["g3"]).alias("end"))))
    return F.when(F.size(ids) > 0, found).otherwise(F.array().cast(_ENTRY))


def _last_of_each(entries: Column) -> Column:
    names = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["id"])))
    return F.transform(names, lambda i: F.try_element_at(F.filter(entries, lambda e: e["id"] == i), F.lit(-1)))


def several_intervals(text: Column, ids: Column) -> Column:
    """array of struct(id, start, end), by id, of several questions' answers in one text: a list or an object of answers, by
    id, index or place, or else lines that name an id; the last of an id counts. Null where the text, or an answer in it, does not parse."""

    def placed(row: Column, at: Column) -> Column:
        place = lambda own: F.coalesce(F.when(F.array_contains(ids, own), own), bound(F.coalesce(_hint(row, own) - 1, at.cast("bigint")), lambda p: F.when(p >= 0, F.get(ids, p.cast("int")))))
        return F.struct(bound(_own_id(row), place).alias("id"), interval_of_row(row).alias("t"))

    def entries(value: Column) -> Column:
        listed = F.filter(F.transform(_listed(value), placed), lambda e: e["id"].isNotNull())
        keyed = F.transform(_by_key(value, ids), lambda p: F.struct(p["id"].alias("id"), interval_of_row(p["value"]).alias("t")))
        return F.transform(F.coalesce(listed, keyed), lambda e: F.struct(e["id"].alias("id"), e["t"]["start"].alias("start"), e["t"]["end"].alias("end")))

    whole = lambda e: F.when(F.forall(e, lambda x: x["start"].isNotNull() & x["end"].isNotNull()), e)
    lines = lambda bare: bound(_lines(F.translate(bare, "–—到", "---"), ids, "i", INTERVAL.removeprefix("(?i)"), seconds_of), lambda e: F.when(F.size(e) > 0, e))
    found = lambda s: F.when(s["v"].isNotNull(), bound(entries(s["v"]), whole)).otherwise(lines(s["bare"]))
    return bound(bound(bound(stripped(without_fence(text)), lambda b: F.struct(b.alias("bare"), strict_json(b).alias("v"))), found), _last_of_each)


def lenient_intervals(text: Column, ids: Column) -> Column:
    """struct(found, rejected, layer): found has an entry (id, start, end) of every question that an answer of its own is
    found for. Each id stands for itself: of its answers in all JSON of the text the first that parses counts, and those
    before it are rejected (their ids); ids still missing are looked for behind their names (lenient)."""

    def entry(own: Column, t: Column) -> Column:
        return F.struct(own.alias("id"), t["start"].alias("start"), t["end"].alias("end"))

    def entries(value: Column) -> Column:
        listed = F.transform(_listed(value), lambda r, i: entry(F.coalesce(_own_id(r), F.get(ids, i)), loose_interval_of_row(r)))
        number = lambda t, g: F.nullif(F.regexp_extract(t, LOOSE, g), F.lit("")).cast("double")
        said = lambda v: F.when(_is(v, "OBJECT"), loose_interval_of_row(v)).otherwise(_pair(number(_text(v), 1), number(_text(v), 2)))
        keyed = F.transform(_by_key(value, ids), lambda p: entry(F.coalesce(_own_id(p["value"]), p["id"]), said(p["value"])))
        return F.coalesce(listed, keyed, F.array().cast(_ENTRY))

    good = lambda e: e["start"].isNotNull() & e["end"].isNotNull()

    def chosen(said: Column) -> Column:
        own = F.transform(F.array_distinct(ids), lambda i: F.filter(said, lambda e: e["id"] == i))
        first = F.filter(F.transform(own, lambda l: F.get(F.filter(l, good), F.lit(0))), lambda e: e.isNotNull())
        ahead = lambda l: F.slice(l, F.lit(1), F.coalesce(F.array_min(F.transform(l, lambda e, i: F.when(good(e), i))), F.size(l)))
        passed = F.flatten(F.transform(own, lambda l: F.transform(ahead(l), lambda e: e["id"])))
        return F.struct(first.alias("found"), passed.alias("rejected"))

    def filled(c: Column) -> Column:
        missing = F.filter(ids, lambda i: ~F.exists(c["found"], lambda e: e["id"] == i))
        lines = _lines(text, missing, "is", LOOSE, lambda x: x.cast("double"))
        of = lambda l: F.filter(F.transform(F.array_distinct(missing), lambda i: F.get(F.filter(l, lambda e: e["id"] == i), F.lit(0))), lambda e: e.isNotNull())
        return bound(lines, of)

    def result(c: Column) -> Column:
        every = lambda more: F.struct(F.array_sort(F.concat(c["found"], more)).alias("found"), c["rejected"].alias("rejected"), F.when(F.size(c["found"]) > 0, "strict").when(F.size(more) > 0, "lenient").otherwise("none").alias("layer"))
        return bound(F.coalesce(filled(c), F.array().cast(_ENTRY)), every)

    said = bound(json_values(text), lambda v: F.flatten(F.transform(v, entries)))
    return bound(bound(F.coalesce(said, F.array().cast(_ENTRY)), chosen), result)


def one_row_each(rows: DataFrame, text_col: str, ids_col: str) -> DataFrame:
    """rows with question, start, end and layer, a row for each question of theirs that an interval is found for; a bad answer costs its own question only."""
    got = rows.withColumn("_got", lenient_intervals(F.col(text_col), F.col(ids_col)))
    return got.withColumn("_one", F.explode("_got.found")).select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_one.id").alias("question"), "_one.start", "_one.end", F.col("_got.layer").alias("layer"))
