"""Points in answers: lists of several shapes in JSON, and those that stand in prose. Column expressions, but for the scan for JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bound, strict_json
from .answers import as_object, json_objects, without_fence
from .geometry import refusal

# Names under which an object holds its points, the fields of a point, and the names of a hand's points, in order.
HOLDERS = ("points", "trajectory", "coordinates")
FIELDS = {2: ("u", "v"), 3: ("x", "y", "z")}
HANDS = ("{}_gripper", "{}", "{}_gripper_points", "{}_trajectory")
NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
# Lists of lists, and two or more points in brackets. The repeats keep what they have, so long lists need no deep stack.
_LISTS = r"\[\s*\[[^\[\]]*\](?:\s*,\s*\[[^\[\]]*\])*+\s*\]"
_BRACKETS = rf"(?:\(\s*{NUMBER}\s*(?:,\s*{NUMBER}\s*){{1,2}}\)\s*,?\s*){{2,}}+"


def _list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def _is_number(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"), F.lit(False))


def _is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def _no_points() -> Column:
    return F.array().cast("array<array<double>>")


def held(value: Column) -> Column:
    """What an object holds under the first of the names, else the value itself."""
    inside = F.coalesce(*[F.try_variant_get(value, f"$.{k}", "variant") for k in HOLDERS])
    return F.when(_is_object(value), inside).otherwise(value)


def coerced(value: Column, dimension: int) -> Column:
    """The points of a variant: a list of lists or of objects with the fields of a point, or a list of numbers as one point; what is none is left out."""

    def point(row: Column) -> Column:
        fields = F.array(*[F.try_variant_get(row, f"$.{k}", "variant") for k in FIELDS[dimension]])
        values = F.slice(F.when(_is_object(row), fields).otherwise(_list(row)), 1, dimension)
        good = lambda v: (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull())
        return bound(F.transform(values, _number), lambda v: F.when(good(v), v))

    def points(items: Column) -> Column:
        first = F.slice(items, 1, dimension)
        one = (F.size(first) == dimension) & F.forall(first, _is_number)
        return F.when(one, F.array(F.transform(first, _number))).otherwise(F.array_compact(F.transform(items, point)))

    return F.coalesce(bound(bound(value, lambda v: _list(held(v))), points), _no_points())


def _counts(value: Column) -> Column:
    """Whether a variant is there and neither empty nor zero."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    filled = F.when(kind == "VOID", False).when(kind == "STRING", text != "").when(kind == "BOOLEAN", text == "true").when(kind.rlike("^(ARRAY|OBJECT)"), ~text.isin("[]", "{}"))
    return value.isNotNull() & filled.otherwise(F.coalesce(_number(value), F.lit(1.0)) != 0)


def with_hands(rows: DataFrame, text_col: str, dimension: int) -> DataFrame:
    """rows with left_gripper and right_gripper: the points in the first JSON object of an answer, each hand under the first of its names that counts."""
    bare = without_fence(F.col(text_col))
    found = rows.withColumn("_first", F.get(json_objects(bare), F.lit(0)))
    value = bound(F.struct(bare.alias("bare"), strict_json(bare).isNotNull().alias("whole")), lambda s: F.when(s["whole"], as_object(s["bare"])).otherwise(F.try_parse_json("_first")))
    found = found.withColumn("_value", value)
    for side in ("left", "right"):
        named = F.array(*[F.try_variant_get("_value", f"$.{k.format(side)}", "variant") for k in HANDS])
        found = found.withColumn(f"{side}_gripper", coerced(F.get(F.filter(named, _counts), F.lit(0)), dimension))
    return found.drop("_first", "_value")


def harvested(fragment: Column, dimension: int) -> Column:
    """The rows of numbers of a list; where these are fewer than two, all numbers in turn, if they make two points."""
    numbers = lambda r: bound(_list(r), lambda v: F.when(F.forall(v, _is_number), F.transform(v, _number)))
    rows = F.coalesce(F.array_compact(F.transform(_list(strict_json(fragment)), numbers)), _no_points())
    in_turn = F.transform(F.regexp_extract_all(fragment, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))
    cut = lambda n: F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / dimension).cast("int") - 1), lambda i: F.slice(n, i * dimension + 1, dimension))
    return bound(F.struct(rows.alias("rows"), in_turn.alias("n")), lambda s: F.when((F.size(s["rows"]) < 2) & (F.size(s["n"]) >= 2 * dimension), cut(s["n"])).otherwise(s["rows"]))


def in_prose(text: Column, dimension: int, expected: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """The most points of a list or a row of brackets in a text that are a trajectory, the first of equally many; null without any."""
    fragments = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (_LISTS, _BRACKETS)])
    good = F.filter(F.transform(fragments, lambda f: harvested(f, dimension)), lambda p: refusal(p, dimension, expected, width, height).isNull())
    return F.array_max(F.transform(good, lambda p, i: F.struct(F.size(p).alias("n"), (-i).alias("i"), p.alias("p"))))["p"]
