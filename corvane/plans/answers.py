"""Parsing of answers, over model outputs made of `orders` by templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as an
from ..operators import runs
from ..sources import table
from .registry import query

# Expressions that Spark and DuckDB read alike.
_LETTER = "substr('ABCD', CAST(o_orderkey % 4 AS INT) + 1, 1)"
_NAMES = "CASE o_orderkey % 4 WHEN 0 THEN 'open the drawer' WHEN 1 THEN 'close the drawer' WHEN 2 THEN 'move the cup' ELSE 'remove the cup' END"
_OUTPUT = f"""CASE o_orderkey % 19
  WHEN 0 THEN '{{"choice": "' || {_LETTER} || '", "reason": "it moves"}}' WHEN 1 THEN '```json' || chr(10) || '{{"choice": "' || {_LETTER} || '"}}' || chr(10) || '```'
  WHEN 2 THEN {_LETTER} WHEN 3 THEN ' ' || lower({_LETTER}) || ' ' WHEN 4 THEN 'The answer is ' || {_LETTER} || '.' WHEN 5 THEN '{{"answer": "' || {_LETTER} || '"}}'
  WHEN 6 THEN '{{"choice": "", "option": "' || {_LETTER} || '"}}' WHEN 7 THEN 'I think they ' || {_NAMES} || ', yes' WHEN 8 THEN '' WHEN 9 THEN 'None of these' WHEN 10 THEN '   '
  WHEN 11 THEN '{{"choice": null}}' WHEN 12 THEN 'Z' WHEN 13 THEN 'either A or ' || {_LETTER} WHEN 14 THEN '<think>could be B or so</think>{{"choice": "' || {_LETTER} || '"}}'
  WHEN 15 THEN '<Reasoning>not sure' WHEN 16 THEN 'So: {{"x": 1}} and then {{"letter": "' || {_LETTER} || '"}}' WHEN 17 THEN '{{"choice": ' || {_LETTER} || ', ''reason'': ''none'',}}' ELSE 'A robot moves: ' || {_NAMES} END"""
_BASE = f"SELECT o_orderkey AS id, {_LETTER} AS expected, {_OUTPUT} AS output FROM orders"

# Options A to D of these texts, the third without one in every fifth row.
_OPTIONS = "array(struct('a' as id, 'Open the drawer.' as text), struct('B' as id, 'Close the drawer.' as text), struct('C' as id, if(id % 5 = 0, null, 'Move the cup.') as text), struct('D' as id, 'Remove the cup.' as text), struct(cast(null as string) as id, 'x' as text))"


def outputs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey as id", f"{_LETTER} as expected", f"{_OUTPUT} as output").withColumn("options", an.option_texts(F.expr(_OPTIONS)))


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_FENCE = f"""CASE WHEN starts_with({_STRIP}, '```') THEN {_STRIP.format("regexp_replace(regexp_replace(" + _STRIP + ", '^```(?:json)?\\s*', ''), '\\s*```$', '')")} ELSE {_STRIP} END"""
_TAGS = "|".join(rf"<\s*{t}\s*>.*?<\s*/\s*{t}\s*>" for t in an.REASONING)
_THINK = _STRIP.format(f"regexp_replace(regexp_replace({{0}}, '{_TAGS}', ' ', 'gis'), '^\\s*<\\s*(?:{'|'.join(an.REASONING)})\\s*>', '', 'i')")
_PLAIN = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_HYPHEN = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_SQL_TEXTS = "['Open the drawer.', 'Close the drawer.', CASE WHEN id % 5 = 0 THEN 'None' ELSE 'Move the cup.' END, 'Remove the cup.']"


def _sql_letter(text: str) -> str:
    upper = f"upper({_STRIP.format(text)})"
    return f"""CASE WHEN {upper} IN ('A','B','C','D') THEN {upper} WHEN regexp_extract({upper}, '\\b([A-Z])\\b', 1) IN ('A','B','C','D') THEN regexp_extract({upper}, '\\b([A-Z])\\b', 1)
      ELSE list_filter(list_transform(range(1, 5), lambda i: CASE WHEN contains({_PLAIN.format(text)}, {_PLAIN.format(_SQL_TEXTS + '[i]')}) THEN substr('ABCD', i, 1) END), lambda x: x IS NOT NULL)[1] END"""


def _sql_true(j: str, keys) -> str:
    one = "CASE WHEN json_type({j}, '$.{k}') IS NULL OR json_type({j}, '$.{k}') = 'NULL' OR json_extract_string({j}, '$.{k}') IN ('', '[]', '{{}}') THEN NULL ELSE json_extract_string({j}, '$.{k}') END"
    return "coalesce(" + ", ".join(one.format(j=j, k=k) for k in keys) + ", '')"


def _sql_object(t: str) -> str:
    return f"CASE WHEN json_valid({t}) AND json_type(CASE WHEN json_valid({t}) THEN {t} END) = 'OBJECT' THEN {t} END"


_PARSED = f"""t AS ({_BASE}), f AS (SELECT *, {_FENCE.format('output')} AS bare, {_THINK.format('output')} AS thought FROM t),
    g AS (SELECT *, {_sql_object('bare')} AS j, {_FENCE.format('thought')} AS bare2 FROM f), h AS (SELECT *, {_sql_object('bare2')} AS j2, list_filter(regexp_extract_all(thought, '\\{{[^{{}}]*\\}}'), lambda x: json_valid(x)) AS objects FROM g),
    p AS (SELECT *, CASE WHEN j IS NOT NULL THEN {_sql_letter(_sql_true('j', an.CHOICE_KEYS))} ELSE {_sql_letter('bare')} END AS base,
      CASE WHEN j2 IS NOT NULL THEN {_sql_letter(_sql_true('j2', an.CHOICE_KEYS))} ELSE {_sql_letter('bare2')} END AS second, CASE WHEN len(objects) > 0 THEN {_sql_letter(_sql_true('objects[len(objects)]', an.CHOICE_KEYS))} END AS third FROM h)"""


@query(
    "t8_t9_t10_cleaned",
    f"""WITH t AS ({_BASE}) SELECT id, {_FENCE.format('output')} AS bare, {_THINK.format('output')} AS thought, {_PLAIN.format('output')} AS plain, {_HYPHEN.format("output || ' 1-3-2'")} AS hyphened, contains(lower(output), 'none') AS says_none FROM t""",
)
def cleaned(spark, d):
    out = F.col("output")
    return outputs(spark, d).select("id", an.without_fence(out).alias("bare"), an.without_reasoning(out).alias("thought"), an.plain(out).alias("plain"), an.plain(F.concat(out, F.lit(" 1-3-2")), True).alias("hyphened"), F.contains(F.lower(out), F.lit("none")).alias("says_none"))


@query("t11_t12_t13_choices", f"WITH {_PARSED} SELECT id, base AS baseline, coalesce(base, second, third) AS choice, coalesce(base, second, third) IS NOT NULL AS parse_ok, base IS NULL AND coalesce(second, third) IS NOT NULL AS parse_recovered FROM p")
def choices(spark, d):
    return an.with_choices(outputs(spark, d), "output", "options").select("id", "baseline", "choice", "parse_ok", "parse_recovered")


@query(
    "t23_resolutions",
    f"""WITH {_PARSED}, u AS (SELECT *, upper({_STRIP.format('output')}) AS u FROM p) SELECT id, CASE WHEN u IN ('A','B','C','D') THEN 'exact' WHEN regexp_extract(u, '\\b([A-Z])\\b', 1) IN ('A','B','C','D') THEN 'isolated'
      WHEN {_sql_letter('output')} IS NOT NULL THEN 'text_match' ELSE 'none' END AS level FROM u""",
)
def resolutions(spark, d):
    return outputs(spark, d).select("id", an.resolution(F.col("output"), F.col("options")).alias("level"))


def _sql_longest(text: str) -> str:
    squeeze = "trim(regexp_replace(upper({0}), '\\s+', ' ', 'g'))"
    found = f"list_filter(list_transform(range(1, 5), lambda i: CASE WHEN {squeeze.format(_SQL_TEXTS + '[i]')} NOT IN ('', 'NONE') AND contains({squeeze.format(text)}, {squeeze.format(_SQL_TEXTS + '[i]')}) THEN {{'n': -len({squeeze.format(_SQL_TEXTS + '[i]')}), 'i': i}} END), lambda x: x IS NOT NULL)"
    return f"substr('ABCD', CAST(list_sort({found})[1].i AS INT), 1)"


_FIXED = """regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '''([^''\\\\]*)''(\\s*[:,}}\\]])', '"\\1"\\2', 'g'), '(:\\s*)([A-Za-z][A-Za-z0-9_\\-]{{0,31}})(\\s*[,}}\\]])', '\\1"\\2"\\3', 'g'), '(:\\s*)"(true|false|null)"(\\s*[,}}\\]])', '\\1\\2\\3', 'g'), ',(\\s*[}}\\]])', '\\1', 'g')"""
_CAUGHT = "'It is ' || output || ' open the drawer. Remove the cup. '"


def _sql_strict(j: str) -> str:
    named = [f"upper({_STRIP.format(f'json_extract_string({j}, chr(36) || chr(46) || {k!r})')})" for k in an.STRICT_KEYS]
    return "coalesce(" + ", ".join(f"CASE WHEN {n} IN ('A','B','C','D') THEN {n} END" for n in named) + ")"


@query(
    "t14_t15_t16_strict",
    f"""WITH t AS ({_BASE}), f AS (SELECT *, {_FENCE.format('output')} AS bare FROM t), r AS (SELECT *, {_FIXED.format('bare')} AS fixed FROM f), j AS (SELECT *, coalesce({_sql_object('bare')}, {_sql_object('fixed')}) AS j FROM r),
    s AS (SELECT *, coalesce({_sql_strict('j')}, list_filter(list_transform(list_filter(regexp_extract_all(bare, '\\{{[^{{}}]*\\}}'), lambda x: json_valid(x)), lambda o: {_sql_strict('o')}), lambda x: x IS NOT NULL)[1]) AS a, {_sql_longest('output')} AS b, {_sql_longest(_CAUGHT)} AS longest FROM j)
    SELECT id, fixed, coalesce(a, b) AS choice, CASE WHEN a IS NOT NULL THEN 'strict' WHEN b IS NOT NULL THEN 'lenient' ELSE 'none' END AS layer, longest FROM s""",
)
def strict(spark, d):
    out = F.col("output")
    got = outputs(spark, d).withColumn("s", an.strict_choice(out, F.col("options")))
    return got.select("id", an.repaired(an.without_fence(out)).alias("fixed"), "s.choice", "s.layer", an.longest_option(F.concat(F.lit("It is "), out, F.lit(" open the drawer. Remove the cup. ")), F.col("options")).alias("longest"))


@query(
    "x1_x2_x3_objects",
    f"""WITH t AS ({_BASE}), o AS (SELECT id, list_filter(regexp_extract_all(output, '\\{{[^{{}}]*\\}}'), lambda x: json_valid(x)) AS o FROM t) SELECT id, len(o) AS n, o[1] AS first, CASE WHEN len(o) > 0 THEN o[len(o)] END AS last, array_to_string(o, '|') AS balanced FROM o""",
)
def objects(spark, d):
    got = outputs(spark, d).select("id", an.json_objects("output").alias("o"), an.balanced_objects("output").alias("b"))
    return got.select("id", F.size("o").cast("bigint").alias("n"), F.get("o", F.lit(0)).alias("first"), F.try_element_at("o", F.lit(-1)).alias("last"), F.concat_ws("|", "b").alias("balanced"))


@query(
    "x9_x10_options",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'A=one,B=two' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'A=' || o_orderstatus || ',B=None' ELSE 'A=' || o_orderstatus || ',B=x' END END AS options, CASE WHEN o_orderkey % 2 = 0 THEN 'A=' || o_orderstatus || ',B=' ELSE 'A=' || o_orderstatus || ',B=x' END AS fixed FROM orders",
)
def options(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey as id", "if(o_orderkey % 3 = 0, map('a', 'one', 'b', 'two'), null) as choices", "array(struct('a' as id, o_orderstatus as text), struct(cast(null as string) as id, 'y' as text), struct('b' as id, if(o_orderkey % 2 = 0, null, 'x') as text)) as options")
    line = lambda o: F.concat_ws(",", F.transform(o, lambda x: F.concat_ws("=", x["id"], x["text"])))
    given = F.transform(F.map_entries("choices"), lambda e: F.struct(F.upper(e["key"]).alias("id"), e["value"].alias("text")))
    return rows.select("id", line(F.coalesce(given, an.option_texts(F.col("options")))).alias("options"), line(an.option_texts(F.col("options"), True)).alias("fixed"))


@query(
    "a33_parser_impact",
    f"""WITH {_PARSED} SELECT count(*) AS n, count_if(base IS DISTINCT FROM coalesce(base, second, third)) AS changed, count_if(base IS DISTINCT FROM expected AND coalesce(base, second, third) = expected) AS to_correct,
      count_if(base = expected AND coalesce(base, second, third) IS DISTINCT FROM expected) AS to_wrong FROM p""",
)
def impact(spark, d):
    return runs.parser_impact(an.with_choices(outputs(spark, d), "output", "options").withColumnsRenamed({"baseline": "before", "choice": "after"}))


@query(
    "a1_summary",
    f"""WITH {_PARSED}, r AS (SELECT id % 7 AS run, output, base, coalesce(base, second, third) AS choice, expected FROM p), q AS (SELECT run, output <> '' AS answered, run = 3 AND choice IS NULL AS failed, choice IS NOT NULL AS ok, base IS NULL AND choice IS NOT NULL AS recovered, coalesce(choice = expected, false) AS correct FROM r)
    SELECT run, count(*) AS total, count_if(answered) AS answered, count_if(failed) AS errors, round(count_if(correct) / count(*), 6) AS accuracy, round(1 - count_if(ok) / count(*), 6) AS parse_failure_rate,
      CASE WHEN count_if(ok) > 0 THEN round(count_if(correct AND ok) / count_if(ok), 6) ELSE 0.0 END AS accuracy_answered, count_if(recovered) AS parse_recovered FROM q GROUP BY run""",
)
def summary(spark, d):
    rows = an.with_choices(outputs(spark, d), "output", "options").selectExpr(
        "id % 7 as run", "output <> '' as answered", "id % 7 = 3 and choice is null as failed", "parse_ok", "parse_recovered", "coalesce(choice = expected, false) as correct"
    )
    return runs.summary(rows, "run")
