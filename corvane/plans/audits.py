"""Shortcut audits: queries over choice questions made of orders, parts and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits
from ..sources import table
from .registry import query

_Z = "CASE WHEN {n} > 0 THEN round(({h} / {n} - {p}) / sqrt({p}::DOUBLE * (1 - {p}::DOUBLE) / {n}), 6) ELSE 0.0 END"

# Four options of one to four words, the answer's number, and a letter.
_TEXTS = ["'cup'", "'the ' || o_orderstatus", "CASE WHEN o_orderkey % 50 = 0 THEN '' WHEN o_orderkey % 9 = 0 THEN 'cup' ELSE 'take  it now' END", "CASE WHEN o_orderkey % 3 = 0 THEN 'put it on table' ELSE 'put it' END"]
_ITEMS = f"it AS (SELECT o_orderkey AS id, 'f' || (o_custkey % 6) AS family, o_orderstatus AS run, [{', '.join(_TEXTS)}] AS options, CAST((o_orderkey * 7 + o_custkey) % 4 AS INT) AS answer FROM orders)"


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey as id", "concat('f', o_custkey % 6) as family", "o_orderstatus as run", f"array({', '.join(_TEXTS)}) as options", "cast((o_orderkey * 7 + o_custkey) % 4 as int) as answer")


@query("a14_distribution", f"WITH {_ITEMS}, c AS (SELECT run, substr('ABCD', answer + 1, 1) AS letter, count(*) AS n FROM it GROUP BY 1, 2) SELECT *, round(n / sum(n) OVER (PARTITION BY run), 6) AS share FROM c")
def a14(spark, d):
    return audits.distribution(items(spark, d).withColumn("letter", F.substring(F.lit("ABCD"), F.col("answer") + 1, F.lit(1))), "run", "letter")


@query(
    "a22_unique_longest",
    f"""WITH {_ITEMS}, n AS (SELECT run, answer, list_transform(options, lambda o: len(regexp_split_to_array(trim(o), '\\s+'))) AS n FROM it WHERE len(list_filter(options, lambda o: o = '')) = 0),
    h AS (SELECT run, count(*) AS n, count_if(n[answer + 1] = list_max(n) AND len(list_filter(n, lambda x: x = list_max(n))) = 1) AS hits FROM n GROUP BY 1) SELECT run, n, hits, {_Z.format(h='hits', n='n', p='0.25')} AS z FROM h""",
)
def a22(spark, d):
    return audits.unique_longest(items(spark, d), "run")


@query(
    "a27_largest",
    f"""WITH x AS (SELECT o_orderstatus AS run, [o_orderkey % 11, CASE WHEN o_orderkey % 8 <> 0 THEN o_custkey % 9 END, 5, 6] AS s, CAST(o_orderkey % 4 AS INT) AS a FROM orders),
    h AS (SELECT run, count(*) AS n, count_if(s[a + 1] = list_max(s) AND len(list_filter(s, lambda v: v = list_max(s))) = 1) AS hits FROM x WHERE s[2] IS NOT NULL GROUP BY 1) SELECT run, n, hits, {_Z.format(h='hits', n='n', p='0.25')} AS z FROM h""",
)
def a27(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderstatus as run", "array(o_orderkey % 11, if(o_orderkey % 8 <> 0, o_custkey % 9, null), 5, 6) as sizes", "cast(o_orderkey % 4 as int) as answer")
    return audits.largest(rows, "run")


@query(
    "a23_permutation_balance",
    "WITH c AS (SELECT o_orderkey * o_orderkey % 7 AS k, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT sum(n) AS total, count(*) AS kinds FROM c) SELECT CAST(total AS BIGINT) AS total, kinds, round(max(abs((n / total - 1 / kinds) / sqrt(1 / kinds * (1 - 1 / kinds) / total))), 6) AS worst_z FROM c, w GROUP BY 1, 2",
)
def a23(spark, d):
    return audits.kinds_balance(table(spark, d, "orders").selectExpr("o_orderkey * o_orderkey % 7 as k"), "k")


@query("a24_duplicates", f"WITH {_ITEMS}, t AS (SELECT run, list_filter(options, lambda o: o <> '') AS o FROM it) SELECT run, count(*) AS n, count_if(len(list_distinct(o)) < len(o)) AS bad FROM t GROUP BY 1")
def a24(spark, d):
    return audits.duplicated(items(spark, d), "run")


@query("a25_sides", f"WITH h AS (SELECT count(*) AS n, count_if((o_orderkey * 3 + o_custkey) % 5 < 2) AS hits FROM orders) SELECT n, hits, {_Z.format(h='hits', n='n', p='0.5')} AS z FROM h")
def a25(spark, d):
    return audits.sides(table(spark, d, "orders").selectExpr("if((o_orderkey * 3 + o_custkey) % 5 < 2, 'the left camera', 'the leftmost camera') as q"), "q")


@query(
    "a26_borrowed",
    """WITH own AS (SELECT DISTINCT p_brand AS family, p_name AS text FROM part), i AS (SELECT p_brand AS family, p_name AS answer, unnest(['box', upper(p_name), p_name, p_type]) AS t FROM part)
    SELECT i.family, count(*) AS n, count_if(o.text IS NULL) AS borrowed, count_if(o.text IS NOT NULL AND t = answer) AS clash, count_if(o.text IS NULL AND EXISTS (SELECT 1 FROM own w WHERE w.family = i.family AND lower(w.text) = lower(t))) AS near_clash
    FROM i LEFT JOIN own o ON o.family = i.family AND o.text = t GROUP BY 1""",
)
def a26(spark, d):
    part = table(spark, d, "part")
    own = part.selectExpr("p_brand as family", "p_name as text").distinct()
    return audits.borrowed(part.selectExpr("p_brand as family", "p_name as answer", "array('box', upper(p_name), p_name, p_type) as distractors"), own)


_MAD = "list_avg(list_transform(range(1, 65), lambda q: abs(v[{0}][q] - v[{1}][q])))"


@query(
    "a28_outliers",
    f"""WITH i AS (SELECT vec_id // 4 AS item, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) AS v FROM embeddings GROUP BY 1 HAVING count(*) = 4), t AS (SELECT item, [{', '.join('round(' + ' + '.join(_MAD.format(a, b) for b in range(1, 5)) + ', 9)' for a in range(1, 5))}] AS t FROM i),
    h AS (SELECT item % 3 AS family, count(*) AS n, count_if(list_position(t, list_max(t)) - 1 = item % 4) AS hits FROM t GROUP BY 1) SELECT family, n, hits, round(hits / n - 0.25, 6) AS gain FROM h""",
)
def a28(spark, d):
    rows = table(spark, d, "embeddings").selectExpr("vec_id div 4 as item", "vec_id", "cast(embedding as array<double>) as e").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("vec_id", "e"))).alias("v")).filter("size(v) = 4")
    return audits.outliers(rows.selectExpr("item % 3 as family", "transform(v, x -> x.e) as vectors", "cast(item % 4 as int) as answer"), "family")


_ANSWERED = "SELECT 'f' || (o_custkey % 6) AS family, 'act' || ((o_orderkey % 7) * (o_custkey % 6) % 9) AS action FROM orders"


@query(
    "a29_u7_coverage",
    f"""WITH a AS ({_ANSWERED}), d AS (SELECT 'f' || f AS family, 'act' || k AS action FROM range(6) x(f), range(9) y(k)), c AS (SELECT family, action, count(*) AS n FROM a GROUP BY 1, 2), t AS (SELECT family, round(max(n) / sum(n), 6) AS top_share FROM c GROUP BY 1)
    SELECT d.family, count(*) AS actions, count_if(c.n IS NULL) AS never, any_value(t.top_share) AS top_share FROM d LEFT JOIN c USING (family, action) LEFT JOIN t ON t.family = d.family GROUP BY 1""",
)
def a29(spark, d):
    defined = spark.range(54).selectExpr("concat('f', id div 9) as family", "concat('act', id % 9) as action")
    return audits.coverage(table(spark, d, "orders").selectExpr("concat('f', o_custkey % 6) as family", "concat('act', (o_orderkey % 7) * (o_custkey % 6) % 9) as action"), defined)


@query(
    "a30_most_frequent",
    f"""WITH a AS ({_ANSWERED}), c AS (SELECT family, action, count(*) AS k FROM a GROUP BY 1, 2), r AS (SELECT *, sum(k) OVER (PARTITION BY family) AS n, count(*) OVER (PARTITION BY family) AS kinds, row_number() OVER (PARTITION BY family ORDER BY k DESC, action) AS rn FROM c)
    SELECT family, action, k AS hits, CAST(n AS BIGINT) AS n, CASE WHEN kinds > 1 THEN round((k / n - 1 / kinds) / sqrt(1 / kinds * (1 - 1 / kinds) / n), 6) ELSE 0.0 END AS z FROM r WHERE rn = 1""",
)
def a30(spark, d):
    return audits.most_frequent(table(spark, d, "orders").selectExpr("concat('f', o_custkey % 6) as family", "concat('act', (o_orderkey % 7) * (o_custkey % 6) % 9) as action"))


@query(
    "a31_blind_bound",
    """WITH x AS (SELECT list_filter(['1-2-3','1-3-2','2-1-3','2-3-1','3-1-2'], lambda t: t <> ['1-2-3','1-3-2','2-1-3','2-3-1','3-1-2'][CAST(o_custkey % 5 AS INT) + 1]) AS o, o_orderkey FROM orders), i AS (SELECT o, o[CAST(o_orderkey % 7 % 4 AS INT) + 1] AS a, substr('ABCD', CAST(o_orderkey % 7 % 4 AS INT) + 1, 1) AS letter FROM x),
    t AS (SELECT unnest(['1-2-3','1-3-2','2-1-3','2-3-1','3-1-2']) AS t), p AS (SELECT [a.t, b.t, c.t, d.t, e.t] AS w FROM t a, t b, t c, t d, t e WHERE len(list_distinct([a.t, b.t, c.t, d.t, e.t])) = 5), k AS (SELECT o, a, count(*) AS n FROM i GROUP BY 1, 2),
    h AS (SELECT w, sum(CASE WHEN list_filter(w, lambda t: list_contains(o, t))[1] = a THEN n ELSE 0 END) / sum(n) AS hit FROM p, k GROUP BY 1), l AS (SELECT max(n) AS most, sum(n) AS total FROM (SELECT letter, count(*) AS n FROM i GROUP BY 1))
    SELECT round(hit, 6) AS best, w[1] AS favourite, round(most / total, 6) AS letter FROM h, l ORDER BY hit DESC, w LIMIT 1""",
)
def a31(spark, d):
    five = "array('1-2-3', '1-3-2', '2-1-3', '2-3-1', '3-1-2')"
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey", f"filter({five}, t -> t <> {five}[cast(o_custkey % 5 as int)]) as options")
    rows = rows.selectExpr("options", "options[cast(o_orderkey % 7 % 4 as int)] as answer_text", "substr('ABCD', cast(o_orderkey % 7 % 4 as int) + 1, 1) as letter")
    return audits.blind_bound(rows, ["1-2-3", "1-3-2", "2-1-3", "2-3-1", "3-1-2"])


@query(
    "a19_blind",
    """WITH b AS (SELECT 'p' || (o_orderkey % 3) AS policy, 'f' || (o_custkey % 6) AS family, o_orderstatus AS task, o_orderkey % 4 AS picked, o_custkey % 4 AS answer, 3 + o_orderkey % 3 AS n_options FROM orders WHERE o_orderkey % 10 <> 0)
    SELECT coalesce(policy, 'all') AS policy, coalesce(family, 'all') AS family, coalesce(task, 'all') AS task, count(*) AS n, round(avg(CAST(picked = answer AS INT)), 6) AS rate, round(avg(1 / n_options), 6) AS base FROM b GROUP BY CUBE (policy, family, task)""",
)
def a19(spark, d):
    rows = table(spark, d, "orders").selectExpr("concat('p', o_orderkey % 3) as policy", "concat('f', o_custkey % 6) as family", "o_orderstatus as task", "if(o_orderkey % 10 <> 0, o_orderkey % 4, null) as picked", "o_custkey % 4 as answer", "3 + o_orderkey % 3 as n_options")
    return audits.blind(rows)


@query(
    "a43_stratified",
    "WITH r AS (SELECT o_orderkey % 2 = 0 AS correct, CASE WHEN o_custkey % 3 = 0 THEN 'a' ELSE 'b' END AS chosen, CASE WHEN o_orderkey % 5 < 2 THEN 'a' ELSE 'z' END AS cur FROM orders) SELECT cur = 'a' AS current_is_option, count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS accuracy, round(avg(CAST(chosen = cur AS INT)), 6) AS chose_current FROM r GROUP BY 1",
)
def a43(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey % 2 = 0 as correct", "if(o_custkey % 3 = 0, 'a', 'b') as chosen_text", "if(o_orderkey % 5 < 2, 'a', 'z') as current_text", "array('a', 'b') as options")
    return audits.stratified(rows)


@query("a34_w16_completeness", "WITH c AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem) SELECT size, l_linenumber AS position, count(*) AS asked, count_if(l_returnflag <> 'R') AS got, round(count_if(l_returnflag <> 'R') / count(*), 6) AS rate FROM c GROUP BY GROUPING SETS ((size), (size, l_linenumber))")
def a34(spark, d):
    line = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber as position", "l_returnflag <> 'R' as hit")
    return audits.completeness(line.join(line.groupBy("l_orderkey").agg(F.count("*").alias("size")), "l_orderkey"))


@query("a4_chosen_types", "SELECT o_orderpriority AS kind, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def a4(spark, d):
    return audits.chosen_types(table(spark, d, "orders").selectExpr("if(o_orderstatus = 'F', '', o_orderpriority) as kind"), "kind")
