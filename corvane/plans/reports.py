"""Plans, costs, leaderboards, exports and paths: queries over the star schema and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports, runs
from ..sources import LOG, log, table
from .core import _FINAL
from .registry import query

_MATRIX = """md AS (SELECT s_name AS model, s_suppkey % 2 = 0 AS local FROM supplier), fa AS (SELECT n_name AS family, n_nationkey % 3 = 0 OR (n_nationkey % 3 = 1 AND n_regionkey % 2 = 0) AS two FROM nation), ru AS (SELECT * FROM (VALUES ('time', true), ('left_right', false), ('step', false)) t(run, video)),
    cells AS (SELECT *, CASE WHEN local AND video THEN unnest([2.0, 8.0]) END AS variant FROM md, fa, ru WHERE local AND video UNION ALL SELECT *, NULL FROM md, fa, ru WHERE NOT (local AND video)),
    k AS (SELECT *, model || '/' || family || '/' || run || '/' || coalesce(CAST(variant AS VARCHAR), 'default') AS key, CASE WHEN run = 'left_right' AND NOT two THEN 'left_right requires two' END AS reason FROM cells)"""


def matrix(spark: SparkSession, d: str, shard: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    models = table(spark, d, "supplier").selectExpr("s_name as model", "s_suppkey % 2 = 0 as local")
    families = table(spark, d, "nation").selectExpr("n_name as family", "if(n_nationkey % 3 < 2, map('two', n_nationkey % 3 = 0 or n_regionkey % 2 = 0), map()) as derived", "map('two', n_nationkey % 3 = 0) as manual")
    kinds = spark.createDataFrame([("time", True), ("left_right", False), ("step", False)], "run string, video boolean")
    return reports.expanded(models, families, kinds, [2.0, 8.0], [("left_right", "two")], shard)


@query("j8_p23_o1_matrix", f"WITH {_MATRIX} SELECT key, model, family, run, CAST(variant AS DOUBLE) AS variant FROM k WHERE reason IS NULL AND CAST(('0x' || md5(key))::UHUGEINT % 4 AS INT) = 1")
def j8(spark, d):
    return matrix(spark, d, (2, 4))[0]


@query("p23_skipped", f"WITH {_MATRIX} SELECT key, reason FROM k WHERE reason IS NOT NULL")
def p23(spark, d):
    return matrix(spark, d)[1]


@query(
    "a18_a39_estimate",
    """WITH r AS (SELECT 'm' || (o_custkey % 5) AS model, o_orderpriority AS family, o_orderstatus AS run, count(*) AS items, count(DISTINCT o_custkey) AS calls FROM orders GROUP BY 1, 2, 3),
    m AS (SELECT DISTINCT o_orderpriority AS family, o_orderstatus AS run, o_orderkey % 100 AS path, CASE WHEN o_orderkey % 100 % 9 <> 0 THEN 1000 + o_orderkey % 100 END AS bytes FROM orders), o AS (SELECT family, run, sum(bytes) AS bytes, count_if(bytes IS NULL) AS missing FROM m GROUP BY 1, 2)
    SELECT model, count(*) AS runs, CAST(sum(items) AS BIGINT) AS items, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(missing) AS BIGINT) AS missing FROM r LEFT JOIN o USING (family, run) GROUP BY ROLLUP (model)""",
)
def a18(spark, d):
    o = table(spark, d, "orders")
    of_runs = o.groupBy(F.expr("concat('m', o_custkey % 5)").alias("model"), F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("run")).agg(F.count("*").alias("items"), F.count_distinct("o_custkey").alias("calls"))
    media = o.selectExpr("o_orderpriority as family", "o_orderstatus as run", "o_orderkey % 100 as path", "if(o_orderkey % 100 % 9 <> 0, 1000 + o_orderkey % 100, null) as bytes")
    return reports.estimate(of_runs, media)


_SUMMARIES = "SELECT p_partkey AS id, 'm' || (p_partkey % 7) AS model, 'v' || (p_partkey % 2) AS variant, CASE p_partkey % 4 WHEN 0 THEN 'time' WHEN 1 THEN 'trajectory_2D' WHEN 2 THEN 'planning' ELSE 'step_order' END AS run, p_size / 100.0 AS accuracy, p_size % 9 / 9.0 AS mean_score, p_size % 5 / 20.0 AS mean_tiou, p_size % 3 / 3.0 AS tiou_at_50, CASE WHEN p_partkey % 31 = 0 THEN 0 ELSE 100 END AS total, CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE 90 END AS answered, CASE WHEN p_partkey % 11 = 0 THEN 10 ELSE 1 END AS errors, CASE WHEN p_partkey % 17 = 0 THEN 0.5 ELSE 0.1 END AS parse_failure_rate FROM part"
_BOARD = f"""s AS ({_SUMMARIES}), v AS (SELECT *, CASE run WHEN 'time' THEN 'tiou_at_50' WHEN 'trajectory_2D' THEN 'mean_score' ELSE 'accuracy' END AS metric, CASE run WHEN 'time' THEN tiou_at_50 WHEN 'trajectory_2D' THEN mean_score ELSE accuracy END AS value FROM s),
    b AS (SELECT *, CASE WHEN answered = 0 THEN NULL WHEN run = 'time' AND mean_tiou < 0.13 THEN 'below mean_tiou 0.13' WHEN run IN ('planning', 'step_order') AND accuracy < 0.25 THEN 'below chance' WHEN value = 0 THEN 'zero' END AS floor,
      CASE WHEN total = 0 THEN NULL WHEN answered = 0 THEN 'nothing answered' WHEN errors / total >= 0.1 THEN 'errors' WHEN parse_failure_rate >= 0.5 THEN 'not parsed' END AS fault FROM v)"""


def board(spark: SparkSession, d: str) -> DataFrame:
    return reports.leaderboard(spark.sql(_SUMMARIES.replace("FROM part", "FROM {part}"), part=table(spark, d, "part")).withColumn("id", F.col("id")).selectExpr("id", "model", "variant", "run", *[f"cast({c} as double) as {c}" for c in ("accuracy", "mean_score", "mean_tiou", "tiou_at_50")], "total", "answered", "errors", "cast(parse_failure_rate as double) as parse_failure_rate"))


@query("a16_a17_k4_leaderboard", f"WITH {_BOARD} SELECT id, model, variant, run, metric, round(CAST(value AS DOUBLE), 6) AS value, floor, fault FROM b")
def a16(spark, d):
    return board(spark, d).select("id", "model", "variant", "run", "metric", F.round("value", 6).alias("value"), "floor", "fault")


@query(
    "k5_markdown_pivot",
    f"""WITH {_BOARD}, m AS (SELECT model, variant, run, arg_min(printf('%.1f', round(CAST(100 * value AS DOUBLE), 1)) || CASE WHEN floor IS NOT NULL THEN '*' ELSE '' END || CASE WHEN fault IS NOT NULL THEN '!' ELSE '' END, id) AS cell FROM b GROUP BY 1, 2, 3)
    SELECT model, variant, {', '.join(f"max(CASE WHEN run = '{r}' THEN cell END) AS {r}" for r in ('time', 'trajectory_2D', 'planning', 'step_order'))} FROM m GROUP BY 1, 2""",
)
def k5(spark, d):
    rows = board(spark, d).groupBy("model", "variant", "run").agg(F.min_by(F.struct("value", "floor", "fault"), "id").alias("r")).select("model", "variant", "run", "r.*")
    return reports.pivoted(rows, ["time", "trajectory_2D", "planning", "step_order"])


@query(
    "k3_j3_export",
    f"WITH {LOG}, {_FINAL}, i AS (SELECT user_id || '/' || day(ts) AS id, min(event_type) AS choice, max(value) AS best FROM events GROUP BY 1) SELECT final.id, coalesce(CASE WHEN ok THEN final.choice END, i.choice) AS choice, round(best, 6) AS best FROM final LEFT JOIN i USING (id)",
)
def k3(spark, d):
    results = runs.final_rows(log(spark, d)).select("id", F.expr("if(ok, choice, null) as choice"))
    items = table(spark, d, "events").groupBy(F.format_string("%d/%d", "user_id", F.dayofmonth("ts")).alias("id")).agg(F.min("event_type").alias("choice"), F.round(F.max("value"), 6).alias("best"))
    return reports.exported(results, items)


@query("k11_j7_j16_orphans", "SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey + p_size % 3 FROM part)")
def k11(spark, d):
    there = table(spark, d, "part").selectExpr("p_partkey + p_size % 3 as key")
    return reports.missing(table(spark, d, "lineitem").selectExpr("l_partkey as key"), there, "key")


@query("a11_reuse", "WITH u AS (SELECT l_returnflag AS kind, l_partkey AS key, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT kind, count(*) AS files, CAST(sum(n) AS BIGINT) AS uses, CAST(sum(n) - count(*) AS BIGINT) AS saved FROM u GROUP BY 1")
def a11(spark, d):
    return reports.reuse(table(spark, d, "lineitem").selectExpr("l_returnflag as kind", "l_partkey as key", "l_orderkey as item"))


@query("p4_p10_media", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'step:1,step:2,step:3' ELSE 'clip,context,frame' END AS roles, CASE WHEN o_orderkey % 4 = 0 THEN 'a' WHEN o_orderkey % 5 = 0 THEN 'b,c' ELSE 'd' END AS paths FROM orders")
def p4(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey as id", "if(o_orderkey % 3 = 0, 'step_order', 'planning') as task", "array('clip', 'video', 'frame') as kinds", "if(o_orderkey % 4 = 0, array('a'), null) as x", "if(o_orderkey % 5 = 0, array('b', 'c'), cast(array() as array<string>)) as y", "array('d') as z")
    return rows.select("id", F.array_join(reports.media_roles(F.col("task"), F.col("kinds")), ",").alias("roles"), F.array_join(reports.first_available(F.col("x"), F.col("y"), F.col("z")), ",").alias("paths"))


# Media paths: files in four folders, and paths that name them in other ways.
_FILE = "'data/f' || (page_id % 3) || CASE page_id % 4 WHEN 0 THEN '/planning/left/' WHEN 1 THEN '/time/left/' WHEN 2 THEN '/time/right/' ELSE '/step_order/top/' END || (page_id % 12) || '.mp4'"
_PATH = "CASE page_id % 7 WHEN 0 THEN {f} WHEN 1 THEN '/out' || chr(92) || 'left' || chr(92) || (page_id % 12) || '.mp4' WHEN 2 THEN '/gen/time/hand/x/' || (page_id % 12) || '.mp4' WHEN 3 THEN 'raw/observation.images.top/' || (page_id % 12) || '.mp4' WHEN 4 THEN 'none/' || page_id || 'x.mp4' WHEN 5 THEN 'notes.txt' ELSE 'deep/planning/left/' || (page_id % 12) || '.MP4' END"


def _sql_resolved() -> str:
    ends = []
    for k in range(2, 7):
        some = f"list_filter(h, lambda f: len(string_split(f, '/')) >= {k} AND list_slice(string_split(f, '/'), -{k}, -1) = list_slice(parts, -{k}, -1))"
        ends.append(f"e{k} AS (SELECT path, parts, words, ex, CASE WHEN len(h) > 1 AND len(parts) >= {k} AND len({some}) > 0 THEN {some} ELSE h END AS h FROM {'j' if k == 2 else f'e{k - 1}'})")
    for k in (1, 2):
        some = f"list_filter(h, lambda f: list_contains(string_split(f, '/'), words[{k}]))"
        ends.append(f"w{k} AS (SELECT path, parts, words, ex, CASE WHEN len(h) > 1 AND len(words) >= {k} AND len({some}) > 0 THEN {some} ELSE h END AS h FROM {'e6' if k == 1 else 'w1'})")
    return ", ".join(ends)


_STAGES = "('" + "', '".join(reports.STAGE_WORDS) + "')"


@query(
    "x8_j17_p18_resolved",
    f"""WITH f AS (SELECT DISTINCT {_FILE} AS file FROM pages), p AS (SELECT DISTINCT {_PATH.format(f=_FILE)} AS path FROM pages), q AS (SELECT path, string_split(replace(path, chr(92), '/'), '/') AS parts FROM p),
    n AS (SELECT string_split(file, '/')[-1] AS name, list(file ORDER BY file) AS files FROM f GROUP BY 1), j AS (SELECT path, parts, list_reverse(list_filter(parts[: -2], lambda x: x IN {_STAGES})) AS words, coalesce(files, []) AS h, list_contains(coalesce(files, []), path) AS ex FROM q LEFT JOIN n ON name = parts[-1]), {_sql_resolved()}
    SELECT path, CASE WHEN NOT regexp_matches(lower(path), '\\.(mp4|jpe?g|png|webp|avi|mov)$') THEN 'no media' WHEN contains(path, 'observation.images') THEN 'provenance' WHEN ex THEN 'exact' WHEN len(h) = 1 THEN 'resolved' WHEN len(h) > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status,
      CASE WHEN NOT regexp_matches(lower(path), '\\.(mp4|jpe?g|png|webp|avi|mov)$') OR contains(path, 'observation.images') THEN NULL WHEN ex THEN path WHEN len(h) = 1 THEN h[1] END AS found FROM w2""",
)
def x8b(spark, d):
    pages = table(spark, d, "pages")
    paths = spark.sql(f"SELECT {_PATH.format(f=_FILE)} AS path FROM {{p}}", p=pages)
    return reports.resolved(paths, spark.sql(f"SELECT {_FILE} AS file FROM {{p}}", p=pages))
