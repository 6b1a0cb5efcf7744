"""Intervals, append logs, rollups and labels: queries over events, orders, lineitem and others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import functions as fn
from ..functions import words
from ..operators import labels, runs
from ..sources import LOG, SEGMENTS, VIDEOS, log, segments, table, videos
from .registry import query as _query

_BY = "PARTITION BY file, episode ORDER BY start_frame, end_frame, event_id"
_BEFORE = f"coalesce(max(end_frame + 1) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@_query("w3_overlaps", f"WITH {SEGMENTS} SELECT * FROM (SELECT file, episode, event_id, start_frame, lag(end_frame) OVER ({_BY}) AS previous_end FROM seg) WHERE start_frame < previous_end")
def w3(spark, d):
    return labels.overlaps(segments(spark, d))


@_query(
    "w4_gaps",
    f"""WITH {SEGMENTS}, {VIDEOS} SELECT file, episode, lo, start_frame - 1 AS hi FROM (SELECT *, {_BEFORE} AS lo FROM seg) WHERE start_frame > lo
    UNION ALL SELECT v.file, v.episode, m.reached AS lo, v.frames - 1 AS hi FROM video v JOIN (SELECT file, episode, max(end_frame) + 1 AS reached FROM seg GROUP BY 1, 2) m USING (file, episode) WHERE v.frames > m.reached""",
)
def w4(spark, d):
    return labels.gaps(segments(spark, d), videos(spark, d))


@_query(
    "m14_coverage",
    f"""WITH {SEGMENTS}, {VIDEOS}, c AS (SELECT file, episode, count(*) AS n_segments, arg_max(end_frame, (start_frame, end_frame, event_id)) - min(start_frame) + 1 AS span_frames, CAST(sum(end_frame - start_frame + 1) AS BIGINT) AS labelled_frames FROM seg GROUP BY 1, 2)
    SELECT file, episode, n_segments, span_frames, labelled_frames, round(span_frames / frames, 3) AS span_coverage, round(labelled_frames / frames, 3) AS labelled_fraction FROM c JOIN video USING (file, episode)""",
)
def m14(spark, d):
    return labels.coverage(segments(spark, d), videos(spark, d))


@_query("a12_repeats", f"WITH {SEGMENTS} SELECT file, episode, subtask, count(*) AS n FROM seg GROUP BY ALL HAVING count(*) > 1")
def a12(spark, d):
    return labels.repeats(segments(spark, d))


@_query("a13_same_starts", f"WITH {SEGMENTS} SELECT file, 0 AS episode, start_frame // 2000 AS start_frame, count(*) AS n, min(event_id) AS first_event FROM seg GROUP BY ALL HAVING count(*) > 1")
def a13(spark, d):
    return labels.same_starts(segments(spark, d).withColumn("start_frame", F.expr("start_frame div 2000")).withColumn("episode", F.lit(0)))


#: Texts of the event types as actions, for Spark and DuckDB alike.
ACTIONS = "CASE event_type WHEN 'click' THEN 'Pick up the cup.' WHEN 'purchase' THEN 'Put the cup on table.' WHEN 'view' THEN 'Wipe the bowl with cup.' WHEN 'signup' THEN 'Take a bowl.' ELSE 'Put the tea.' END"


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_type").distinct().selectExpr("event_type as subtask", f"{ACTIONS} as text")


_ACTS = """acts AS (SELECT * FROM (VALUES ('click', 'take', 'cup'), ('purchase', 'put', 'cup'), ('view', 'use', 'bowl'), ('view', 'use', 'cup'), ('signup', 'take', 'bowl')) AS t(subtask, kind, object))"""
_STATE = "coalesce(last_value(CASE kind WHEN 'take' THEN 1 WHEN 'put' THEN 0 END IGNORE NULLS) OVER (PARTITION BY file, episode, object ORDER BY start_frame, end_frame, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@_query(
    "w5_holding",
    f"""WITH {SEGMENTS}, {_ACTS}, h AS (SELECT s.*, kind, object, {_STATE} AS held FROM seg s JOIN acts USING (subtask)),
    f AS (SELECT file, episode, event_id, object, CASE WHEN kind = 'take' AND held = 1 THEN 'take twice' WHEN kind = 'put' AND held = 0 THEN 'put without take' WHEN kind = 'use' AND held = 0 THEN 'use without holding' END AS fault FROM h)
    SELECT file, episode, event_id, fault, string_agg(object, ',' ORDER BY object) AS objects FROM f WHERE fault IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def w5(spark, d):
    return labels.holding(segments(spark, d), vocabulary(spark, d))


@_query(
    "w8_unique_ids",
    f"""WITH {SEGMENTS}, i AS (SELECT event_id, printf('%s_%d@f%06d', family, file % 7, start_frame // 20000) AS id FROM seg)
    SELECT event_id, CASE WHEN n > 1 THEN id || '-' || n ELSE id END AS id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id) AS n FROM i)""",
)
def w8(spark, d):
    return labels.unique_ids(segments(spark, d).withColumn("file", F.col("file") % 7).withColumn("start_frame", F.expr("start_frame div 20000")))


@_query(
    "a44_transitions",
    f"""WITH {SEGMENTS}, s AS (SELECT subtask, lead(subtask) OVER ({_BY}) AS following FROM seg), p AS (SELECT subtask, following, count(*) AS n FROM s WHERE following IS NOT NULL GROUP BY ALL)
    SELECT subtask, following, n, round(n / sum(n) OVER (PARTITION BY subtask), 6) AS share FROM p""",
)
def a44(spark, d):
    return labels.transitions(segments(spark, d))


_BOUNDS = "bounds AS (SELECT file, CAST(episode // 10 AS BIGINT) AS bound, CAST(min(start_frame) AS BIGINT) AS lo, CAST(max(start_frame) AS BIGINT) AS hi FROM seg GROUP BY 1, 2)"


def bounds_of(s: DataFrame) -> DataFrame:
    """Stretches of a file made of ten days each; those of one file overlap."""
    return s.groupBy("file", F.expr("episode div 10").alias("bound")).agg(F.min("start_frame").alias("lo"), F.max("start_frame").alias("hi"))


@_query(
    "j1_episode_of",
    f"""WITH {SEGMENTS}, {_BOUNDS} SELECT s.event_id, coalesce(min(b.bound), 0) AS bound FROM seg s LEFT JOIN bounds b ON s.file = b.file AND s.start_frame >= b.lo - 10 AND s.start_frame <= b.hi + 10 GROUP BY 1""",
)
def j1(spark, d):
    s = segments(spark, d)
    return labels.episode_of(s, bounds_of(s), 10).select("event_id", "bound")


_FINAL = "final AS (SELECT id, ok, seq, user_id, choice, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ok DESC, seq DESC) AS rn FROM log) WHERE rn = 1)"


@_query("w1_final_rows", f"WITH {LOG}, {_FINAL} SELECT * FROM final")
def w1(spark, d):
    return runs.final_rows(log(spark, d))


@_query("w2_completed", f"WITH {LOG} SELECT id FROM log GROUP BY id HAVING bool_or(ok)")
def w2(spark, d):
    return runs.completed(log(spark, d))


@_query(
    "w9_breaker",
    f"""WITH {LOG}, i AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY user_id ORDER BY seq) AS island FROM log),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY seq) AS nth FROM i WHERE NOT ok) SELECT user_id, min(seq) AS broken_at FROM s WHERE nth = 3 GROUP BY 1""",
)
def w9(spark, d):
    return runs.breaker(log(spark, d), "user_id", 3)


@_query(
    "p19_units_up_to",
    """WITH u AS (SELECT user_id, CAST(day(ts) AS BIGINT) AS unit, count(*) AS n FROM events GROUP BY 1, 2),
    b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u) SELECT user_id, unit, n FROM b WHERE before < 20""",
)
def p19(spark, d):
    units = table(spark, d, "events").groupBy("user_id", F.dayofmonth("ts").cast("bigint").alias("unit")).agg(F.count("*").alias("n"))
    return runs.units_up_to(units, "user_id", 20)


@_query("o8_shard", f"WITH {LOG} SELECT DISTINCT id FROM log WHERE CAST(('0x' || md5(id))::UHUGEINT % 7 AS INT) = 2")
def o8(spark, d):
    return runs.shard(log(spark, d).select("id").distinct(), "id", 7, 3)


_ROWS = "r AS (SELECT o_orderkey AS id, o_orderpriority AS run, o_orderstatus AS choice, o_orderstatus <> 'P' AS answered, o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AS correct FROM orders)"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("choice"), F.expr("o_orderstatus <> 'P'").alias("answered"), F.expr("o_orderstatus = 'F' and o_orderkey % 3 <> 0").alias("correct")
    )


@_query(
    "a3_counts_by",
    f"""WITH {_ROWS}, g AS (SELECT 'run' AS kind, run AS value, correct FROM r UNION ALL SELECT 'choice', choice, correct FROM r)
    SELECT kind, coalesce(nullif(value, ''), 'unknown') AS value, count(*) AS total, round(avg(CAST(correct AS INT)), 6) AS accuracy FROM g GROUP BY 1, 2""",
)
def a3(spark, d):
    return runs.counts_by(_rows(spark, d), "run", "choice")


@_query(
    "j4_compare",
    """WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS answer, o_orderkey % 2 = 0 AS correct FROM orders),
    b AS (SELECT l_orderkey + 1 AS id, CASE WHEN count(*) > 2 THEN max(l_linestatus) END AS answer, l_orderkey % 4 = 0 AS correct FROM lineitem GROUP BY l_orderkey)
    SELECT CASE WHEN b.id IS NULL THEN 'only_a' WHEN a.id IS NULL THEN 'only_b' ELSE 'both' END AS side, count(*) AS n,
      count_if(a.answer IS NOT DISTINCT FROM b.answer) AS same_answer, count_if(a.correct IS NOT DISTINCT FROM b.correct) AS same_verdict FROM a FULL JOIN b ON a.id = b.id GROUP BY 1""",
)
def j4(spark, d):
    a = table(spark, d, "orders").selectExpr("o_orderkey as id", "o_orderstatus as answer", "o_orderkey % 2 = 0 as correct")
    b = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.expr("if(count(*) > 2, max(l_linestatus), null)").alias("answer"))
    return runs.compare(a, b.selectExpr("l_orderkey + 1 as id", "answer", "l_orderkey % 4 = 0 as correct"))


@_query(
    "u6_merged",
    """WITH old AS (SELECT s_suppkey AS k, s_nationkey AS item, 'old' AS build FROM supplier), new AS (SELECT c_nationkey AS k, c_custkey AS item, 'new' AS build FROM customer)
    SELECT * FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT * FROM new""",
)
def u6(spark, d):
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("item"), F.lit("old").alias("build"))
    new = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("item"), F.lit("new").alias("build"))
    return runs.merged(old, new, "k")


_INTERVALS = """t AS (SELECT l_returnflag AS run, l_quantity AS s, l_quantity + 10 * (1 + l_tax) AS e, CASE WHEN l_linenumber <> 7 THEN l_quantity + l_linenumber * l_discount * 20 END AS a,
    CASE WHEN l_linenumber <> 7 THEN l_quantity + 8 END AS b FROM lineitem), m AS (SELECT *, a IS NOT NULL AS ok, least(a, b) AS x, greatest(a, b) AS y FROM t),
    v AS (SELECT *, greatest(0.0, least(y, e) - greatest(x, s)) AS both_, greatest(y, e) - least(x, s) AS hull FROM m), w AS (SELECT *, CASE WHEN hull > 0 THEN both_ / hull ELSE 0.0 END AS tiou FROM v)"""


@_query(
    "a5_time_summary",
    f"""WITH {_INTERVALS} SELECT run, count(*) AS total, count_if(ok) AS answered, round(sum(CASE WHEN ok THEN tiou ELSE 0.0 END) / count(*), 6) AS mean_tiou,
    round(count_if(ok AND tiou >= 0.3) / count(*), 6) AS tiou_at_30, round(count_if(ok AND tiou >= 0.5) / count(*), 6) AS tiou_at_50, round(count_if(ok AND tiou >= 0.7) / count(*), 6) AS tiou_at_70,
    round(avg(CASE WHEN ok THEN CAST((x + y) / 2 >= s AND (x + y) / 2 <= e AS DOUBLE) END), 6) AS center_inside, round(avg(CASE WHEN ok THEN CASE WHEN e > s THEN both_ / (e - s) ELSE 0.0 END END), 6) AS overlap_recall,
    round(avg(CASE WHEN ok THEN CAST(both_ > 0 AS DOUBLE) END), 6) AS pointing, round(avg(CASE WHEN ok THEN abs(x - s) END), 6) AS abs_start_error, round(avg(CASE WHEN ok THEN abs(y - e) END), 6) AS abs_end_error FROM w GROUP BY run""",
)
def a5(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "l_returnflag as run", "l_quantity as start", "l_quantity + 10 * (1 + l_tax) as end", "if(l_linenumber <> 7, l_quantity + l_linenumber * l_discount * 20, null) as pred_start", "if(l_linenumber <> 7, l_quantity + 8, null) as pred_end"
    )
    return runs.time_summary(rows, "run")


@_query(
    "a21_letter_balance",
    """WITH c AS (SELECT user_id % 6 AS run, substr('ABCDE', CAST(event_id * event_id % 5 + 1 AS INT), 1) AS letter FROM events),
    n AS (SELECT run, letter, count(*) AS k FROM c GROUP BY 1, 2), t AS (SELECT run, sum(k) AS n FROM n GROUP BY 1), f AS (SELECT t.run, t.n, coalesce(n.k, 0) AS k FROM t CROSS JOIN (SELECT unnest(['A','B','C','D','E']) AS letter) l LEFT JOIN n ON n.run = t.run AND n.letter = l.letter)
    SELECT run, CAST(n AS BIGINT) AS n, round(max(abs((k / n - 0.2) / sqrt(0.2::DOUBLE * (1 - 0.2::DOUBLE) / n))), 6) AS worst_z, round((max(k) - min(k)) / n, 6) AS spread FROM f GROUP BY run, n""",
)
def a21(spark, d):
    e = table(spark, d, "events")
    return runs.letter_balance(e.select((F.col("user_id") % 6).alias("run"), F.expr("substring('ABCDE', cast(event_id * event_id % 5 + 1 as int), 1)").alias("letter")), "run", "letter", "ABCDE")


@_query(
    "a8_totals",
    "SELECT coalesce(n_name, 'all') AS family, count(*) AS n, count_if(c_acctbal > 0) AS usable, round(count_if(c_acctbal > 0) / count(*), 6) AS ratio FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name)",
)
def a8(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    out = joined.rollup("n_name").agg(F.count("*").alias("n"), F.count_if(F.expr("c_acctbal > 0")).alias("usable"))
    return out.select(F.coalesce("n_name", F.lit("all")).alias("family"), "n", "usable", F.round(F.col("usable") / F.col("n"), 6).alias("ratio"))


@_query("a10_cube", "SELECT coalesce(o_orderpriority, 'all') AS family, coalesce(o_orderstatus, 'all') AS task, count(*) AS items FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def a10(spark, d):
    out = table(spark, d, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("items"))
    return out.select(F.coalesce("o_orderpriority", F.lit("all")).alias("family"), F.coalesce("o_orderstatus", F.lit("all")).alias("task"), "items")


_SQL_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\.+$', ''), '\\b(the|a|an)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
_TEXT = "'Pick the ' || p_name || ' from a ' || p_type || '.'"


@_query(
    "t1_label_keys",
    f"""SELECT p_partkey, {_SQL_KEY.format(_TEXT)} AS key, array_to_string(list_filter(regexp_split_to_array(lower({_TEXT}), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ('the', 'a', 'an')), '_') AS id,
    trim(regexp_replace(lower(p_brand || '/' || p_type), '[^a-z0-9]+', '_', 'g'), '_') AS family FROM part""",
)
def t1(spark, d):
    text = F.concat(F.lit("Pick the "), "p_name", F.lit(" from a "), "p_type", F.lit("."))
    return table(spark, d, "part").select("p_partkey", words.key(text).alias("key"), fn.label_id(text).alias("id"), fn.family_name(F.concat_ws("/", "p_brand", "p_type")).alias("family"))


@_query(
    "a37_key_collisions",
    f"WITH k AS (SELECT p_partkey, {_SQL_KEY.format(_TEXT)} AS key FROM part), l AS (SELECT key, p_partkey, lag(p_partkey) OVER (PARTITION BY key ORDER BY p_partkey) AS holder FROM k) SELECT * FROM l WHERE holder IS NOT NULL",
)
def a37(spark, d):
    text = F.concat(F.lit("Pick the "), "p_name", F.lit(" from a "), "p_type", F.lit("."))
    keys = table(spark, d, "part").select("p_partkey", words.key(text).alias("key"))
    return keys.withColumn("holder", F.lag("p_partkey").over(W.partitionBy("key").orderBy("p_partkey"))).filter("holder is not null")


@_query(
    "m2_clocks",
    """WITH x AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS ms FROM lineitem)
    SELECT l_orderkey, l_linenumber, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock, round(ms / 1000, 6) AS seconds FROM x""",
)
def m2(spark, d):
    ms = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    out = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.clock(ms).alias("clock"))
    return out.withColumn("seconds", F.round(fn.seconds_of(F.col("clock")), 6))


_OPTIONS = "['first', 'second', 'third', 'fourth', 'fifth']"


@_query(
    "x15_rotations",
    f"""WITH k AS (SELECT event_id, CAST(('0x' || md5(event_id || '|in'))::UHUGEINT % 5 AS INT) AS k FROM events)
    SELECT event_id, k, array_to_string({_OPTIONS}[k + 1 : 5] || {_OPTIONS}[1 : k], ',') AS options FROM k""",
)
def x15(spark, d):
    k = fn.md5_mod(F.concat(F.col("event_id").cast("string"), F.lit("|in")), 5).cast("int")
    options = F.array(*[F.lit(x) for x in ("first", "second", "third", "fourth", "fifth")])
    return table(spark, d, "events").select("event_id", k.alias("k")).withColumn("options", F.concat_ws(",", fn.rotated(options, F.col("k"))))


@_query("p20_sample", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS n FROM events) WHERE n <= 25")
def p20(spark, d):
    n = F.row_number().over(W.partitionBy("event_type").orderBy(F.md5(F.col("event_id").cast("string").cast("binary")), "event_id"))
    return table(spark, d, "events").select("event_type", "event_id").withColumn("n", n).filter("n <= 25").drop("n")


@_query(
    "x8_path_parts",
    """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages), b AS (SELECT page_id, path, string_split(path, '/') AS a FROM p)
    SELECT page_id, path, a[len(a)] AS name, len(a) AS depth, count(*) OVER (PARTITION BY a[len(a)]) AS holders FROM b""",
)
def x8(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    parts = table(spark, d, "pages").select("page_id", path.alias("path")).withColumn("a", F.split("path", "/"))
    named = parts.select("page_id", "path", F.element_at("a", -1).alias("name"), F.size("a").cast("bigint").alias("depth"))
    counts = named.groupBy("name").agg(F.count("*").alias("holders")).withColumnRenamed("name", "other")
    return named.join(counts, F.col("name").eqNullSafe(F.col("other"))).drop("other")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by family over the final rows of an append log."""
    family = F.concat(F.lit("fam"), (F.col("user_id") % 6).cast("string")).alias("family")
    rows = runs.final_rows(log(spark, sf_dir)).select(
        family, F.col("ok").alias("answered"), (~F.col("ok")).alias("failed"), F.expr("ok and value < 40").alias("parse_ok"), F.expr("ok and value < 4").alias("parse_recovered"), F.expr("ok and choice = 'view'").alias("correct")
    )
    return runs.summary(rows, "family")


_query(
    "leaderboard_accuracy",
    f"""WITH {LOG}, {_FINAL} SELECT 'fam' || (user_id % 6) AS family, count(*) AS total, count_if(ok) AS answered, count_if(NOT ok) AS errors, round(count_if(ok AND choice = 'view') / count(*), 6) AS accuracy,
    round(1 - count_if(ok AND value < 40) / count(*), 6) AS parse_failure_rate, CASE WHEN count_if(ok AND value < 40) > 0 THEN round(count_if(ok AND choice = 'view' AND value < 40) / count_if(ok AND value < 40), 6) ELSE 0.0 END AS accuracy_answered,
    count_if(ok AND value < 4) AS parse_recovered FROM final GROUP BY 1""",
)(flagship)
