"""Gates and small rules: queries over orders, lineitem, events and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frame_time
from ..functions import intervals as iv
from ..operators import gates
from ..sources import SEGMENTS, located, segments, table
from .registry import query


@query("p17_m10_keys", f"WITH {SEGMENTS} SELECT event_id, printf('%s/%s/main/clip/%06d-%06d', family, 'e' || episode, start_frame, end_frame) AS key, round(start_frame / 20.0::DOUBLE, 3) AS start, 0.0 AS none FROM seg")
def p17(spark, d):
    s = segments(spark, d)
    key = gates.media_key(F.col("family"), F.concat(F.lit("e"), F.col("episode").cast("string")), F.lit("main"), "clip", F.col("start_frame"), F.col("end_frame"))
    return s.select("event_id", key.alias("key"), frame_time(F.col("start_frame"), F.lit(20.0)).alias("start"), frame_time(F.col("start_frame"), F.lit(0.0)).alias("none"))


@query("p21_truth_leaks", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0")
def p21(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey as id", "array('stem', if(o_orderkey % 7 = 0, 'Truth', 'media')) as prompt_keys", "array('id', if(o_orderkey % 11 = 0, 'LABEL', 'text')) as option_keys")
    return gates.truth_leaks(rows).select("id")


@query("p22_unfit", "SELECT o_orderkey AS id, 'times in the input' AS rule FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT o_orderkey, 'answer no option' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'options twice' FROM orders WHERE o_orderkey % 4 = 0")
def p22(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey as id", "if(o_orderkey % 5 = 0, 'E', 'A') as answer", "array('A', 'B') as option_ids", "array('clip_path', if(o_orderkey % 6 = 0, 'start', 'view')) as input_keys", "repeat('x\nOptions:\nA. y', cast(if(o_orderkey % 4 = 0, 2, 1) as int)) as question")
    return gates.unfit(rows)


_TASK = "CASE o_orderkey % 5 WHEN 0 THEN 'time' WHEN 1 THEN 'step_order' WHEN 2 THEN 'left_right' WHEN 3 THEN 'image_in_video' ELSE 'planning' END"


@query("p7_blinded", f"SELECT o_orderkey AS id, {_TASK} AS task, CAST(NULL AS VARCHAR) AS input FROM orders WHERE o_orderkey % 5 IN (2, 3)")
def p7(spark, d):
    return gates.blinded(table(spark, d, "orders").selectExpr("o_orderkey as id", f"{_TASK} as task", "o_orderpriority as input"))


@query(
    "p2_p6_consumed",
    f"""SELECT o_orderkey AS id, o_orderpriority || '/e' || (o_custkey % 9) AS video_id, {_TASK} AS type, 'B' AS answer, CASE o_orderkey % 5 WHEN 0 THEN 'video_path' WHEN 1 THEN 'image_paths' WHEN 2 THEN 'image_path' ELSE 'clip_path' END AS input_key,
    CASE WHEN o_orderkey % 5 = 1 THEN 'a,b,c' ELSE 'a' END AS input, CASE WHEN o_orderkey % 5 = 0 THEN round(o_totalprice / 7, 3) END AS video_seconds FROM orders""",
)
def p6(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey as id", "o_orderpriority as family", "concat('e', o_custkey % 9) as episode", f"{_TASK} as task", "'B' as answer", "array('a', 'b', 'c') as media", "o_totalprice / 7 as seconds")
    return gates.consumed(rows)


@query(
    "v29_v30_sizes",
    "WITH x AS (SELECT p_partkey, 200 + p_size * 37 AS w, 150 + p_size * 11 AS h, p_partkey % 2 = 0 AS b FROM part), y AS (SELECT *, CASE WHEN b THEN h - 24 ELSE h END AS u, sqrt(100000.0::DOUBLE / (w * CASE WHEN b THEN h - 24 ELSE h END)) AS f FROM x) SELECT p_partkey, greatest(2, CAST(round_even(w * f, 0) AS BIGINT) // 2 * 2) AS width, greatest(2, CAST(round_even(u * f, 0) AS BIGINT) // 2 * 2) AS height, w >= 3 * h AND w % 3 = 0 AS joined FROM y",
)
def v29(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", "200 + p_size * 37 as w", "150 + p_size * 11 as h", "p_partkey % 2 = 0 as b")
    return rows.select("p_partkey", gates.scaled_size(F.col("w"), F.col("h"), F.col("b"), 24, 100000).alias("s"), gates.is_joined(F.col("w"), F.col("h")).alias("joined")).select("p_partkey", "s.*", "joined")


@query("x13_layouts", "WITH f AS (SELECT p_brand AS family, max(p_size % 4 - CASE WHEN p_brand < 'Brand#3' THEN 1 ELSE 3 END) AS d FROM part GROUP BY 1) SELECT family, CASE WHEN d <= 0 THEN 'flat' WHEN d = 1 THEN 'nested' ELSE 'scattered' END AS layout, CASE WHEN d <= 0 THEN 'legacy' WHEN d = 1 THEN 'n/a' ELSE 'current' END AS version FROM f")
def x13(spark, d):
    depths = table(spark, d, "part").selectExpr("p_brand as family", "greatest(p_size % 4 - if(p_brand < 'Brand#3', 1, 3), 0) as depth")
    rows = gates.layout(depths).withColumn("run", F.expr("if(layout = 'nested', 'time', 'planning')")).withColumn("keys", F.expr("if(layout = 'flat', array('clips', 'x'), array('view_order'))"))
    return rows.select("family", "layout", gates.schema_version(F.col("run"), F.col("keys")).alias("version"))


@query("g12_picked", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'A' WHEN 2 THEN 'C' END AS picked FROM orders")
def g12(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey as id", "case o_orderkey % 4 when 0 then ' \"Put the cup.\" ' when 1 then 'I say pick the cup. Surely' when 2 then 'WIPE.' else 'no idea' end as reply", "array('Pick the cup.', 'Put the cup.', 'Wipe.') as options")
    return rows.select("id", gates.picked_by_text(F.col("reply"), F.col("options")).alias("picked"))


@query("j19_all_different", "SELECT p_brand AS family, p_name AS candidate FROM part GROUP BY 1, 2 HAVING bool_and(p_size % 5 <> 0)")
def j19(spark, d):
    return gates.all_different(table(spark, d, "part").selectExpr("p_brand as family", "p_name as candidate", "p_partkey as other", "if(p_size % 5 <> 0, 'different', 'same') as verdict"))


@query(
    "j18_chained",
    """WITH r AS (SELECT l_orderkey AS unit, l_linenumber - 1 AS place, CASE WHEN l_linenumber % 3 = 0 THEN 'q' || (l_linenumber - 1) ELSE 'other' END AS own, CASE WHEN l_linenumber % 3 = 1 THEN 2 END AS hint FROM lineitem), q AS (SELECT DISTINCT l_orderkey AS unit, l_linenumber AS position, CASE WHEN l_linenumber < 6 THEN 'q' ELSE 'z' END || l_linenumber AS question FROM lineitem)
    SELECT r.unit, place, coalesce(a.question, b.question) AS question FROM r LEFT JOIN q a ON a.unit = r.unit AND a.question = own LEFT JOIN q b ON b.unit = r.unit AND b.position = coalesce(hint, place + 1)""",
)
def j18(spark, d):
    line = table(spark, d, "lineitem")
    rows = line.selectExpr("l_orderkey as unit", "l_linenumber - 1 as at", "if(l_linenumber % 3 = 0, concat('q', l_linenumber - 1), 'other') as own", "if(l_linenumber % 3 = 1, 2, null) as hint")
    return gates.chained(rows, line.selectExpr("l_orderkey as unit", "l_linenumber as position", "concat(if(l_linenumber < 6, 'q', 'z'), l_linenumber) as question")).selectExpr("unit", "at as place", "question")


_REPLY = """CASE o_orderkey % 6 WHEN 0 THEN '[{"id": "b", "start": 1, "end": "0:09"}, {"index": 1, "answer": "2 to 4.5"}]' WHEN 1 THEN '{"answers": [{"start_time": 3, "end_time": 5}, {"id": "2", "interval": "7, 8"}]}' WHEN 2 THEN '```json' || chr(10) || '{"a": "0:01 - 0:02", "x": 5}' || chr(10) || '```'
  WHEN 3 THEN 'a: from 3 – 4' || chr(10) || 'b is 5 to 6.5' WHEN 4 THEN 'none' ELSE '[{"id": "a", "start": "soon", "end": 2}]' END"""


@query(
    "m8_several_intervals",
    """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'a:2.0-4.5|b:1.0-9.0' WHEN 1 THEN 'a:3.0-5.0|b:7.0-8.0' WHEN 2 THEN 'a:1.0-2.0' WHEN 3 THEN 'a:3.0-4.0|b:5.0-6.5' END AS found FROM orders""",
)
def m8(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey as id", f"{_REPLY} as reply", "array('a', 'b') as ids").withColumn("got", iv.several_intervals(F.col("reply"), F.col("ids")))
    text = F.array_join(F.transform("got", lambda x: F.concat(x["id"], F.lit(":"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), "|")
    return rows.select("id", text.alias("found"))


@query("s9_located", "WITH c AS (SELECT p_brand AS family, p_type AS run, p_size AS depth, min(p_partkey) AS k FROM part GROUP BY 1, 2, 3) SELECT family, run, arg_min('f' || k, depth) AS path FROM c GROUP BY 1, 2")
def s9(spark, d):
    one = table(spark, d, "part").groupBy(F.col("p_brand").alias("family"), F.col("p_type").alias("run"), F.col("p_size").alias("depth")).agg(F.concat(F.lit("f"), F.min("p_partkey").cast("string")).alias("path"))
    return located(one)


@query("u1_u8_unions", "SELECT family, count(*) AS n FROM (SELECT DISTINCT * FROM (SELECT p_brand AS family FROM part UNION ALL SELECT p_type FROM part) UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part) GROUP BY 1")
def u1(spark, d):
    part = table(spark, d, "part")
    bag = part.selectExpr("p_brand as family").unionByName(part.selectExpr("p_type as family"))
    return bag.distinct().unionByName(bag).groupBy("family").agg(F.count("*").alias("n"))
