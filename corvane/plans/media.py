"""Points in answers, media, families and blind options: queries over orders, part, nation, customer and supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import points
from ..operators import blind, families, media
from ..sources import table
from .questions import _WORDS
from .registry import query

_HANDS = """CASE o_orderkey % 5 WHEN 0 THEN '{"left_gripper": [[1, 2], [3, 4.5]], "right": {"points": [{"u": 5, "v": 6}, {"u": 7}]}}' WHEN 1 THEN '```json' || chr(10) || '{"left": [1, 2, 9], "right_gripper": [], "right_trajectory": [["7", 8], [9]]}' || chr(10) || '```'
  WHEN 2 THEN 'So: {"left_gripper_points": [[1, null], [2, 3]]} it is' WHEN 3 THEN '[{"left": [[1, 2]]}]' ELSE 'none' END"""


def _text(found):
    return F.array_join(F.transform(found, lambda p: F.array_join(F.transform(p, lambda x: x.cast("string")), ",")), "|")


@query("x4_x5_hands", "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '1.0,2.0|3.0,4.5' WHEN 1 THEN '1.0,2.0' WHEN 2 THEN '2.0,3.0' ELSE '' END AS left_points, CASE o_orderkey % 5 WHEN 0 THEN '5.0,6.0' WHEN 1 THEN '7.0,8.0' ELSE '' END AS right_points FROM orders")
def x4(spark, d):
    rows = points.with_hands(table(spark, d, "orders").selectExpr("o_orderkey as id", f"{_HANDS} as reply"), "reply", 2)
    return rows.select("id", _text("left_gripper").alias("left_points"), _text("right_gripper").alias("right_points"))


_PROSE = """CASE o_orderkey % 6 WHEN 0 THEN 'a [[10, 20], [30, 40]] or [[1, 2], [3, 4], [50, 60]]' WHEN 1 THEN 'go (10, 20), (30, 40) then (5, 6)' WHEN 2 THEN '[[0.1, 0.2], [0.3, 0.4]]' WHEN 3 THEN '[[10, 20, 30, 40]]' WHEN 4 THEN 'nothing' ELSE '[[10, 20], ["x", 5], [30, 40]]' END"""


@query("x6_in_prose", "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN '1.0,2.0|3.0,4.0|50.0,60.0' WHEN 1 THEN '10.0,20.0|30.0,40.0' WHEN 3 THEN '10.0,20.0|30.0,40.0' WHEN 5 THEN '10.0,20.0|30.0,40.0' END AS found FROM orders")
def x6(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey as id", f"{_PROSE} as reply")
    return rows.select("id", _text(points.in_prose(F.col("reply"), 2, F.lit(2), F.lit(640), F.lit(480))).alias("found"))


_ITEM = """'{"question": "see f1.mp4", "input": {"clip_path": "/made/f' || (p_size % 10) || '.mp4", "left_eye": "/made/f2.mp4", "image_paths": ["x/g' || (p_size % 10) || '.JPG", "words"]}, "from": "v/observation.images.top/f1.mp4"}'"""


@query(
    "x7_relocated",
    "SELECT p_partkey AS id, CASE WHEN p_size % 10 < 5 THEN 'data/f' ELSE '/made/f' END || (p_size % 10) || '.mp4' AS clip, CASE WHEN p_size % 10 >= 5 THEN 'data/g' ELSE 'x/g' END || (p_size % 10) || '.JPG' AS image, 'see f1.mp4' AS question, '/made/f2.mp4' AS eye, 'v/observation.images.top/f1.mp4' AS raw FROM part",
)
def x7(spark, d):
    part = table(spark, d, "part")
    files = part.selectExpr("if(p_size % 10 < 5, concat('data/f', p_size % 10, '.mp4'), concat('data/g', p_size % 10, '.JPG')) as file")
    at = lambda path, name: F.get_json_object("item", path).alias(name)
    return media.relocated(part.selectExpr("p_partkey as id", f"{_ITEM} as item"), files).select("id", at("$.input.clip_path", "clip"), at("$.input.image_paths[0]", "image"), at("$.question", "question"), at("$.input.left_eye", "eye"), at("$.from", "raw"))


@query(
    "p11_parts",
    """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'text:Head camera image:|image:a|text:Candidate options:|text:Option A image:|image:oa|text:Option B: none of them' WHEN 1 THEN 'text:Left-eye video clip:|video:v|text:Candidate option images:|text:Option A image:|image:oa|text:Option B: none of them'
      WHEN 2 THEN 'text:Image 1:|image:a|text:Image 2:|image:b' WHEN 3 THEN 'image:a|image:b' WHEN 4 THEN 'video:v|video:w' ELSE 'image:s|image:a' END || '|text:Which?' AS parts FROM orders""",
)
def p11(spark, d):
    task = "case o_orderkey % 6 when 0 then 'left_right' when 1 then 'image_in_video' when 2 then 'step_order' when 3 then 'planning_2' when 4 then 'understanding' else 'step_order' end"
    options = "array(named_struct('id', 'a', 'text', 'x', 'image_path', 'oa', 'none', false), named_struct('id', 'b', 'text', 'none of them', 'image_path', cast(null as string), 'none', true))"
    rows = table(spark, d, "orders").selectExpr("o_orderkey as id", f"{task} as task", "'Which?' as prompt", "array('v', 'w') as videos", "array('a', 'b') as images", "if(o_orderkey % 6 = 5, 's', null) as first", f"{options} as options")
    found = media.media_parts(*[F.col(c) for c in ("task", "prompt", "videos", "images", "first", "options")])
    return rows.select("id", F.array_join(F.transform(found, lambda p: F.concat_ws(":", p["kind"], p["value"])), "|").alias("parts"))


@query(
    "s7_s8_episodes",
    """SELECT n_name AS family, s_suppkey AS number FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 5 NOT IN (0, 1) AND n_nationkey IN (SELECT (c_nationkey * 2) % 25 FROM customer) AND (n_regionkey = 0 OR s_suppkey < n_regionkey * 20)""",
)
def s7(spark, d):
    registry = table(spark, d, "nation").selectExpr("n_nationkey as key", "n_name as family", "case n_nationkey % 5 when 0 then 'excluded' when 1 then 'parked' when 2 then null else 'active' end as status", "if(n_regionkey = 0, null, n_regionkey * 20) as cap")
    sources = table(spark, d, "customer").selectExpr("(c_nationkey * 2) % 25 as key").distinct().join(registry.select("key", "family"), "key")
    kept = families.active(registry, sources)
    episodes = table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("number")).join(kept.select("key", "family"), "key")
    return families.below_cap(episodes, kept).select("family", "number")


@query("s17_views", "SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'main_right' WHEN 2 THEN 'wrist_left' WHEN 3 THEN 'wrist_right' END AS view FROM part")
def s17(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), families.view_of(F.expr("case p_size % 5 when 0 then 'cam_color' when 1 then 'right_eye' when 2 then 'wrist_L' when 3 then 'right_wrist' else 'roof' end")).alias("view"))


@query("j20_environments", "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'e' || (s_suppkey % 2) ELSE 'base' END AS env, string_agg(s_name, ',' ORDER BY s_suppkey) AS models FROM supplier GROUP BY 1")
def j20(spark, d):
    supplier = table(spark, d, "supplier")
    environments = supplier.filter("s_suppkey % 3 = 0").selectExpr("s_name as model", "concat('e', s_suppkey % 2) as env")
    return families.by_environment(supplier.selectExpr("s_name as model", "s_suppkey as at"), environments, "base").withColumn("models", F.array_join("models", ","))


# Families of three actions, which borrow, and of six.
_FEW = ("Pick the cup.", "Wipe the long table.", "Pour it.")
_MANY = (*_FEW, "Open the old blue box.", "Take a tray.", "Put the lid on the pot.")
_OUTSIDE = ("Fold the towel.", "Shut the small grey drawer.", "Stir.", "Cut the red apple.")
_POOL = ("Pour the cup.", "Wipe it.", "Pick the long table.")
_ARRAY = lambda texts: "array(" + ", ".join(f"'{t}'" for t in texts) + ")"
_LIST = lambda texts: "[" + ", ".join(f"'{t}'" for t in texts) + "]"


def _sql_turned(texts: str, by: str) -> str:
    k = f"CAST(('0x' || md5({by}))::UHUGEINT % CAST(len({texts}) AS UHUGEINT) AS INT)"
    return f"list_concat({texts}[{k} + 1 :], {texts}[: {k}])"


def _sql_nearest(texts: str) -> str:
    return f"list_transform(list_sort(list_transform(range(1, len({texts}) + 1), lambda z: {{'d': abs({_WORDS.format(texts + '[z]')} - {_WORDS.format('answer')}), 'i': z}})), lambda r: {texts}[r.i])"


_POLICIES = ("as_built", "allreal", "three", "pool", "cross", "four")


@query(
    "g11_blind_options",
    f"""WITH a AS (SELECT o_orderkey AS id, 'i' || o_orderkey AS item, CASE WHEN o_orderkey % 2 = 0 THEN {_LIST(_FEW)} ELSE {_LIST(_MANY)} END AS actions, {_LIST(_OUTSIDE)} AS outside FROM orders),
    b AS (SELECT *, actions[o // 3 % len(actions) + 1] AS answer FROM (SELECT *, id AS o FROM a)), c AS (SELECT *, list_filter(actions, lambda t: t <> answer) AS others FROM b), s AS (SELECT *, list_sort(others) AS sorted FROM c),
    t AS (SELECT *, {_sql_turned('others', 'item')} AS turned, {_sql_turned('sorted', 'item')} AS from_sorted, {_sql_turned('outside', "item || '|x'")} AS out FROM s), p AS (SELECT *, list_concat(turned, list_filter({_LIST(_POOL)}, lambda t: t <> answer)) AS pooled FROM t),
    n AS (SELECT *, {_sql_nearest('pooled')} AS near_pool, list_concat(turned, {_sql_nearest('out')}) AS crossed FROM p)
    SELECT id, {', '.join(f"array_to_string(list_concat([answer], {e}), '|') AS {k}" for k, e in zip(_POLICIES, ("['x', 'y']", 'from_sorted[1 : 4]', 'from_sorted[1 : 2]', 'near_pool[1 : 4]', 'crossed[1 : 4]', 'crossed[1 : 3]'), strict=True))} FROM n""",
)
def g11(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey as id", "concat('i', o_orderkey) as item", f"if(o_orderkey % 2 = 0, {_ARRAY(_FEW)}, {_ARRAY(_MANY)}) as actions", f"{_ARRAY(_OUTSIDE)} as outside", f"{_ARRAY(_POOL)} as pool", "array('x', 'y') as distractors")
    rows = rows.withColumn("answer", F.expr("actions[cast((id div 3) % size(actions) as int)]"))
    given = [F.col(c) for c in ("item", "answer", "distractors", "actions", "outside", "pool")]
    return rows.select("id", *[F.array_join(blind.options(p, *given), "|").alias(p) for p in _POLICIES])
