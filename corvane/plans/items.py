"""Items as documents, over part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import items
from ..operators.questions import ranked, recombined
from ..sources import table
from .registry import query

_ITEM = """i AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'understanding' WHEN 1 THEN 'left_right' WHEN 2 THEN 'time' ELSE 'step_order' END AS task, p_brand || '/' || p_partkey AS item FROM part),
    o AS (SELECT *, CASE task WHEN 'left_right' THEN ['k' || k, 'a' || k, 'b' || k, 'c' || k] WHEN 'time' THEN [] ELSE ['yes ' || k, 'no', 'maybe'] END AS said FROM i), s AS (SELECT *, list_transform(list_sort(list_transform(said, lambda t: {'k': md5(item || '|' || t), 't': t})), lambda r: r.t) AS ord FROM o)"""


@query(
    "p1_p2_p3_items",
    f"""WITH {_ITEM} SELECT item AS id, task, CASE WHEN task = 'time' THEN '00:00:' || printf('%06.3f', k % 50 + 0.5) || '-00:01:' || printf('%06.3f', k % 50 + 1.25) ELSE substr('ABCDEF', list_position(ord, said[1]), 1) END AS answer,
    CASE task WHEN 'understanding' THEN 'yes ' || k WHEN 'step_order' THEN 'yes ' || k END AS option_text, CASE WHEN task IN ('understanding', 'step_order') THEN array_to_string(ord, '|') ELSE '' END AS options,
    CASE task WHEN 'left_right' THEN 'frame=assets/m' || k || '.jpg,' || array_to_string(list_transform(range(1, 5), lambda j: 'option:' || substr('ABCDEF', j, 1) || '=assets/' || ord[j] || '.jpg'), ',') WHEN 'step_order' THEN 'step:1=assets/m' || k || '.jpg,step:2=assets/n' || k || '.jpg' WHEN 'time' THEN 'context=assets/m' || k || '.mp4' ELSE 'clip=assets/m' || k || '.mp4' END AS media FROM s""",
)
def p1(spark, d):
    task = "case p_partkey % 4 when 0 then 'understanding' when 1 then 'left_right' when 2 then 'time' else 'step_order' end"
    rows = table(spark, d, "part").selectExpr("p_partkey as k", "p_brand as family", f"{task} as task", "concat(p_brand, '/', p_partkey) as item")
    rows = rows.selectExpr(
        "*", "'What?' as stem", "if(task = 'left_right', 'left gripper camera view', concat('yes ', k)) as answer_text", "if(task = 'left_right', array(), array('no', 'maybe')) as distractors",
        "if(task = 'left_right', transform(array('k', 'a', 'b', 'c'), p -> named_struct('key', concat(p, k), 'view', 'wrist')), array()) as pictures", "concat('k', k) as correct", "k % 50 + 0.5D as start", "k % 50 + 61.25D as end", "'act' as subtask", "'made' as provenance",
        "case task when 'understanding' then array(named_struct('kind', 'clip', 'view', 'main', 'key', concat('m', k))) when 'time' then array(named_struct('kind', 'video', 'view', 'main', 'key', concat('m', k))) when 'left_right' then array(named_struct('kind', 'frame', 'view', 'main', 'key', concat('m', k))) else array(named_struct('kind', 'frame', 'view', 'main', 'key', concat('m', k)), named_struct('kind', 'frame', 'view', 'main', 'key', concat('n', k))) end as media",
    )
    out = items.documents(rows, "assets")
    roles = F.concat_ws(",", F.transform("prompt.media", lambda m: F.concat_ws("=", m["role"], m["path"])))
    texts = F.concat_ws("|", F.transform("prompt.options", lambda o: o["text"]))
    return out.select("id", "task", "truth.answer", "truth.option_text", texts.alias("options"), roles.alias("media"))


@query("t18_media_labels", "SELECT p_partkey AS k, 'image:a:' || substr(repeat(p_name || ' ', 9), 1, 80) || '|video:b:' || '|image:c:' || p_brand AS media FROM part")
def t18(spark, d):
    parts = "array(named_struct('kind', 'text', 'value', p_type), named_struct('kind', 'text', 'value', repeat(concat(p_name, ' '), 9)), named_struct('kind', 'image', 'value', 'a'), named_struct('kind', 'video', 'value', 'b'), named_struct('kind', 'text', 'value', p_brand), named_struct('kind', 'image', 'value', 'c'), named_struct('kind', 'text', 'value', 'end'))"
    rows = table(spark, d, "part").selectExpr("p_partkey as k", f"{parts} as parts")
    return rows.select("k", F.concat_ws("|", F.transform(items.media_labels(F.col("parts")), lambda m: F.concat_ws(":", m["kind"], m["path"], m["label"]))).alias("media"))


@query(
    "o2_ranked_candidates",
    """WITH v AS (SELECT DISTINCT p_brand AS family, CASE WHEN p_size % 2 = 0 THEN 'pick' ELSE 'wipe' END AS verb, p_name AS object FROM part), o AS (SELECT DISTINCT family, object FROM v), w AS (SELECT DISTINCT family, verb FROM v), real AS (SELECT DISTINCT family, verb || ' ' || object || ' with brush' AS key FROM v),
    c AS (SELECT v.family, v.verb || ' ' || o.object || ' with brush' AS key, 0 AS tier FROM v JOIN o USING (family) WHERE o.object <> v.object UNION ALL SELECT v.family, w.verb || ' ' || v.object || ' with brush', 1 FROM v JOIN w USING (family) WHERE w.verb <> v.verb UNION ALL SELECT v.family, g.verb || ' ' || v.object || ' with brush', 2 FROM v CROSS JOIN (VALUES ('move'), ('wipe')) g(verb) WHERE g.verb <> v.verb AND NOT EXISTS (SELECT 1 FROM w WHERE w.family = v.family AND w.verb = g.verb)),
    m AS (SELECT family, key, min(tier) AS tier FROM c WHERE NOT EXISTS (SELECT 1 FROM real r WHERE r.family = c.family AND r.key = c.key) GROUP BY 1, 2) SELECT family, key, tier, CAST(row_number() OVER (PARTITION BY family ORDER BY tier, key) AS INT) AS nth FROM m""",
)
def o2(spark, d):
    rows = table(spark, d, "part").selectExpr("p_brand as family", "concat(if(p_size % 2 = 0, 'Pick the ', 'Wipe the '), p_name, ' with brush.') as text").distinct()
    return ranked(recombined(rows, ["move", "wipe"]))
