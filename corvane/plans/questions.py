"""Questions: queries over events as segments and part as a vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import parsed
from ..operators import questions as q
from ..sources import SEGMENTS, segments, table
from .labels import _KEY
from .registry import query

# Texts of a family: those of its event types, which name the family in every other one.
_TEXT = "CASE event_type WHEN 'click' THEN 'Pick up the cup.' WHEN 'purchase' THEN 'Put the lid ' || (user_id % 6) || ' on table.' WHEN 'view' THEN 'Wipe the bowl ' || (user_id % 3) || '.' WHEN 'signup' THEN 'Take a tray.' ELSE 'Open the old blue box ' || (user_id % 2) || '.' END"
_OBJECT = "CASE event_type WHEN 'click' THEN 'cup' WHEN 'purchase' THEN 'lid ' || (user_id % 6) WHEN 'view' THEN 'bowl ' || (user_id % 3) WHEN 'signup' THEN 'tray' ELSE 'old blue box ' || (user_id % 2) END"
_VOCABULARY = f"voc AS (SELECT DISTINCT 'fam' || (user_id % 6) AS family, event_type AS subtask, {_TEXT} AS text, {_OBJECT} AS object FROM events WHERE user_id % 6 <> 5 OR event_type IN ('click', 'view'))"
#: The sixth family's labels keep to two actions, so that texts are borrowed for it.
_SEG = f"{SEGMENTS}, sg AS (SELECT * REPLACE (CASE WHEN family = 'fam5' AND subtask NOT IN ('click', 'view') THEN 'click' ELSE subtask END AS subtask) FROM seg)"


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr("concat('fam', user_id % 6) as family", "event_type as subtask", f"{_TEXT} as text")
    return rows.filter("family <> 'fam5' or subtask in ('click', 'view')").distinct().withColumn("object", parsed(F.col("text"))["object"])


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).withColumn("subtask", F.expr("if(family = 'fam5' and subtask not in ('click', 'view'), 'click', subtask)"))


@query("j11_cooccurrence", f"WITH {_SEG}, e AS (SELECT DISTINCT family, file, episode, subtask FROM sg), p AS (SELECT DISTINCT a.family, a.subtask, b.subtask AS other FROM e a JOIN e b USING (family, file, episode)) SELECT family, subtask, string_agg(other, ',' ORDER BY other) AS others FROM p GROUP BY 1, 2")
def j11(spark, d):
    return q.cooccurring(labelled(spark, d)).withColumn("others", F.array_join("others", ","))


_BORROWED = "bor AS (SELECT f.family, list(DISTINCT v.text ORDER BY v.text) AS texts FROM (SELECT DISTINCT family FROM voc) f JOIN voc v ON v.family <> f.family WHERE v.object NOT IN (SELECT object FROM voc o WHERE o.family = f.family) AND v.text NOT IN (SELECT text FROM voc o WHERE o.family = f.family) GROUP BY 1)"


@query("j13_u3_borrowable", f"WITH {_VOCABULARY}, {_BORROWED} SELECT family, array_to_string(texts, '|') AS texts FROM bor")
def j13(spark, d):
    return q.borrowable(vocabulary(spark, d)).withColumn("texts", F.array_join("texts", "|"))


def _sql_rotated(texts: str, salt: str) -> str:
    k = f"CAST(('0x' || md5(item || '|{salt}'))::UHUGEINT % CAST(greatest(len({texts}), 1) AS UHUGEINT) AS INT)"
    return f"list_concat({texts}[{k} + 1 :], {texts}[: {k}])"


_WORDS = "len(list_filter(string_split(" + _KEY + ", ' '), lambda w: w <> ''))"
_ORDER = "PARTITION BY file ORDER BY start_frame, end_frame, event_id"
_ASKED = f"""{_SEG}, {_VOCABULARY}, {_BORROWED}, n AS (SELECT *, CASE WHEN lead(episode) OVER ({_ORDER}) = episode THEN lead(subtask) OVER ({_ORDER}) END AS nxt FROM sg),
    e AS (SELECT DISTINCT family, file, episode, subtask FROM sg), oth AS (SELECT family, answer_subtask, list(other ORDER BY other) AS others FROM (SELECT DISTINCT a.family, a.subtask AS answer_subtask, b.subtask AS other FROM e a JOIN e b USING (family, file, episode)) GROUP BY 1, 2),
    k AS (SELECT *, unnest(['understanding', 'planning', 'planning_2']) AS task FROM n), s AS (SELECT *, CASE WHEN task = 'understanding' THEN subtask ELSE nxt END AS answer_subtask, family || '/' || file || '/' || event_id || '@' || task AS item FROM k),
    m AS (SELECT family, map_from_entries(list((subtask, text))) AS m FROM voc GROUP BY 1),
    t AS (SELECT s.*, m[answer_subtask] AS answer_text, coalesce(list_transform(others, lambda x: m[x]), []) AS own, coalesce(texts, []) AS texts FROM s LEFT JOIN m USING (family) LEFT JOIN oth USING (family, answer_subtask) LEFT JOIN bor USING (family)),
    u AS (SELECT *, list_filter(own, lambda x: x <> answer_text) AS ins, list_filter(texts, lambda x: x <> answer_text) AS outs FROM t), v AS (SELECT *, {_sql_rotated('ins', 'in')} AS i, {_sql_rotated('outs', 'out')} AS o FROM u),
    x AS (SELECT *, list_concat(i, list_transform(list_sort(list_transform(range(1, len(o) + 1), lambda z: {{'d': abs({_WORDS.format('o[z]')} - {_WORDS.format('answer_text')}), 'i': z}})), lambda r: o[r.i])) AS pool FROM v),
    y AS (SELECT *, list_filter(list_transform(range(1, len(pool) + 1), lambda z: CASE WHEN list_position(pool, pool[z]) = z THEN pool[z] END), lambda z: z IS NOT NULL)[1 : 3] AS dis FROM x),
    z AS (SELECT *, CASE WHEN (end_frame - start_frame + 1) / 20.0 < 0.4 THEN 'short' WHEN task <> 'understanding' AND nxt IS NULL THEN 'no next' WHEN len(dis) < 3 THEN 'few distractors' END AS reason FROM y)"""


@query("g1_g3_w11_w13_text_questions", f"WITH {_ASKED} SELECT item, answer_text, array_to_string(dis, '|') AS distractors FROM z WHERE reason IS NULL")
def g3(spark, d):
    items, _ = q.text_questions(labelled(spark, d), vocabulary(spark, d), 20.0)
    return items.select("item", "answer_text", F.array_join("distractors", "|").alias("distractors"))


@query(
    "p15_p16_w11_skipped",
    f"""WITH {_ASKED}, c AS (SELECT file, start_frame, end_frame, event_id, count_if(reason IS NULL) AS n FROM z GROUP BY ALL), b AS (SELECT event_id, coalesce(sum(n) OVER (PARTITION BY file ORDER BY start_frame, end_frame, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
    r AS (SELECT task, CASE WHEN before >= 20 THEN 'cap' ELSE reason END AS reason FROM z JOIN b USING (event_id)) SELECT reason, CAST(sum(CASE WHEN reason = 'cap' AND task <> 'understanding' THEN 0 ELSE 1 END) AS BIGINT) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""",
)
def p16(spark, d):
    return q.text_questions(labelled(spark, d), vocabulary(spark, d), 20.0, cap=20)[1]


@query(
    "p1_p5_w15_composed",
    f"""WITH {_ASKED}, c AS (SELECT item, answer_text, list_transform(list_sort(list_transform(list_concat([answer_text], dis), lambda t: {{'k': md5(item || '|' || t), 't': t}})), lambda r: r.t) AS o FROM z WHERE reason IS NULL)
    SELECT item, substr('ABCDEF', list_position(o, answer_text), 1) AS answer, 'What?' || chr(10) || 'Options:' || chr(10) || array_to_string(list_transform(range(1, len(o) + 1), lambda i: substr('ABCDEF', i, 1) || '. ' || o[i]), chr(10)) AS question, 'What?' AS head FROM c""",
)
def p1(spark, d):
    items, _ = q.text_questions(labelled(spark, d), vocabulary(spark, d), 20.0)
    out = q.composed(items.withColumn("stem", F.lit("What?")))
    return out.select("item", "answer", "question", q.head(F.col("question")).alias("head"))


@query("p13_p14_clips", f"WITH {SEGMENTS} SELECT event_id, start_frame AS raw, greatest(start_frame, end_frame - 60) AS tail, event_id % 3 = 0 AND event_id % 2 = 0 AS leak FROM seg")
def p13(spark, d):
    s = segments(spark, d).withColumn("raw", q.clip_start("raw", 20.0)).withColumn("tail", q.clip_start("tail", 20.0))
    s = s.withColumn("task", F.expr("if(event_id % 2 = 0, 'planning', 'understanding')")).withColumn("clip_end", F.col("end_frame") + (F.col("event_id") % 3 == 0).cast("int"))
    return s.join(q.leaks(s).select("event_id", F.lit(True).alias("leak")), "event_id", "left").select("event_id", "raw", "tail", F.coalesce("leak", F.lit(False)).alias("leak"))


@query(
    "g7_p3_time_questions",
    f"""WITH {SEGMENTS}, c AS (SELECT *, count(*) OVER (PARTITION BY file, episode, subtask) AS n, start_frame // 20 AS s, (end_frame + 1) // 20 AS e FROM seg)
    SELECT family || '/' || file || '/' || event_id || '@time' AS item, printf('%02d:%02d:%06.3f-%02d:%02d:%06.3f', s // 3600, s // 60 % 60, CAST(s % 60 AS DOUBLE), e // 3600, e // 60 % 60, CAST(e % 60 AS DOUBLE)) AS answer FROM c WHERE n = 1 AND file % 4 <> 0""",
)
def g7(spark, d):
    s = segments(spark, d).withColumn("start", F.expr("start_frame div 20")).withColumn("end", F.expr("(end_frame + 1) div 20"))
    return q.time_questions(s, s.select("file").distinct().filter("file % 4 <> 0")).select("item", "answer")


_LABELS = "['Image 1 -> Image 2 -> Image 3','Image 1 -> Image 3 -> Image 2','Image 2 -> Image 1 -> Image 3','Image 2 -> Image 3 -> Image 1','Image 3 -> Image 1 -> Image 2','Image 3 -> Image 2 -> Image 1']"


@query(
    "g6_o5_x14_x16_order",
    f"""WITH {SEGMENTS}, c AS (SELECT file, event_id AS nth, 'o' || event_id AS item, [start_frame // 50000, start_frame // 50000 + 1 + event_id % 3, start_frame // 50000 + 9] AS f FROM seg), r AS (SELECT *, row_number() OVER (PARTITION BY file, list_sort(f) ORDER BY nth) AS n FROM c),
    k AS (SELECT *, CAST(('0x' || md5(item))::UHUGEINT % 6 AS INT) AS k6, CAST(('0x' || md5(item))::UHUGEINT % 5 AS INT) AS k5 FROM r WHERE n = 1), p AS (SELECT *, [[0,1,2],[0,2,1],[1,0,2],[1,2,0],[2,0,1],[2,1,0]][k6 + 1] AS s FROM k),
    a AS (SELECT *, 'Image ' || list_position(s, 0) || ' -> Image ' || list_position(s, 1) || ' -> Image ' || list_position(s, 2) AS answer_text FROM p), w AS (SELECT *, list_filter({_LABELS}, lambda t: t <> answer_text) AS wrong FROM a)
    SELECT item, array_to_string(list_transform(s, lambda i: f[i + 1]), ',') AS shown, answer_text, array_to_string(list_transform(range(3), lambda n: wrong[(k5 + n * 7919) % 5 + 1]), '|') AS distractors FROM w""",
)
def g6(spark, d):
    c = segments(spark, d).selectExpr("file", "event_id as at", "concat('o', event_id) as item", "array(start_frame div 50000, start_frame div 50000 + 1 + event_id % 3, start_frame div 50000 + 9) as frames")
    return q.order_questions(c).select("item", F.concat_ws(",", F.col("shown").cast("array<string>")).alias("shown"), "answer_text", F.array_join("distractors", "|").alias("distractors"))


@query(
    "g2_j12_w7_blocks",
    f"""WITH {SEGMENTS}, e AS (SELECT file, episode, list({{'id': event_id, 's': subtask}} ORDER BY start_frame, end_frame, event_id) AS a FROM seg GROUP BY 1, 2), x AS (SELECT a, unnest(range(1, len(a) + 1)) AS i FROM e),
    t AS (SELECT a[i].id AS event_id, list_filter(range(1, len(a) + 1), lambda j: a[j].s <> a[i].s AND abs(j - i) >= 2) AS far, list_filter(range(1, len(a) + 1), lambda j: a[j].s <> a[i].s AND abs(j - i) = 1) AS near, a, ('0x' || md5(CAST(a[i].id AS VARCHAR)))::UHUGEINT AS h FROM x),
    k AS (SELECT *, CAST(h % CAST(greatest(len(far), 1) AS UHUGEINT) AS INT) AS kf, CAST(h % CAST(greatest(len(near), 1) AS UHUGEINT) AS INT) AS kn FROM t)
    SELECT event_id, array_to_string(list_concat(list_transform(range(len(far)), lambda s: a[far[(kf + s * 7919) % len(far) + 1]].id), list_transform(range(len(near)), lambda s: a[near[(kn + s * 7919) % len(near) + 1]].id)), ',') AS blocks FROM k""",
)
def g2(spark, d):
    return q.other_blocks(segments(spark, d)).withColumn("blocks", F.concat_ws(",", F.col("blocks").cast("array<string>")))


_PRINT = """l AS (SELECT sha256({f} || chr(31) || coalesce({t}, '')) AS l FROM {rows}), b AS (SELECT substr(l, 1, 3) AS b, md5(string_agg(l, '' ORDER BY l)) AS d FROM l GROUP BY 1)"""


@query("a40_g9_fingerprint", f"WITH {_ASKED}, rws AS (SELECT item, answer_text || '|' || array_to_string(dis, '|') AS t FROM z WHERE reason IS NULL), {_PRINT.format(f='item', t='t', rows='rws')}, f AS (SELECT substr(md5(string_agg(b || d, '' ORDER BY b || d)), 1, 12) AS fingerprint FROM b) SELECT fingerprint, true AS same FROM f")
def a40(spark, d):
    build = lambda: q.fingerprint(q.text_questions(labelled(spark, d), vocabulary(spark, d), 20.0)[0].select("item", F.array_join(F.concat(F.array("answer_text"), "distractors"), "|").alias("t")), "t", "item")
    again = build().withColumnRenamed("fingerprint", "other")
    return build().join(F.broadcast(again)).select("fingerprint", (F.col("fingerprint") == F.col("other")).alias("same"))


@query(
    "g10_recombined",
    f"""WITH v AS (SELECT DISTINCT p_brand AS family, CASE WHEN p_size % 2 = 0 THEN 'Pick the ' ELSE 'Wipe the ' END || p_name || ' with brush.' AS text, p_name AS object, CASE WHEN p_size % 2 = 0 THEN 'pick' ELSE 'wipe' END AS verb FROM part),
    o AS (SELECT DISTINCT family, object FROM v), w AS (SELECT DISTINCT family, verb FROM v), real AS (SELECT DISTINCT family, verb || ' ' || object || ' with brush' AS key FROM v),
    c AS (SELECT v.family, v.verb || ' ' || o.object || ' with brush' AS key, 0 AS tier FROM v JOIN o USING (family) WHERE o.object <> v.object UNION ALL SELECT v.family, w.verb || ' ' || v.object || ' with brush', 1 FROM v JOIN w USING (family) WHERE w.verb <> v.verb
      UNION ALL SELECT v.family, g.verb || ' ' || v.object || ' with brush', 2 FROM v CROSS JOIN (VALUES ('move'), ('wipe')) g(verb) WHERE g.verb <> v.verb AND NOT EXISTS (SELECT 1 FROM w WHERE w.family = v.family AND w.verb = g.verb))
    SELECT family, key, min(tier) AS tier FROM c WHERE NOT EXISTS (SELECT 1 FROM real r WHERE r.family = c.family AND r.key = c.key) GROUP BY 1, 2""",
)
def g10(spark, d):
    rows = table(spark, d, "part").selectExpr("p_brand as family", "concat(if(p_size % 2 = 0, 'Pick the ', 'Wipe the '), p_name, ' with brush.') as text").distinct()
    return q.recombined(rows, ["move", "wipe"])
