"""Checks of labelled intervals, words of labels, clocks and frames: queries over events, part and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..functions import words
from ..operators import labels
from ..sources import SEGMENTS, VIDEOS, segments, table, videos
from .core import _ACTS, _BOUNDS, _BY, _STATE, bounds_of, vocabulary
from .registry import query

#: Derived seconds, wrong in some rows; both engines read them alike.
_START, _END = "round(start_frame / 20.0, 3) + CASE WHEN event_id % 11 = 0 THEN 0.5 ELSE 0.0 END", "round((end_frame + 1) / 20.0, 3)"
_TIMED = f"timed AS (SELECT *, {_START} AS start, {_END} AS \"end\" FROM seg)"


def timed(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).selectExpr("*", f"cast({_START} as double) as start", f"cast({_END} as double) as `end`")


_BAD_TIMES = 'abs(start - round(start_frame / 20.0, 3)) > 0.002 OR abs("end" - round((end_frame + 1) / 20.0, 3)) > 0.002'


@query("d2_reference", f"WITH {SEGMENTS} SELECT event_id, subtask FROM seg WHERE subtask NOT IN ('click', 'purchase', 'view', 'signup')")
def d2(spark, d):
    return labels.undefined(segments(spark, d), vocabulary(spark, d).filter("subtask <> 'error'")).select("event_id", "subtask")


@query("d3_derivation", f"WITH {SEGMENTS}, {_TIMED} SELECT event_id FROM timed WHERE {_BAD_TIMES}")
def d3(spark, d):
    return labels.underived(timed(spark, d), 20.0).select("event_id")


@query(
    "d5_suspicious",
    f"""WITH {SEGMENTS} SELECT file, episode, start_frame, 'zero length' AS kind, count(*) AS n FROM seg WHERE end_frame <= start_frame + 400 GROUP BY 1, 2, 3
    UNION ALL SELECT file, 0, start_frame, 'same start', count(*) FROM (SELECT file, start_frame // 2000 AS start_frame FROM seg) GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def d5(spark, d):
    s = segments(spark, d)
    short = labels.suspicious(s.withColumn("end_frame", F.col("end_frame") - 400)).filter("kind = 'zero length'")
    same = labels.suspicious(s.withColumn("start_frame", F.expr("start_frame div 2000")).withColumn("episode", F.lit(0).cast("bigint"))).filter("kind = 'same start'")
    return short.unionByName(same)


_SHIFTED = "shifted AS (SELECT file, bound, lo + 40000 AS lo, lo + 60000 + 4000 * (file % 40) AS hi FROM bounds)"


def _shifted(s: DataFrame) -> DataFrame:
    return bounds_of(s).selectExpr("file", "bound", "lo + 40000 as lo", "lo + 60000 + 4000 * (file % 40) as hi")


@query(
    "d6_j2_coverage",
    f"""WITH {SEGMENTS}, {_BOUNDS}, {_SHIFTED}, m AS (SELECT *, count(*) OVER (PARTITION BY file) AS n FROM shifted)
    SELECT file, bound FROM m WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM seg s WHERE s.file = m.file AND m.lo - 10 <= s.start_frame AND s.end_frame <= m.hi + 10)""",
)
def d6(spark, d):
    s = segments(spark, d)
    return labels.unlabelled(s, _shifted(s), 10)


@query(
    "d8_ambiguity",
    f"""WITH {SEGMENTS}, k AS (SELECT file, episode, subtask, count(*) AS n, min((start_frame, end_frame, event_id)) AS came FROM seg GROUP BY 1, 2, 3), e AS (SELECT file, episode, max(n) AS n, min(came) AS came FROM k GROUP BY 1, 2)
    SELECT file, arg_min(episode, came) AS episode FROM e WHERE n > 1 GROUP BY 1""",
)
def d8(spark, d):
    return labels.ambiguous(segments(spark, d))


_KEYS = {"subtask": "true", "start_frame": "true", "metadata": "event_id % 50 = 0", "narration": "event_id % 70 = 0"}


@query("d1_u2_pollution", "WITH e AS (SELECT user_id AS file, bool_or(event_id % 50 = 0) AS m, bool_or(event_id % 70 = 0) AS n FROM events GROUP BY 1) SELECT file, CASE WHEN m AND n THEN 'metadata,narration' WHEN m THEN 'metadata' ELSE 'narration' END AS extra FROM e WHERE m OR n")
def d1(spark, d):
    keys = F.array_compact(F.array(*[F.expr(f"if({rule}, '{k}', null)") for k, rule in _KEYS.items()]))
    return labels.polluted(table(spark, d, "events").select(F.col("user_id").alias("file"), keys.alias("keys")), ["subtask", "start_frame"])


@query(
    "d9_structure",
    f"""WITH {SEGMENTS}, t AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE subtask END AS subtask, start_frame - 100000 * CAST(event_id % 13 = 0 AS INT) AS start_frame, end_frame - 5000 AS end_frame FROM seg)
    SELECT event_id, CASE WHEN subtask IS NULL THEN 'subtask missing' WHEN start_frame < 0 THEN 'start_frame not natural' ELSE 'end_frame before start_frame' END AS rule FROM t WHERE subtask IS NULL OR start_frame < 0 OR end_frame < start_frame""",
)
def d9(spark, d):
    t = segments(spark, d).selectExpr("event_id", "if(event_id % 9 = 0, null, subtask) as subtask", "start_frame - 100000 * cast(event_id % 13 = 0 as int) as start_frame", "end_frame - 5000 as end_frame", "0.0D as start", "1.0D as `end`")
    return labels.broken(t)


@query(
    "d10_video",
    f"""WITH {SEGMENTS}, {VIDEOS}, c AS (SELECT file, episode, max(end_frame) AS last, max((end_frame + 1) / 20.0) AS hi, min(start_frame / 20.0) AS lo FROM seg GROUP BY 1, 2),
    v AS (SELECT * FROM c JOIN (SELECT file, episode, declared_fps, duration, CASE WHEN file % 6 = 0 THEN 0 ELSE frames - 200000 END AS frames FROM video) USING (file, episode))
    SELECT file, episode, 'unreadable' AS kind FROM v WHERE frames = 0 UNION ALL SELECT file, episode, 'frame rate' FROM v WHERE frames > 0 AND abs(declared_fps - frames / duration) > 0.5
    UNION ALL SELECT file, episode, 'beyond the end' FROM v WHERE frames > 0 AND last > frames + 2 UNION ALL SELECT file, episode, 'little covered' FROM v WHERE frames > 0 AND (hi - lo) / duration < 0.1""",
)
def d10(spark, d):
    rows = segments(spark, d).selectExpr("*", "start_frame / 20.0D as start", "(end_frame + 1) / 20.0D as `end`")
    return labels.against_videos(rows, videos(spark, d).withColumn("frames", F.expr("if(file % 6 = 0, 0, frames - 200000)")))


_FINDINGS = f"""findings AS (SELECT family, file, 'overlap' AS kind, CAST(event_id AS VARCHAR) AS detail FROM (SELECT *, lag(end_frame) OVER ({_BY}) AS p FROM seg) WHERE start_frame < p
    UNION ALL SELECT family, file, 'reference', subtask FROM seg WHERE subtask = 'error' UNION ALL SELECT family, file, 'derivation', CAST(event_id AS VARCHAR) FROM timed WHERE {_BAD_TIMES}
    UNION ALL SELECT DISTINCT 'fam' || (file % 6), file, 'sequence', CAST(event_id AS VARCHAR) FROM (SELECT *, {_STATE} AS held FROM seg JOIN acts USING (subtask)) WHERE kind = 'take' AND held = 1 OR kind <> 'take' AND held = 0)"""


def findings(spark: SparkSession, d: str) -> DataFrame:
    """family, file, kind, detail of four checks over all segments."""
    s, t = segments(spark, d), timed(spark, d)
    family = F.concat(F.lit("fam"), (F.col("file") % 6).cast("string")).alias("family")
    rows = lambda df, kind, detail: df.select(family, "file", F.lit(kind).alias("kind"), F.col(detail).cast("string").alias("detail"))
    out = rows(labels.overlaps(s), "overlap", "event_id").unionByName(rows(labels.undefined(s, vocabulary(spark, d).filter("subtask <> 'error'")), "reference", "subtask"))
    return out.unionByName(rows(labels.underived(t, 20.0), "derivation", "event_id")).unionByName(rows(labels.holding(s, vocabulary(spark, d)).select("file", "event_id").distinct(), "sequence", "event_id"))


@query("d14_a35_report", f"WITH {SEGMENTS}, {_TIMED}, {_ACTS}, {_FINDINGS} SELECT family, count_if(kind = 'overlap') AS overlap, count_if(kind = 'reference') AS reference, count_if(kind = 'derivation') AS derivation, count_if(kind = 'sequence') AS sequence FROM findings GROUP BY 1")
def d14(spark, d):
    return labels.report(findings(spark, d), ["overlap", "reference", "derivation", "sequence"])


@query(
    "a35_examples",
    f"""WITH {SEGMENTS}, {_TIMED}, {_ACTS}, {_FINDINGS}, k AS (SELECT kind, family, min(detail) AS detail FROM findings GROUP BY kind, family, substr(detail, 1, 40)), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY family, detail) AS n FROM k) SELECT kind, n, family, detail FROM r WHERE n <= 4""",
)
def a35(spark, d):
    return labels.examples(findings(spark, d))


@query(
    "d11_review",
    f"""WITH {SEGMENTS}, {_TIMED}, {_ACTS}, {_FINDINGS}, f AS (SELECT file, bool_or(kind <> 'reference') AS blocks FROM findings GROUP BY 1), d AS (SELECT file, count(*) AS n FROM seg GROUP BY 1 UNION ALL SELECT -1, 0)
    SELECT d.file, CASE WHEN n = 0 OR coalesce(blocks, false) THEN 'block' WHEN blocks IS NOT NULL THEN 'warn' ELSE 'ok' END AS level FROM d LEFT JOIN f ON d.file = f.file""",
)
def d11(spark, d):
    documents = segments(spark, d).groupBy("file").agg(F.count("*").alias("n_segments"))
    empty = spark.createDataFrame([(-1, 0)], "file long, n_segments long")
    softened = findings(spark, d).withColumn("kind", F.expr("if(kind = 'reference', 'suspicious', kind)"))
    return labels.reviewed(softened, documents.unionByName(empty))


@query(
    "d12_addable",
    f"""WITH {SEGMENTS}, c AS (SELECT event_id AS id, file, episode, end_frame AS a, end_frame + 20000 - 30000 * CAST(event_id % 10 = 0 AS INT) AS b FROM seg)
    SELECT id, b >= a AND NOT EXISTS (SELECT 1 FROM seg s WHERE s.file = c.file AND s.episode = c.episode AND a <> s.end_frame AND b <> s.start_frame AND a <= s.end_frame AND s.start_frame <= b) AS ok FROM c""",
)
def d12(spark, d):
    s = segments(spark, d)
    return labels.addable(s.selectExpr("event_id as id", "file", "episode", "end_frame as start_frame", "end_frame + 20000 - 30000 * cast(event_id % 10 = 0 as int) as end_frame"), s)


@query("j15_w6_successors", f"WITH {SEGMENTS} SELECT event_id, lead(subtask) OVER ({_BY}) AS next_subtask FROM seg")
def j15(spark, d):
    return labels.successors(segments(spark, d))


@query("a38_usage", f"WITH {SEGMENTS} SELECT family, subtask, count(DISTINCT file) AS files FROM seg GROUP BY 1, 2")
def a38(spark, d):
    return labels.usage(segments(spark, d))


# Words of labels, over part.
_LABEL = "CASE p_partkey % 6 WHEN 0 THEN 'Pick up the ' || p_name || '.' WHEN 1 THEN 'N' || p_partkey || ': put ' || p_name || ' in the box' WHEN 2 THEN 'wipe a ' || p_name || ' with brush' WHEN 3 THEN 'label1 - Take ' || lower(p_type) || '.' WHEN 4 THEN 'stop' ELSE '  set down into the ' || p_name || '  ' END"
_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\.+$', ''), '\\b(the|a|an)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_PARSED = f"""w AS (SELECT *, list_filter(string_split({_KEY.format('text')}, ' '), lambda x: x <> '') AS w FROM l), v AS (SELECT *, CASE WHEN len(w) > 1 AND w[2] IN {_IN(words.PARTICLES)} THEN 2 ELSE 1 END AS nv FROM w),
    r AS (SELECT *, w[nv + 1 :] AS rest FROM v), c AS (SELECT *, coalesce(list_min(list_filter(list_transform(range(1, len(rest) + 1), lambda i: CASE WHEN rest[i] IN {_IN(words.PREPOSITIONS)} THEN i END), lambda x: x IS NOT NULL)), len(rest) + 1) AS cut FROM r)"""


def label_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey", f"{_LABEL} as text")


@query("t2_parsed", f"WITH l AS (SELECT p_partkey, {_LABEL} AS text FROM part), {_PARSED} SELECT p_partkey, array_to_string(w[1 : nv], ' ') AS verb, array_to_string(rest[1 : cut - 1], ' ') AS object, array_to_string(rest[cut :], ' ') AS modifier FROM c")
def t2(spark, d):
    return label_lines(spark, d).select("p_partkey", words.parsed(F.col("text")).alias("w")).select("p_partkey", "w.*")


_CLASS = "trim(regexp_replace(regexp_replace(text, '^\\s*[A-Za-z]*\\d+\\s*[:：.\\-]\\s*', ''), '\\s+', ' ', 'g'))"


@query(
    "t3_t4_described",
    f"""WITH l AS (SELECT p_partkey, {_LABEL} AS text FROM part), a AS (SELECT p_partkey, {_CLASS} AS class, string_split(regexp_replace({_CLASS}, '\\.+$', ''), ' ') AS w FROM l),
    b AS (SELECT *, w[2 :] AS rest FROM a), c AS (SELECT *, coalesce(list_min(list_filter(list_transform(range(1, len(rest) + 1), lambda i: CASE WHEN lower(rest[i]) NOT IN {_IN(words.NARRATION_PARTICLES)} THEN i END), lambda x: x IS NOT NULL)), len(rest) + 1) AS k FROM b),
    e AS (SELECT *, rest[k :] AS tail, len(rest) >= k AND lower(rest[k]) IN ('the', 'a', 'an') AS given FROM c), f AS (SELECT *, CASE WHEN given THEN tail[2 :] ELSE tail END AS o FROM e),
    g AS (SELECT *, array_to_string(list_concat(w[1 : 1], rest[1 : k - 1], CASE WHEN len(o) = 0 THEN [] WHEN given THEN tail[1 : 1] ELSE ['the'] END, o), ' ') AS body FROM f)
    SELECT p_partkey, class, array_to_string(o, ' ') AS object, lower(w[1]) AS verb, ' ' || upper(substr(body, 1, 1)) || substr(body, 2) || '.' AS narration FROM g""",
)
def t3(spark, d):
    lines = label_lines(spark, d)
    return lines.select("p_partkey", words.class_text(F.col("text")).alias("class"), words.described(F.col("text")).alias("w")).select("p_partkey", "class", "w.*")


@query(
    "t6_t7_swapped",
    f"""WITH l AS (SELECT p_partkey, 'Pick the ' || p_name || ' and the ' || p_name || '.' AS text, p_name AS old, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE 'cup' END AS new FROM part),
    s AS (SELECT p_partkey, text, CASE WHEN old <> new THEN replace(replace(text, 'the ' || old || ' and', 'the ' || new || ' and'), '', '') END AS swapped FROM l),
    k AS (SELECT *, CASE p_partkey % 7 WHEN 0 THEN 'no capital.' WHEN 1 THEN 'Pick the up cup.' WHEN 2 THEN 'Put the cup.' WHEN 3 THEN 'Take the pan.' WHEN 4 THEN 'Wipe the very old blue bowl slowly.' WHEN 5 THEN 'Stop.' ELSE 'Move the ring.' END AS t FROM s)
    SELECT p_partkey, swapped, CASE p_partkey % 7 WHEN 0 THEN 'form' WHEN 1 THEN 'wellformed' WHEN 2 THEN 'not_correct' WHEN 3 THEN 'unique' WHEN 4 THEN 'length' WHEN 5 THEN 'parses' END AS refusal FROM k""",
)
def t6(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", "concat('Pick the ', p_name, ' and the ', p_name, '.') as text", "upper(p_name) as old", "if(p_partkey % 5 = 0, upper(p_name), 'cup') as new")
    t = "case p_partkey % 7 when 0 then 'no capital.' when 1 then 'Pick the up cup.' when 2 then 'Put the cup.' when 3 then 'Take the pan.' when 4 then 'Wipe the very old blue bowl slowly.' when 5 then 'Stop.' else 'Move the ring.' end"
    rows = rows.selectExpr("*", f"{t} as t", "array('put cup') as own", "array('take pan') as taken", "if(p_partkey % 7 = 5, 'Go up.', 'Lift the lid.') as correct")
    return rows.select("p_partkey", words.swapped(F.col("text"), F.col("old"), F.col("new")).alias("swapped"), words.refusal(F.col("t"), F.col("correct"), F.col("own"), F.col("taken")).alias("refusal"))


@query(
    "a36_j10_vocabulary",
    f"""WITH l AS (SELECT p_partkey, p_brand AS family, 'Put the ' || p_name || ' on ' || p_type AS text FROM part), k AS (SELECT DISTINCT family, {_KEY.format('text')} AS k FROM l), p AS (SELECT family, k, array_to_string(string_split(k, ' ')[2 : len(string_split(k, ' ')) - 2], ' ') AS object FROM k)
    SELECT family, object, count(*) AS n, min(k) AS first FROM p GROUP BY 1, 2 HAVING count(*) > 1""",
)
def a36(spark, d):
    from ..operators.vocabulary import shared_parts

    lines = table(spark, d, "part").selectExpr("p_brand as family", "concat('Put the ', p_name, ' on ', p_type) as text")
    return shared_parts(lines, "object")


@query(
    "j10_hazards",
    "WITH k AS (SELECT DISTINCT p_brand AS family, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 2) ELSE replace(p_name, ' ', '_') END AS id FROM part) SELECT a.family, a.id AS part, b.id AS whole FROM k a JOIN k b ON a.family = b.family AND a.id <> b.id AND contains(b.id, a.id)",
)
def j10(spark, d):
    from ..operators.vocabulary import hazards

    ids = table(spark, d, "part").selectExpr("p_brand as family", "if(p_partkey % 3 = 0, split_part(p_name, ' ', 2), replace(p_name, ' ', '_')) as id")
    return hazards(ids)


@query(
    "s12_w14_categories",
    """WITH l AS (SELECT page_id % 5 AS list, unnest(string_split(html, '>')) AS line, generate_subscripts(string_split(html, '>'), 1) AS nth, page_id FROM pages),
    c AS (SELECT list, page_id, nth, trim(regexp_replace(regexp_replace(line, '^\\s*[A-Za-z]*\\d+\\s*[:：.\\-]\\s*', ''), '\\s+', ' ', 'g')) AS line FROM l)
    SELECT list, lower(line) AS key, arg_min(line, (page_id, nth)) AS line FROM c WHERE line <> '' AND NOT starts_with(line, '#') GROUP BY 1, 2""",
)
def s12(spark, d):
    from ..sources import categories

    lines = table(spark, d, "pages").select((F.col("page_id") % 5).alias("list"), "page_id", F.posexplode(F.split("html", ">")).alias("at", "line"))
    return categories(lines, "list", "page_id", "at")


# Clocks and frames, over lineitem.
_S = "l_extendedprice / 7"


@query(
    "m1_m3_clocks",
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, {_S} AS s FROM lineitem), y AS (SELECT *, CAST(floor(s) AS BIGINT) AS w, CAST(round_even((s - floor(s)) * 1000, 0) AS BIGINT) AS ms FROM x)
    SELECT l_orderkey, l_linenumber, printf('%02d:%02d:%02d.%03d', w // 3600, w // 60 % 60, w % 60 + CASE WHEN ms = 1000 THEN 1 ELSE 0 END, CASE WHEN ms = 1000 THEN 0 ELSE ms END) AS clock,
      printf('%02d:%02d:%06.3f', w // 3600, w // 60 % 60, s - (w // 60) * 60) AS rest FROM y""",
)
def m1(spark, d):
    s = F.expr(_S)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.clock_of_seconds(s).alias("clock"), fn.clock_of_remainder(s).alias("rest"))


_TOKEN = "CASE l_linenumber % 6 WHEN 0 THEN '12.5s' WHEN 1 THEN CAST(l_orderkey AS {s}) WHEN 2 THEN '1:' || (l_orderkey % 60) || ':2.5' WHEN 3 THEN ' ' || (l_orderkey % 7) || ':30S ' WHEN 4 THEN 'soon' ELSE '0:1:0:' || (l_orderkey % 9) END"


@query(
    "m5_loose_seconds",
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, {_TOKEN.format(s='VARCHAR')} AS t FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(CASE l_linenumber % 6 WHEN 0 THEN 12.5 WHEN 1 THEN l_orderkey WHEN 2 THEN 3600 + 60 * (l_orderkey % 60) + 2.5
      WHEN 3 THEN 60 * (l_orderkey % 7) + 30 WHEN 5 THEN 3600 + l_orderkey % 9 END AS DOUBLE) AS seconds FROM x""",
)
def m5(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.loose_seconds(F.expr(_TOKEN.format(s="STRING"))).alias("seconds"))


_SAID = "CASE l_linenumber % 7 WHEN 0 THEN '{\"start\": \"0:00:' || (l_orderkey % 60) || '\", \"end\": 75}' WHEN 1 THEN '```json' || chr(10) || '{\"start_time\": 3.5, \"end_time\": \"1:15\"}' || chr(10) || '```' WHEN 2 THEN '{\"answer\": \"00:00:05.250 – 00:00:09\"}' WHEN 3 THEN 'from 3.5 to 1:15 or so' WHEN 4 THEN '2到' || (l_orderkey % 50) WHEN 5 THEN '7, 9.5' ELSE 'never' END"


@query(
    "m6_m7_intervals",
    f"""SELECT l_orderkey, l_linenumber, CAST(CASE l_linenumber % 7 WHEN 0 THEN l_orderkey % 60 WHEN 1 THEN 3.5 WHEN 2 THEN 5.25 WHEN 3 THEN 3.5 WHEN 4 THEN 2 WHEN 5 THEN 7 END AS DOUBLE) AS start,
      CAST(CASE l_linenumber % 7 WHEN 0 THEN 75 WHEN 1 THEN 75 WHEN 2 THEN 9 WHEN 3 THEN 75 WHEN 4 THEN l_orderkey % 50 WHEN 5 THEN 9.5 END AS DOUBLE) AS "end" FROM lineitem""",
)
def m6(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.interval_of_text(F.expr(_SAID)).alias("i")).select("l_orderkey", "l_linenumber", "i.*")


@query(
    "m12_m13_phases",
    f"""WITH {SEGMENTS}, p AS (SELECT event_id, start_frame, start_frame + event_id % 12 AS e, unnest([0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS phase FROM seg), f AS (SELECT *, start_frame + CAST(round_even((e - start_frame) * phase, 0) AS BIGINT) AS frame FROM p),
    k AS (SELECT *, row_number() OVER (PARTITION BY event_id, frame ORDER BY phase) AS n FROM f) SELECT event_id, phase, frame FROM k WHERE n = 1 OR phase = 0.5""",
)
def m12(spark, d):
    from ..operators.questions import phases

    return phases(segments(spark, d).withColumn("end_frame", F.col("start_frame") + F.col("event_id") % 12)).select("event_id", "phase", "frame")


@query(
    "m16_p24_sampling",
    """WITH x AS (SELECT l_orderkey, l_linenumber, CAST(1 + l_quantity * 7 AS BIGINT) AS frames, l_linenumber AS n FROM lineitem),
    e AS (SELECT l_orderkey, l_linenumber, CASE WHEN n <= 1 THEN [(frames - 1) // 2] ELSE list_transform(range(n), lambda i: least(frames - 1, CAST(floor((frames - 1) / n / 2 + round_even((frames - 1) / n * i, 0)) AS BIGINT))) END AS even,
      list_transform(range(greatest(1, CAST(floor(frames / 20.0::DOUBLE * 3) AS BIGINT))), lambda i: least(frames - 1, CAST(round_even(i * 20.0::DOUBLE / 3, 0) AS BIGINT))) AS rate FROM x)
    SELECT l_orderkey, l_linenumber, array_to_string(even, ',') AS even, array_to_string(rate, ',') AS rate FROM e""",
)
def m16(spark, d):
    frames, n = F.expr("cast(1 + l_quantity * 7 as bigint)"), F.col("l_linenumber")
    text = lambda a: F.concat_ws(",", a.cast("array<string>"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text(fn.evenly(n, frames)).alias("even"), text(fn.at_rate(F.lit(3.0), F.lit(20.0), frames)).alias("rate"))


@query(
    "v26_m21_intervals",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS s, l_quantity + 10 AS e, l_quantity + (l_linenumber - 4) * l_discount * 60 AS a, l_quantity + 10 + (l_linenumber - 4) * l_discount * 60 AS b FROM lineitem),
    m AS (SELECT *, greatest(0.0, least(b, e) - greatest(a, s)) AS i, greatest(b, e) - least(a, s) AS h FROM t)
    SELECT l_orderkey, l_linenumber, round(i / h, 6) AS tiou, i > 0 AS pointing, round(a - s, 6) AS start_error, round(b - e, 6) AS end_error, round((a + b) / 2, 6) AS pred_center, round(i, 6) AS intersection, i / h >= 0.5 AS enough, abs(a - s) <= 10 / 3.0 + 1e-9 AS within_law FROM m""",
)
def v26(spark, d):
    t = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity as s", "l_quantity + 10 as e", "l_quantity + (l_linenumber - 4) * l_discount * 60 as a", "l_quantity + 10 + (l_linenumber - 4) * l_discount * 60 as b")
    m = fn.interval_metrics(F.col("a"), F.col("b"), F.col("s"), F.col("e"))
    near = F.abs(m["start_error"]) <= fn.shift_within(F.col("e") - F.col("s")) + 1e-9
    return t.select("l_orderkey", "l_linenumber", *[F.round(m[k], 6).alias(k) for k in ("tiou", "start_error", "end_error", "pred_center", "intersection")], m["pointing"].alias("pointing"), (m["tiou"] >= 0.5).alias("enough"), near.alias("within_law"))
