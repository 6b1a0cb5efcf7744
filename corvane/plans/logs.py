"""Files and streams: what is written from the tables, read back or streamed, and the rows that come out of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared, sinks, streaming
from ..functions import intervals as iv
from ..operators import labels, questions, reports, runs
from ..sources import LOG, cache_keys, episode_bounds, items, last_by_key, loading, log, results, table
from . import core  # noqa: F401  its SQL is used here
from .registry import ORACLES as _CORE
from .registry import query

_LOG_SCHEMA = "id string, seq long, ok boolean, user_id long, choice string, value double"


def _files(spark: SparkSession, rows: DataFrame, path: str) -> int:
    """Rows as JSON lines, dealt to files out of their order; how many files a third of them is."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(max(3, n), F.xxhash64("seq")).write.json(path)
    return -(-max(3, n) // 3)


@query("st1_final_rows", _CORE["w1_final_rows"])
def st1(spark, d):
    with shared.work_folder(spark, "st1") as top:
        at_once = _files(spark, log(spark, d), f"{top}/log")
        streaming.latest_rows(streaming.lines(spark, f"{top}/log", _LOG_SCHEMA, at_once), f"{top}/out", f"{top}/checkpoint").awaitTermination()
        return shared.checkpointed(sinks.table(spark, f"{top}/out").select("id", "ok", "seq", "user_id", "choice", "value"))


@query("st2_breaker", _CORE["w9_breaker"])
def st2(spark, d):
    with shared.work_folder(spark, "st2") as top:
        at_once = _files(spark, log(spark, d), f"{top}/log")
        streaming.watch(streaming.lines(spark, f"{top}/log", _LOG_SCHEMA, at_once), "user_id", 3, f"{top}/out", f"{top}/checkpoint", span=1000).awaitTermination()
        return shared.checkpointed(streaming.broken_at(sinks.table(spark, f"{top}/out"), 3).select(F.col("key").cast("long").alias("user_id"), "broken_at"))


@query("st5_k8_upserts", "SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS version, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS value, (SELECT CAST(2 * count(*) - count_if(o_orderkey % 3 = 0) AS BIGINT) FROM orders) AS written, (SELECT CAST(count_if(o_orderkey % 3 = 0) AS BIGINT) FROM orders) AS refused FROM orders")
def st5(spark, d):
    """A third of the second batch goes by a version that its keys never had; the first batch comes twice."""
    orders = table(spark, d, "orders").withColumn("key", F.col("o_orderkey").cast("string"))
    first = orders.select("key", F.lit(None).cast("long").alias("base"), F.lit(1).cast("long").alias("version"), F.col("o_orderstatus").alias("value"))
    second = orders.select("key", F.expr("if(o_orderkey % 3 = 0, 0L, 1L)").alias("base"), F.lit(2).cast("long").alias("version"), F.col("o_orderpriority").alias("value"))
    with shared.work_folder(spark, "st5") as top:
        for n, rows in enumerate((first, second)):
            rows.write.mode("append").json(f"{top}/in/{n}")
            changes = spark.readStream.schema("key string, base long, version long, value string").json(f"{top}/in/*")
            streaming.versioned(changes, f"{top}/out", f"{top}/checkpoint", buckets=16).awaitTermination()
        done = sinks.upsert(first, f"{top}/out", "changes", 0)["counters"]
        return shared.checkpointed(sinks.table(spark, f"{top}/out").select("key", F.col("version").cast("int").alias("version"), "value", F.lit(done["written"]).cast("long").alias("written"), F.lit(done["refused"]).cast("long").alias("refused")))


@query("k7_k8_items", "SELECT p_brand AS family, 't' || p_size % 5 AS task, count(*) AS n, count(*) AS listed, p_brand = (SELECT min(p_brand) FROM part) AS rebuilt, true AS same, 2 AS version FROM part GROUP BY 1, 2")
def k7(spark, d):
    """Items written by family and task, and the first family alone once more: read back, with what the manifest says."""
    part = table(spark, d, "part").select(F.col("p_brand").alias("family"), F.expr("concat('t', p_size % 5)").alias("task"), F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.lit(None).cast("string").alias("note"))
    first = part.agg(F.min("family")).first()[0]
    with shared.work_folder(spark, "k7") as top:
        old = sinks.write_items(part, top, "builder 1")["families"]
        new = sinks.write_items(part.filter(F.col("family") == first), top, "builder 1", whole=False)
        said = [(f, t, n, x["build"] != old[f]["build"], x["fingerprint"] == old[f]["fingerprint"], new["version"]) for f, x in new["families"].items() for t, n in x["tasks"].items()]
        listed = spark.createDataFrame(said, "family string, task string, listed long, rebuilt boolean, same boolean, version int")
        counts = sinks.read_items(spark, top).groupBy("family", "task").agg(F.count("*").alias("n"))
        return shared.checkpointed(counts.join(listed, ["family", "task"]).select("family", "task", "n", "listed", "rebuilt", "same", "version"))


@query("k1_k9_compacted", _CORE["w1_final_rows"])
def k9(spark, d):
    rows = log(spark, d)
    with shared.work_folder(spark, "k9") as top:
        sinks.append_lines(rows.filter("seq % 2 = 0"), f"{top}/log")
        sinks.append_lines(rows.filter("seq % 2 <> 0"), f"{top}/log")
        sinks.compact(spark, f"{top}/log", runs.final_rows)
        return shared.checkpointed(spark.read.schema(_LOG_SCHEMA).json(f"{top}/log").select("id", "ok", "seq", "user_id", "choice", "value"))


@query("s1_items", "SELECT p_partkey // 1000 AS family, p_partkey AS id, p_name AS text FROM part")
def s1(spark, d):
    """A JSON document for each thousand parts: lists of objects, bare or under `items`, with rows among them that are no objects."""
    item = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    docs = table(spark, d, "part").groupBy(F.expr("p_partkey div 1000").alias("family")).agg(F.concat_ws(",", F.collect_list(F.to_json(item))).alias("rows"))
    text = F.when(F.col("family") % 2 == 0, F.concat(F.lit('{"items": [7, null, '), "rows", F.lit("]}"))).otherwise(F.concat(F.lit("["), "rows", F.lit(', "x", []]')))
    with shared.work_folder(spark, "s1") as top:
        docs.select("family", text.alias("value")).repartition("family").write.partitionBy("family").text(top)
        got = items(spark, f"{top}/*/*.txt").select(F.regexp_extract("file", "family=([^/]*)/", 1).cast("long").alias("family"), F.from_json("item", "id long, text string").alias("i"))
        return shared.checkpointed(got.select("family", "i.id", "i.text"))


@query("s2_results", f"WITH {LOG} SELECT id, seq FROM log UNION ALL SELECT 'x', -1")
def s2(spark, d):
    with shared.work_folder(spark, "s2") as top:
        log(spark, d).select(F.to_json(F.struct("id", "seq")).alias("value")).write.text(f"{top}/log")
        shared.write_text(spark, f"{top}/log/cut.txt", '{"id": "x", "seq": -1}\n\n{"id": "y", "se')
        return shared.checkpointed(results(spark, f"{top}/log/*.txt").select(F.from_json("row", "id string, seq long").alias("r")).select("r.*"))


@query(
    "s3_bounds",
    "SELECT printf('file-%03d', o_custkey % 40) AS file, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_totalprice, o_totalprice + 5) - 1 AS bound, CAST(o_totalprice AS DOUBLE) AS lo, CAST(o_totalprice + 5 AS DOUBLE) AS hi FROM orders",
)
def s3(spark, d):
    name = "videos/observation.images.{}/{}".format
    orders = table(spark, d, "orders")
    meta = lambda view, by: orders.filter(by).select(F.expr("o_custkey % 40").alias(name(view, "file_index")), F.col("o_totalprice").cast("double").alias(name(view, "from_timestamp")), F.expr("cast(o_totalprice + 5 as double)").alias(name(view, "to_timestamp")), F.lit(0).alias(name("other", "file_index")))
    with shared.work_folder(spark, "s3") as top:
        meta("main", "o_orderkey % 2 = 0").write.parquet(f"{top}/episodes/chunk-000")
        meta("main", "o_orderkey % 2 <> 0").write.parquet(f"{top}/episodes/chunk-001/more")
        return shared.checkpointed(episode_bounds(spark, top, ["front", "main"]))


@query("s14_cache", f"WITH {LOG} SELECT id, arg_max(choice, seq) AS choice FROM log GROUP BY id")
def s14(spark, d):
    with shared.work_folder(spark, "s14") as top:
        lines = log(spark, d).select(F.to_json(F.struct("id", "seq", "choice")).alias("value"))
        lines.unionByName(spark.createDataFrame([("{broken",), ('{"id": null}',), ('{"id": "cut"} {',)], "value string")).write.text(top)
        rows = spark.read.text(top).select(F.col("value").alias("row"), F.get_json_object("value", "$.seq").cast("long").alias("seq"))
        return shared.checkpointed(last_by_key(rows, "id", "seq").select("id", F.get_json_object("row", "$.choice").alias("choice")))


@query(
    "m9_lenient_intervals",
    """WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations), g AS (SELECT conv_id, bool_or(n % 5 <> 0) AS strict FROM t GROUP BY 1)
    SELECT conv_id, 't' || turn AS question, CASE WHEN n % 5 = 0 THEN CAST(turn AS DOUBLE) ELSE 10.0 * turn END AS start, CASE WHEN n % 5 = 0 THEN turn + 4.5 ELSE CAST(n AS DOUBLE) END AS "end", CASE WHEN strict THEN 'strict' ELSE 'lenient' END AS layer FROM t JOIN g USING (conv_id)""",
)
def m9(spark, d):
    """A reply for each conversation: an object of answers with its turns as notes, some of which don't parse; those stand in lines before it."""
    turns = table(spark, d, "conversations").selectExpr("conv_id", "turn", "coalesce(text, '') as note", "concat('t', turn) as id", "length(coalesce(text, '')) % 5 = 0 as bad")
    row = F.struct("id", F.when(F.col("bad"), "soon").otherwise((F.col("turn") * 10).cast("string")).alias("start"), F.concat(F.length("note").cast("string"), F.lit(" s")).alias("end"), "note")
    line = F.when(F.col("bad"), F.concat("id", F.lit(" took "), F.col("turn").cast("string"), F.lit(" to "), (F.col("turn") + 4.5).cast("string")))
    replies = turns.groupBy("conv_id").agg(F.collect_list(line).alias("lines"), F.collect_list(row).alias("answers"), F.collect_list("id").alias("ids"))
    replies = replies.select("conv_id", F.concat(F.concat_ws("\n", "lines"), F.lit("\nSo: "), F.to_json(F.struct("answers")), F.lit(" done")).alias("reply"), "ids")
    return iv.one_row_each(replies, "reply", "ids").select("conv_id", "question", "start", "end", "layer")


@query(
    "s10_s11_loaded",
    "SELECT 'fam' || (p_partkey // 1000) AS family, CAST(p_partkey AS VARCHAR) AS id, '/media/fam' || (p_partkey // 1000) || '/clips/' || p_partkey || '.mp4' AS path, p_name AS text, true AS same FROM part",
)
def s10(spark, d):
    """Items of families of a thousand, a document each, loaded raw and normalised."""
    part = table(spark, d, "part").withColumn("family", F.expr("concat('fam', p_partkey div 1000)"))
    item = F.struct(F.col("p_partkey").alias("id"), F.concat(F.lit("clips/"), F.col("p_partkey").cast("string"), F.lit(".mp4")).alias("clip_path"), F.col("p_name").alias("question"))
    docs = part.groupBy("family").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list(F.to_json(item))), F.lit("]")).alias("value"))
    media = part.select(F.concat(F.lit("/media/"), "family", F.lit("/clips/"), F.col("p_partkey").cast("string"), F.lit(".mp4")).alias("file"))
    with shared.work_folder(spark, "s10") as top:
        docs.repartition("family").write.partitionBy("family").text(f"{top}/new")
        for name in shared.children(spark, f"{top}/new"):
            if name.startswith("family="):
                shared.move_into(spark, f"{top}/new/{name}", ".txt", f"{top}/raw/{name.removeprefix('family=')}", "understanding.json")
        loading.build(spark, f"{top}/raw", f"{top}/out", "builder 1", media)
        raw, built = (loading.load(spark, f"{top}/raw", f"{top}/out", "builder 1", source, media=media) for source in ("raw", "normalised"))
        both = raw.join(built.withColumnRenamed("item", "other"), ["family", "task", "id"], "full")
        return shared.checkpointed(both.select("family", "id", F.get_json_object("item", "$.clip_path").alias("path"), F.get_json_object("item", "$.question").alias("text"), F.col("item").eqNullSafe(F.col("other")).alias("same")))


@query(
    "u4_u5_sides",
    """WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS answer, o_orderkey % 2 = 0 AS correct FROM orders), b AS (SELECT l_orderkey + 1 AS id, CASE WHEN count(*) > 2 THEN max(l_linestatus) END AS answer, l_orderkey % 4 = 0 AS correct FROM lineitem GROUP BY l_orderkey)
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'only_a' WHEN a.id IS NULL THEN 'only_b' ELSE 'both' END AS side, a.answer IS NOT DISTINCT FROM b.answer AS same_answer, a.correct IS NOT DISTINCT FROM b.correct AS same_verdict FROM a FULL JOIN b ON a.id = b.id""",
)
def u4(spark, d):
    a = table(spark, d, "orders").selectExpr("o_orderkey as id", "o_orderstatus as answer", "o_orderkey % 2 = 0 as correct")
    b = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.expr("if(count(*) > 2, max(l_linestatus), null)").alias("answer"))
    return runs.sides(a, b.selectExpr("l_orderkey + 1 as id", "answer", "l_orderkey % 4 = 0 as correct"))


@query(
    "p19_o7_first_units",
    """WITH u AS (SELECT user_id, CAST(day(ts) AS BIGINT) AS unit, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY unit) AS nth, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u) SELECT user_id, unit, n FROM b WHERE nth <= 5 AND before < 8""",
)
def p19(spark, d):
    units = table(spark, d, "events").groupBy("user_id", F.dayofmonth("ts").cast("bigint").alias("unit")).agg(F.count("*").alias("n"))
    return runs.units_up_to(units, "user_id", 8, first=5)


@query(
    "x8_relative",
    """SELECT '../clips/' || p_partkey || '.mp4' AS path, CASE WHEN p_partkey % 3 = 0 THEN 'relative' WHEN p_partkey % 3 = 1 THEN 'resolved' ELSE 'unresolved' END AS status,
    CASE WHEN p_partkey % 3 = 0 THEN '/data/qa/clips/' || p_partkey || '.mp4' WHEN p_partkey % 3 = 1 THEN '/data/else/' || p_partkey || '.mp4' END AS found FROM part""",
)
def x8(spark, d):
    part = table(spark, d, "part")
    files = part.selectExpr("explode(case p_partkey % 3 when 0 then array(concat('/data/qa/clips/', p_partkey, '.mp4'), concat('/data/other/clips/', p_partkey, '.mp4')) when 1 then array(concat('/data/else/', p_partkey, '.mp4')) else array(concat('/data/none/', p_partkey, '.txt')) end) as file")
    return reports.resolved(part.selectExpr("concat('../clips/', p_partkey, '.mp4') as path"), files, base="/data/qa/fam/./")


@query(
    "t24_rewritten",
    """WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'clips/' || p_partkey || '.mp4' WHEN 1 THEN '/old/place/clips/' || p_partkey || '.mp4' WHEN 2 THEN '/qa/fam/clips/' || p_partkey || '.mp4' WHEN 3 THEN '/raw/' || p_partkey || '.mp4' ELSE 'gone/' || p_partkey || '.mp4' END AS path FROM part)
    SELECT path, CASE k % 5 WHEN 0 THEN 'rewritten' WHEN 1 THEN 'rewritten' WHEN 2 THEN 'already_ok' WHEN 3 THEN 'provenance' ELSE 'unresolved' END AS status, CASE WHEN k % 5 < 3 THEN '/qa/fam/clips/' || k || '.mp4' ELSE path END AS found FROM p""",
)
def t24(spark, d):
    part = table(spark, d, "part")
    path = "case p_partkey % 5 when 0 then concat('clips/', p_partkey, '.mp4') when 1 then concat('/old/place/clips/', p_partkey, '.mp4') when 2 then concat('/qa/fam/clips/', p_partkey, '.mp4') when 3 then concat('/raw/', p_partkey, '.mp4') else concat('gone/', p_partkey, '.mp4') end as path"
    return reports.rewritten(part.selectExpr(path), part.selectExpr("concat('/qa/fam/clips/', p_partkey, '.mp4') as file"), "/qa/fam", ["/old/place", "/older"])


@query("s13_cache_keys", "SELECT DISTINCT 'c' || (p_partkey // 1000) AS cache, 'pick ' || lower(p_name) AS key FROM part")
def s13(spark, d):
    """Caches of a thousand labels each, a document for each cache."""
    part = table(spark, d, "part").withColumn("cache", F.expr("concat('c', p_partkey div 1000)"))
    label = F.concat(F.lit("Pick the "), "p_name", F.lit("."))
    docs = part.groupBy("cache").agg(F.to_json(F.create_map(F.lit("distractors"), F.map_from_entries(F.collect_set(F.struct(label.alias("k"), F.lit(1).alias("v")))))).alias("value"))
    with shared.work_folder(spark, "s13") as top:
        docs.repartition("cache").write.partitionBy("cache").text(f"{top}/new")
        for name in shared.children(spark, f"{top}/new"):
            if name.startswith("cache="):
                shared.move_into(spark, f"{top}/new/{name}", ".txt", f"{top}/caches", f"{name.removeprefix('cache=')}.json")
        return shared.checkpointed(cache_keys(spark, f"{top}/caches/*.json", "distractors"))


@query(
    "k3_k4_k5_written",
    """WITH b AS (SELECT p_brand AS model, count(*) AS n, round(avg(p_size), 3) AS value FROM part GROUP BY 1), m AS (SELECT row_number() OVER (ORDER BY model) + 1 AS n, '| ' || model || ' | ' || n || ' | ' || value || ' |' AS line FROM b)
    SELECT 'markdown' AS file, CAST(n AS BIGINT) AS n, line FROM m UNION ALL VALUES ('markdown', 0, '| model | n | value |'), ('markdown', 1, '| --- | --- | --- |') UNION ALL SELECT 'csv', n, model || '=' || value FROM b UNION ALL SELECT 'export', n, model FROM b""",
)
def k3(spark, d):
    board = table(spark, d, "part").groupBy(F.col("p_brand").alias("model")).agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 3).alias("value"))
    with shared.work_folder(spark, "k3") as top:
        sinks.write_csv(board, f"{top}/csv", ["value", "model", "n"])
        sinks.export(board, board.agg(F.sum("n").alias("total")), {"run": "all"}, f"{top}/export")
        written = spark.read.option("header", True).csv(f"{top}/csv").select(F.lit("csv").alias("file"), F.col("n").cast("long").alias("n"), F.concat_ws("=", "model", "value").alias("line"))
        exported = spark.read.json(f"{top}/export/results").select(F.lit("export").alias("file"), "n", F.col("model").alias("line"))
        return shared.checkpointed(sinks.markdown(board, ["model"]).select(F.lit("markdown").alias("file"), "n", "line").unionByName(written).unionByName(exported))


@query(
    "o6_capped_examples",
    "WITH f AS (SELECT o_orderstatus AS kind, o_orderpriority AS family, min('order ' || o_custkey) AS detail FROM orders GROUP BY 1, 2, substr('order ' || o_custkey, 1, 40)), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY family, detail) AS n FROM f) SELECT kind, CAST(n AS INT) AS n, family, detail FROM r WHERE n <= CASE kind WHEN 'F' THEN 8 WHEN 'O' THEN 12 ELSE 5 END",
)
def o6(spark, d):
    findings = table(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("family"), F.concat(F.lit("order "), F.col("o_custkey").cast("string")).alias("detail"))
    return labels.examples(findings, 5, {"F": 8, "O": 12})


@query("g8_none_option", "SELECT p_partkey AS item, CAST(NULL AS VARCHAR) AS none_option FROM part UNION ALL SELECT p_partkey, 'All other options are wrong.' FROM part")
def g8(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item"))
    return questions.with_none_option(items, "off").unionByName(questions.with_none_option(items, "fixed"))
