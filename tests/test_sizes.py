"""What larger tables need of a plan: rules that small tables do not show."""

import glob
import hashlib
import random

import corpus_pipeline
from corvane import sinks, streaming
from corvane.llm import common, neardup
from corvane.operators import media, questions, reports, vectors
from corvane.plans import pictures as plans_pictures


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_paths_and_files_are_not_broadcast(spark):
    """Nothing says how many there are: a driver that gathers them all for the executors runs out of memory."""
    paths = spark.range(4).selectExpr("concat('../clips/', id, '.mp4') as path")
    files = spark.range(4).selectExpr("concat('/data/qa/clips/', id, '.mp4') as file")
    found = reports.resolved(paths, files, base="/data/qa/fam")
    assert "Broadcast" not in plan(found) and {r["status"] for r in found.collect()} == {"relative"}


def test_items_and_their_paths_are_not_broadcast(spark):
    items = spark.range(4).selectExpr("id", """concat('{"clip_path": "clips/', id, '.mp4"}') as item""")
    files = spark.range(4).selectExpr("concat('/media/clips/', id, '.mp4') as file")
    found = media.relocated(items, files)
    assert "Broadcast" not in plan(found) and all("/media/clips/" in r["item"] for r in found.collect())


def shuffles(spark) -> dict[str, int]:
    """Bytes of the shuffles that are on disk."""
    out: dict[str, int] = {}
    for line in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"):
        name = line.rsplit("/", 1)[-1]
        if name.startswith("shuffle_") and name.endswith(".data"):
            out[name.split("_")[1]] = out.get(name.split("_")[1], 0) + spark._jvm.java.io.File(line).length()
    return out


def documents(spark, n: int, copies: int):
    """n documents of random words, of which so many are near copies of the first."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(n)]
    for i in range(1, copies + 1):
        texts[i] = texts[0].rsplit(" ", i)[0]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).localCheckpoint()


def test_shuffles_of_near_duplicates_go_step_by_step(spark, monkeypatch):
    """The disk of a step was that of all steps before it."""
    docs, true, alive = documents(spark, 300, 20), common.checkpointed, []
    common.free(spark)
    before = set(shuffles(spark))

    def watched(df):
        out = true(df)
        alive.append(len(set(shuffles(spark)) - before))
        return out

    monkeypatch.setattr(common, "checkpointed", watched)
    assert neardup.near_duplicates(docs).filter("kept").count() == 280
    assert len(alive) > 10 and max(alive[:8]) <= 12, alive


def test_ids_that_may_be_there(spark):
    ids, all_ = spark.range(0, 10_000, 10), spark.range(10_000).selectExpr("if(id = 5, null, id) as id")
    got = {r["id"] for r in all_.filter(common.maybe_in(ids, "id")(all_["id"])).collect()}
    assert None not in got and {r["id"] for r in ids.collect()} <= got and len(got) < 1100


def test_documents_that_are_alone_are_not_shuffled(spark):
    docs = documents(spark, 400, 4).selectExpr("if(doc_id = 399, null, doc_id) as doc_id", "text")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    before = set(shuffles(spark))
    rows = kept.collect()
    assert len(rows) == 396 and sum(r["doc_id"] is None for r in rows) == 1
    assert sum(n for k, n in shuffles(spark).items() if k not in before) < 40_000  # all texts are 600 KB


def test_pictures_are_shuffled_once_for_each_bucket(spark):
    before = set(shuffles(spark))
    assert plans_pictures.episodes(spark, "/root/testdata/sf0.001").collect()
    assert sum(n for k, n in shuffles(spark).items() if k not in before) < 400_000  # 15 vectors of 64 bytes for each of 1,000 events are 960 KB


def test_a_fingerprint_is_that_of_its_sql_however_many_rows(spark):
    def expected(lines):
        buckets: dict[str, list[str]] = {}
        for x in sorted(hashlib.sha256(t.encode()).hexdigest() for t in lines):
            buckets.setdefault(x[:3], []).append(x)
        md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
        return md5("".join(sorted(b + md5("".join(ls)) for b, ls in buckets.items())))[:12]

    few = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, t string")
    assert questions.fingerprint(few, "t", "id").first()[0] == expected(["1\x1fa", "1\x1fa", "2\x1fb"])
    n = 1024 * 4096 + 1
    assert questions.fingerprint(spark.range(n).selectExpr("id", "'x' as t"), "t", "id").first()[0] == expected(f"{i}\x1fx" for i in range(n))


def test_items_are_written_to_few_files(spark, tmp_path):
    items = spark.range(4000).selectExpr("concat('f', id % 40) as family", "'t' as task", "id", "'x' as text").repartition(8)
    sinks.write_items(items, str(tmp_path / "i"), "b")
    assert len(glob.glob(f"{tmp_path}/i/*/family=*/task=*/*.parquet")) <= 48 and sinks.read_items(spark, str(tmp_path / "i")).count() == 4000


def test_streaks_need_no_python_and_no_outcome_is_no_failure(spark, tmp_path):
    lines = ['{"seq": 1, "ok": false, "k": "a"}', '{"seq": 2, "k": "a"}', '{"seq": 3, "ok": false, "k": "a"}', '{"seq": 1, "ok": false, "k": "b"}', '{"seq": 2, "ok": false, "k": "b"}']
    (tmp_path / "in").mkdir()
    for n, line in enumerate(reversed(lines)):
        (tmp_path / "in" / f"{n}.json").write_text(line + "\n")
    log = streaming.lines(spark, str(tmp_path / "in"), "seq long, ok boolean, k string", 2)
    assert "InPandas" not in streaming.streaks(log, "k", 2)._jdf.queryExecution().analyzed().toString()
    streaming.watch(log, "k", 2, str(tmp_path / "out"), str(tmp_path / "c"), span=2, buckets=2).awaitTermination()
    assert sorted(map(tuple, streaming.broken_at(sinks.table(spark, str(tmp_path / "out")), 2).collect())) == [("a", 3), ("b", 2)]


def test_blocks_of_pictures_are_not_shuffled_for_each_pair(spark):
    frames = spark.range(4000).selectExpr("'f' as family", "'v' as view", "id as key", "cast(id % 3 as string) as subtask", "transform(sequence(1, 64), i -> cast(xxhash64(id, i) as double)) as vector")
    before = set(shuffles(spark))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert vectors.floors(frames).count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(n for k, n in shuffles(spark).items() if k not in before) < 8_000_000  # all vectors are 2 MB, all pairs of their 16 blocks 35 MB
