"""Files, sinks and streams: splits, crashes, replays, late rows and stale writes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corvane import shared, sinks, sources, streaming
from corvane.operators import runs
from corvane.sources import loading

LOG = "id string, seq long, ok boolean, run string"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_lines_of_files_in_splits(spark, tmp_path):
    text = "".join(f'{{"k": {i}, "t": "{"x" * (i % 90)}"}}\n' + ("\n" if i % 7 == 0 else "") for i in range(4000))
    (tmp_path / "a.jsonl").write_text(text + '{"k": "cut')
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n{"k": 2} \n\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = sources.results(spark, str(tmp_path / "*.jsonl")).collect()
        own = sorted((r["n"], json.loads(r["row"])["k"]) for r in got if r["file"].endswith("a.jsonl"))
        assert own == [(i, i) for i in range(4000)] and len(got) == 4002
        for broken in ('{"k": 3999} cut{"k"\n', '{"id":2} {"id":3}\n', "{}}\n"):
            (tmp_path / "c.jsonl").write_text(text[: len(text) // 2].rpartition("\n")[0] + "\n" + broken + text[len(text) // 2 :].partition("\n")[2])
            with pytest.raises(Exception, match="broken line"):
                sources.results(spark, str(tmp_path / "c.jsonl")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("seed", [1, 2])
def test_streams_end_with_the_rows_of_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    log = [(f"{r}/{rng.randrange(6)}", i, rng.random() < 0.3, r) for r in "ab" for i in range(60)] + [("c/0", i, False, "c") for i in range(25)] + [("d/0", i, i % 2 == 0, "d") for i in range(9)]
    batch = spark.createDataFrame(log, LOG)
    rng.shuffle(log)
    for n in range(4):  # late rows in every file
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps(dict(zip(("id", "seq", "ok", "run"), r, strict=True))) + "\n" for r in log[n::4]))
    stream = lambda: streaming.lines(spark, str(tmp_path / "in"), LOG)
    streaming.latest_rows(stream(), str(tmp_path / "final"), str(tmp_path / "c1"), buckets=4).awaitTermination()
    assert rows(sinks.table(spark, str(tmp_path / "final")).select("id", "ok", "seq", "run")) == rows(runs.final_rows(batch).select("id", "ok", "seq", "run"))
    streaming.watch(stream(), "run", 5, str(tmp_path / "streaks"), str(tmp_path / "c2"), span=10, buckets=4).awaitTermination()
    assert rows(streaming.broken_at(sinks.table(spark, str(tmp_path / "streaks")), 5)) == rows(runs.breaker(batch, "run", 5))
    version = sinks.manifest(spark, str(tmp_path / "streaks"))["version"]
    streaming.watch(stream(), "run", 5, str(tmp_path / "streaks"), str(tmp_path / "c2"), span=10, buckets=4).awaitTermination()
    assert sinks.manifest(spark, str(tmp_path / "streaks"))["version"] == version


def test_upserts(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda *r: spark.createDataFrame(r, "key string, base long, version long, value string")
    sinks.upsert(frame(("a", None, 1, "x"), ("b", None, 1, "y"), ("b", 1, 2, "too soon")), path, "s", 0, buckets=4)
    first = rows(sinks.table(spark, path))
    assert first == [("a", 1, "x"), ("b", 1, "y")]
    assert sinks.upsert(frame(("a", None, 9, "again")), path, "s", 0)["version"] == 1 and rows(sinks.table(spark, path)) == first
    done = sinks.upsert(frame(("a", 1, 2, "z"), ("b", 0, 2, "stale"), ("c", 5, 6, "never was")), path, "s", 1)
    assert rows(sinks.table(spark, path)) == [("a", 2, "z"), ("b", 1, "y")] and done["counters"] == {"written": 3, "refused": 3}
    sinks.upsert(frame(("b", 1, 2, "other stream")), path, "t", 0)
    assert rows(sinks.table(spark, path)) == [("a", 2, "z"), ("b", 2, "other stream")]
    assert sinks.vacuum(spark, path) and rows(sinks.table(spark, path)) == [("a", 2, "z"), ("b", 2, "other stream")]
    with pytest.raises(sinks.Stale):
        sinks._commit(spark, path, 3, {})


def test_items_with_a_manifest(spark, tmp_path):
    path = str(tmp_path / "i")
    frame = lambda *r: spark.createDataFrame(r, "family string, task string, id string, text string")
    a, b = ("f", "t", "1", "x"), ("g", "t", "1", "y")
    one = sinks.write_items(frame(a, b, ("g", "u", "2", None)), path, "b1")
    assert one["items"] == 3 and one["families"]["g"]["tasks"] == {"t": 1, "u": 1}
    two = sinks.write_items(frame(("g", "t", "1", "new")), path, "b1", whole=False)
    assert two["families"]["f"] == one["families"]["f"] and two["families"]["g"]["tasks"] == {"t": 1} and two["families"]["g"]["fingerprint"] != one["families"]["g"]["fingerprint"]
    assert rows(sinks.read_items(spark, path).select("family", "task", "id", "text")) == [a, ("g", "t", "1", "new")]
    assert sinks.write_items(frame(b, a), path, "b1")["families"]["f"]["fingerprint"] == one["families"]["f"]["fingerprint"]
    with pytest.raises(sinks.Stale, match="built by b1"):
        sinks.write_items(frame(a), path, "b2", whole=False)
    with pytest.raises(sinks.Stale, match="no manifest"):
        sinks.read_items(spark, str(tmp_path / "nothing"))
    assert len(sinks.vacuum(spark, path)) == 2 and sinks.read_items(spark, path).count() == 2


def test_compaction_survives_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    log = [("a", 1, False, "r"), ("a", 2, True, "r"), ("a", 3, False, "r"), ("b", 4, False, "r")]
    want = [("a", 2), ("b", 4)]
    final = lambda df: runs.final_rows(df)
    read = lambda: rows(runs.final_rows(spark.read.schema(LOG).json(path)).select("id", "seq"))
    for steps in range(3):  # the crash comes before the rename number `steps`
        shared.remove(spark, path)
        sinks.append_lines(spark.createDataFrame(log[:2], LOG), path)
        sinks.append_lines(spark.createDataFrame(log[2:], LOG), path)
        left, true = [steps], shared.rename

        def crash(*a, left=left, true=true):
            if not left[0]:
                raise KeyboardInterrupt
            left[0] -= 1
            true(*a)

        monkeypatch.setattr(shared, "rename", crash)
        if steps < 2:
            with pytest.raises(KeyboardInterrupt):
                sinks.compact(spark, path, final)
            monkeypatch.undo()
            sinks.recover(spark, path)
            assert read() == want
        assert sinks.compact(spark, path, final) in ((4, 2), (2, 2)) and read() == want
        monkeypatch.undo()
        assert sinks.compact(spark, path, final) == (2, 2) and not shared.exists(spark, f"{path}.old")


def test_loading_has_a_guard(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    (raw / "f").mkdir(parents=True)
    (raw / "g").mkdir()
    (raw / "f" / "t.json").write_text('{"items": [{"id": 1, "clip_path": "clips/1.mp4"}, 7]}')
    (raw / "g" / "t.json").write_text('[{"id": 1}]')
    media = spark.createDataFrame([("/m/f/clips/1.mp4",)], "file string")
    args = (spark, str(raw), out, "b1")
    with pytest.raises(sinks.Stale, match="no manifest"):
        loading.load(*args, "normalised", "f", "t")
    loading.build(*args, media)
    same = rows(loading.load(*args, "raw", "f", "t", media))
    assert same == rows(loading.load(*args, "normalised", "f", "t")) and "/m/f/clips/1.mp4" in same[0][3]
    with pytest.raises(ValueError, match="source is one of"):
        loading.load(*args, "either", "f", "t")
    with pytest.raises(FileNotFoundError):
        loading.load(*args, "raw", "f", "u")
    with pytest.raises(sinks.Stale, match="not by b2"):
        loading.load(spark, str(raw), out, "b2", "normalised", "f", "t")
    (raw / "f" / "t.json").write_text('{"items": [{"id": 2}, 7]}')
    with pytest.raises(sinks.Stale, match="f: its files have changed"):
        loading.load(*args, "normalised", "f", "t")
    assert loading.load(*args, "normalised", "g", "t").count() == 1
    loading.build(*args, media, families=["f"])
    assert rows(loading.load(*args, "normalised", "f", "t").select("id")) == [("2",)] and loading.load(*args, "normalised").count() == 2


def test_exports(spark, tmp_path):
    table = spark.createDataFrame([("m", 1.5, None), ("a|b", None, "x")], "model string, value double, note string")
    lines = [r["line"] for r in sinks.markdown(table, ["model"]).orderBy("n").collect()]
    assert lines == ["| model | value | note |", "| --- | --- | --- |", "| a\\|b | — | x |", "| m | 1.5 | — |"]
    sinks.write_csv(table, str(tmp_path / "csv"), ["note", "model"])
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "csv"))) == [("x", "a|b"), (None, "m")]
    sinks.export(table, table.agg(F.count("*").alias("total")), {"run": "r"}, str(tmp_path / "e"))
    assert json.loads(shared.read_text(spark, str(tmp_path / "e" / "meta.json"))) == {"run": "r"} and spark.read.json(str(tmp_path / "e" / "summary")).first()["total"] == 2
