"""Hand-written rows for rules that tables do not show: shared boundaries, halves, null keys, odd files."""

import itertools
import json
import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corvane import functions as fn
from corvane import sources
from corvane.functions import answers, geometry, intervals, points, words
from corvane.operators import labels, media, pictures, reports, runs

SEGMENT = "family string, file long, episode long, event_id long, subtask string, start_frame long, end_frame long"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_a_shared_boundary_is_no_overlap(spark):
    s = spark.createDataFrame([("f", 1, 0, 1, "a", 0, 10), ("f", 1, 0, 2, "b", 10, 20), ("f", 1, 0, 3, "c", 19, 30), ("f", 1, 1, 4, "d", 0, 5)], SEGMENT)
    assert [r["event_id"] for r in labels.overlaps(s).collect()] == [3]
    videos = spark.createDataFrame([(1, 0, 40), (1, 1, 6), (2, 0, 3)], "file long, episode long, frames long")
    assert rows(labels.gaps(s, videos)) == [(1, 0, 31, 39), (2, 0, 0, 2)]
    new = spark.createDataFrame([(10, 1, 0, 30, 40), (11, 1, 0, 29, 40), (12, 1, 0, 20, 19), (13, 9, 0, 1, 2)], "id long, file long, episode long, start_frame long, end_frame long")
    assert rows(labels.addable(new, s)) == [(10, True), (11, False), (12, False), (13, True)]


def test_only_what_can_be_taken_is_followed(spark):
    texts = spark.createDataFrame([("t", "Pick up the cup."), ("p", "Put the cup on table."), ("u", "Wipe the bowl with cup."), ("l", "Put the leaves in cup.")], "subtask string, text string")
    acts = [("p", 0), ("t", 1), ("t", 2), ("u", 3), ("p", 4), ("u", 5), ("l", 6)]
    s = spark.createDataFrame([("f", 1, 0, i, a, i, i + 1) for a, i in acts] + [("f", 1, 1, 9, "u", 0, 1)], SEGMENT)
    assert rows(labels.holding(s, texts)) == [(1, 0, 0, "put without take", "cup"), (1, 0, 2, "take twice", "cup"), (1, 0, 5, "use without holding", "cup"), (1, 1, 9, "use without holding", "cup")]


def test_repeated_segments_each_find_their_episode(spark):
    s = spark.createDataFrame([("f", 1, 0, 7, "a", 5, 6), ("f", 1, 0, 7, "a", 25, 26), ("f", 2, 0, 8, "a", 5, 6)], SEGMENT)
    bounds = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 20, 30), (1, 2, 27, 40)], "file long, bound long, lo long, hi long")
    assert sorted((r["start_frame"], r["bound"]) for r in labels.episode_of(s, bounds, 0).collect()) == [(5, 0), (5, 0), (25, 1)]
    assert rows(labels.unlabelled(s, bounds, 0)) == [(1, 2)]


def test_a_success_wins_over_a_later_error(spark):
    log = spark.createDataFrame([("a", 1, True, "x"), ("a", 2, False, "y"), ("b", 3, False, "u"), ("b", 4, False, "v")], "id string, seq long, ok boolean, answer string")
    assert sorted((r["id"], r["seq"]) for r in runs.final_rows(log).collect()) == [("a", 1), ("b", 4)]


def test_halves_go_to_the_even_frame(spark):
    got = spark.range(4).select(fn.phase_frame(F.lit(10), F.lit(10) + F.col("id") * 2 + 1, F.lit(0.5))).collect()
    assert [r[0] for r in got] == [10 + round((2 * i + 1) * 0.5) for i in range(4)]
    clock = spark.createDataFrame([(59.9996,), (0.0,), (3661.5,)], "s double").select(fn.clock_of_seconds(F.col("s"))).collect()
    assert [r[0] for r in clock] == ["00:00:60.000", "00:00:00.000", "01:01:01.500"]


@pytest.mark.parametrize(
    ("text", "interval"),
    [("1 – 2", (1, 2)), ("0:05 到 0:09.5", (5, 9.5)), ("3,4", (3, 4)), ("from 1:00:00 to 1:00:01", (3600, 3601)), ("", (None, None)), ("soon", (None, None)), (None, (None, None)), ('{"start": "x", "end": 2}', (None, 2))],
)
def test_intervals_in_text(spark, text, interval):
    got = spark.createDataFrame([(text,)], "t string").select(fn.interval_of_text(F.col("t")).alias("i")).first()["i"]
    assert (got["start"], got["end"]) == interval


def test_json_objects_in_prose(spark):
    texts = ['a {"x": {"y": 1}} b {broken {"z": 2}', "", None, "{" * 3000, '{"a": "}"}']
    got = [(r["o"], r["b"]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(answers.json_objects("t").alias("o"), answers.balanced_objects("t").alias("b")).collect()]
    assert got[0] == (['{"x": {"y": 1}}', '{"y": 1}', '{"z": 2}'], ['{"x": {"y": 1}}'])
    assert got[1:4] == [([], [])] * 3 and got[4][0] == ['{"a": "}"}']


def test_falsy_choices_are_passed_over(spark):
    options = F.expr("array(struct('A' as id, 'one' as text), struct('B' as id, 'two' as text))")
    texts = ['{"choice": 0, "answer": "B"}', '{"choice": false, "letter": "a"}', '{"choice": [], "option": "two"}', '{"choice": true}', "[1]", "a robot", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(answers.choice(F.col("t"), options)).collect()
    assert [r[0] for r in got] == ["B", "A", "B", None, None, "A", None]


def test_parts_of_labels(spark):
    texts = ["Pick up the tea pot lid with a spoon.", "stop", "", "Set down.", "with care"]
    got = [tuple(r["w"]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(words.parsed(F.col("t")).alias("w")).collect()]
    assert got == [("pick up", "tea pot lid", "with spoon"), ("stop", "", ""), ("", "", ""), ("set down", "", ""), ("with", "care", "")]


CURVES = [([[0, 0], [1, 0], [2, 1]], [[0, 1], [2, 2], [3, 1], [0, 0]]), ([[0, 0]], [[3, 4]]), ([], [[1, 1]]), ([[1, 1]], []), ([[5, 5], [5, 5], [1, 1], [9, 2]], [[5, 5], [1, 2], [1, 2]])]


def discrete_frechet(a, b):
    cells = {}
    for i, j in itertools.product(range(len(a)), range(len(b))):
        before = [cells[p] for p in ((i - 1, j), (i - 1, j - 1), (i, j - 1)) if p in cells]
        cells[i, j] = max(min(before) if before else 0.0, math.dist(a[i], b[j]))
    return cells[len(a) - 1, len(b) - 1] if a and b else None


def test_curves_against_direct_computation(spark):
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([([[float(x) for x in p] for p in c] for c in pair) for pair in CURVES])], "i int, a array<array<double>>, b array<array<double>>")
    a, b = F.col("a"), F.col("b")
    got = frame.select("i", geometry.frechet(a, b), geometry.hausdorff(a, b), geometry.chamfer(a, b), geometry.path_length(a), geometry.extent(a)).orderBy("i").collect()
    for (p, q), (_, frechet, hausdorff, chamfer, length, extent) in zip(CURVES, got, strict=True):
        if not p or not q:
            assert frechet is hausdorff is chamfer is None
            continue
        there, back = [min(math.dist(x, y) for y in q) for x in p], [min(math.dist(x, y) for y in p) for x in q]
        assert math.isclose(frechet, discrete_frechet(p, q)) and math.isclose(hausdorff, max(there + back)) and math.isclose(chamfer, sum(there) / len(there) + sum(back) / len(back))
        assert math.isclose(length, sum(map(math.dist, p, p[1:]))) and math.isclose(extent, math.dist([min(c) for c in zip(*p, strict=True)], [max(c) for c in zip(*p, strict=True)]), abs_tol=1e-12)
    scores = frame.select(geometry.curve_score(a, b, F.lit(10.0)).alias("s")).collect()
    assert [r["s"]["format_failure"] for r in scores] == [False, False, False, True, False] and scores[3]["s"]["score"] == 0.0 and scores[2]["s"]["score"] is None


def test_result_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"key": "x", "v": 1}\n\n{"key": "x", "v": 2}\n{"key": "y"}\n{"key": "bro')
    (tmp_path / "b.jsonl").write_text('{"key": "z"}\n')
    got = sources.results(spark, str(tmp_path / "*.jsonl"))
    assert sorted((r["file"][-7:], r["n"]) for r in got.collect()) == [("a.jsonl", 0), ("a.jsonl", 1), ("a.jsonl", 2), ("b.jsonl", 0)]
    assert {r["key"]: json.loads(r["row"]).get("v") for r in sources.last_by_key(got, "key", "file", "n").collect()} == {"x": 2, "y": None, "z": None}
    (tmp_path / "c.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    with pytest.raises(Exception, match="broken line 1"):
        sources.results(spark, str(tmp_path / "c.jsonl")).collect()


def test_question_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, 5, "x", {"id": 2}]')
    (tmp_path / "b.json").write_text('{"items": [{"id": 3}, null], "more": 1}')
    assert sorted(json.loads(r["item"])["id"] for r in sources.items(spark, str(tmp_path / "*.json")).collect()) == [1, 2, 3]
    places = "family string, run string, depth int, path string"
    assert sources.located(spark.createDataFrame([("f", "time", 2, "p"), ("f", "time", 2, "q"), ("f", "time", 0, "r")], places)).collect()[0]["path"] == "r"
    with pytest.raises(Exception, match="several files"):
        sources.located(spark.createDataFrame([("f", "time", 2, "p"), ("f", "time", 2, "q")], places)).collect()


def test_bounds_are_read_from_all_files_and_the_named_view(spark, tmp_path):
    view = "videos/observation.images.top/"
    for i, (index, lo) in enumerate([(0, 0.0), (0, 9.0), (1, 0.0)]):
        folder = tmp_path / f"chunk-{i}"
        folder.mkdir()
        columns = {"data/file_index": [7], "videos/observation.images.wrist/file_index": [5], f"{view}file_index": [index], f"{view}from_timestamp": [lo], f"{view}to_timestamp": [lo + 8]}
        pq.write_table(pa.table(columns), folder / "e.parquet")
    assert rows(sources.episode_bounds(spark, str(tmp_path), ["main", "top"])) == [("file-000", 0, 0.0, 8.0), ("file-000", 1, 9.0, 17.0), ("file-001", 0, 0.0, 8.0)]
    assert sources.episode_bounds(spark, str(tmp_path), ["main"]).count() == 0


def test_paths_are_narrowed_step_by_step(spark):
    files = ["/d/f/planning/left/1.mp4", "/d/f/time/left/1.mp4", "/d/f/time/right/1.mp4", "/d/f/time/right/2.mp4"]
    paths = {"x/right/1.mp4": "resolved", "gen/planning/z/1.mp4": "resolved", "left/1.mp4": "ambiguous", "2.mp4": "resolved", "9.mp4": "unresolved", "/d/f/time/left/1.mp4": "exact", "a/observation.images.top/1.mp4": "provenance", "words": "no media"}
    frame = spark.createDataFrame([(f,) for f in files], "file string")
    got = {r["path"]: (r["status"], r["found"]) for r in reports.resolved(spark.createDataFrame([(p,) for p in paths], "path string"), frame).collect()}
    assert {p: s for p, (s, _) in got.items()} == paths
    assert got["x/right/1.mp4"][1] == files[2] and got["gen/planning/z/1.mp4"][1] == files[0]
    by_group = reports.resolved(spark.createDataFrame([("left/1.mp4",)], "path string"), frame, "planning").first()
    assert (by_group["status"], by_group["found"]) == ("resolved", files[0])


def test_summaries_of_nothing_are_zero(spark):
    none = spark.createDataFrame([], "run string, answered boolean, failed boolean, parse_ok boolean, parse_recovered boolean, correct boolean")
    assert runs.summary(none, "run").count() == 0
    got = runs.summary(none).first().asDict()
    assert got["total"] == 0 and got["accuracy"] == got["accuracy_answered"] == got["parse_failure_rate"] == 0.0


@pytest.mark.parametrize("span", [1, 2, 3, 1000])
def test_breaker_over_stretches(spark, span):
    """Streaks that cross, fill and end with stretches of a log, against a plain count."""
    ok = {"a": "0010000", "b": "000", "c": "1" * 9, "d": "0101000001", "e": "00", "f": "1000"}
    log = [(k, i, x == "1") for k, xs in ok.items() for i, x in enumerate(xs)]
    expected = {}
    for k, xs in ok.items():
        at = xs.find("000")
        if at >= 0:
            expected[k] = at + 2
    got = runs.breaker(spark.createDataFrame(log, "k string, seq long, ok boolean"), "k", 3, span)
    assert dict(rows(got)) == expected


def test_paths_at_odd_places(spark):
    """Items that are null, no JSON, deep, or name one file twice; a name of two files stays as it is."""
    deep = "[" * 50 + '"x/a.mp4"' + "]" * 50
    items = spark.createDataFrame([(1, None), (2, "{broken a.mp4"), (3, deep), (4, '{"p": ["a.mp4", "x/a.mp4"], "reason": "a.mp4"}'), (5, '"two.png"'), (6, "")], "id long, item string")
    files = spark.createDataFrame([("d/a.mp4",), ("d/two.png",), ("e/two.png",)], "file string")
    got = {r["id"]: r["item"] for r in media.relocated(items, files).collect()}
    assert got == {1: None, 2: "{broken a.mp4", 3: deep.replace("x/", "d/"), 4: '{"p": ["d/a.mp4", "d/a.mp4"], "reason": "a.mp4"}', 5: '"two.png"', 6: ""}


def test_points_in_long_prose(spark):
    """Thousands of points, points of three numbers, null and empty texts."""
    many = "[" + ", ".join(f"[{i}, {i + 1}]" for i in range(5000)) + "]"
    brackets = ", ".join(f"({i}.5, 2, 3)" for i in range(3000))
    two = spark.createDataFrame([(1, many), (2, None), (3, "")], "id long, t string").select("id", F.size(points.in_prose(F.col("t"), 2, F.lit(0))).alias("n"))
    assert {r["id"]: r["n"] for r in two.collect() if r["n"] and r["n"] > 0} == {1: 5000}
    three = spark.createDataFrame([("(0.5, 1, 2) (1, 2, 3)",), (brackets,)], "t string").select(F.size(points.in_prose(F.col("t"), 3, F.lit(0))).alias("n"))
    assert [r["n"] if r["n"] and r["n"] > 0 else None for r in three.collect()] == [2, None]  # the second is not in metres


@pytest.mark.parametrize(
    ("text", "good"),
    [('{"a":1} garbage', False), ('{"a":1}}', False), (' {"a":1}\n', True), ("[1]", True), ("1,2", False), ('{"a":1}] , [1', False), ('1},"x":{1', False), ('{"a":1},"b":2', False), ("", False), (None, False), ('{"id":2} cut{"id"', False)],
)
def test_json_and_nothing_else(spark, text, good):
    assert spark.createDataFrame([(text,)], "t string").select(fn.strict_json(F.col("t")).isNotNull()).first()[0] == good


def test_choices_in_odd_answers(spark):
    options = F.expr("array(struct('A' as id, 'one' as text), struct('B' as id, 'two' as text), struct('C' as id, 'three' as text))")
    cases = {  # baseline, choice; strict choice, layer, rejected
        '{"choice": "zzz", "meta": {"letter": "A"}}': (None, None, None, "none", 2), 'So: {"choice": "B"} done': ("B", "B", "B", "strict", 0), '{"choice": null} The answer is C': ("C", "C", None, "none", 0),
        'x {"choice":"q"} {"label":"two"}': ("B", "B", "B", "strict", 1), "{'choice': B, 'reason': x,}": ("B", "B", "B", "strict", 0), "<think>one</think>{\"k\": 1} {\"answer\": \"C\"}": ("C", "C", "C", "strict", 0), "I say three": ("C", "C", "C", "lenient", 0),
    }
    frame = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("o", options)
    got = answers.with_choices(frame, "t", "o").withColumn("s", answers.strict_choice(F.col("t"), F.col("o"))).collect()
    assert {r["t"]: (r["baseline"], r["choice"], r["s"]["choice"], r["s"]["layer"], len(r["s"]["rejected"])) for r in got} == cases | {"<think>one</think>{\"k\": 1} {\"answer\": \"C\"}": ("A", "A", "C", "strict", 0)}


def test_several_intervals_by_id_hint_and_place(spark):
    cases = {  # text: all at once (None: an error), each for itself
        '[{"id": "b", "start": 1, "end": "0:09"}, {"index": 1, "answer": "2 to 4.5"}]': ([("a", 2.0, 4.5), ("b", 1.0, 9.0)],) * 2,
        '{"answers": [{"start_time": 3, "end_time": 5}, {"id": "2", "interval": "7, 8"}]}': ([("a", 3.0, 5.0), ("b", 7.0, 8.0)], [("a", 3.0, 5.0)]),
        '[{"id": "a", "start": "soon", "end": 2}, {"id": "b", "start": 3, "end": 4}]': (None, [("b", 3.0, 4.0)]),
        '{"a": {"from": "1s", "to": "2.5s"}, "b": {"start": "10", "end": null}} b: 7 ~ 9': (None, [("a", 1.0, 2.5), ("b", 7.0, 9.0)]),
        '[{"id":"a","start":1,"end":2},{"id":"a","start":3,"end":4}]': ([("a", 3.0, 4.0)], [("a", 1.0, 2.0)]),
        "a: from 3 – 4\nb is 5 to 6.5": ([("a", 3.0, 4.0), ("b", 5.0, 6.5)], [("a", 5.0, 6.5)]),
        '{"b": "00:00:05 - 7"}': ([("b", 5.0, 7.0)], [("b", 5.0, 7.0)]), "[1, 2]": (None, []), "none": (None, []), "": (None, []), "5": (None, []),
    }
    frame = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("ids", F.array(F.lit("a"), F.lit("b")))
    got = frame.select("t", intervals.several_intervals(F.col("t"), F.col("ids")).alias("all"), intervals.lenient_intervals(F.col("t"), F.col("ids"))["found"].alias("each")).collect()
    assert {r["t"]: (r["all"] and [tuple(x) for x in r["all"]], [tuple(x) for x in r["each"]]) for r in got} == cases


def test_a_turned_curve_comes_back(spark):
    square = [[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0]]
    c, s = math.cos(0.7), math.sin(0.7)
    turned = [[7 + c * x - s * y, -2 + s * x + c * y] for x, y in square]
    frame = spark.createDataFrame([(turned, square), (turned[:3], square), ([[2.0, 2.0]] * 4, square)], "p array<array<double>>, q array<array<double>>")
    got = [r[0] for r in frame.select(geometry.rotated_onto(F.col("p"), F.col("q"), 2)).collect()]
    assert all(math.isclose(x, y, abs_tol=1e-9) for a, b in zip(got[0], square, strict=True) for x, y in zip(a, b, strict=True))
    assert got[1] == turned[:3] and got[2] == [[2.0, 2.0]] * 4


def test_pictures_of_one_block_and_anchors_outside_of_the_clip(spark):
    def asked(subtasks, far, end=100):
        """What image_in_video makes of the first segment of an episode; far: the blocks whose pictures are far from all others."""
        segs = [("f", 1, 0, i, t, 1000 * i, 1000 * i + (end if i == 0 else 100)) for i, t in enumerate(subtasks)]
        s = spark.createDataFrame(segs, "family string, file long, episode long, event_id long, subtask string, start_frame long, end_frame long")
        frames = [(i, 1000 * i + round((end if i == 0 else 100) * p)) for i in range(len(subtasks)) for p in (0.1, 0.3, 0.5, 0.7, 0.9)]
        looks = [("f", 1, 0, "main", f, [float(n + 1 if i in far or i == 0 else 0), float(f % 7)]) for n, (i, f) in enumerate(frames)]
        rows = pictures.episodes(s, spark.createDataFrame(looks, "family string, file long, episode long, view string, frame long, vector array<double>"))
        floors = spark.createDataFrame([("f", "main", 0.3)], "family string, view string, floor double")
        got, skipped = pictures.image_in_video(rows, floors, "tail", 20.0)
        return [r["blocks"] for r in got.filter("item like 'f/1-0/0@%'").collect()], {r["reason"] for r in skipped.collect()}

    blocks, reasons = asked(["x", "y", "x"], far={1})
    assert blocks == [] and "all three of one block" in reasons
    blocks, reasons = asked(["x", "y", "z"], far={1, 2})
    assert len(blocks) == 1 and set(blocks[0]) == {1, 2}
    blocks, reasons = asked(["x", "y", "z"], far={1, 2}, end=400)
    assert blocks == [] and "anchor outside of the clip" in reasons
