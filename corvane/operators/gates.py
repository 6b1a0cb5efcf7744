"""Gates before a release, and small rules of media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that tell a truth, and inputs that would give the answer away.
TRUTH_WORDS = ("answer", "truth", "seconds", "subtask", "correct", "label")


def media_key(family: Column, episode: Column, view: Column, kind: str, start: Column, end: Column) -> Column:
    return F.format_string(f"%s/%s/%s/{kind}/%06d-%06d", family, episode, view, start, end)


def truth_leaks(items: DataFrame) -> DataFrame:
    """items (prompt_keys, option_keys) with a key that tells the truth, whatever its case."""
    words = F.array(*map(F.lit, TRUTH_WORDS))
    lower = lambda c: F.transform(c, F.lower)
    return items.filter(F.arrays_overlap(lower("prompt_keys"), words) | F.arrays_overlap(lower("option_keys"), words))


def unfit(items: DataFrame) -> DataFrame:
    """items (answer, option_ids, input_keys, question) with the rules that they break: times in the input, an answer that is no option, options written twice."""
    rules = F.array_compact(F.array(
        F.when(F.arrays_overlap("input_keys", F.array(F.lit("start"), F.lit("end"))), "times in the input"),
        F.when((F.size("option_ids") > 0) & ~F.array_contains("option_ids", F.col("answer")), "answer no option"),
        F.when(F.size(F.split("question", "\nOptions:")) > 2, "options twice"),
    ))
    return items.select("id", F.explode(rules).alias("rule"))


def blinded(items: DataFrame) -> DataFrame:
    """Items of the two tasks with pictures as options, without their input."""
    return items.filter(F.col("task").isin("left_right", "image_in_video")).withColumn("input", F.lit(None).cast(items.schema["input"].dataType))


def consumed(items: DataFrame) -> DataFrame:
    """What a consumer reads of an item (id, family, episode, task, stem, options, answer, media, seconds): the input under the name that its task gives it."""
    name = F.when(F.col("task") == "time", "video_path").when(F.col("task") == "step_order", "image_paths").when(F.col("task") == "left_right", "image_path").otherwise("clip_path")
    video_id = F.concat_ws("/", "family", "episode")
    return items.select("id", video_id.alias("video_id"), F.col("task").alias("type"), "answer", name.alias("input_key"), F.when(F.col("task") == "step_order", F.array_join("media", ",")).otherwise(F.get("media", F.lit(0))).alias("input"), F.when(F.col("task") == "time", F.round("seconds", 3)).alias("video_seconds"))


def scaled_size(width: Column, height: Column, burned: Column, bar: int, pixels: float) -> Column:
    """struct(width, height) of a picture without its burned bar, of about so many pixels, both even."""
    usable = F.when(burned, height - bar).otherwise(height)
    factor = F.sqrt(F.lit(float(pixels)) / (width * usable))
    even = lambda x: F.greatest(F.lit(2).cast("bigint"), F.floor(F.bround(x * factor, 0) / 2).cast("bigint") * 2)
    return F.struct(even(width).alias("width"), even(usable).alias("height"))


def is_joined(width: Column, height: Column) -> Column:
    """Whether a picture is three views side by side."""
    return (width >= height * 3) & (width % 3 == 0)


def layout(depths: DataFrame) -> DataFrame:
    """Per family (family, depth of each question file) flat, nested or scattered."""
    deepest = depths.groupBy("family").agg(F.max("depth").alias("d"))
    return deepest.select("family", F.when(F.col("d").isNull(), "unknown").when(F.col("d") == 0, "flat").when(F.col("d") == 1, "nested").otherwise("scattered").alias("layout"))


def schema_version(run: Column, keys: Column) -> Column:
    has = lambda *names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    return F.when(run != "planning", "n/a").when(has("joined_clip", "view_order"), "current").when(has("clips", "prejoined_video_path"), "legacy").otherwise("unknown")


def picked_by_text(reply: Column, options: Column) -> Column:
    """The letter of the option that a reply repeats, else of the first that is in it; null if none is."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"^\.+|\.+$", ""))
    said = F.regexp_replace(F.lower(F.regexp_replace(F.trim(reply), "^[\"'.]+|[\"'.]+$", "")), r"^\.+|\.+$", "")
    numbered = F.transform(options, lambda t, i: F.struct(bare(t).alias("t"), i.alias("i")))
    same, part = F.filter(numbered, lambda o: o["t"] == said), F.filter(numbered, lambda o: F.contains(said, o["t"]))
    at = F.coalesce(F.get(same, F.lit(0))["i"], F.get(part, F.lit(0))["i"])
    return F.when(at.isNotNull(), F.substring(F.lit("ABCDEF"), at + 1, F.lit(1)))


def all_different(verdicts: DataFrame) -> DataFrame:
    """Candidates (family, candidate, other, verdict) that are different from all real actions."""
    return verdicts.groupBy("family", "candidate").agg(F.bool_and(F.col("verdict") == "different").alias("ok")).filter("ok").select("family", "candidate")


def chained(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (unit, at, own, hint) with the question (ids: unit, position, question) of their own id, else of the hinted position, else of their place."""
    named = ids.dropDuplicates(["unit", "position"]).groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("position", "question"))).alias("_ids"))
    joined = rows.join(named, "unit", "left")
    by_id = F.when(F.array_contains(F.map_values("_ids"), F.col("own")), F.col("own"))
    return joined.withColumn("question", F.coalesce(by_id, F.col("_ids")[F.coalesce("hint", F.col("at") + 1)])).drop("_ids")
