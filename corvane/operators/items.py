"""Question items as documents: what is asked, what is true and where it comes from, each apart; and labels of their media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bound, clock_of_remainder
from .questions import LETTERS, letter_of, shuffled

# The role of a kind of media in a prompt, and the length of a label.
ROLES = {"clip": "clip", "video": "context", "frame": "frame"}
LABEL = 80


def path_of(folder: str, kind: Column, key: Column) -> Column:
    return F.concat(F.lit(f"{folder}/"), key, F.when(kind == "frame", ".jpg").otherwise(".mp4"))


def _block(role: Column, view: Column, kind: Column, key: Column, folder: str) -> Column:
    return F.struct(role.alias("role"), view.alias("view"), F.when(kind == "frame", "image").otherwise("video").alias("kind"), path_of(folder, kind, key).alias("path"))


def documents(items: DataFrame, folder: str) -> DataFrame:
    """id, family, task, prompt (stem, options, media), truth (answer, answer_text, option_text, subtask, seconds) and provenance of items.

    items: item, family, task, stem, answer_text, distractors (texts), pictures (structs of key and view; the options, if
    there are any), correct (the key of the right one), start and end (seconds; of time questions), subtask, media
    (structs of kind, view and key) and provenance. Options are shuffled by the md5 of item and option, texts and
    pictures alike; options that are pictures have no text and come after the prompt's own media, by role. Nothing of
    the truth is in the prompt.
    """
    own = F.transform("media", lambda m, i: _block(F.when(F.col("task") == "step_order", F.concat(F.lit("step:"), (i + 1).cast("string"))).otherwise(F.coalesce(*[F.when(m["kind"] == k, r) for k, r in ROLES.items()])), m["view"], m["kind"], m["key"], folder))
    pictured, timed = F.size("pictures") > 0, F.col("task") == "time"
    keys = F.transform("pictures", lambda p: p["key"])
    said = F.when(pictured, keys).when(timed, F.array().cast("array<string>")).otherwise(F.concat(F.array("answer_text"), "distractors"))
    rows = items.withColumn("_order", shuffled(F.col("item"), said))
    letter = lambda i: F.substring(F.lit(LETTERS), i + 1, F.lit(1))
    options = F.transform("_order", lambda o, i: F.struct(letter(i).alias("id"), F.when(~pictured, o).alias("text")))
    view = lambda k: F.get(F.filter("pictures", lambda p: p["key"] == k), F.lit(0))["view"]
    shown = F.when(pictured, F.transform("_order", lambda o, i: _block(F.concat(F.lit("option:"), letter(i)), view(o), F.lit("frame"), o, folder)))
    prompt = F.struct(F.col("stem"), options.alias("options"), F.when(pictured, F.concat(own, shown)).otherwise(own).alias("media"))
    interval = F.concat_ws("-", clock_of_remainder(F.col("start")), clock_of_remainder(F.col("end")))
    answer = F.when(timed, interval).otherwise(letter_of(F.col("_order"), F.when(pictured, F.col("correct")).otherwise(F.col("answer_text"))))
    seconds = F.when(timed, F.struct("start", "end"))
    truth = F.struct(answer.alias("answer"), F.when(~timed, F.col("answer_text")).alias("answer_text"), F.when(~timed & ~pictured, F.col("answer_text")).alias("option_text"), F.col("subtask"), seconds.alias("seconds"))
    return rows.select(F.col("item").alias("id"), "family", "task", prompt.alias("prompt"), truth.alias("truth"), "provenance")


def media_labels(parts: Column) -> Column:
    """Of the parts (kind, value) of a call its pictures and videos as structs kind, path and label: the beginning of the text just before each, or nothing."""
    def step(s: Column, p: Column) -> Column:
        here = F.struct(p["kind"].alias("kind"), p["value"].alias("path"), s["label"].alias("label"))
        media = F.struct(F.array_append(s["out"], here).alias("out"), F.lit("").alias("label"))
        text = F.struct(s["out"].alias("out"), F.substring(p["value"], 1, LABEL).alias("label"))
        return F.when(p["kind"] == "text", text).when(p["kind"].isin("image", "video"), media).otherwise(s)

    start = F.struct(F.array().cast("array<struct<kind:string,path:string,label:string>>").alias("out"), F.lit("").alias("label"))
    return bound(F.aggregate(parts, start, step), lambda s: s["out"])
