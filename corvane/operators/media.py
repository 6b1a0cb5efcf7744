"""Media of items: the parts that a model is sent, and paths anywhere in an item's JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .reports import MEDIA, by_shuffle, resolved

# Keys of texts, which may name files without being paths; keys of raw recordings, which are never sent.
TEXT_KEYS = ("Q", "question", "A", "answer_text", "reason", "prompt")
RAW_KEYS = (
    "original_video_path", "original_video_paths", "source_video_path", "source_video_paths", "prejoined_video_path", "prejoined_video_paths",
    "left_eye", "right_eye", "left_wrist", "right_wrist", "cam_color", "wrist_l", "wrist_r",
)
RAW_MARK = "observation.images"
_MEDIA = re.compile(MEDIA)


def _walked(node: object, path: Callable[[str], str], key: str | None = None) -> object:
    if isinstance(node, dict):
        return {k: v if k in TEXT_KEYS else _walked(v, path, k) for k, v in node.items()}
    if isinstance(node, list):
        return [_walked(v, path, key) for v in node]
    if not isinstance(node, str) or key in RAW_KEYS or RAW_MARK in node or not _MEDIA.search(node):
        return node
    return path(node)


def _rewritten(item: str | None, found: dict | None) -> str | None:
    try:
        return json.dumps(_walked(json.loads(item), lambda p: found.get(p, p)), ensure_ascii=False) if item and found else item
    except (ValueError, RecursionError):
        return item


def _paths(item: str | None) -> list[str]:
    out: dict[str, None] = {}
    try:
        _walked(json.loads(item or "null"), lambda p: out.setdefault(p) or p)
    except (ValueError, RecursionError):
        return []
    return list(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def media_paths(items: pd.Series) -> pd.Series:
    """The different paths of media in an item's JSON, at any depth; none where it does not parse."""
    return items.map(_paths)


@F.pandas_udf(T.StringType())
def with_paths(items: pd.Series, found: pd.Series) -> pd.Series:
    """The item's JSON with its paths replaced."""
    return pd.Series([_rewritten(i, None if f is None else dict(f)) for i, f in zip(items, found, strict=True)])


def relocated(items: DataFrame, files: DataFrame, group: str = "") -> DataFrame:
    """items (id, item: JSON text) with each path of media that means one of the files (file) replaced by it; others stay as they are."""
    uses = items.select("id", F.explode(media_paths("item")).alias("path"))
    found = resolved(uses, files, group).select("path", "found")
    known = F.when(F.col("found").isNotNull(), F.struct("path", "found"))  # no filter: it would be pushed into the long expressions of the search
    of_item = uses.join(by_shuffle(found), "path").groupBy("id").agg(F.map_from_entries(F.collect_set(known)).alias("_found"))
    return items.join(by_shuffle(of_item), "id", "left").withColumn("item", with_paths("item", "_found")).drop("_found")


def _part(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def _each(kind: str, paths: Column) -> Column:
    return F.transform(paths, lambda p: _part(kind, p))


def _options(options: Column) -> Column:
    no_picture = lambda o: F.raise_error(F.concat(F.lit("no picture of option "), o["id"])).cast("string")
    label = lambda o: F.concat(F.lit("Option "), F.upper(o["id"]))
    pictured = lambda o: F.array(_part("text", F.concat(label(o), F.lit(" image:"))), _part("image", F.coalesce(o["image_path"], no_picture(o))))
    return F.flatten(F.transform(options, lambda o: F.when(o["none"], F.array(_part("text", F.concat(label(o), F.lit(": "), o["text"])))).otherwise(pictured(o))))


def media_parts(task: Column, prompt: Column, videos: Column, images: Column, first: Column, options: Column) -> Column:
    """The parts (kind, value) of a call in order, the prompt last.

    Two tasks show each option as a picture under its letter, after the head's picture or the clip if there is one.
    step_order shows its pictures by number, but where there is a `first` picture (older items) that one and the next.
    planning_2 shows its images, and its videos if it has none; all others their videos. videos and images: arrays of
    paths; options: an array of id, text, image_path and none (no picture needed).
    """
    text = lambda t: F.array(_part("text", F.lit(t)))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    led = lambda words, kind, paths: F.when(F.size(paths) > 0, F.concat(text(words), _each(kind, F.slice(paths, 1, 1)))).otherwise(none)
    numbered = F.flatten(F.transform(images, lambda p, i: F.array(_part("text", F.concat(F.lit("Image "), (i + 1).cast("string"), F.lit(":"))), _part("image", p))))
    old = F.array_distinct(F.concat(F.array(first), images))
    too_few = F.raise_error(F.lit("no second picture of an older item")).cast("array<string>")
    pair = F.when(F.size(old) < 2, too_few).otherwise(F.slice(old, 1, 2))
    body = (
        F.when(task == "left_right", F.concat(led("Head camera image:", "image", images), text("Candidate options:"), _options(options)))
        .when(task == "image_in_video", F.concat(led("Left-eye video clip:", "video", videos), text("Candidate option images:"), _options(options)))
        .when((task == "step_order") & first.isNotNull(), _each("image", pair))
        .when(task == "step_order", numbered)
        .when((task == "planning_2") & (F.size(images) > 0), _each("image", images))
        .otherwise(_each("video", videos))
    )
    return F.concat(body, F.array(_part("text", prompt)))
