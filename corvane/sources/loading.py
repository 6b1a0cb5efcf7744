"""One way to load question items, for a run as for what is checked or estimated before it.

Raw items are read from their files and get their media paths resolved each time; normalised ones were built once from
the same files by the same steps. Which of both is meant is always said, and nothing falls back to the other: normalised
items of another builder, or of files that have changed, been added or gone since, are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared, sinks
from ..operators.media import relocated
from ..operators.questions import fingerprint
from . import items

SOURCES = ("raw", "normalised")


def inputs(spark: SparkSession, raw: str) -> DataFrame:
    """family, task, file, size, modified of the files <raw>/<family>/<task>.json; their contents aren't read."""
    files = spark.read.format("binaryFile").load(f"{raw}/*/*.json").select("path", "length", "modificationTime")
    part = lambda n: F.element_at(F.split("path", "/"), n)
    return files.select(part(-2).alias("family"), F.regexp_replace(part(-1), r"\.json$", "").alias("task"), F.col("path").alias("file"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))


def states(spark: SparkSession, raw: str) -> dict[str, str]:
    """Of each family a digest of its files' names, sizes and times."""
    files = inputs(spark, raw).withColumn("state", F.concat_ws("|", "size", "modified"))
    return {r["family"]: r["fingerprint"] for r in fingerprint(files.select("family", "task", "state"), "state", "task", by=("family",)).collect()}  # a row for each family


def resolved_items(spark: SparkSession, files: str, media: DataFrame | None) -> DataFrame:
    """family, task, id, item (JSON text) of question files, with media paths that mean one of the files (media: file) replaced by it."""
    rows = items(spark, files)
    part = lambda n: F.element_at(F.split("file", "/"), n)
    rows = rows.select(part(-2).alias("family"), F.regexp_replace(part(-1), r"\.json$", "").alias("task"), F.get_json_object("item", "$.id").alias("own"), "item")
    rows = rows.withColumn("id", F.concat_ws("/", "family", "task", "own"))
    if media is not None:
        rows = rows.drop("item").join(relocated(rows.select("id", "item"), media), "id")
    return rows.select("family", "task", F.col("own").alias("id"), "item")


def build(spark: SparkSession, raw: str, out: str, builder: str, media: DataFrame | None = None, families: list[str] | None = None) -> dict:
    """Write the normalised items of all families, or of some beside those that are there; the manifest, with the state of the files that they were made of."""
    now = states(spark, raw)
    wanted = sorted(now) if families is None else families
    rows = resolved_items(spark, f"{raw}/{{{','.join(wanted)}}}/*.json", media)
    return sinks.write_items(rows, out, builder, whole=families is None, notes={f: {"inputs": now[f]} for f in wanted if f in now})


def stale(spark: SparkSession, raw: str, out: str, builder: str, families: list[str]) -> list[str]:
    """Why normalised items can't be used; nothing if they can."""
    said, now = sinks.manifest(spark, out), states(spark, raw)
    if said is None:
        return [f"{out} has no manifest"]
    if said["builder"] != builder:
        return [f"{out} was built by {said['builder']}, not by {builder}"]
    return [f"{f}: " + ("not built" if f not in said["families"] else "no files" if f not in now else "its files have changed") for f in families if said["families"].get(f, {}).get("inputs") != now.get(f) or f not in now]


def load(spark: SparkSession, raw: str, out: str, builder: str, source: str, family: str | None = None, task: str | None = None, media: DataFrame | None = None) -> DataFrame:
    """family, task, id, item of a task of a family (None: of all), raw or normalised; both differ in nothing but where they are read from."""
    if source == "raw":
        if family and task and not shared.exists(spark, f"{raw}/{family}/{task}.json"):
            raise FileNotFoundError(f"{raw}/{family}/{task}.json")
        return resolved_items(spark, f"{raw}/{family or '*'}/{task or '*'}.json", media)
    if source != "normalised":
        raise ValueError(f"source is one of {', '.join(SOURCES)}, not {source!r}")
    now = sorted(states(spark, raw)) if family is None else [family]
    why = stale(spark, raw, out, builder, now)
    if why:
        raise sinks.Stale("; ".join(why))
    rows = sinks.read_items(spark, out, now)
    return (rows if task is None else rows.filter(F.col("task") == task)).select("family", "task", "id", "item")
