"""Inputs: Parquet tables, JSON lines with a broken end, and the derived views that the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import strict_json


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled frame intervals made of events: 20 frames a second of the day, 400 frames per unit of value."""
    micros = F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(86_400_000_000))
    start = F.floor(micros * 20 / 1_000_000).cast("bigint")
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("fam"), (F.col("user_id") % 6).cast("string")).alias("family"), F.col("user_id").alias("file"), F.dayofmonth("ts").cast("bigint").alias("episode"),
        F.col("event_type").alias("subtask"), start.alias("start_frame"), (start + F.floor(F.col("value") * 400).cast("bigint")).alias("end_frame"),
    )


SEGMENTS = """seg AS (
  SELECT event_id, 'fam' || (user_id % 6) AS family, user_id AS file, CAST(day(ts) AS BIGINT) AS episode, event_type AS subtask,
    CAST(floor((epoch_us(ts) % 86400000000) * 20 / 1000000) AS BIGINT) AS start_frame,
    CAST(floor((epoch_us(ts) % 86400000000) * 20 / 1000000) AS BIGINT) + CAST(floor(value * 400) AS BIGINT) AS end_frame
  FROM events)"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video for each file and episode of the segments: frames, duration in seconds and a declared frame rate, some of them wrong."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.dayofmonth("ts").cast("bigint").alias("episode")).distinct().selectExpr(
        "file", "episode", "1728000 + (file % 5) * 1000 as frames", "86400.0D + (file % 3) * 40 as duration", "if(file % 7 = 0, 21.0D, 20.0D) as declared_fps"
    )


VIDEOS = """video AS (SELECT file, episode, 1728000 + (file % 5) * 1000 AS frames, CAST(86400 + (file % 3) * 40 AS DOUBLE) AS duration, CASE WHEN file % 7 = 0 THEN 21.0 ELSE 20.0 END AS declared_fps FROM (SELECT DISTINCT user_id AS file, CAST(day(ts) AS BIGINT) AS episode FROM events))"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append log made of events: one id per user and day, failures among the attempts."""
    return table(spark, sf_dir, "events").select(
        F.format_string("%d/%d", "user_id", F.dayofmonth("ts")).alias("id"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"),
        "user_id", F.col("event_type").alias("choice"), "value",
    )


LOG = "log AS (SELECT user_id || '/' || day(ts) AS id, event_id AS seq, event_type <> 'error' AS ok, user_id, event_type AS choice, value FROM events)"


def categories(lines: DataFrame, name: str, *order: str) -> DataFrame:
    """Lines of vocabularies: numbers before a class are stripped, empty lines and those of `#` left out, and of lines that differ in case only the first is kept."""
    from ..functions.words import class_text

    clean = lines.withColumn("line", class_text(F.col("line"))).filter("line <> '' and not startswith(line, '#')")
    return clean.groupBy(name, F.lower("line").alias("key")).agg(F.min_by("line", F.struct(*order)).alias("line"))


def items(spark: SparkSession, path: str) -> DataFrame:
    """file, item (JSON text) of JSON documents that are a list of objects or have one under `items`; what is no object is left out. A document that isn't JSON has no items."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), strict_json(F.col("value")).alias("v"))
    listed = docs.withColumn("l", F.coalesce(F.try_variant_get("v", "$.items", "array<variant>"), F.try_variant_get("v", "$", "array<variant>")))
    return listed.select("file", F.explode("l").alias("i")).filter(F.startswith(F.schema_of_variant("i"), F.lit("OBJECT"))).select("file", F.to_json("i").alias("item"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n (from 0), last, row: the lines of text files that aren't blank.

    A file is read in splits by many tasks. Lines of one split have consecutive ids; how many lines the file's splits
    before it have is summed over one row for each split.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("row")).filter(F.trim(F.regexp_replace("row", r"\s", " ")) != "")
    lines = lines.withColumn("_id", F.monotonically_increasing_id())
    splits, order = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")), W.partitionBy("file").orderBy("_block")
    splits = splits.withColumn("_before", F.sum("_n").over(order) - F.col("_n")).withColumn("_all", F.sum("_n").over(W.partitionBy("file"))).drop("_n")
    out = lines.join(splits, ["file", "_block"]).withColumn("n", F.col("_before") + F.col("_id") - F.col("_first"))
    return out.select("file", "n", (F.col("n") == F.col("_all") - 1).alias("last"), "row")


def results(spark: SparkSession, path: str) -> DataFrame:
    """file, n, row of JSON lines, in which the last line of a file may be broken, as a run that was stopped leaves it; another broken line is an error."""
    marked = numbered_lines(spark, path).withColumn("broken", strict_json(F.col("row")).isNull())
    failed = F.raise_error(F.concat(F.lit("broken line "), F.col("n").cast("string"), F.lit(" of "), F.col("file"))).cast("string")
    return marked.filter("not broken or not last").select("file", "n", F.when(F.col("broken"), failed).otherwise(F.col("row")).alias("row"))


def last_by_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of rows of a cache (a row text of JSON) the last of each key; rows that do not parse or have no key do not count."""
    keyed = rows.withColumn(key, F.try_variant_get(strict_json(F.col("row")), f"$.{key}", "string")).filter(F.col(key).isNotNull())
    return keyed.groupBy(key).agg(F.max_by("row", F.struct(*order)).alias("row"))


def cache_keys(spark: SparkSession, path: str, field: str) -> DataFrame:
    """cache (a file's name without its ending), key: the keys, as labels are compared, of what each JSON document has under the field."""
    from ..functions.words import key

    docs = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*?)\.json$", 1).alias("cache"), strict_json(F.col("value")).alias("v"))
    own = F.map_keys(F.try_variant_get("v", f"$.{field}", "map<string,variant>"))
    return docs.select("cache", F.explode(own).alias("k")).select("cache", key(F.col("k")).alias("key")).distinct()


def episode_bounds(spark: SparkSession, path: str, views: list[str]) -> DataFrame:
    """file, bound (from 0), lo, hi: the stretches of a family's videos, from all Parquet files below the folder, and the columns of the first of the views that they have.

    Columns are named videos/observation.images.<view>/file_index, from_timestamp and to_timestamp.
    """
    meta = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(path)
    prefix = next((p for p in (f"videos/observation.images.{v}/" for v in views) if any(c.startswith(p) for c in meta.columns)), None)
    if prefix is None:
        return spark.createDataFrame([], "file string, bound long, lo double, hi double")
    rows = meta.select(F.format_string("file-%03d", F.col(f"`{prefix}file_index`").cast("int")).alias("file"), *[F.col(f"`{prefix}{c}_timestamp`").cast("double").alias(a) for c, a in (("from", "lo"), ("to", "hi"))])
    return rows.withColumn("bound", (F.row_number().over(W.partitionBy("file").orderBy("lo", "hi")) - 1).cast("bigint")).select("file", "bound", "lo", "hi")


def located(candidates: DataFrame) -> DataFrame:
    """candidates (family, run, depth, path) of question files: the one at the least depth; several of the same depth are an error."""
    first = candidates.groupBy("family", "run", "depth").agg(F.min("path").alias("path"), F.count("*").alias("n")).groupBy("family", "run").agg(F.min(F.struct("depth", "n", "path")).alias("r"))
    clash = F.raise_error(F.concat(F.lit("several files of one depth: "), F.col("r.path"))).cast("string")
    return first.select("family", "run", F.when(F.col("r.n") > 1, clash).otherwise(F.col("r.path")).alias("path"))
