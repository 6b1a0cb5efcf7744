"""The index of labelled videos: one nested row for each file, and the totals and reasons that are rolled up from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .labels import episode_of

REPEAT = "ambiguous_repeat"


def index(segments: DataFrame, bounds: DataFrame, videos: DataFrame, slack: int) -> DataFrame:
    """One row for each file of segments (family, file, event_id, subtask, start_frame, end_frame).

    frames (of videos: file, frames; null without a video); labelled and unlabelled, the bounds (file, bound, lo, hi) that
    some or no segment begins in, the second only of files with several; gaps (lo, hi) that no segment covers, up to the
    last frame; span_coverage and labelled_fraction; full_video, whether no bound is unlabelled, and why it isn't so;
    and segments in order with bound, usable and reasons. A segment is not usable if its subtask comes again in its bound.
    """
    rows = episode_of(segments.select("family", "file", "event_id", "subtask", "start_frame", "end_frame"), bounds, slack)
    again = F.count("*").over(W.partitionBy("file", "bound", "subtask")) > 1
    by_start = W.partitionBy("file").orderBy("start_frame", "end_frame", "event_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("reasons", F.when(again, F.array(F.lit(REPEAT))).otherwise(F.array().cast("array<string>"))).withColumn("_from", F.coalesce(F.max(F.col("end_frame") + 1).over(by_start), F.lit(0)))
    gap = F.when(F.col("start_frame") > F.col("_from"), F.struct(F.col("_from").alias("lo"), (F.col("start_frame") - 1).alias("hi")))
    one = F.struct("start_frame", "end_frame", "event_id", "subtask", "bound", (F.size("reasons") == 0).alias("usable"), "reasons")
    out = rows.groupBy("family", "file").agg(
        F.sort_array(F.collect_set("bound")).alias("labelled"), F.sort_array(F.collect_list(gap)).alias("_gaps"), F.max(F.col("end_frame") + 1).alias("_reached"),
        (F.max(F.struct("start_frame", "end_frame", "event_id"))["end_frame"] - F.min("start_frame") + 1).alias("_span"), F.sum(F.col("end_frame") - F.col("start_frame") + 1).alias("_covered"), F.sort_array(F.collect_list(one)).alias("segments"),
    )
    whole = bounds.groupBy("file").agg(F.sort_array(F.collect_set("bound")).alias("_bounds"))
    out = out.join(whole, "file", "left").join(videos.select("file", "frames"), "file", "left")
    end = F.greatest("_reached", F.lit(0))
    after = F.when(F.col("frames") > end, F.array(F.struct(end.alias("lo"), (F.col("frames") - 1).alias("hi")))).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint>>"))
    share = lambda c: F.when(F.col("frames") > 0, F.round(F.col(c) / F.col("frames"), 3)).otherwise(F.lit(0.0))
    missing = F.when(F.size("_bounds") > 1, F.array_except("_bounds", "labelled")).otherwise(F.array().cast("array<bigint>"))
    why = F.when(F.size("unlabelled") > 0, F.concat(F.size("_bounds").cast("string"), F.lit(" episodes, without labels: "), F.concat_ws(", ", F.transform("unlabelled", lambda b: b.cast("string")))))
    out = out.withColumn("unlabelled", missing).withColumns({"gaps": F.concat("_gaps", after), "span_coverage": share("_span"), "labelled_fraction": share("_covered"), "full_video": F.size("unlabelled") == 0, "full_video_reason": why})
    return out.select("family", "file", "frames", "labelled", "unlabelled", "gaps", "span_coverage", "labelled_fraction", "full_video", "full_video_reason", "segments")


def totals(indexed: DataFrame) -> DataFrame:
    """Of each family, and of all under the name `all`: files, segments and usable ones, mean coverages, files of use as a whole and their share."""
    usable = F.size(F.filter("segments", lambda s: s["usable"]))
    rows = indexed.select("family", F.size("segments").alias("_n"), usable.alias("_usable"), "span_coverage", "labelled_fraction", F.col("full_video").cast("int").alias("_full"))
    out = rows.rollup("family").agg(
        F.grouping("family").alias("_all"), F.count("*").alias("files"), F.sum("_n").alias("segments"), F.sum("_usable").alias("usable"), F.round(F.avg("span_coverage"), 6).alias("span_coverage"),
        F.round(F.avg("labelled_fraction"), 6).alias("labelled_fraction"), F.sum("_full").cast("long").alias("full_videos"), F.round(F.avg("_full"), 6).alias("full_ratio"),
    )
    return out.withColumn("family", F.when(F.col("_all") == 1, "all").otherwise(F.col("family"))).drop("_all")


def reasons(indexed: DataFrame) -> DataFrame:
    """reason, n: why segments are not usable."""
    return indexed.select(F.explode("segments").alias("s")).select(F.explode("s.reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
