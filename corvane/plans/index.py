"""The index of labelled videos, over segments of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index
from ..sources import SEGMENTS, segments, table
from .registry import query

#: A video for each user; three of four quarters of it are bounds, and all four of every fifth.
_INDEX = f"""{SEGMENTS}, f AS (SELECT DISTINCT user_id AS file FROM events), b AS (SELECT file, q AS bound, q * 432000 AS lo, q * 432000 + 431999 AS hi FROM f, range(4) t(q) WHERE q < 3 OR file % 5 = 0), v AS (SELECT file, 1728000 + (file % 5) * 1000 AS frames FROM f),
    s AS (SELECT seg.*, coalesce((SELECT min(bound) FROM b WHERE b.file = seg.file AND start_frame >= lo - 10 AND start_frame <= hi + 10), 0) AS bound FROM seg),
    r AS (SELECT *, count(*) OVER (PARTITION BY file, bound, subtask) > 1 AS again, coalesce(max(end_frame + 1) OVER (PARTITION BY file ORDER BY start_frame, end_frame, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM s),
    i AS (SELECT family, file, count(*) AS n, count_if(NOT again) AS usable, count_if(start_frame > upto) AS gaps, sum(CASE WHEN start_frame > upto THEN start_frame - upto ELSE 0 END) AS gap_frames, max(end_frame + 1) AS reached, arg_max(end_frame, (start_frame, end_frame, event_id)) - min(start_frame) + 1 AS span, sum(end_frame - start_frame + 1) AS covered, list_sort(list_distinct(list(bound))) AS labelled FROM r GROUP BY 1, 2),
    x AS (SELECT i.*, frames, list_sort(list_filter((SELECT list(bound) FROM b WHERE b.file = i.file), lambda q: NOT list_contains(labelled, q))) AS unlabelled, gaps + CASE WHEN frames > reached THEN 1 ELSE 0 END AS all_gaps, gap_frames + greatest(0, frames - greatest(reached, 0)) AS all_gap_frames, round(span / frames, 3) AS span_coverage, round(covered / frames, 3) AS labelled_fraction FROM i JOIN v USING (file))"""


def indexed(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "events").select(F.col("user_id").alias("file")).distinct()
    bounds = files.withColumn("bound", F.explode(F.sequence(F.lit(0), F.when(F.col("file") % 5 == 0, 3).otherwise(2)).cast("array<bigint>"))).selectExpr("file", "bound", "bound * 432000 as lo", "bound * 432000 + 431999 as hi")
    return index.index(segments(spark, d), bounds, files.selectExpr("file", "1728000 + (file % 5) * 1000 as frames"), 10)


@query(
    "a8_index",
    f"""WITH {_INDEX} SELECT family, file, frames, array_to_string(labelled, ',') AS labelled, array_to_string(unlabelled, ',') AS unlabelled, CAST(all_gaps AS BIGINT) AS gaps, CAST(all_gap_frames AS BIGINT) AS gap_frames, span_coverage, labelled_fraction, len(unlabelled) = 0 AS full_video,
    CASE WHEN len(unlabelled) > 0 THEN CASE WHEN file % 5 = 0 THEN 4 ELSE 3 END || ' episodes, without labels: ' || array_to_string(unlabelled, ', ') END AS full_video_reason, n AS segments, CAST(usable AS BIGINT) AS usable FROM x""",
)
def a8_index(spark, d):
    names = lambda c: F.concat_ws(",", F.col(c).cast("array<string>"))
    width = F.aggregate("gaps", F.lit(0).cast("bigint"), lambda t, g: t + g["hi"] - g["lo"] + 1)
    usable = F.size(F.filter("segments", lambda s: s["usable"])).cast("bigint")
    return indexed(spark, d).select(
        "family", "file", "frames", names("labelled").alias("labelled"), names("unlabelled").alias("unlabelled"), F.size("gaps").cast("bigint").alias("gaps"), width.alias("gap_frames"), "span_coverage", "labelled_fraction", "full_video", "full_video_reason",
        F.size("segments").cast("bigint").alias("segments"), usable.alias("usable"),
    )


@query(
    "a8_index_totals",
    f"""WITH {_INDEX} SELECT coalesce(family, 'all') AS family, count(*) AS files, CAST(sum(n) AS BIGINT) AS segments, CAST(sum(usable) AS BIGINT) AS usable, round(avg(span_coverage), 6) AS span_coverage, round(avg(labelled_fraction), 6) AS labelled_fraction,
    CAST(count_if(len(unlabelled) = 0) AS BIGINT) AS full_videos, round(avg(CAST(len(unlabelled) = 0 AS INT)), 6) AS full_ratio FROM x GROUP BY ROLLUP (family)""",
)
def a8_totals(spark, d):
    return index.totals(indexed(spark, d))


@query("a9_reasons", f"WITH {_INDEX} SELECT 'ambiguous_repeat' AS reason, count(*) AS n FROM r WHERE again")
def a9(spark, d):
    return index.reasons(indexed(spark, d))
