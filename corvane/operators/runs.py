"""Append logs of results, run control, rollups and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import interval_metrics, md5_mod, z_score


def final_rows(log: DataFrame) -> DataFrame:
    """Per id the last success, or the last failure if there is no success. One pass with a map-side maximum, no window."""
    rest = [c for c in log.columns if c not in ("id", "ok", "seq")]
    return log.groupBy("id").agg(F.max(F.struct("ok", "seq", *rest)).alias("r")).select("id", "r.*")


def completed(log: DataFrame) -> DataFrame:
    return log.groupBy("id").agg(F.bool_or("ok").alias("done")).filter("done").select("id")


def breaker(log: DataFrame, key: str, threshold: int, span: int = 100_000) -> DataFrame:
    """Per key the first seq (a number) at which that many failures in a row were reached.

    Streaks are counted within stretches of `span` numbers, so a key's log is many groups; only one row of each stretch,
    with the failures at its end, meets the others of its key, and gives the next stretch what it begins with.
    """
    stretch = W.partitionBy(key, "_part")
    rows = log.select(key, "seq", "ok", F.floor(F.col("seq") / span).alias("_part"))
    rows = rows.withColumn("_island", F.coalesce(F.sum(F.col("ok").cast("int")).over(stretch.orderBy("seq")), F.lit(0))).withColumn("_last", F.max("_island").over(stretch))
    rows = rows.withColumn("_nth", F.sum((~F.col("ok")).cast("int")).over(W.partitionBy(key, "_part", "_island").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))
    ends = rows.groupBy(key, "_part").agg((F.max("_last") > 0).cast("int").alias("_cut"), F.count_if(~F.col("ok") & (F.col("_island") == F.col("_last"))).alias("_tail"))
    order = W.partitionBy(key).orderBy("_part")
    ends = ends.withColumn("_run", F.sum("_cut").over(order)).withColumn("_sum", F.sum("_tail").over(W.partitionBy(key, "_run").orderBy("_part")))
    before = ends.select(key, "_part", F.coalesce(F.lag("_sum").over(order), F.lit(0)).alias("_before"))
    streak = F.col("_nth") + F.when(F.col("_island") == 0, F.col("_before")).otherwise(0)
    return rows.filter("not ok").join(before, [key, "_part"]).filter(streak == threshold).groupBy(key).agg(F.min("seq").alias("broken_at"))


def units_up_to(units: DataFrame, group: str, limit: int | None = None, first: int | None = None) -> DataFrame:
    """Whole units (group, unit, n) of each group in order: at most the first so many, and of these until their rows reach the limit."""
    order = W.partitionBy(group).orderBy("unit")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = units.withColumn("_before", before).withColumn("_nth", F.row_number().over(order))
    if first is not None:
        kept = kept.filter(F.col("_nth") <= first)
    if limit is not None:
        kept = kept.filter(F.col("_before") < limit)
    return kept.select(group, "unit", "n")


def shard(rows: DataFrame, key: str, shards: int, i: int) -> DataFrame:
    return rows.filter(md5_mod(F.col(key), shards) == i - 1)


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """Choice summary of rows with answered, failed, parse_ok, parse_recovered, correct: accuracy over all, accuracy_answered over the parsed ones; all measures 0 where there is nothing."""
    n = lambda c: F.count_if(F.expr(c))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("total"), n("answered").alias("answered"), n("failed").alias("errors"), n("correct").alias("right_"), n("parse_ok").alias("parsed_"), n("correct and parse_ok").alias("both_"), n("parse_recovered").alias("parse_recovered")
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(F.lit(0.0))
    lost = F.when(F.col("total") > 0, F.round(1 - F.col("parsed_") / F.col("total"), 6)).otherwise(F.lit(0.0))
    return out.withColumn("accuracy", ratio("right_", "total")).withColumn("parse_failure_rate", lost).withColumn("accuracy_answered", ratio("both_", "parsed_")).drop("right_", "parsed_", "both_")


def parser_impact(rows: DataFrame) -> DataFrame:
    """Rows with expected, before and after (choices of two parsers): how many changed, became right, became wrong."""
    right = lambda c: F.coalesce(F.col(c) == F.col("expected"), F.lit(False))
    return rows.agg(
        F.count("*").alias("n"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("changed"), F.count_if(~right("before") & right("after")).alias("to_correct"), F.count_if(right("before") & ~right("after")).alias("to_wrong")
    )


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts and accuracy by each key for itself, empty keys as `unknown`: one pass over grouping sets."""
    named = rows.select(*[F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit("unknown")).alias(k) for k in keys], "correct")
    sets = [F.create_map(F.lit("kind"), F.lit(k), F.lit("value"), F.col(k)) for k in keys]
    one = named.select(F.explode(F.array(*sets)).alias("g"), "correct").select(F.col("g")["kind"].alias("kind"), F.col("g")["value"].alias("value"), "correct")
    return one.groupBy("kind", "value").agg(F.count("*").alias("total"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


def sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids (id, answer, correct) of two versions: in which they are (side: both, only_a, only_b), and whether answer and verdict agree (nulls are equal)."""
    both = a.select("id", F.struct("answer", "correct").alias("a")).join(b.select("id", F.struct("answer", "correct").alias("b")), "id", "full")
    side = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("both")
    return both.select("id", side.alias("side"), F.col("a.answer").eqNullSafe(F.col("b.answer")).alias("same_answer"), F.col("a.correct").eqNullSafe(F.col("b.correct")).alias("same_verdict"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many ids are on each of the sides, and of how many answer and verdict agree."""
    return sides(a, b).groupBy("side").agg(F.count("*").alias("n"), F.count_if("same_answer").alias("same_answer"), F.count_if("same_verdict").alias("same_verdict"))


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Manifest after a partial rebuild: keys of the new rows replace the old ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def time_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Interval metrics by group: overlap measures over all rows, errors over answered ones (a null prediction is not answered)."""
    m = interval_metrics(F.col("pred_start"), F.col("pred_end"), F.col("start"), F.col("end"))
    got = rows.select(*by, F.col("pred_start").isNotNull().alias("answered"), *[c.alias(k) for k, c in m.items()])
    at = [F.round(F.count_if(F.col("answered") & (F.col("tiou") >= t)) / F.count("*"), 6).alias(f"tiou_at_{int(100 * t)}") for t in (0.3, 0.5, 0.7)]
    mean = lambda c, name: F.round(F.avg(F.when(F.col("answered"), c)), 6).alias(name)
    return got.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if("answered").alias("answered"), F.round(F.sum(F.when(F.col("answered"), F.col("tiou")).otherwise(0.0)) / F.count("*"), 6).alias("mean_tiou"), *at,
        mean(F.col("center_inside").cast("double"), "center_inside"), mean(F.col("overlap_recall"), "overlap_recall"), mean(F.col("pointing").cast("double"), "pointing"), mean(F.col("abs_start_error"), "abs_start_error"), mean(F.col("abs_end_error"), "abs_end_error"),
    )


def letter_balance(rows: DataFrame, run: str, letter: str, letters: str) -> DataFrame:
    """Per run: the letter distribution's worst z against an even one, and its spread."""
    counts = [F.count_if(F.col(letter) == x).alias(x) for x in letters]
    wide = rows.groupBy(run).agg(F.count("*").alias("n"), *counts)
    worst = F.greatest(*[F.abs(z_score(F.col(x), F.col("n"), 1 / len(letters))) for x in letters])
    spread = (F.greatest(*letters) - F.least(*letters)) / F.col("n")
    return wide.select(run, "n", F.round(worst, 6).alias("worst_z"), F.round(spread, 6).alias("spread"))
