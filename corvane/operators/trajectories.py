"""Scores of predicted trajectories, per row and per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

SIDES = ("left_gripper", "right_gripper")


def scored(rows: DataFrame, dimension: int, zero_unscored: bool = True) -> DataFrame:
    """rows (expected and predicted: struct of left_gripper and right_gripper; in two dimensions width, height) with active, distances, scores, out_of_bounds and format_failure.

    Only the active sides count; means are over those that have a value.
    """
    expected, predicted = F.col("expected"), F.col("predicted")
    active = g.active_gripper(expected[SIDES[0]], expected[SIDES[1]], dimension)
    out = rows.withColumn("active", active)
    counts = {s: F.col("active").isin(s, "both") for s in SIDES}
    none = F.array().cast("array<array<double>>")
    every = F.concat(*[F.when(counts[s], expected[s]).otherwise(none) for s in SIDES])
    size = (F.col("width"), F.col("height")) if dimension == 2 else (None, None)
    out = out.withColumn("tolerance", g.tolerance(every, dimension, *size))
    for s in SIDES:
        out = out.withColumn(f"_{s}", F.when(counts[s], g.curve_score(expected[s], predicted[s], F.col("tolerance"), zero_unscored)))
    mean = lambda field: F.round(g.mean_available(*[F.col(f"_{s}.{field}") for s in SIDES]), 6)
    for k in g.METRICS:
        out = out.withColumn(k, mean(k)).withColumn(f"{k}_score", mean(f"{k}_score"))
    outside: Column = F.lit(0)
    if dimension == 2:
        outside = sum((F.when(counts[s], F.size(g.out_of_bounds(predicted[s], *size))).otherwise(0) for s in SIDES), F.lit(0))
    failed = F.coalesce(F.col(f"_{SIDES[0]}.format_failure"), F.lit(False)) | F.coalesce(F.col(f"_{SIDES[1]}.format_failure"), F.lit(False))
    out = out.withColumn("score", F.round(g.mean_available(*[F.col(f"{k}_score") for k in g.METRICS]), 6))
    return out.withColumn("out_of_bounds", outside).withColumn("format_failure", failed).drop(*[f"_{s}" for s in SIDES])


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """Of scored rows with answered, failed: means over answered ones, the score over all that did not fail (a missing one counts 0)."""
    ran = ~F.col("failed")
    mean = lambda c: F.round(F.avg(F.when(F.col("answered"), F.col(c))), 6)
    return rows.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if("answered").alias("answered"), F.count_if("failed").alias("errors"), *[mean(k).alias(f"mean_{k}") for k in g.METRICS], *[mean(f"{k}_score").alias(f"mean_{k}_score") for k in g.METRICS],
        F.round(F.avg(F.when(ran, F.coalesce("score", F.lit(0.0)))), 6).alias("mean_score"), F.count_if(F.col("answered") & F.col("score").isNotNull()).alias("scored"),
        F.count_if(ran & (F.col("format_failure") | ~F.col("answered"))).alias("format_failures"), F.round(F.count_if(ran & F.col("score").isNull()) / F.count("*"), 6).alias("unscored_rate"),
    )


def retries(rows: DataFrame, most: int = 1) -> DataFrame:
    """rows (attempt, out_of_bounds) with whether to ask again."""
    return rows.withColumn("retry", (F.col("attempt") < most) & (F.col("out_of_bounds") > 0))
