"""Which families, episodes, views and environments take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of families that take no part, and the names that three recording set-ups give to views of one role.
LEFT_OUT = ("excluded", "parked")
VIEWS = {
    "left_eye": "main", "top": "main", "cam_color": "main", "right_eye": "main_right", "left_wrist": "wrist_left", "wrist_L": "wrist_left", "wrist_l": "wrist_left",
    "right_wrist": "wrist_right", "wrist_R": "wrist_right", "wrist_r": "wrist_right",
}


def active(registry: DataFrame, sources: DataFrame) -> DataFrame:
    """Families of the registry (family, status) that are not left out and have a source."""
    return registry.filter(F.coalesce(~F.col("status").isin(*LEFT_OUT), F.lit(True))).join(sources.select("family"), "family", "left_semi")


def below_cap(episodes: DataFrame, registry: DataFrame) -> DataFrame:
    """Episodes (family, number) below the cap of their family (family, cap), all of them where it has none. The registry is a small table, one row a family."""
    caps = registry.select("family", F.col("cap").alias("_cap"))
    return episodes.join(caps, "family", "left").filter(F.col("_cap").isNull() | (F.col("number") < F.col("_cap"))).drop("_cap")


def view_of(name: Column) -> Column:
    """The role of a view, null where its name is unknown."""
    return F.coalesce(*[F.when(name == k, v) for k, v in VIEWS.items()])


def by_environment(models: DataFrame, environments: DataFrame, default: str) -> DataFrame:
    """env, models: the models of a plan (model, at) by their environment (model, env), else by the default one, in the plan's order."""
    rows = models.join(environments.select("model", "env"), "model", "left").withColumn("env", F.coalesce("env", F.lit(default)))
    return rows.groupBy("env").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "model"))), lambda x: x["model"]).alias("models"))
