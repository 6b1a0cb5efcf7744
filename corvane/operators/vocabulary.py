"""Vocabularies of actions: shared parts, ids that contain others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import key, parsed


def shared_parts(lines: DataFrame, part: str) -> DataFrame:
    """Per family the verbs or objects (part) that several different labels (family, text) have: how many, and the first label."""
    keys = lines.select("family", key(F.col("text")).alias("key")).distinct()
    return keys.withColumn(part, parsed(F.col("key"))[part]).groupBy("family", part).agg(F.count("*").alias("n"), F.min("key").alias("first")).filter("n > 1")


def hazards(ids: DataFrame) -> DataFrame:
    """Pairs of ids (family, id) of a family of which one contains the other.

    Every part of an id that is itself an id is found by a join on the part, so ids are not compared in pairs.
    """
    own = ids.select("family", "id").distinct()
    places = F.flatten(F.transform(F.sequence(F.lit(1), F.length("id")), lambda a: F.transform(F.sequence(F.lit(1), F.length("id") - a + 1), lambda n: F.substring(F.col("id"), a, n))))
    parts = own.filter("id <> ''").select("family", F.col("id").alias("whole"), F.explode(F.array_distinct(places)).alias("part")).filter("part <> whole")
    return parts.join(own.withColumnRenamed("id", "part"), ["family", "part"]).select("family", "part", "whole")
