"""Shortcuts that a set of choice questions may leave open: rates of an answer that no one should be able to guess, and their z scores."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import z_score
from ..functions.geometry import mean_absolute


def _rate(rows: DataFrame, hit: Column, chance: float, *by: str) -> DataFrame:
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    return out.withColumn("z", F.round(z_score(F.col("hits"), F.col("n"), chance), 6))


def distribution(rows: DataFrame, run: str, letter: str) -> DataFrame:
    """How often each letter is the answer, and its share of the run."""
    counts = rows.groupBy(run, letter).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(run)), 6))


def unique_longest(items: DataFrame, *by: str) -> DataFrame:
    """items (options: texts, answer: its number from 0), those with an empty option left out: how often the answer alone has the most words."""
    sizes = F.transform("options", lambda o: F.size(F.filter(F.split(F.trim(o), r"\s+"), lambda w: w != "")))
    rows = items.filter(F.forall("options", lambda o: F.coalesce(o, F.lit("")) != "")).withColumn("_n", sizes)
    top = F.array_max("_n")
    return _rate(rows, (F.get("_n", F.col("answer")) == top) & (F.size(F.filter("_n", lambda x: x == top)) == 1), 0.25, *by)


def largest(items: DataFrame, *by: str) -> DataFrame:
    """items (sizes, answer), those with an unknown size left out: how often the answer alone is the largest file."""
    rows = items.filter(F.forall("sizes", lambda s: s.isNotNull()))
    top = F.array_max("sizes")
    return _rate(rows, (F.get("sizes", F.col("answer")) == top) & (F.size(F.filter("sizes", lambda x: x == top)) == 1), 0.25, *by)


def kinds_balance(rows: DataFrame, kind: str) -> DataFrame:
    """Of answers of several kinds: how many kinds, and the greatest z against even shares."""
    counts = rows.groupBy(kind).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.max("n").alias("most"), F.min("n").alias("least"))
    share = 1 / F.col("kinds")
    z = lambda c: F.when(F.col("kinds") > 1, (F.col(c) / F.col("total") - share) / F.sqrt(share * (1 - share) / F.col("total"))).otherwise(F.lit(0.0))
    return whole.select("total", "kinds", F.round(F.greatest(F.abs(z("most")), F.abs(z("least"))), 6).alias("worst_z"))


def duplicated(items: DataFrame, *by: str) -> DataFrame:
    """How many items have an option twice; empty options do not count."""
    texts = F.filter("options", lambda o: F.coalesce(o, F.lit("")) != "")
    return items.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.size(F.array_distinct(texts)) < F.size(texts)).alias("bad"))


def sides(items: DataFrame, question: str) -> DataFrame:
    """How many questions ask for the left."""
    return _rate(items, F.contains(F.col(question), F.lit(" left ")), 0.5)


def borrowed(items: DataFrame, own: DataFrame) -> DataFrame:
    """items (family, answer, distractors) against the texts of their family (own: family, text; a vocabulary): how many distractors, borrowed ones, ones equal to the answer, and borrowed ones that equal another own text by case only."""
    texts = own.groupBy("family").agg(F.collect_set("text").alias("_own"))
    rows = items.join(texts, "family", "left").withColumn("_own", F.coalesce("_own", F.array().cast("array<string>")))
    lower = F.transform("_own", F.lower)
    out = lambda t: ~F.array_contains("_own", t)
    count = lambda rule: F.sum(F.size(F.filter("distractors", rule))).cast("bigint")
    return rows.groupBy("family").agg(
        F.sum(F.size("distractors")).cast("bigint").alias("n"), count(out).alias("borrowed"), count(lambda t: F.array_contains("_own", t) & (t == F.col("answer"))).alias("clash"),
        count(lambda t: out(t) & F.array_contains(lower, F.lower(t))).alias("near_clash"),
    )


def outliers(items: DataFrame, *by: str) -> DataFrame:
    """items (vectors of the options, answer): how often the answer is the first of those farthest from all others, and what choosing it gains over a quarter."""
    total = F.transform("vectors", lambda a: F.aggregate(F.transform("vectors", lambda b: mean_absolute(a, b)), F.lit(0.0), lambda s, x: s + x))
    rows = items.withColumn("_t", F.transform(total, lambda x: F.round(x, 9)))
    out = _rate(rows, F.array_position("_t", F.array_max("_t")).cast("int") - 1 == F.col("answer"), 0.25, *by).drop("z")
    return out.withColumn("gain", F.round(F.col("hits") / F.col("n") - 0.25, 6))


def coverage(answers: DataFrame, defined: DataFrame) -> DataFrame:
    """Per family: actions of the vocabulary (defined: family, action), those that never are an answer (answers: family, action), and the share of the most frequent one."""
    counts = answers.groupBy("family", "action").agg(F.count("*").alias("n"))
    never = defined.select("family", "action").distinct().join(counts, ["family", "action"], "left").groupBy("family").agg(F.count("*").alias("actions"), F.count_if(F.col("n").isNull()).alias("never"))
    return never.join(counts.groupBy("family").agg(F.round(F.max("n") / F.sum("n"), 6).alias("top_share")), "family", "left")


def most_frequent(answers: DataFrame) -> DataFrame:
    """Per family the most frequent answer, the first of equal ones, and its z against even shares of the answers that occur."""
    counts = answers.groupBy("family", "action").agg(F.count("*").alias("k"))
    top = counts.groupBy("family").agg(F.sum("k").alias("n"), F.count("*").alias("kinds"), F.min(F.struct((-F.col("k")).alias("k"), "action")).alias("top"))
    share, hits = 1 / F.col("kinds"), -F.col("top.k")
    z = F.when(F.col("kinds") > 1, (hits / F.col("n") - share) / F.sqrt(share * (1 - share) / F.col("n"))).otherwise(F.lit(0.0))
    return top.select("family", F.col("top.action").alias("action"), hits.alias("hits"), "n", F.round(z, 6).alias("z"))


def blind_bound(items: DataFrame, texts: list[str]) -> DataFrame:
    """items (options: texts, answer_text, letter): the best share that a fixed preference among all texts reaches, its favourite, and that of a fixed letter.

    Items are first counted by their sets of options and answer, of which few exist; the orders are tried on these counts.
    """
    kinds = items.groupBy(F.array_sort("options").alias("options"), "answer_text").agg(F.count("*").alias("n"))
    orders = items.sparkSession.createDataFrame([(list(p),) for p in permutations(sorted(texts))], "wish array<string>")
    hit = F.get(F.filter("wish", lambda t: F.array_contains("options", t)), F.lit(0)) == F.col("answer_text")
    tried = orders.join(F.broadcast(kinds)).groupBy("wish").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hits"), F.sum("n").alias("total"))
    best = tried.agg(F.min(F.struct((-F.col("hits")).alias("h"), "wish")).alias("b"), F.max("total").alias("total"))
    letters = items.groupBy("letter").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    return best.join(F.broadcast(letters)).select(F.round(-F.col("b.h") / F.col("total"), 6).alias("best"), F.get("b.wish", F.lit(0)).alias("favourite"), F.round(F.col("most") / F.col("total"), 6).alias("letter"))


def blind(answers: DataFrame) -> DataFrame:
    """answers (policy, family, task, picked, answer, n_options): hit rate and expected rate of those that picked anything, for each cell and all marginals (null: all)."""
    rows = answers.filter("picked is not null")
    out = rows.cube("policy", "family", "task").agg(F.count("*").alias("n"), F.round(F.avg((F.col("picked") == F.col("answer")).cast("double")), 6).alias("rate"), F.round(F.avg(1 / F.col("n_options")), 6).alias("base"))
    named = [F.coalesce(c, F.lit("all")).alias(c) for c in ("policy", "family", "task")]
    return out.select(*named, "n", "rate", "base")


def stratified(answers: DataFrame) -> DataFrame:
    """answers (correct, chosen_text, current_text, options): accuracy apart by whether the current action is an option, and how often it is chosen."""
    inside = F.array_contains("options", F.col("current_text")).alias("current_is_option")
    return answers.groupBy(inside).agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"), F.round(F.avg((F.col("chosen_text") == F.col("current_text")).cast("double")), 6).alias("chose_current"))


def completeness(rows: DataFrame) -> DataFrame:
    """rows (size, position, hit): the share that was answered by size of the batch (position null) and by size and position."""
    out = rows.groupingSets([["size"], ["size", "position"]], "size", "position").agg(F.count("*").alias("asked"), F.count_if("hit").alias("got"))
    return out.withColumn("rate", F.round(F.col("got") / F.col("asked"), 6))


def chosen_types(rows: DataFrame, kind: str) -> DataFrame:
    """How often a distractor of each type was chosen; rows without a type do not count."""
    return rows.filter(F.coalesce(F.col(kind), F.lit("")) != "").groupBy(kind).agg(F.count("*").alias("n"))
