"""Plans, costs, leaderboards, exports, and the resolution of media paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bound, md5_mod

# The main measure of a kind of run, the floor that a run without any skill reaches, and limits of faults.
PRIMARY = {"trajectory_2D": "mean_score", "trajectory_3D": "mean_score", "time": "tiou_at_50"}
FLOORS = {"time": ("mean_tiou", 0.13)}
CHANCE = 0.25
ERROR_FAULT, PARSE_FAULT = 0.10, 0.50
STAGE_WORDS = ("time", "time_understanding", "image_in_video", "step_order", "planning", "understanding")
MEDIA = r"(?i)\.(?:mp4|jpe?g|png|webp|avi|mov)$"


def expanded(models: DataFrame, families: DataFrame, runs: DataFrame, variants: list[float], rules: list[tuple[str, str]], shard: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The matrix of models (model, local), families (family, derived and manual attributes: maps) and runs (run, video), and what is skipped and why.

    Frame variants are for local models on video only. A rule (run, attribute) skips a run where the family lacks the
    attribute; what is derived from data goes before what is set by hand. These are small tables of a plan.
    """
    cells = models.join(F.broadcast(families)).join(F.broadcast(runs))
    several = F.col("local") & F.col("video") & F.lit(bool(variants))
    cells = cells.withColumn("variant", F.explode(F.when(several, F.array(*map(F.lit, variants or [0.0]))).otherwise(F.array(F.lit(None).cast("double")))))
    has = lambda a: F.coalesce(F.col("derived")[a], F.col("manual")[a], F.lit(False))
    reason: Column = F.lit(None).cast("string")
    for run, attribute in reversed(rules):
        reason = F.when((F.col("run") == run) & ~has(attribute), F.concat(F.col("run"), F.lit(f" requires {attribute}"))).otherwise(reason)
    cells = cells.withColumn("reason", reason).withColumn("key", F.concat_ws("/", "model", "family", "run", F.coalesce(F.col("variant").cast("string"), F.lit("default"))))
    chosen = cells.filter("reason is null")
    if shard:
        chosen = chosen.filter(md5_mod(F.col("key"), shard[1]) == shard[0] - 1)
    return chosen.select("key", "model", "family", "run", "variant"), cells.filter("reason is not null").select("key", "reason")


def estimate(runs: DataFrame, media: DataFrame) -> DataFrame:
    """Per model and over all (null model): runs, items, calls, bytes and missing files.

    runs: model, family, run, items, calls; media: family, run, path, bytes (null: not there). A path counts once per
    family and run, and again for each model that sends it.
    """
    once = media.groupBy("family", "run", "path").agg(F.max("bytes").alias("bytes")).groupBy("family", "run").agg(F.sum("bytes").alias("bytes"), F.count_if(F.col("bytes").isNull()).alias("missing"))
    rows = runs.join(once, ["family", "run"], "left")
    return rows.rollup("model").agg(F.count("*").alias("runs"), F.sum("items").alias("items"), F.sum("calls").alias("calls"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"))


def leaderboard(summaries: DataFrame) -> DataFrame:
    """Summaries (run, accuracy, mean_score, mean_tiou, tiou_at_50, total, answered, errors, parse_failure_rate and others) with metric, value, floor and fault.

    A floor is breached by a run that was answered but scores below what needs no skill, or exactly zero; a fault is a
    run that did not go well: nothing answered, a tenth of errors, half of the answers not parsed.
    """
    metric = F.coalesce(*[F.when(F.col("run") == r, m) for r, m in PRIMARY.items()], F.lit("accuracy"))
    pick = lambda name: F.coalesce(*[F.when(name == m, F.col(m)) for m in ("accuracy", "mean_score", "mean_tiou", "tiou_at_50")])
    out = summaries.withColumn("metric", metric).withColumn("value", pick(F.col("metric")))
    low = F.coalesce(*[F.when((F.col("run") == r) & (F.col(m) < limit), f"below {m} {limit:g}") for r, (m, limit) in FLOORS.items()], F.when(~F.col("run").isin(*PRIMARY) & (F.col("accuracy") < CHANCE), "below chance"))
    floor = F.when(F.coalesce("answered", F.lit(0)) == 0, None).when(low.isNotNull(), low).when(F.col("value") == 0, "zero")
    fault = (
        F.when(F.coalesce("total", F.lit(0)) == 0, None).when(F.col("answered") == 0, "nothing answered").when(F.col("errors") / F.col("total") >= ERROR_FAULT, "errors").when(F.col("parse_failure_rate") >= PARSE_FAULT, "not parsed")
    )
    return out.withColumn("floor", floor).withColumn("fault", fault)


def pivoted(rows: DataFrame, runs: list[str]) -> DataFrame:
    """A row for each model and variant, a column for each run: its value, a star where it is below a floor, an exclamation mark where it failed."""
    cell = F.concat(F.format_string("%.1f", F.round(100 * F.col("value"), 1)), F.when(F.col("floor").isNotNull(), "*").otherwise(""), F.when(F.col("fault").isNotNull(), "!").otherwise(""))
    return rows.withColumn("_cell", cell).groupBy("model", "variant").pivot("run", runs).agg(F.first("_cell"))


def exported(results: DataFrame, items: DataFrame, key: str = "id") -> DataFrame:
    """Results joined to their items; where both have a column the result's value is taken unless it is null."""
    both = [c for c in items.columns if c in results.columns and c != key]
    joined = results.join(items.withColumnsRenamed({c: f"_item_{c}" for c in both}), key, "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_item_{c}")).alias(c) if c in both else F.col(c) for c in [*results.columns, *[c for c in items.columns if c not in results.columns]]])


def missing(claimed: DataFrame, there: DataFrame, key: str) -> DataFrame:
    return claimed.select(key).distinct().join(there.select(key), key, "left_anti")


def reuse(media: DataFrame) -> DataFrame:
    """media (kind, key, item) of all uses: per kind the different files, uses, and what sharing saves."""
    once = media.groupBy("kind", "key").agg(F.count("*").alias("uses"))
    return once.groupBy("kind").agg(F.count("*").alias("files"), F.sum("uses").alias("uses")).withColumn("saved", F.col("uses") - F.col("files"))


def media_roles(task: Column, kinds: Column) -> Column:
    """Roles of an item's media in order: step:1 and so on for step_order, else by kind."""
    return F.transform(kinds, lambda k, i: F.when(task == "step_order", F.concat(F.lit("step:"), (i + 1).cast("string"))).when(k == "video", "context").otherwise(k))


def first_available(*candidates: Column) -> Column:
    """The first candidate list that is not empty."""
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in candidates])


def is_provenance(path: Column) -> Column:
    return F.contains(F.translate(path, "\\", "/"), F.lit("observation.images"))


def _endings(parts: Column) -> Column:
    """The last 1 to 6 parts of a path, as texts; as many as it has parts."""
    return F.transform(F.sequence(F.lit(1), F.least(F.lit(6), F.size(parts))), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))


def under(base: Column, path: Column) -> Column:
    """A path below a folder, without `.` and with `..` worked out; an absolute one stays as it is."""
    step = lambda kept, p: F.when(p.isin("", "."), kept).when(p == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, p))
    parts = F.aggregate(F.split(F.concat_ws("/", base, F.translate(path, "\\", "/")), "/"), F.array().cast("array<string>"), step)
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.when(F.startswith(base, F.lit("/")), "/").otherwise(""), F.array_join(parts, "/")))


def rewritten(paths: DataFrame, files: DataFrame, base: str, prefixes: list[str]) -> DataFrame:
    """paths (path) with status and found, for question files in the folder `base`: a relative path, or one with a legacy
    prefix, means the file below that folder (rewritten, or already_ok if it read so; else unresolved); another absolute
    path is already_ok if it is a file, else provenance."""
    slashed = F.translate("path", "\\", "/")
    absolute = F.startswith(slashed, F.lit("/")) | (F.substring(slashed, 2, 1) == ":")
    legacy = F.coalesce(*[F.when(F.startswith(slashed, F.lit(f"{p}/")), F.substring(slashed, F.lit(len(p) + 2), F.length(slashed))) for p in prefixes], F.lit(None).cast("string"))
    rows = paths.select("path").distinct().withColumn("_legacy", legacy).withColumn("_own", absolute & F.col("_legacy").isNull())
    rows = rows.withColumn("file", F.when(F.col("_own"), slashed).otherwise(under(F.lit(base), F.coalesce("_legacy", slashed))))
    rows = rows.join(files.select("file").distinct().withColumn("_there", F.lit(True)), "file", "left")
    status = F.when(F.col("_there"), F.when(F.col("file") == F.col("path"), "already_ok").when(F.col("_own"), "already_ok").otherwise("rewritten")).when(F.col("_own"), "provenance").otherwise("unresolved")
    return rows.select("path", status.alias("status"), F.when(F.col("_there"), F.col("file")).otherwise(F.col("path")).alias("found"))


def by_shuffle(rows: DataFrame) -> DataFrame:
    """The side of a join that is not to be broadcast: texts made of a few packed columns are far more than the plan takes them for."""
    return rows.hint("merge")


def resolved(paths: DataFrame, files: DataFrame, group: str = "", base: str = "") -> DataFrame:
    """paths (path) with status and found: files (file) that the paths mean.

    A path is a file itself (exact), or below the folder `base`, if there is one (relative), or the one file of its name. Of several the longest common endings, from two to six
    parts, then the words of stages in the path, the last first, and at last the group narrow the choice; what then has
    several stays ambiguous, without any it is unresolved. Paths of raw recordings are provenance, others than media are
    none. Files meet paths by their endings, reduced to one row for each ending and set of words, however many share a name.
    """
    there = files.select("file").distinct().withColumn("_f", F.split("file", "/"))
    words = F.filter(F.array(*map(F.lit, STAGE_WORDS)), lambda w: F.array_contains(F.col("_f"), w))
    grouped = F.contains("file", F.lit(f"/{group}/")) if group else F.lit(False)
    kinds = there.select(F.posexplode(_endings(F.col("_f"))).alias("_depth", "_end"), words.alias("_w"), grouped.alias("_in"), "file").groupBy("_depth", "_end", "_w", "_in").agg(F.count("*").alias("n"), F.min("file").alias("file"))
    of_end = kinds.groupBy("_depth", "_end").agg(F.collect_list(F.struct(F.col("_w").alias("words"), F.col("_in").alias("inside"), "n", "file")).alias("_hits"))  # at most two for each set of words
    wanted = paths.select("path").distinct().withColumn("_parts", F.split(F.translate("path", "\\", "/"), "/"))
    met = wanted.select("path", F.posexplode(_endings(F.col("_parts"))).alias("_depth", "_end")).join(by_shuffle(of_end), ["_depth", "_end"]).groupBy("path").agg(F.max_by("_hits", "_depth").alias("_hits"))
    exact = wanted.select("path").join(by_shuffle(there.select(F.col("file").alias("path"))), "path", "left_semi").withColumn("_exact", F.lit(True))
    rows = wanted.join(by_shuffle(met), "path", "left").join(by_shuffle(exact), "path", "left").withColumn("_exact", F.coalesce("_exact", F.lit(False)))
    near = wanted.select("path", under(F.lit(base), F.col("path")).alias("_near")).join(by_shuffle(there.select(F.col("file").alias("_near"))), "_near") if base else wanted.select("path", F.lit(None).cast("string").alias("_near")).limit(0)
    rows = rows.join(by_shuffle(near), "path", "left")
    rows = rows.withColumn("_hits", F.coalesce("_hits", F.array().cast("array<struct<words:array<string>,inside:boolean,n:bigint,file:string>>")))
    many = lambda hits: F.aggregate(hits, F.lit(0).cast("bigint"), lambda t, h: t + h["n"])
    # Words of stages before the name, the last first: at each step those files that have it.
    said = F.reverse(F.filter(F.slice("_parts", F.lit(1), F.size("_parts") - 1), lambda p: p.isin(*STAGE_WORDS)))
    step = lambda hits, w: bound(F.filter(hits, lambda h: F.array_contains(h["words"], w)), lambda some: F.when((many(hits) > 1) & (F.size(some) > 0), some).otherwise(hits))
    rows = rows.withColumn("_said", said).withColumn("_hits", F.aggregate("_said", F.col("_hits"), step)).drop("_said")
    if group:
        same = F.filter("_hits", lambda h: h["inside"])
        rows = rows.withColumn("_same", same).withColumn("_hits", F.when((many(F.col("_hits")) > 1) & (many(F.col("_same")) == 1), F.col("_same")).otherwise(F.col("_hits"))).drop("_same")
    n = many(F.col("_hits"))
    status = F.when(~F.col("path").rlike(MEDIA), "no media").when(is_provenance(F.col("path")), "provenance").when(F.col("_exact"), "exact").when(F.col("_near").isNotNull(), "relative").when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved")
    rows = rows.withColumn("status", status)
    found = F.when(F.col("status") == "exact", F.col("path")).when(F.col("status") == "relative", F.col("_near")).when(F.col("status") == "resolved", F.get("_hits", F.lit(0))["file"])
    return rows.select("path", "status", found.alias("found"))
