"""Outputs: items by family and task with a manifest, upserts of versioned rows, compaction of logs, exports, CSV and Markdown.

A manifest is the last thing that a writer writes, one file for each version, and readers go by the newest: what a
writer that failed has left is not in it. Two writers of one version cannot both win, since a version's file is made once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..operators.questions import fingerprint


class Stale(ValueError):
    """What is to be written or read goes by a state that is no longer so."""


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest manifest of a folder; None if it has none."""
    names = [n for n in shared.children(spark, f"{path}/_manifest") if n.endswith(".json")]
    return json.loads(shared.read_text(spark, f"{path}/_manifest/{names[-1]}")) if names else None


def _commit(spark: SparkSession, path: str, version: int, content: dict) -> dict:
    content = {"version": version, **content}
    try:
        shared.write_text(spark, f"{path}/_manifest/{version:012d}.json", json.dumps(content, ensure_ascii=False, sort_keys=True))
    except (FileExistsError, OSError) as e:
        raise Stale(f"version {version} of {path} is there already") from e
    return content


def append_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines beside those that are there."""
    rows.write.mode("append").json(path)


def write_items(items: DataFrame, path: str, builder: str, source_version: str = "", whole: bool = True, notes: dict[str, dict] | None = None) -> dict:
    """Items (family, task, id and any more columns) in a folder for each family and task; returns the manifest, which is written last.

    It has the rows of each family and task and a fingerprint over all columns of each family, in the order of ids, and
    what notes has of a family.
    A partial build (whole=False) replaces the families that it has and keeps the others; a manifest of another builder
    isn't merged: then the build must be whole. Folders of a family are new ones each time, so what readers of the older
    manifest read stays until `vacuum`.
    """
    spark, old = items.sparkSession, manifest(items.sparkSession, path)
    if not whole and old and old["builder"] != builder:
        raise Stale(f"{path} was built by {old['builder']}, so {builder} must build it as a whole")
    build = uuid.uuid4().hex
    items = shared.checkpointed(items)
    items.repartitionByRange("family", "task", "id").write.partitionBy("family", "task").parquet(f"{path}/{build}")  # a task's rows are of few families, so files are about as many as families and tasks together
    content = F.to_json(F.struct(*sorted(items.columns)), {"ignoreNullFields": "false"})
    prints = fingerprint(items.select("family", "id", content.alias("content")), "content", "id", by=("family",)).withColumnRenamed("fingerprint", "print")
    counts = items.groupBy("family", "task").agg(F.count("*").alias("n"))
    families: dict[str, dict] = {} if whole or not old else dict(old["families"])
    fresh: dict[str, dict] = {}
    for r in counts.join(prints, "family").collect():  # a row for each family and task
        fresh.setdefault(r["family"], {**(notes or {}).get(r["family"], {}), "build": build, "fingerprint": r["print"], "tasks": {}})["tasks"][r["task"]] = r["n"]
    families |= fresh
    return _commit(spark, path, (old["version"] if old else 0) + 1, {"builder": builder, "source_version": source_version or (old or {}).get("source_version", ""), "families": families, "items": sum(sum(f["tasks"].values()) for f in families.values())})


def read_items(spark: SparkSession, path: str, families: list[str] | None = None) -> DataFrame:
    """The items of a manifest's families, from the builds that it names."""
    now = manifest(spark, path)
    if now is None:
        raise Stale(f"{path} has no manifest")
    wanted = sorted(now["families"]) if families is None else families
    missing = [f for f in wanted if f not in now["families"]]
    if missing:
        raise Stale(f"{path} has no {', '.join(missing)}")
    out: DataFrame | None = None
    for build in sorted({now["families"][f]["build"] for f in wanted}):
        rows = spark.read.parquet(f"{path}/{build}").filter(F.col("family").isin([f for f in wanted if now["families"][f]["build"] == build]))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise Stale(f"{path} has no families")
    return out


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove builds and versions that the newest manifest doesn't name; the names of the builds."""
    now = manifest(spark, path)
    if now is None:
        return []
    kept = {f["build"] for f in now.get("families", {}).values()} | set(now.get("buckets", {}).values())
    gone = [n for n in shared.children(spark, path) if n not in kept and n != "_manifest"]
    for n in gone:
        shared.remove(spark, f"{path}/{n}")
    for n in shared.children(spark, f"{path}/_manifest")[:-1]:
        shared.remove(spark, f"{path}/_manifest/{n}")
    return gone


def upsert(rows: DataFrame, path: str, stream: str, batch: int, buckets: int = 64) -> dict:
    """Merge changes (key, base, version and any more columns) into a table of one row for each key; returns the manifest.

    A change is written if its base is the version that its key has in the table (null: the key isn't there yet), else
    it is stale and refused; of several changes of a key in one batch the one of the least version is looked at, and
    the others are refused. A batch that the table has had from this stream, by its number, changes nothing. Counters
    of written and refused changes add up in the manifest.
    """

    def judged(come: DataFrame, before: DataFrame | None) -> tuple[DataFrame, dict[str, int]]:
        rest = [c for c in come.columns if c not in ("key", "base", "version", "_bucket")]
        first = come.groupBy("_bucket", "key").agg(F.min(F.struct("version", "base", *rest)).alias("r"), F.count("*").alias("_n")).select("_bucket", "key", "r.*", "_n")
        now = F.lit(None).cast("long")
        if before is not None:
            first, now = first.join(before.select("key", F.col("version").alias("_now")), "key", "left"), F.col("_now")
        first = shared.checkpointed(first.withColumn("_good", F.col("base").eqNullSafe(now)))
        written, refused = first.agg(F.count_if("_good"), F.coalesce(F.sum(F.col("_n") - F.col("_good").cast("int")), F.lit(0))).first()
        return first.filter("_good").select("_bucket", "key", "version", *rest), {"written": written, "refused": refused}

    return _merge(rows, path, "key", stream, batch, buckets, judged)


def replace(rows: DataFrame, path: str, key: str, batch: int, buckets: int = 64, stream: str = "rows") -> dict:
    """Merge rows, one of each key, into a table: they replace those that it has. A batch that it has had changes nothing."""
    return _merge(rows, path, key, stream, batch, buckets, lambda come, before: (come, {"written": come.count()}))


def _merge(rows: DataFrame, path: str, key: str, stream: str, batch: int, buckets: int, judged) -> dict:
    """Only the buckets of keys that come are written anew; the manifest names the build of each bucket."""
    spark, old = rows.sparkSession, manifest(rows.sparkSession, path)
    if old and old["batches"].get(stream, -1) >= batch:
        return old
    n = old["n_buckets"] if old else buckets
    bucketed = lambda df: df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    come = shared.checkpointed(bucketed(rows))
    touched = [r[0] for r in come.select("_bucket").distinct().collect()]  # at most the buckets
    held = dict(old["buckets"]) if old else {}
    before = table(spark, path, touched)
    new, counts = judged(come, before)
    if before is not None:
        new = bucketed(before).join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    build = uuid.uuid4().hex
    new.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{build}")
    there = [n.removeprefix("_bucket=") for n in shared.children(spark, f"{path}/{build}") if n.startswith("_bucket=")]
    counters = dict(old["counters"]) if old else {}
    for k, v in counts.items():
        counters[k] = counters.get(k, 0) + int(v)
    return _commit(spark, path, (old["version"] if old else 0) + 1, {"n_buckets": n, "buckets": held | dict.fromkeys(there, build), "batches": (old["batches"] if old else {}) | {stream: batch}, "counters": counters})


def table(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The rows of a table of upsert or replace, of some buckets or all; None if it has none of them."""
    now = manifest(spark, path)
    builds: dict[str, list[int]] = {}
    for b, build in (now["buckets"] if now else {}).items():
        if buckets is None or int(b) in buckets:
            builds.setdefault(build, []).append(int(b))
    out: DataFrame | None = None
    for build, own in sorted(builds.items()):
        rows = spark.read.parquet(f"{path}/{build}").filter(F.col("_bucket").isin(own)).drop("_bucket")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def compact(spark: SparkSession, path: str, final) -> tuple[int, int]:
    """Replace a folder of log files (JSON lines) by what final() keeps of them; the rows before and after.

    The new generation is written aside, then the old one is renamed away, the new one to its place, and only then the
    old one is removed. `recover` finishes what a crash has left between these steps; it is called first.
    """
    recover(spark, path)
    rows = spark.read.json(path)
    before = rows.count()
    final(rows).write.json(f"{path}.new")
    after = spark.read.schema(rows.schema).json(f"{path}.new").count()
    if after < before:
        shared.rename(spark, path, f"{path}.old")
        shared.rename(spark, f"{path}.new", path)
        shared.remove(spark, f"{path}.old")
    else:
        shared.remove(spark, f"{path}.new")
    return before, after


def recover(spark: SparkSession, path: str) -> None:
    """After a crash: a new generation counts once the old one was renamed away, which happens only when it was whole."""
    if shared.exists(spark, f"{path}.old"):
        if not shared.exists(spark, path):
            shared.rename(spark, f"{path}.new", path)
        shared.remove(spark, f"{path}.old")
    shared.remove(spark, f"{path}.new")


def export(results: DataFrame, summary: DataFrame, meta: dict, path: str) -> None:
    """An export: results as JSON lines, the summary (few rows) and the run's meta as one file each; meta is written last."""
    spark = results.sparkSession
    results.write.mode("overwrite").json(f"{path}/results")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    shared.remove(spark, f"{path}/meta.json")
    shared.write_text(spark, f"{path}/meta.json", json.dumps(meta, ensure_ascii=False, sort_keys=True))


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in this order, under a header."""
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def markdown(rows: DataFrame, order: list[str]) -> DataFrame:
    """n, line: a Markdown table of all columns, by `order`; nulls are a dash. Lines have numbers, so that it can be sorted anywhere."""
    spark, cells = rows.sparkSession, [F.coalesce(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"\|", r"\\|"), F.lit("—")) for c in rows.columns]
    head = spark.createDataFrame([(0, f"| {' | '.join(rows.columns)} |"), (1, f"|{' --- |' * len(rows.columns)}")], "n long, line string")
    from pyspark.sql import Window

    body = rows.select((F.row_number().over(Window.orderBy(*order)) + 1).cast("long").alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    return head.unionByName(body)
