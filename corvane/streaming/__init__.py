"""An append log as a stream: the last good row of each id, breaks after failures in a row, upserts by version.

Every operator ends with the rows of its batch form, whatever the order and the cut of the batches, late rows included.
A stream is read with whatever trigger; a query that has failed goes on from its checkpoint folder, and a batch that
comes again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sinks
from ..functions import bound
from ..operators.runs import final_rows

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def lines(spark: SparkSession, path: str, schema: str, files_at_once: int = 1) -> DataFrame:
    """JSON lines as a stream of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def latest_rows(log: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Start the stream of final_rows: the state has one row for each id, and only ids that change are written, by `replace`."""
    return _into(final_rows(log), path, checkpoint, "id", buckets)


def _streaks(seen: Column, threshold: int) -> Column:
    """Of all rows (seq, ok) so far of a stretch of a key's log: what they mean to the whole."""
    rows = F.array_sort(seen)
    # A number that came with both outcomes is a success.
    once = lambda a: F.filter(a, lambda x, i: x["ok"] | F.coalesce(F.get(a, i + 1)["seq"] != x["seq"], F.lit(True)))
    none = F.struct(F.lit(False).alias("cut"), F.lit(0).cast("long").alias("run"), F.lit(None).cast("long").alias("broken"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x["ok"], F.lit(0).cast("long")).otherwise(s["run"] + 1)
        first = F.when(s["cut"] & ~x["ok"] & (s["run"] + 1 == threshold), x["seq"])
        return F.struct((s["cut"] | x["ok"]).alias("cut"), run.alias("run"), F.coalesce(s["broken"], first).alias("broken"))

    def said(a: Column) -> Column:
        begun = F.array_position(F.transform(a, lambda x: x["ok"]), True)
        lead = F.transform(F.slice(a, F.lit(1), F.least(F.lit(threshold), F.when(begun > 0, begun - 1).otherwise(F.size(a))).cast("int")), lambda x: x["seq"])
        return bound(F.aggregate(a, none, step), lambda s: F.struct(s["cut"].alias("cut"), s["run"].alias("tail"), lead.alias("lead"), s["broken"].alias("broken")))

    return bound(bound(rows, once), said)


def streaks(log: DataFrame, key: str, threshold: int, span: int = 100_000) -> DataFrame:
    """key, stretch, cut (whether it has a success), tail (failures at its end), lead (the numbers of the first failures before
    a success), broken (the first break after one) of every stretch (key, seq div span) that a batch has rows of; the newest row
    of a stretch counts.

    The state is the set of numbers and outcomes of each stretch, at most `span` of them, in a store on disk. A row
    without an outcome is neither success nor failure.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = log.filter("ok is not null").select(F.col(key).cast("string").alias("key"), F.floor(F.col("seq") / span).cast("long").alias("stretch"), F.col("seq").cast("long").alias("seq"), "ok")
    seen = rows.groupBy("key", "stretch").agg(F.collect_set(F.struct("seq", "ok")).alias("_seen"))
    return seen.select("key", "stretch", _streaks(F.col("_seen"), threshold).alias("s")).select("key", "stretch", "s.*")


def broken_at(found: DataFrame, threshold: int) -> DataFrame:
    """key, broken_at: the first number at which that many failures in a row were reached, from the newest row of streaks of each stretch.

    A streak goes on into the next stretch: what a stretch ends with is added up over those without a success.
    """
    order = Window.partitionBy("key").orderBy("stretch")
    rows = found.withColumn("_run", F.sum(F.col("cut").cast("int")).over(order))
    rows = rows.withColumn("_sum", F.sum("tail").over(Window.partitionBy("key", "_run").orderBy("stretch"))).withColumn("_before", F.coalesce(F.lag("_sum").over(order), F.lit(0)))
    in_lead = F.when(F.col("_before") < threshold, F.try_element_at("lead", (threshold - F.col("_before")).cast("int")))
    return rows.select("key", F.coalesce(in_lead, "broken").alias("b")).groupBy("key").agg(F.min("b").alias("broken_at")).filter("broken_at is not null")


def watch(log: DataFrame, key: str, threshold: int, path: str, checkpoint: str, span: int = 100_000, buckets: int = 64):
    """Start the stream of streaks into a table; broken_at(sinks.table(...)) reads it at any time."""
    return _into(streaks(log, key, threshold, span).withColumn("id", F.concat_ws("/", "key", "stretch")), path, checkpoint, "id", buckets)


def versioned(changes: DataFrame, path: str, checkpoint: str, stream: str = "changes", buckets: int = 64):
    """Start the stream of changes (key, base, version and more columns) into a table by sinks.upsert: stale ones are refused, a batch that comes again changes nothing."""
    return _started(changes, checkpoint, lambda rows, batch: sinks.upsert(rows, path, stream, batch, buckets))


def _into(rows: DataFrame, path: str, checkpoint: str, key: str, buckets: int):
    return _started(rows, checkpoint, lambda batch, n: sinks.replace(batch, path, key, n, buckets))


def _started(rows: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], object]):
    def batch(df: DataFrame, n: int) -> None:
        write(df, n)

    return rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
