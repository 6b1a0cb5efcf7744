"""What the operators of this subpackage share: reading tables, the shared folder, byte files in it."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the table of maybe_in, as a power of two.
PLACE_BITS = 25


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or the session's checkpoint folder.

    With neither set no folder is known to be shared, so that is an error, but in local mode, where driver and tasks are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not own.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = own.get()
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder. The files go when nothing refers to the result any more."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/corvane-{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of new_folder, with what failed attempts have left in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more. It does so when the driver collects
    its garbage, which a driver with little to do puts off, while the executors' disks fill."""
    gc.collect()
    spark._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """checkpointed, and the shuffle files that led to it go at once, if nothing else refers to the frame."""
    spark, out = df.sparkSession, checkpointed(df)
    del df
    gc.collect()
    time.sleep(1.2)  # py4j tells the JVM once a second what Python no longer refers to
    free(spark)
    return out


def maybe_in(ids: DataFrame, name: str) -> Callable[[Column], Column]:
    """A test for ids that is true of all that the frame has, of few others as long as it has some million, and of no null.

    It goes by a table of 2**PLACE_BITS bits, whatever the number of ids, and only saves work: rows for which it is false
    need not be shuffled to a join with the frame.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(1 << PLACE_BITS).cast("long"))
    places = ids.filter(F.col(name).cast("long").isNotNull()).select((place(F.col(name)) + 1).alias("p"))
    parts = places.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()  # 4 KB each, 4 MB in all
    table = np.zeros(1 << (PLACE_BITS - 3), np.uint8)
    for r in parts:
        table[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)

    @F.pandas_udf("boolean")
    def known(p: pd.Series) -> pd.Series:
        at = p.to_numpy()
        return pd.Series((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return lambda c: known(place(c)) & c.cast("long").isNotNull()


def fresh(columns: list[str], name: str) -> str:
    """A name for a working column that none of the columns has, whatever its case."""
    taken, out = {c.lower() for c in columns}, f"_corvane_{name}"
    while out in taken:
        out += "_"
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_files(folder: str):
    """(file system, path) for a folder given as a URI or plain path; works inside tasks."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        if folder.startswith("file:") and not folder.startswith("file://"):
            folder = "file://" + folder[len("file:") :]
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def doc_hash_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds of the contracts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def held_out(doc_id: Column, n: int, fold: int) -> Column:
    """Whether a document is in the fold; a null id is in none."""
    return F.coalesce(doc_hash_mod(doc_id, n) == fold, F.lit(False))
