"""Session helpers of the text operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch, unless the session says otherwise: ten thousand long texts at once would not fit in a worker.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes where the session leaves them unbounded."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset, the context's own checkpoint folder counts; a local
    session, whose executors are this machine, gets one. A cluster without one
    is refused: each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{os.path.abspath('spark-warehouse')}/checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/lucerna-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, repeats: bool = True) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back: a cut of lineage that survives lost executors.

    Tables of hashes, whose values hardly repeat, are written without dictionaries.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("parquet.enable.dictionary", str(repeats).lower()).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Removes the files of `stored` tables whose readers have all run."""
    for df in frames:
        context = df.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def small(rows: DataFrame, most: int) -> DataFrame:
    """Marked for broadcast if it has at most `most` rows; for stored tables, whose count reads footers only."""
    return F.broadcast(rows) if rows.count() <= most else rows


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns, under fixed names: extra or clashing ones can't get in the way."""
    bounded(df.sparkSession)
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def bytes_of(text: Column | str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def most_frequent(counts: DataFrame, limit: int, key: str, n: str = "n") -> DataFrame:
    """The `limit` rows of the largest counts, ties by `key`, for the driver.

    A histogram of the counts' powers of two (64 rows at most) finds the class
    that the limit cuts; a second one, of the counts within it, and a third, of
    64 thousand slots of the key's hash, find the cut in it. So no task ever
    sends more than its part of the `limit` rows.
    """
    level = F.floor(F.log2(F.col(n).cast("double"))).cast("int")
    slot = F.pmod(F.xxhash64(key), F.lit(1 << 16)).cast("int")

    def cut(rows: DataFrame, by: Column, room: int, falling: bool) -> tuple[int | None, int]:
        """The group of `by` in which the room ends, and the room left before it; none if all fit."""
        for r in sorted(rows.groupBy(by.alias("by")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["by"] if falling else r["by"]):
            if r["rows"] > room:
                return r["by"], room
            room -= r["rows"]
        return None, room

    at, room = cut(counts, level, limit, True)
    if at is None:
        return counts
    within = counts.where(level == at)
    # in a class of 2^k to 2^(k+1), up to 4096 steps
    step = F.floor(F.col(n) / F.lit(max(1, (1 << at) >> 12)))
    fine, room = cut(within, step, room, True)
    tied = within.where(step == fine)
    last, room = cut(tied, slot, room, False)
    rest = tied.where(slot == last).orderBy(F.desc(n), key).limit(room)
    return counts.where((level > at) | ((level == at) & (step > fine)) | ((level == at) & (step == fine) & (slot < last))).union(rest)
