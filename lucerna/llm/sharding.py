"""Sharding by a two-pass external shuffle (operator 1)."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lucerna.llm import common

SHARDS = 40
#: Bytes of records (`size`) a bucket holds on average; it is shuffled in memory.
BUCKET_BYTES = 8 << 20
#: Hashes of repeated rows (16 bytes each) up to which their list is broadcast.
BROADCAST_ROWS = 1_000_000
LAW = "key"


def _draw(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Rendezvous hashing: the shard whose seeded draw for the key is largest. One more shard takes rows only into itself."""
    draws = F.array(*(F.struct(F.xxhash64(key, F.lit(seed), F.lit(s)).alias("draw"), F.lit(s).alias("shard")) for s in range(shards)))
    return F.array_max(draws)["shard"]


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes all rows into `shards` shards below `folder` (one folder `shard=N` each) and returns them as read back.

    Law `key`: the id and the number of shards decide the shard. Pass 1
    scatters the rows by seeded hashes into buckets of a shard, as many as its
    bytes need; pass 2 shuffles each bucket with Fisher-Yates, seeded by the
    bucket, and writes it. Returns the columns of `docs` in a struct `row`,
    with shard, slot (position in the shard, gapless from 0), size (UTF-8
    bytes of the text, none for a null, plus 16), text_crc32, grown_shard (the
    shard among one more).

    Rows and seed alone decide the slots, however the input is partitioned, so
    a task that runs again sends every row where it went before. Null ids are
    one key; rows with one id share a shard but are spread over its buckets by
    a hash of the whole row. Whole repeated rows are counted first and
    numbered, so that they spread too. A text may be of any length; columns may
    have any names. An empty table gives an empty result.
    """
    key = F.col(f"`{id_col}`").cast("string")
    text = F.col(f"`{text_col}`")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    parts = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    rows = docs.select(
        whole.alias("row"),
        (common.bytes_of(text) + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(key, shards, seed).alias("shard"),
        shard_of(key, shards + 1, seed).alias("grown_shard"),
        _draw(F.coalesce(key, F.lit("")), seed + 1).alias("by_id"),
        F.xxhash64(*parts).alias("h1"),
        F.xxhash64(F.lit(1), *parts).alias("h2"),
    )
    again = common.stored(rows.groupBy("h1", "h2").agg(F.count("*").alias("copies")).where("copies > 1").select("h1", "h2"), "repeated")
    if not again.isEmpty():
        held = common.small(again, BROADCAST_ROWS)
        others = [c for c in rows.columns if c not in ("h1", "h2")]
        numbered = rows.join(held, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(*(F.first(c).alias(c) for c in others), F.count("*").alias("copies"))
        numbered = numbered.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
        rows = rows.join(held, ["h1", "h2"], "left_anti").withColumn("copy", F.lit(1).cast("long")).unionByName(numbered.drop("copies"))
    else:
        rows = rows.withColumn("copy", F.lit(1).cast("long"))
    rows = rows.withColumn("spread", F.xxhash64("by_id", "h1", "h2", "copy")).drop("h1", "h2", "copy")
    total = docs.agg(F.sum(common.bytes_of(text) + 16)).first()[0] or 0
    buckets = max(1, math.ceil(total / shards / bucket_bytes))
    bucket = F.pmod("spread", F.lit(buckets)).cast("int")
    shape = docs.select(whole.alias("row")).schema["row"].dataType.simpleString()

    def shuffled(group: pa.Table) -> pa.Table:
        # a fixed order first, so that the seed alone decides the outcome
        n = group.num_rows
        order = np.lexsort((group["spread"].to_numpy(), group["by_id"].to_numpy()))
        s, b = group["shard"][0].as_py(), group["bucket"][0].as_py()
        draw = np.random.default_rng([seed, s, b])
        swap = np.arange(n)
        for i in range(n - 1, 0, -1):
            j = int(draw.integers(0, i + 1))
            swap[i], swap[j] = swap[j], swap[i]
        out = group.take(pa.array(order[swap])).drop_columns(["by_id", "spread"])
        return out.append_column("place", pa.array(np.arange(n), pa.int64()))

    scattered = rows.withColumn("bucket", bucket)
    placed = scattered.groupBy("shard", "bucket").applyInArrow(shuffled, f"row {shape}, size long, text_crc32 long, shard int, grown_shard int, bucket int, place long")
    path = f"{folder}/shards"
    placed.write.partitionBy("shard").parquet(path)
    back = docs.sparkSession.read.schema(placed.schema).parquet(path)
    counts = back.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    return back.join(base, ["shard", "bucket"]).select("row", "shard", (F.col("base") + F.col("place")).alias("slot"), "size", "text_crc32", "grown_shard")


def crc32(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rows = write_shards(docs, common.scratch(spark, "shards"))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")
