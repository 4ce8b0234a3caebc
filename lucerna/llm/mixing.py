"""Mixing sources to target weights by systematic sampling (operator 11).

Every document of a source has the same expected copies: the source's target
over its size. Their prefix sums run over the documents of a source from the
largest to the smallest; with one random offset a document is taken once for
each integer that its stretch of the sum crosses. In that order the words taken
miss the target by less than the source's largest document.

The sums are made in two steps, so that a source of any size is split: rows are
dealt out by ranges of (source, size), each range sums its own rows, and the
sums of the ranges before it in the source are added.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucerna.llm import common

WEIGHTS = (1, 2, 3)
#: Most copies of a document, and so most times its size that a source's target may reach.
MOST = 3
SEED = 11
#: Copies and offsets are integers in units of 2^-28: sums are exact, up to ten thousand million documents a source.
BITS = 28

WORD = r"[^\x20\x09-\x0D]++"


def _numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """The rows, stored, with `part`: the number of the range of `order` that each lies in."""
    return common.stored(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)


def _offset(source: Column, seed: int) -> Column:
    """The source's random offset, below one copy."""
    mark = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("+"), source), F.lit("-")))
    return F.conv(F.substring(F.md5(mark.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds weight and target to stored rows of (source, source_size).

    Sources by code point, null last, have the weights in turn and share the
    sum of all sizes; what a target has above `most` times its source's size
    goes to the others by weight, until none is above. Each round is a sum over
    the sources, of which only two numbers come back.
    """
    ranges = _numbered(sources, "sources", F.asc_nulls_last("source"))
    before = ranges.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    at = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    turn = F.pmod(at + F.coalesce("before", F.lit(0)), F.lit(len(weights)))
    weight = F.get(F.array(*(F.lit(int(w)) for w in weights)), turn.cast("int"))
    # the table of ranges has a row for each task
    ranked = common.stored(ranges.withColumn("at", at).join(F.broadcast(before.drop("count")), "part").withColumn("at", F.col("at")).select("source", "source_size", "documents", weight.cast("long").alias("weight")), "ranked")
    size, w = F.col("source_size").cast("decimal(20,0)"), F.col("weight").cast("decimal(10,0)")
    total, rest, open_weight, full = None, 0, 0, F.lit(False)
    while True:
        sums = ranked.select(F.when(full, F.col("source_size")).alias("full"), F.when(~full, F.col("weight")).alias("open"), "source_size").agg(F.sum("full"), F.sum("open"), F.sum("source_size")).first()
        total = int(sums[2] or 0)
        now_rest, now_weight = total - most * int(sums[0] or 0), int(sums[1] or 0)
        if now_weight == open_weight:
            break
        rest, open_weight = now_rest, now_weight
        if not rest or not open_weight:
            break
        full = w * F.lit(Decimal(rest)) > size * F.lit(Decimal(most * open_weight)).cast("decimal(18,0)")
    share = F.when(full, (F.lit(most) * F.col("source_size")).cast("double"))
    share = share.otherwise((F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(open_weight)) if open_weight else F.lit(0.0))
    common.dropped(ranges)
    return ranked.withColumn("target", share)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken (and `row`, the whole row, if `carry`).

    size counts the words of the whole text, of any length (null and empty: 0,
    never taken); taken is copies * size. Equal sizes are ordered by a hash of
    the id, the id and the text; repeated rows are taken like others. A null source is a source, a null id an id. Extra and clashing
    columns don't matter. An empty table gives an empty result; if no document
    has a word, all targets are 0. Reruns and other numbers of tasks agree.
    """
    size = F.coalesce(F.size(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(WORD), F.lit(0))), F.lit(0))
    size = F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(size).cast("long")
    # rows that are equal throughout are alike, so a running number may deal them out
    columns = [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"), F.monotonically_increasing_id().alias("spread")]
    if carry:
        columns.append(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    order = (F.asc_nulls_last("source"), F.desc("size"), key, F.col("doc_id"), F.col("hash"), F.col("spread"))
    counted = docs.select(*columns)
    if not carry:
        # dealing out by ranges looks at the rows twice; so the texts are read once
        counted = common.stored(counted, "counted")
    rows = _numbered(counted, "sizes", *order)
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")), weights, most)
    each = F.when(F.col("source_size") > 0, F.least(F.lit(most << BITS), F.round(F.col("target") / F.col("source_size") * float(1 << BITS)).cast("long"))).otherwise(F.lit(0)).cast("long")
    sources = sources.select("source", "source_size", "target", each.alias("each"), _offset(F.col("source").cast("string"), seed).alias("offset"))
    # what a range has of a source, and the sum of the ranges before it
    spans = rows.groupBy("source", "part").agg(F.count("*").alias("n"))
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spans = spans.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select("source", "part", "source_size", "target", "each", (F.col("before") * F.col("each") + F.col("offset")).alias("start"))
    spans = common.small(common.stored(spans.withColumnRenamed("source", "of").withColumnRenamed("part", "in"), "spans"), 100_000)
    local = Window.partitionBy("part", "source").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(spans, (F.col("part") == F.col("in")) & F.col("source").eqNullSafe(F.col("of")))
    upto = F.col("start") + F.sum("each").over(local)
    copies = F.shiftright(upto, BITS) - F.shiftright(upto - F.col("each"), BITS)
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else []))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of `docs`, with all columns, each as often as `mix` takes it. Options and cases as in `mix`."""
    rows = mix(docs, carry=True, **options).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
