"""Text vectors without a model: hashed TF-IDF under a seeded signed projection (I-Embedder's offline default).

A term falls into one of BUCKETS buckets by its hash; a bucket has an idf, from
the corpus, which is its weight in every dimension, with a fixed sign for each. A
text's vector is the sum of its tokens' weights, brought to unit length. Texts that share
words point the same way, and questions and chunks go through the same function.

What is broadcast is the table of buckets, whose size (33 MB at 64 dimensions)
does not depend on the vocabulary. A text's tokens stay in one task up to the sum, so a shuffle
carries one row of sums a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions import text as X
from lucerna.operators import lineage

#: 16 bits of a term's hash.
BUCKETS = 1 << 16
DIMENSIONS = 64
SEED = 7
#: Signs that one hash of a bucket has.
_SIGNS = 128
_FOUND = "_buckets"


def _hex(x: Column, at: int, digits: int) -> Column:
    """`digits` (up to 15) hexadecimal digits of a hash as an integer."""
    return F.conv(F.substring(x, at, digits), 16, 10).cast("long")


def buckets(text: Column | str) -> Column:
    """The bucket of each token of a text; a null text has none."""
    return F.transform(X.tokens(text), lambda t: _hex(F.md5(t.cast("binary")), 1, 4).cast("int"))


def looked_up(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """The texts as the buckets of their tokens, checkpointed, so that `fit` and `vectors` of them share one look at each text."""
    return lineage.cut(texts.withColumn(_FOUND, buckets(text_col)).drop(text_col))


def _found(texts: DataFrame, text_col: str) -> Column:
    return F.col(_FOUND) if _FOUND in texts.columns else buckets(text_col)


def fit(texts: DataFrame, text_col: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """The table of buckets: bucket, idf, weights (one a dimension). All texts count; they may be `looked_up`.

    idf is ln((texts + 1) / (texts with the bucket + 1)) + 1, so a bucket that no
    text has is the heaviest. No texts: all are alike. The rows are
    checkpointed, as every use of the model reads them.
    """
    # an inner explode would come with a filter on the array's size, for which the tokens are found once more
    rows = texts.select(F.explode_outer(F.array_distinct(_found(texts, text_col))).alias("bucket"))
    held = rows.groupBy("bucket").agg(F.count("bucket").alias("df"))
    n = texts.agg(F.count("*").alias("n"))
    every = texts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    counted = every.join(held, "bucket", "left").crossJoin(F.broadcast(n))
    idf = F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    sign = lambda k: 1 - 2 * F.shiftright(_hex(F.md5(F.concat(F.lit(f"{seed}:{k // _SIGNS}:"), F.col("bucket").cast("string")).cast("binary")), 1 + 8 * (k % _SIGNS // 32), 8), k % 32).bitwiseAND(F.lit(1))
    weighed = counted.select("bucket", idf.alias("idf"), F.array(*map(sign, range(dimensions))).alias("signs"))
    return lineage.cut(weighed.select("bucket", "idf", F.transform("signs", lambda s: s * F.col("idf")).alias("weights")))


def vectors(texts: DataFrame, model: DataFrame, id_col: str = "chunk_id", text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, embedding array<double>): a unit vector for each text; all zeros for a null text and one without tokens.

    Ids name texts: rows of one id count as one text. Texts may be of any length, and may be `looked_up`.
    """
    tokens = texts.select(F.col(f"`{id_col}`").alias("_id"), F.explode_outer(_found(texts, text_col)).alias("bucket"))
    rows = tokens.join(F.broadcast(model), "bucket", "left")
    sums = rows.groupBy("_id").agg(*(F.coalesce(F.sum(F.get("weights", F.lit(k))), F.lit(0.0)).alias(f"v{k}") for k in range(dimensions)))
    # the array is bound, so that its 64 parts stand in the plan once
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = X.bind(F.array(*(f"v{k}" for k in range(dimensions))), lambda v: X.bind(length(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))))
    return sums.select(F.col("_id").alias(id_col), unit.alias("embedding"))
