"""Retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions import text as X
from lucerna.operators import index as I
from lucerna.operators import lineage, scan


def occurrences(index: I.Index, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, chunk_id) of passages that occur word for word in chunks.

    Such a chunk has every token inside the passage (the first and the last may
    be parts of longer words): candidates come from the postings of the rarest
    of them, and are compared in full. The few passages without one are
    compared with every chunk, if they are few enough to broadcast.
    """
    asked = questions.select("qid", "question", X.tokens("question").alias("tokens"))
    inner = F.slice("tokens", F.lit(2), F.greatest(F.size("tokens") - 2, F.lit(0)))
    terms = asked.select("qid", "question", F.explode(F.array_distinct(inner)).alias("term"))
    rarest = terms.join(index.terms.select("term", "df"), "term", "left").groupBy("qid", "question").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "term"))["term"].alias("term"))
    near = I.small(lineage.cut(index.postings.select("term", "chunk_id").join(I.small(lineage.cut(rarest)), "term").select("qid", "question", "chunk_id")))
    found = chunks.select("chunk_id", "text").join(near, "chunk_id").where(F.contains("text", F.col("question"))).select("qid", "chunk_id")
    bare = I.small(asked.where(F.size(inner) <= 0).select("qid", "question"))
    return found.union(chunks.join(bare, F.contains("text", F.col("question"))).select("qid", "chunk_id"))


def ir_metrics(ranked: DataFrame, relevant: DataFrame, ks=(1, 3, 6)) -> DataFrame:
    """(qid, k, p, r, f1) of questions with relevant chunks; precision is over what was retrieved, up to k."""
    gold = relevant.select("qid", "chunk_id", F.lit(1).alias("hit")).distinct()
    total = gold.groupBy("qid").agg(F.count("*").alias("n_relevant"))
    marked = ranked.join(gold, ["qid", "chunk_id"], "left")
    sums = [F.struct(F.lit(k).alias("k"), F.count_if(F.col("rank") <= k).alias("top"), F.count_if((F.col("rank") <= k) & F.col("hit").isNotNull()).alias("hits")) for k in ks]
    per = marked.groupBy("qid").agg(F.array(*sums).alias("at"))
    none = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(0).cast("long").alias("top"), F.lit(0).cast("long").alias("hits")) for k in ks))
    rows = total.join(per, "qid", "left").select("qid", "n_relevant", F.inline(F.coalesce("at", none)))
    p = F.when(F.col("top") > 0, F.col("hits") / F.col("top")).otherwise(0.0)
    r = F.col("hits") / F.col("n_relevant")
    return rows.select("qid", "k", p.alias("p"), r.alias("r")).withColumn("f1", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))


def hit_rate(ranked: DataFrame, relevant: DataFrame, k: int = 6) -> DataFrame:
    """(questions, hits, rate) over questions with relevant chunks."""
    asked = relevant.select("qid").distinct()
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["qid", "chunk_id"], "left_semi").select("qid", F.lit(1).alias("hit")).distinct()
    return asked.join(hits, "qid", "left").agg(F.count("*").alias("questions"), F.count("hit").alias("hits"), (F.count("hit") / F.count("*")).alias("rate"))


def latency(rows: DataFrame, column: str) -> DataFrame:
    """Count, mean and exact median, which no task gathers the values for."""
    median = scan.quantile(rows, column, 0.5)
    return rows.agg(F.count(column).alias("n"), F.avg(column).alias("mean")).withColumn("median", F.lit(median).cast("double"))


def refusal_accuracy(rows: DataFrame, every: bool = False) -> DataFrame:
    """(questions, accuracy) of those rows (answer, should_refuse) that should be refused: the share that abstains, at any length.

    With `every`, of all rows: the share that abstains exactly if it should.
    """
    if every:
        right = X.abstains("answer") == F.col("should_refuse")
        return rows.agg(F.count("*").alias("questions"), F.avg(right.cast("int")).alias("accuracy"))
    return rows.where("should_refuse").agg(F.count("*").alias("questions"), F.avg(X.abstains("answer").cast("int")).alias("accuracy"))


def judge_metrics(rows: DataFrame, names=("faithfulness", "answer_relevancy", "context_precision")) -> DataFrame:
    """(metric, n, mean) of a judge's scores, a column each; rows without a score don't count, a metric without any has no mean."""
    each = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("score")) for n in names))
    return rows.select(F.inline(each)).groupBy("metric").agg(F.count("score").alias("n"), F.avg("score").alias("mean"))


def qa_candidates(chunks: DataFrame, limit: int = 500) -> DataFrame:
    """Chunks of numbered sections with an excerpt."""
    return chunks.where(F.col("section").rlike(r"^[0-9]{1,3}\.\s")).select("chunk_id", "section", F.substring("text", 1, limit).alias("excerpt"))
