"""Whole queries: building an index and answering sets of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions import words as W
from lucerna.operators import answer as A
from lucerna.operators import index as I
from lucerna.operators import lineage
from lucerna.operators import retrieve as R
from lucerna.operators import verify as V


@dataclass
class Engine:
    """Chunks (chunk_id, text, source_file, source_type, section, page, chunk_index, topic), their vectors, and the index over them."""

    chunks: DataFrame
    vectors: DataFrame
    index: I.Index
    df: DataFrame
    topics: dict

    @staticmethod
    def build(chunks: DataFrame, vectors: DataFrame, topics: dict | None = None) -> Engine:
        """The index and the document frequencies are checkpointed for the queries that follow; a large corpus saves and loads them instead."""
        return Engine(chunks, vectors, I.build_index(chunks), lineage.cut(I.document_frequency(chunks)), topics or {})

    def answer(self, questions: DataFrame, **options) -> DataFrame:
        """(qid, answer, refused, n_sources) for a set of questions (qid, question, vector).

        Questions with words outside the corpus are refused before retrieval
        and never reach the scorer; answers that leave a rare word of the
        question out are refused after it, and lose their sources. An answer
        that abstains itself is left as it is, with the sources it was drawn from.
        """
        strange = R.out_of_corpus(questions, self.df, self.topics).select("qid").distinct()
        asked = questions.join(strange, "qid", "left_anti")
        found = lineage.cut(R.hybrid_retrieve(self.index, self.chunks, self.vectors, asked, topics=self.topics, **options))
        said = lineage.cut(A.extractive_answer(found, asked, self.index.terms))
        n = self.index.stats.first()["n"]
        open_ = said.where(F.col("answer") != W.REFUSAL_TEXT)
        missed = R.uncovered(asked.select("qid", "question").join(open_, "qid"), self.df, n, self.topics).select("qid").distinct().withColumn("missed", F.lit(True))
        sources = found.groupBy("qid").agg(F.count("*").alias("n_sources"))
        out = questions.select("qid").join(said, "qid", "left").join(missed, "qid", "left").join(sources, "qid", "left")
        refused = F.when(F.col("answer").isNull(), "out_of_corpus").when(F.col("missed"), "uncovered")
        return out.select("qid", F.when(refused.isNull(), F.col("answer")).otherwise(W.REFUSAL_TEXT).alias("answer"), refused.alias("refused"), F.when(refused.isNull(), F.coalesce("n_sources", F.lit(0))).otherwise(0).cast("long").alias("n_sources"))


def agentic(threads: DataFrame) -> DataFrame:
    """One row per thread with both branches' results, joined at the barrier, to the published text.

    Rows: qid, admitted (judge's verdict or null), rejection, tree
    (struct<error, protocol, content, outcome, citations>), rag (struct<error,
    answer, n_sources, eval_status, provenance>), tree_related, chosen_by_model.
    """
    tree = V.related(V.verify_tree(*(F.col(f"tree.{c}") for c in ("error", "protocol", "content", "outcome", "citations"))), F.col("tree_related"), F.col("chosen_by_model"))
    rag = V.verify_rag(*(F.col(f"rag.{c}") for c in ("error", "answer", "n_sources", "eval_status", "provenance")))
    rows = threads.withColumn("_ok", V.admitted(F.col("admitted"))).withColumn("_tree", tree).withColumn("_rag", rag)
    each = rows.where("_ok").select("qid", F.explode(F.array(
        F.struct(F.lit("arbol").alias("agent"), F.col("_tree.status").alias("status"), F.col("_tree.verification").alias("verification"), F.col("_tree.eligible").alias("eligible"), F.col("tree.content").alias("content")),
        F.struct(F.lit("rag").alias("agent"), F.col("_rag.status").alias("status"), F.col("_rag.verification").alias("verification"), F.col("_rag.eligible").alias("eligible"), F.col("rag.answer").alias("content")),
    )).alias("c")).select("qid", "c.*")
    text = V.integrate(each)
    out = rows.select("qid", F.when(~F.col("_ok"), F.col("rejection")).alias("_no")).join(text, "qid", "left")
    return out.select("qid", F.coalesce("_no", "text", F.lit(W.REFUSAL_TEXT)).alias("text"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))
