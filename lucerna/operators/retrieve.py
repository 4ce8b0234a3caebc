"""Retrieval: dense search, fusion, selection."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from lucerna.functions import text as X
from lucerna.functions import words as W
from lucerna.operators import index as I
from lucerna.operators import lineage, product

INSTITUTIONAL = "institucional"
"""Source type of the house's own documents (a fixed value)."""
RRF_K = 60
QUESTIONS = 20_000
"""Question vectors held in memory at once (about 10 MB at 64 dimensions, 160 MB at 1,024)."""
WHOLE = 1e15
"""Values below it are multiplied and added in single precision without overflow."""


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double precision; of unit vectors it is the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: str, b: str, metric: str = "cosine") -> Column:
    """Cosine (also for unknown names), dot, or euclid as a negated distance, so that more is better."""
    if metric == "dot":
        return dot(a, b)
    if metric == "euclid":
        square = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
        return -F.sqrt(square)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense_search(vectors: DataFrame, questions: DataFrame, k: int, source_type: str | None = None, metric: str = "dot", digits: int | None = None) -> DataFrame:
    """Exact search. `questions` (qid, vector) are a stated set, asked in blocks of QUESTIONS that go with the tasks; `vectors` (chunk_id, source_type, embedding) stream past each block.

    The source filter is below the product, so it reaches the scan (P5). Dot
    products of whole vectors come from matrix products (`product`); a task
    keeps its k best of a question. Null and unlike vectors, and other metrics,
    are scored pair by pair.
    """
    rows = (vectors if source_type is None else vectors.where(F.col("source_type") == source_type)).select("chunk_id", "embedding")
    asked = questions.select("qid", "vector")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    blocks = max(1, -(-size.n // QUESTIONS))
    whole = lambda c: F.coalesce((F.size(c) == size.width) & F.forall(c, lambda x: F.coalesce(F.abs(x) < WHOLE, F.lit(False))), F.lit(False))
    fits, asks = whole("embedding") & F.col("chunk_id").isNotNull(), whole("vector")
    fast = metric == "dot" and (size.width or 0) > 0
    odd_rows, odd_asked = (fast and df.where(~own).limit(1).count() > 0 for df, own in ((rows, fits), (asked, asks)))

    def paired(block: DataFrame, rows: DataFrame) -> DataFrame:
        pairs = rows.join(F.broadcast(block), how="cross")
        return I.top_k(pairs.select("qid", "chunk_id", similarity("embedding", "vector", metric).alias("score")), k, digits=digits).drop("rank")

    def best(block: DataFrame) -> list[DataFrame]:
        if not fast:
            return [paired(block, rows)]
        found = [_products(rows.where(fits), block.where(asks), k, size.width, digits)]
        found += [paired(block.where(asks), rows.where(~fits))] if odd_rows else []
        return found + ([paired(block.where(~asks), rows)] if odd_asked else [])

    # twice as many blocks as needed, so that the hash's unevenness leaves each below the bound
    parts = [asked] if blocks == 1 else [asked.where(F.pmod(F.xxhash64("qid"), F.lit(2 * blocks)) == b) for b in range(2 * blocks)]
    return I.top_k(reduce(DataFrame.unionByName, [found for part in parts for found in best(part)]), k, digits=digits)


def _products(rows: DataFrame, asked: DataFrame, k: int, width: int, digits: int | None) -> DataFrame:
    """(qid, chunk_id, score): the k best rows of each task for each question; vectors are whole and of one width."""
    spark = rows.sparkSession
    qid, chunk = (df.schema[c].dataType for df, c in ((asked, "qid"), (rows, "chunk_id")))
    schema = StructType([StructField("qid", qid), StructField("chunk_id", chunk), StructField("score", DoubleType())])
    block = asked.toArrow()
    if not block.num_rows:
        return spark.createDataFrame([], schema)
    vectors = block.column("vector").combine_chunks()
    shared = spark.sparkContext.broadcast((product.matrix(vectors, width), block.column("qid").combine_chunks()))
    arrow = to_arrow_schema(schema)

    def run(batches):
        q, qids = shared.value
        for of, ids, score in product.best(batches, q, k, digits):
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(of)), pa.array(ids, arrow.field("chunk_id").type), pa.array(score)], schema=arrow)

    # a small table can be one file, and every row costs as much as there are questions
    return rows.repartition(max(8, spark.sparkContext.defaultParallelism)).mapInArrow(run, schema)


def fuse(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over ranked lists (qid, chunk_id, rank from 1): qid, chunk_id, score, rank.

    Ties keep the order in which chunks are first seen: by list, then by rank.
    """
    each = [d.select("qid", "chunk_id", (F.lit(1.0) / (k + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("list"), F.col("rank").alias("at")).alias("seen")) for i, d in enumerate(lists)]
    rows = each[0]
    for d in each[1:]:
        rows = rows.unionByName(d)
    summed = rows.groupBy("qid", "chunk_id").agg(F.sum("part").alias("score"), F.min("seen").alias("seen"))
    order = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), "seen", "chunk_id")
    return summed.withColumn("rank", F.row_number().over(order)).drop("seen")


def candidate_pool(fused: DataFrame, extras: DataFrame | None, k_final: int) -> DataFrame:
    """The first max(3k, 10) of the fused list, and extras that are not among them."""
    pool = fused.where(F.col("rank") <= max(3 * k_final, 10)).select("qid", "chunk_id", "score")
    if extras is None:
        return pool
    return pool.unionByName(extras.select("qid", "chunk_id", "score").join(pool.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti"))


def admin_penalty(section: Column, question: Column, source_type: Column, page: Column, text: Column | None = None, penalty: float = W.ADMIN_PENALTY, table=W.ADMIN, stem: int = W.ADMIN_STEM) -> Column:
    """Minus `penalty` for administrative text, in this order.

    A document's header, unless the question asks for version, code or date;
    the first page of an outside document; a section whose last title (of a
    table of changes, also the first) starts as one of the table, unless the
    question has the stem of its word.
    """
    levels = F.transform(F.split(X.fold(section), " — ", -1), lambda s: F.btrim(F.regexp_replace(s, r"^[0-9]{1,3}\.\s*", ""), F.lit(" :.")))
    lost, none = F.lit(-float(penalty)), F.lit(0.0)

    def by_title(title: Column, asked: Column, otherwise: Column) -> Column:
        out = otherwise
        for prefix, word in reversed(table.items()):
            out = F.when(F.startswith(title, F.lit(prefix)), F.when(F.contains(asked, F.lit(word[:stem])), none).otherwise(lost)).otherwise(out)
        return out

    def judged(x: Column) -> Column:
        asked, first, last = x["asked"], F.get(x["levels"], F.lit(0)), F.element_at(x["levels"], -1)
        titled = by_title(last, asked, F.when(F.startswith(first, F.lit(W.CHANGE_CONTROL)), by_title(first, asked, none)).otherwise(none))
        out = F.when((source_type != INSTITUTIONAL) & F.coalesce(page == 1, F.lit(False)), lost).otherwise(titled)
        if text is not None:
            out = F.when(X.fold(text).rlike(W.DOCUMENT_HEADER), F.when(asked.rlike(W.HEADER_WORDS), none).otherwise(lost)).otherwise(out)
        return out

    # question and titles are folded once a row, not once for each entry of the table
    return X.bind(F.struct(X.fold(question).alias("asked"), levels.alias("levels")), judged)


def boost(raw: Column, section: Column, value: float = 0.0, least: float = 0.02) -> Column:
    """Added for numbered sections that already score `least`; off by default."""
    return F.when((raw >= least) & section.rlike(r"^[0-9]{1,3}\.\s"), F.lit(value)).otherwise(F.lit(0.0))


def coverage(index: I.Index, questions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Offline scorer: share of the question's idf that a chunk covers, in [0, 1]; pairs (qid, chunk_id) gain `raw`."""
    asked = questions.select("qid", F.explode(F.array_distinct(X.tokens("question"))).alias("term"))
    weighed = asked.join(index.terms, "term", "left").select("qid", "term", F.greatest(F.coalesce("idf", F.lit(1.0)), F.lit(0.0)).alias("w"))
    total = weighed.groupBy("qid").agg(F.sum("w").alias("total"))
    # postings of the pairs' chunks stay where they are; what joins them by term is as small as the pairs
    pairs = lineage.cut(pairs)
    near = index.postings.join(I.small(pairs.select("chunk_id").distinct()), "chunk_id", "left_semi")
    hit = near.join(I.small(lineage.cut(pairs.join(weighed, "qid").select("qid", "chunk_id", "term", "w"))), ["term", "chunk_id"]).groupBy("qid", "chunk_id").agg(F.sum("w").alias("got"))
    out = pairs.join(hit, ["qid", "chunk_id"], "left").join(total, "qid", "left")
    return out.withColumn("raw", F.when(F.col("total") > 0, F.coalesce("got", F.lit(0.0)) / F.col("total")).otherwise(0.0)).drop("got", "total")


def rerank(scored: DataFrame, exclude_admin: bool = False, section_boost: float = 0.0) -> DataFrame:
    """Raw score, boost and penalty as `score`, ranked; rows need qid, question, chunk_id, raw, section, source_type, page."""
    penalty = admin_penalty(F.col("section"), F.col("question"), F.col("source_type"), F.col("page"), F.col("text") if "text" in scored.columns else None)
    out = scored.withColumn("penalty", penalty)
    if exclude_admin:
        out = out.where("penalty >= 0")
    out = out.withColumn("score", F.col("raw") + boost(F.col("raw"), F.col("section"), section_boost) + F.col("penalty"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "chunk_id")))


def select_with_quota(ranked: DataFrame, k: int, quota: int, min_score: float, floor: float | None = None, per_document: int | None = None, digits: int = 9) -> DataFrame:
    """R8, in this order: floor, cap for each outside document, reserve for the house's own, fill, sort.

    Rows need qid, chunk_id, score, source_type, source_file. Reserved rows
    win even if they are more than k.
    """
    order = [F.round("score", digits).desc(), F.col("chunk_id")]
    own = F.col("source_type") == INSTITUTIONAL
    rows = ranked if floor is None else ranked.where(F.col("score") >= floor)
    if per_document:
        nth = F.row_number().over(Window.partitionBy("qid", "source_file").orderBy(*order))
        rows = rows.withColumn("_nth", nth).where(own | (F.col("_nth") <= per_document)).drop("_nth")
    good = own & (F.col("score") >= min_score)
    rows = rows.withColumn("_good", good).withColumn("_place", F.row_number().over(Window.partitionBy("qid", "_good").orderBy(*order)))
    rows = rows.withColumn("reserved", F.col("_good") & (F.col("_place") <= quota))
    pick = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("reserved").desc(), *order))
    rows = rows.withColumn("_pick", pick).where(F.col("reserved") | (F.col("_pick") <= k)).drop("_good", "_place", "_pick")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


def question_topics(question: Column, topics: dict[str, list[str]]) -> Column:
    """Names of the topics with a word in the question."""
    found = X.tokens(X.retrieval_query(question))
    named = [F.when(F.arrays_overlap(found, F.array(*map(F.lit, words))), F.lit(name)) for name, words in topics.items()]
    return F.filter(F.array(*named), lambda t: t.isNotNull()) if named else F.array().cast("array<string>")


def chunk_topic(chunks: DataFrame, catalog: DataFrame | None, prefixes: dict[str, str]) -> DataFrame:
    """Adds `topic`: of own documents by the first configured prefix, of others by the catalog (file_key, topic); else null."""
    own = F.lit(None).cast("string")
    for prefix, topic in reversed(list(prefixes.items())):
        own = F.when(F.startswith("source_file", F.lit(prefix)), F.lit(topic)).otherwise(own)
    if catalog is None:
        outside, rows = F.lit(None).cast("string"), chunks
    else:
        keyed = I.small(catalog.select(X.plain_key("file").alias("_key"), F.col("topic").alias("_topic")))
        rows, outside = chunks.join(keyed, X.plain_key("source_file") == F.col("_key"), "left"), F.col("_topic")
    return rows.withColumn("topic", F.when(F.col("source_type") == INSTITUTIONAL, own).otherwise(outside)).drop("_key", "_topic")


def same_topic(rows: DataFrame) -> DataFrame:
    """If the question has one topic (`topics`), chunks of another `topic` go; unknown topics stay."""
    return rows.where((F.size("topics") != 1) | F.col("topic").isNull() | (F.col("topic") == F.get("topics", F.lit(0))))


def hybrid_retrieve(index: I.Index, chunks: DataFrame, vectors: DataFrame, questions: DataFrame, *, k_first: int = 20, k_final: int = 8, quota: int = 3, min_score: float = 0.02, floor: float | None = 0.05, per_document: int | None = 3, topics: dict | None = None, use_reranker: bool = True, exclude_admin: bool = False, scorer: Callable | None = None, digits: int | None = None) -> DataFrame:
    """Both searches, fusion, pool with the house's own, topic filter, rerank, selection.

    `questions`: qid, question, vector. `chunks`: chunk_id, source_file,
    source_type, section, page, topic, and text, by which a document's header is
    known. `vectors` is a table of vectors or a vector_index.VectorIndex. Without
    a reranker the fused list is cut at k_final and nothing else applies (T9).
    Both searches rank scores rounded to `digits`, if given. The pool, a few rows
    a question, is checkpointed, as are the questions and their terms, which both
    searches share; texts are joined to the pool, never the other way.
    """
    asked = lineage.cut(questions.withColumn("question", X.retrieval_query("question")))
    terms = I.asked_terms(index, asked)

    def both(source_type: str | None = None) -> DataFrame:
        dense = dense_search(vectors, asked, k_first, source_type, digits=digits) if isinstance(vectors, DataFrame) else vectors.search(asked, k_first, source_type, digits=digits)
        return fuse([dense, I.bm25_search(index, asked, k_first, source_type, digits, terms)])

    fused = both()
    if not use_reranker:
        return fused.where(F.col("rank") <= k_final).withColumn("method", F.lit("hybrid"))
    extras = both(INSTITUTIONAL).where(F.col("rank") <= 2 * quota)
    pool = lineage.cut(candidate_pool(fused, extras, k_final).select("qid", "chunk_id"))
    raw = lineage.cut((scorer or coverage)(index, asked, pool).join(asked.select("qid", "question"), "qid"))
    rows = chunks.join(I.small(raw), "chunk_id").withColumn("topics", question_topics(F.col("question"), topics or {}))
    return select_with_quota(rerank(same_topic(rows), exclude_admin), k_final, quota, min_score, floor, per_document).withColumn("method", F.lit("rerank"))


def out_of_corpus(questions: DataFrame, df: DataFrame, topics: dict | None = None) -> DataFrame:
    """(qid, term): content words that no chunk has, of questions without a topic; nothing if the vocabulary is empty."""
    asked = questions.where(F.size(question_topics(F.col("question"), topics or {})) == 0)
    words = asked.select("qid", F.explode(X.content_words("question")).alias("term"))
    some = df.limit(1).select(F.lit(True).alias("_some"))
    return words.join(df, "term", "left_anti").join(F.broadcast(some), how="cross").select("qid", "term")


def rare_limit(n: int, ratio: float = 0.01) -> int:
    return max(3, int(n * ratio))


def uncovered(questions: DataFrame, df: DataFrame, n_chunks: int, topics: dict | None = None, ratio: float = 0.01) -> DataFrame:
    """(qid, term): rare content words of the question that the answer lacks; order and repeats are kept by `pos`."""
    asked = questions.where(F.size(question_topics(F.col("question"), topics or {})) == 0)
    words = asked.select("qid", X.tokens("answer").alias("said"), F.posexplode(X.content_words("question")).alias("pos", "term"))
    rare = df.where((F.col("df") > 0) & (F.col("df") <= rare_limit(n_chunks, ratio)))
    return words.join(rare, "term").where(~F.array_contains("said", F.col("term"))).select("qid", "pos", "term")
