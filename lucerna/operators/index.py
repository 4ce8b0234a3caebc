"""Inverted index and BM25.

The index is four tables: postings (term, chunk_id, source_type, len, tf), lengths (chunk_id,
source_type, len), terms (term, df, idf) and stats (n, avgdl, terms, mean_idf).
Statistics are always of the whole index; a filter on the source type comes
after scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lucerna.functions import text as X
from lucerna.operators import lineage

K1, B, EPSILON = 1.5, 0.75, 0.25
"""Fixed values: the defaults of the published Okapi variant with a floor for negative idf."""
#: Rows up to which the query side is broadcast (question terms; under 100 bytes each).
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most `rows` rows; else the join is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Chunks of one part of an index, at most about; a part's scores for all questions are summed in one task.
PART_CHUNKS = 8192


@dataclass
class Index:
    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    stats: DataFrame

    def save(self, folder: str, buckets: int = 32) -> None:
        """Writes the tables; postings are clustered by term, so that a scan for a few terms prunes row groups."""
        self.postings.repartition(buckets, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
        for name in ("lengths", "terms", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")

    @staticmethod
    def load(spark, folder: str) -> Index:
        return Index(*(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "lengths", "terms", "stats")))


def counted(tokens: Column) -> Column:
    """array<struct<term, tf>>: how often each token is there, without a shuffle; null if there is none."""
    first = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    of = lambda s: X.bind(first(s), lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("tf"))))
    return F.when(F.size(tokens) > 0, X.bind(F.sort_array(tokens), of))


def build_index(chunks: DataFrame) -> Index:
    """Chunks (chunk_id, text, source_type) as an index; chunks without tokens count in n and avgdl.

    Texts are tokenised once, and a chunk stays one row: its sorted tokens are
    shuffled as one string, and its terms, again as one string, are checkpointed
    with their counts; postings are read out of that row, and all other tables
    come from it. Rows are dealt out by chunk, so what follows by chunk (counts,
    scores of questions) shuffles nothing more. Rows of one chunk, length and
    type are one chunk.
    """
    spark = chunks.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chunks.select("chunk_id").count() // PART_CHUNKS))
    # tokens hold no blank
    said = lambda found: F.struct(F.size(found).alias("len"), F.nullif(F.array_join(F.sort_array(found), " "), F.lit("")).alias("words"))
    tokenised = chunks.select("chunk_id", "source_type", X.bind(X.tokens("text"), said).alias("said")).select("chunk_id", "source_type", "said.*").repartition(parts, "chunk_id")
    whole = tokenised.groupBy("chunk_id", "source_type", "len").agg(F.array_join(F.collect_list("words"), " ").alias("words"))
    packed = lambda found: F.struct(F.array_join(F.transform(found, lambda t: t["term"]), " ").alias("terms"), F.transform(found, lambda t: t["tf"].cast("int")).alias("tfs"))
    held = F.when(F.col("words") != "", X.bind(counted(F.split("words", " ", -1)), packed))
    rows = lineage.cut(whole.select("chunk_id", "source_type", "len", held.alias("held")).select("chunk_id", "source_type", "len", "held.*"), dealt=True)
    postings = rows.select("chunk_id", "source_type", "len", "tfs", F.posexplode(F.split("terms", " ", -1)).alias("at", "term"))
    postings = postings.select("chunk_id", "source_type", "len", "term", F.get("tfs", F.col("at")).cast("long").alias("tf"))
    lengths = rows.select("chunk_id", "source_type", "len")
    size = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    df = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size.select("n")))
    raw = lineage.cut(df.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))
    mean = raw.agg(F.count("*").alias("terms"), F.avg("raw").alias("mean_idf"))
    stats = lineage.cut(size.crossJoin(mean))
    terms = raw.crossJoin(F.broadcast(stats.select("mean_idf"))).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return Index(postings, lengths, terms, stats)


def document_frequency(chunks: DataFrame) -> DataFrame:
    """A1: (term, df) over text or section, a chunk counting once."""
    both = F.array_distinct(F.concat(X.tokens("text"), X.tokens("section")))
    return chunks.select(F.explode(both).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def query_terms(questions: DataFrame, column=None) -> DataFrame:
    """(qid, term, times): a term that a question repeats counts as often."""
    found = X.tokens("question") if column is None else column
    return questions.select("qid", F.explode(found).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))


def asked_terms(index: Index, questions: DataFrame) -> DataFrame:
    """(qid, term, times, idf, avgdl) of the questions' terms that the index has, so that its postings are joined once."""
    known = query_terms(questions).join(index.terms.select("term", "idf"), "term")
    return small(lineage.cut(known.crossJoin(F.broadcast(index.stats.select("avgdl")))))


def bm25_scores(index: Index, questions: DataFrame, source_type: str | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, score) of every chunk that shares a term with the question; `asked` are its `asked_terms`, where they are known."""
    asked = asked_terms(index, questions) if asked is None else asked
    hits = index.postings.join(asked, "term")
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    scored = hits.groupBy("qid", "chunk_id", "source_type").agg(F.sum(F.col("times") * F.col("idf") * weight).alias("score"))
    return (scored if source_type is None else scored.where(F.col("source_type") == source_type)).select("qid", "chunk_id", "score")


def top_k(scored: DataFrame, k: int, positive: bool = False, digits: int | None = None) -> DataFrame:
    """The k best of each question, rank from 1; ties by chunk_id. `positive` drops scores up to 0 after the cut."""
    score = F.col("score") if digits is None else F.round("score", digits)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(score.desc(), F.col("chunk_id"))))
    out = ranked.where(F.col("rank") <= k)
    return out.where("score > 0") if positive else out


def bm25_search(index: Index, questions: DataFrame, k: int, source_type: str | None = None, digits: int | None = None, asked: DataFrame | None = None) -> DataFrame:
    """R2: global statistics, then the source filter, then the k best, then only positive scores."""
    return top_k(bm25_scores(index, questions, source_type, asked), k, True, digits)


def rank_nodes(nodes: DataFrame, questions: DataFrame, k: int = 4, ratio: float = 0.4) -> DataFrame:
    """(qid, node_id, score, rank): the k nodes of a question's protocol that fit it best, with a positive score of at least `ratio` times the best.

    `nodes` (protocol_id, node_id, kind, text), `questions` (qid, protocol_id,
    question). Each protocol is an index of its own, over its nodes but the
    start, with the tokens and synonyms of nodes (F36). Nodes of one text score
    alike, as do questions of one text: pairs are of different texts.
    """
    own = nodes.where("kind <> 'start'").select("protocol_id", "node_id", F.array_sort(X.node_tokens("text")).alias("tokens"))
    texts = lineage.cut(own.groupBy("protocol_id", "tokens").agg(F.count("*").alias("copies"), F.min("node_id").alias("chunk_id")))
    each = texts.select("protocol_id", "chunk_id", "copies", F.size("tokens").alias("len"), F.explode("tokens").alias("term")).groupBy("protocol_id", "chunk_id", "copies", "len", "term").agg(F.count("*").alias("tf"))
    size = texts.groupBy("protocol_id").agg(F.sum("copies").alias("n"), (F.sum(F.col("copies") * F.size("tokens")) / F.sum("copies")).alias("avgdl"))
    df = each.groupBy("protocol_id", "term").agg(F.sum("copies").alias("df")).join(size, "protocol_id")
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = F.avg("raw").over(Window.partitionBy("protocol_id"))
    idf = raw.withColumn("idf", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw"))).select("protocol_id", "term", "idf", "avgdl")
    told = questions.groupBy("qid", "protocol_id").agg(F.array_sort(F.flatten(F.collect_list(X.node_tokens("question")))).alias("asked"))
    same = lineage.cut(told.groupBy("protocol_id", "asked").agg(F.struct("protocol_id", F.min("qid").alias("qid")).alias("first")))
    asked = same.select(F.col("first").alias("qid"), "protocol_id", F.explode("asked").alias("term")).groupBy("qid", "protocol_id", "term").agg(F.count("*").alias("times"))
    hits = each.join(small(lineage.cut(idf.join(asked, ["protocol_id", "term"]))), ["protocol_id", "term"])
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    scored = hits.groupBy("qid", "protocol_id", "chunk_id").agg(F.sum(F.col("times") * F.col("idf") * weight).alias("score"))
    # a text's least node is before its others, so the k best nodes are among the k least of the k best texts
    fit = lineage.cut(top_k(scored, k, True, 9).drop("rank"))
    nth = F.row_number().over(Window.partitionBy("protocol_id", "tokens").orderBy("node_id"))
    least = own.withColumn("nth", nth).where(F.col("nth") <= k).join(texts.select("protocol_id", "tokens", "chunk_id"), ["protocol_id", "tokens"]).select("protocol_id", "chunk_id", "node_id")
    best = top_k(least.join(small(fit), ["protocol_id", "chunk_id"]).select("qid", F.col("node_id").alias("chunk_id"), "score"), k, True, 9)
    most = F.max("score").over(Window.partitionBy("qid"))
    kept = best.withColumn("most", most).where(F.col("score") >= ratio * F.col("most")).select(F.col("qid").alias("first"), F.col("chunk_id").alias("node_id"), "score", "rank")
    return told.join(same, ["protocol_id", "asked"]).select("qid", "first").join(kept, "first").drop("first")
