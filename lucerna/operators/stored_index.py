"""A BM25 index on disk that grows by segments and is searched in part.

A segment holds some chunks: `rows`, the chunks' term counts, by a hash of the
chunk id; `blocks`, the postings of a term in a cell (a hash-dealt group of about
CELL chunks), by a hash of the term, with the largest count and the least length;
and what it adds to the statistics: `terms` and `stats`, whose sums over the
segments are those of the whole. New versions of chunks go into a new segment,
which takes the old ones out of the sums and lists them as gone. A segment counts
once the manifest names it, so a job that is cut off leaves the index as it was.

A search first adds up, from the blocks' two numbers, how much a cell can give a
question at most. The few best cells are scored; a cell that can't reach the k-th
score found there is never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucerna.functions import text as X
from lucerna.operators import index as I
from lucerna.operators import lineage

CELL = 256
#: Folders that a segment's rows (by chunk) and blocks (by term) lie in.
PARTS = 64
#: Cells of a question that are scored before the others are judged.
SEEDS = 4


def _hashed(c: str, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def _impact(tf: Column, length: Column, avgdl: Column) -> Column:
    return tf * (I.K1 + 1) / (tf + I.K1 * (1 - I.B + I.B * length / avgdl))


@dataclass
class Search:
    """A search's found rows and what it read: `found` (qid, chunk_id, score, rank), `asked` and `read` blocks."""

    found: DataFrame
    asked: int
    read: int


class StoredIndex:
    def __init__(self, spark: SparkSession, folder: str, parts: int | None = None) -> None:
        """The index that lies in a folder."""
        self.spark, self.folder = spark, folder
        self.parts = parts or spark.read.parquet(f"{folder}/manifest").first().parts

    @staticmethod
    def create(chunks: DataFrame, folder: str, parts: int = PARTS) -> StoredIndex:
        """Indexes chunks (chunk_id, text, source_type) in a new folder. Chunk ids are unique."""
        index = StoredIndex(chunks.sparkSession, folder, parts)
        index._add(0, index._counted(chunks), None, 0)
        return index

    # --- what is live

    def _segments(self) -> list[int]:
        """Segments since the last merge; the manifest has a row for each."""
        named = self.spark.read.parquet(f"{self.folder}/manifest").collect()
        base = max(r.base for r in named)
        return sorted(r.segment for r in named if r.segment >= base)

    def _table(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name == "gone":  # a first segment has none
            kind = reader.parquet(f"{self.folder}/rows").schema["chunk_id"].dataType.simpleString()
            reader = reader.schema(f"chunk_id {kind}, segment int")
        return reader.parquet(f"{self.folder}/{name}").where(F.col("segment").isin(self._segments()))

    def _without_gone(self, rows: DataFrame) -> DataFrame:
        """Rows (segment, chunk_id) that no later segment replaced."""
        gone = self._table("gone").select(F.col("chunk_id").alias("_gone"), F.col("segment").alias("_by"))
        return rows.join(I.small(gone), (F.col("chunk_id") == F.col("_gone")) & (F.col("segment") < F.col("_by")), "left_anti")

    def rows(self, parts: list[int] | None = None) -> DataFrame:
        """(chunk_id, source_type, len, terms) of all live chunks, or of those in some parts."""
        rows = self._table("rows")
        return self._without_gone(rows if parts is None else rows.where(F.col("part").isin(parts))).drop("segment", "part")

    def stats(self) -> DataFrame:
        """(n, avgdl, terms, mean_idf) of the live chunks."""
        raw = self._raw()
        sums = self._table("stats").agg(F.sum("docs").alias("n"), (F.sum("words") / F.sum("docs")).alias("avgdl"))
        return sums.crossJoin(raw.agg(F.count("*").alias("terms"), F.avg("raw").alias("mean_idf")))

    def _raw(self) -> DataFrame:
        n = self._table("stats").agg(F.sum("docs").alias("n"))
        df = self._table("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return df.crossJoin(F.broadcast(n)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))

    # --- writing

    def _counted(self, chunks: DataFrame) -> DataFrame:
        """Term counts of chunks, from one look at each text, which nothing is shuffled for."""
        words = chunks.select("chunk_id", "source_type", X.tokens("text").alias("tokens"))
        none = F.array().cast("array<struct<term:string,tf:bigint>>")
        return words.select("chunk_id", "source_type", F.size("tokens").alias("len"), F.coalesce(I.counted(F.col("tokens")), none).alias("terms"))

    def _write(self, df: DataFrame, name: str, segment: int, *by: str) -> None:
        df.withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("segment", *by).parquet(f"{self.folder}/{name}")

    def _add(self, segment: int, new: DataFrame, old: DataFrame | None, base: int) -> None:
        """Writes a segment of counted chunks that replace live rows `old`; the manifest comes last.

        Its rows are written first, by the tasks that have them (a file for
        each task and part), and all else comes from the files. Rows are dealt out by cell, so that the
        postings of a cell are listed without a shuffle of postings.
        """
        slices = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.parts)
        rows = new.withColumn("part", _hashed("chunk_id", self.parts))
        self._write(rows, "rows", segment, "part")
        shape = rows.withColumn("segment", F.lit(segment)).schema
        new = self.spark.read.schema(shape).parquet(f"{self.folder}/rows").where(F.col("segment") == segment).drop("segment", "part")
        size = new.agg(F.count("*").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("words"))
        cells = max(1, -(-size.first()["docs"] // CELL))
        dealt = new.withColumn("cell", F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.lit(cells)).cast("int")).repartition(slices, "cell")
        posting = F.struct("chunk_id", "source_type", "len", "tf")
        each = dealt.select("chunk_id", "source_type", "len", "cell", F.inline("terms"))
        held = each.groupBy("cell", "term").agg(F.collect_list(posting).alias("postings"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len")).withColumn("bucket", _hashed("term", self.parts))
        self._write(held.sortWithinPartitions("bucket", "term", "cell"), "blocks", segment, "bucket")
        df = new.select(F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term")).agg(F.count("*").alias("df"))
        if old is not None:
            old = lineage.cut(old)
            lost = old.select(F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term")).agg((-F.count("*")).alias("df"))
            df = df.union(lost).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
            size = size.union(old.agg(-F.count("*"), -F.coalesce(F.sum("len"), F.lit(0))))
        self._write(df, "terms", segment)
        self._write(size, "stats", segment)
        self._write((new if old is None else old).select("chunk_id").where(F.lit(old is not None)), "gone", segment)
        self.spark.createDataFrame([(segment, base, self.parts)], "segment int, base int, parts int").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def _next(self) -> int:
        return max(r.segment for r in self.spark.read.parquet(f"{self.folder}/manifest").collect()) + 1

    def upsert(self, chunks: DataFrame) -> None:
        """Adds chunks; those with an id that is there replace the old ones. Only parts of the rows that hold such ids are read."""
        self._add(self._next(), self._counted(chunks), self._held(chunks.select("chunk_id")), min(self._segments()))

    def delete(self, ids: DataFrame) -> None:
        """Takes out the chunks of some ids (chunk_id)."""
        nothing = self.rows().limit(0)
        self._add(self._next(), nothing, self._held(ids.select("chunk_id").distinct()), min(self._segments()))

    def _held(self, ids: DataFrame) -> DataFrame:
        touched = [r.part for r in ids.select(_hashed("chunk_id", self.parts).alias("part")).distinct().collect()]
        return self.rows(touched).join(I.small(ids), "chunk_id", "left_semi")

    def merge(self) -> None:
        """Puts all live chunks into one segment, from their counts; earlier ones are read no more."""
        segment = self._next()
        self._add(segment, self.rows(), None, segment)

    # --- searching

    def search(self, questions: DataFrame, k: int, source_type: str | None = None, digits: int | None = None) -> Search:
        """R2: as `index.bm25_search`: global statistics, then the source filter, then the k best with a positive score.

        `questions` (qid, question). What is broadcast is checked: the asked
        terms, and the cells to read; what is shuffled are sums by question
        and chunk of these cells.
        """
        stats = lineage.cut(self.stats())
        raw = self._raw().crossJoin(F.broadcast(stats.select("mean_idf", "avgdl")))
        idf = F.when(F.col("raw") < 0, I.EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
        asked = lineage.cut(I.query_terms(questions).join(raw, "term").select("qid", "term", (F.col("times") * idf).alias("weight"), "avgdl"))
        buckets = [r.bucket for r in asked.select(_hashed("term", self.parts).alias("bucket")).distinct().collect()]
        blocks = self._table("blocks").where(F.col("bucket").isin(buckets))
        most = F.greatest(F.col("weight"), F.lit(0.0)) * _impact(F.col("max_tf"), F.col("min_len"), F.col("avgdl"))
        met = blocks.select("segment", "cell", "term", "max_tf", "min_len").join(I.small(asked), "term")
        bounds = met.groupBy("qid", "segment", "cell").agg(F.sum(most).alias("most"), F.count("*").alias("blocks"))
        nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("most"), "segment", "cell"))
        bounds = lineage.cut(bounds.withColumn("nth", nth))
        first = lineage.cut(self._scored(blocks, asked, bounds.where(F.col("nth") <= SEEDS), source_type))
        ranked = I.top_k(first, k, digits=digits)
        floor = ranked.where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
        slack = 10.0**-digits if digits is not None else 1e-9
        rest = bounds.where(F.col("nth") > SEEDS).join(I.small(lineage.cut(floor)), "qid", "left").where(F.col("floor").isNull() | (F.col("most") >= F.col("floor") - slack))
        rest = lineage.cut(rest.drop("floor"))
        found = I.top_k(first.unionByName(self._scored(blocks, asked, rest, source_type)), k, True, digits)
        total = lambda df: df.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
        return Search(found, total(bounds), total(bounds.where(F.col("nth") <= SEEDS)) + total(rest))

    def _scored(self, blocks: DataFrame, asked: DataFrame, cells: DataFrame, source_type: str | None) -> DataFrame:
        """(qid, chunk_id, score) of the live chunks of some cells (qid, segment, cell)."""
        chosen = I.small(cells.select("qid", "segment", "cell").join(I.small(asked), "qid"))
        # where the cells are too many to be broadcast, only blocks of asked terms are shuffled
        blocks = blocks.join(I.small(asked.select("term").distinct()), "term", "left_semi")
        hits = blocks.select("segment", "cell", "term", "postings").join(chosen, ["segment", "cell", "term"]).select("qid", "segment", "weight", "avgdl", F.inline("postings"))
        if source_type is not None:
            hits = hits.where(F.col("source_type") == source_type)
        return self._without_gone(hits).groupBy("qid", "chunk_id").agg(F.sum(F.col("weight") * _impact(F.col("tf"), F.col("len"), F.col("avgdl"))).alias("score"))
