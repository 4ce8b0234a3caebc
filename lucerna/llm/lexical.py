"""Ranked lexical search as a blocked sparse matrix product (operator 12).

The right side holds an integer impact for each term of each document, the left
side how often each item asks each term. Both are tables of blocks: a row is a
block of the matrix, its rows (terms) compressed. A pair of blocks is multiplied
row by row after Gustavson: the item's term rows are merged into one row of
scores over the block's documents, of which the best k stay. A task keeps the
best of all its blocks; the best of the tasks meet by item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F

from lucerna.llm import common, vec
from lucerna.llm.decontaminate import _expand, words

TOP = 10
#: Bytes of text of a block of documents, and of a block of items.
BLOCK_BYTES = 4 << 20
ITEM_BYTES = 256 << 10
#: Blocks of items that are broadcast; more are met by a plan that broadcasts nothing.
BROADCAST_BLOCKS = 128
#: Bytes of a Parquet row group of blocks, which a writer and a reader hold as a whole.
GROUP_BYTES = 16 << 20
#: Rows after which a writer first looks at its size; by default a hundred, which are half a gigabyte of blocks.
CHECK_ROWS = 1

_PARTS = ("ids", "sizes", "terms", "first", "member", "times")
BLOCKS = "task int, block long, rows long, words long, " + ", ".join(f"{p} binary" for p in _PARTS)
_TYPES = dict(zip(_PARTS, (np.int64, np.int64, np.uint64, np.int64, np.int32, np.int32)))
#: Stands for a null id; it comes last among equal scores.
NO_ID = np.iinfo(np.int64).max


def _block(ids: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """The rows that have a term, as a block: of each term, by hash, its members and how often each holds it."""
    live = np.flatnonzero(np.diff(first))
    sizes = np.diff(first)[live]
    terms, term = np.unique(hashes, return_inverse=True)
    key = term * np.int64(len(live)) + np.repeat(np.arange(len(live)), sizes)
    key, times = np.unique(key, return_counts=True)
    term, member = key // len(live), key % len(live)
    return {"ids": ids[live], "sizes": sizes, "terms": terms, "first": np.searchsorted(term, np.arange(len(terms) + 1)), "member": member, "times": times}


def blocks(rows: DataFrame, name: str, limit: int) -> DataFrame:
    """Stored blocks of rows of (id, text), each of at most `limit` bytes of text or of one row."""

    def run(batches):
        task, at = TaskContext.get().partitionId(), 0
        for part, data, offsets in vec.text_slices(batches, "text", limit):
            hashes, first = words(data, offsets)
            if not len(hashes):
                continue
            ids = part.column("id")
            block = _block(np.asarray(ids.fill_null(NO_ID), np.int64), hashes, first)
            values = [[task], [at], [len(block["ids"])], [len(hashes)], *([block[p].astype(_TYPES[p]).tobytes()] for p in _PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * len(_PARTS)))], names=["task", "block", "rows", "words", *_PARTS])
            at += 1

    made = rows.mapInArrow(run, BLOCKS)
    path = common.scratch(rows.sparkSession, name)
    _sized(made.write).parquet(path)
    out = rows.sparkSession.read.schema(made.schema).parquet(path)
    out.scratch_path = path
    return out


def _sized(writer: DataFrameWriter) -> DataFrameWriter:
    """Row groups of about GROUP_BYTES, however large the rows are."""
    return writer.options(**{"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": CHECK_ROWS, "parquet.page.size.row.check.max": CHECK_ROWS})


def _matrix(batch: pa.RecordBatch, row: int, mark: str) -> dict[str, np.ndarray]:
    return {p: np.frombuffer(batch.column(mark + p)[row].as_buffer(), _TYPES[p]) for p in _PARTS}


def _pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every block of documents with every block of items."""
    left = docs.select(*(F.col(c).alias(f"d_{c}") for c in _PARTS))
    right = items.select(*(F.col(c).alias(c if c in ("task", "block") else f"i_{c}") for c in items.columns if c not in ("rows", "words")))
    return left.crossJoin(common.small(right, BROADCAST_BLOCKS))


def _shared(docs: dict, items: dict) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the items' terms that the documents hold, and the documents' rows of the same terms."""
    at = np.searchsorted(docs["terms"], items["terms"])
    same = np.flatnonzero(at < len(docs["terms"]))
    same = same[docs["terms"][at[same]] == items["terms"][same]]
    return same, at[same]


def _frequencies(batches):
    """Of each term of the items (by block and row), the documents of all blocks of the task that hold it."""
    found: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            docs, items = _matrix(batch, k, "d_"), _matrix(batch, k, "i_")
            own = found.setdefault((batch.column("task")[k].as_py(), batch.column("block")[k].as_py()), np.zeros(len(items["terms"]), np.int64))
            mine, theirs = _shared(docs, items)
            own[mine] += docs["first"][theirs + 1] - docs["first"][theirs]
    for (task, block), n in found.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), task, np.int32)), pa.array(np.full(len(at), block)), pa.array(at), pa.array(n[at])], names=["task", "block", "at", "n"])


class _Best:
    """The best k of each item of a block of items, over the blocks of documents met so far."""

    def __init__(self, items: dict, weight: np.ndarray, once: bool) -> None:
        self.ids, self.weight = items["ids"], weight
        order = np.argsort(items["member"], kind="stable")
        self.term = np.repeat(np.arange(len(items["terms"])), np.diff(items["first"]))[order]
        self.asked = np.ones(len(order), np.int64) if once else items["times"][order].astype(np.int64)
        self.first = np.searchsorted(items["member"][order], np.arange(len(self.ids) + 1))
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(self.ids)

    def merge(self, docs: dict, items: dict, n_docs: int, n_words: int, k: int) -> None:
        mine, theirs = _shared(docs, items)
        length = 100 - 90 + (90 * docs["sizes"] * n_docs) // n_words
        width = docs["first"][theirs + 1] - docs["first"][theirs]
        entry = _expand(docs["first"][theirs], width)
        member, tf = docs["member"][entry], docs["times"][entry].astype(np.int64)
        impact = np.repeat(self.weight[mine], width) * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[member]))
        at = np.concatenate([[0], np.cumsum(width)])
        row = np.full(len(items["terms"]), -1)
        row[mine] = np.arange(len(mine))
        term_row = row[self.term]
        for item in range(len(self.ids)):
            own = slice(self.first[item], self.first[item + 1])
            scores = np.zeros(len(docs["ids"]), np.int64)
            for r, times in zip(term_row[own].tolist(), self.asked[own].tolist()):
                if r >= 0:
                    span = slice(at[r], at[r + 1])
                    scores[member[span]] += impact[span] * times if times > 1 else impact[span]
            best, ids = self.found[item]
            hit = np.flatnonzero(scores >= max(1, best[-1] if len(best) == k else 1))
            if not len(hit):
                continue
            if len(hit) > k:
                cut = np.partition(scores[hit], len(hit) - k)[len(hit) - k]
                hit = hit[scores[hit] >= cut]
            best, ids = np.concatenate([best, scores[hit]]), np.concatenate([ids, docs["ids"][hit]])
            order = np.lexsort((ids, -best))[:k]
            self.found[item] = best[order], ids[order]


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, once: bool = True, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The `k` best documents of each item: item_id, rank, doc_id, score (over 0; all, if fewer).

    Ids are integers. With `once` a term counts once in an item, else as often
    as it occurs there. Whole texts of any length are read; null ones and ones
    without a term match nothing. Equal scores go by ascending doc_id, a null id
    last; repeated documents rank each for itself. Items equal in id and text
    count once, items of one id with other texts are ranked each for itself.
    Extra and clashing columns don't matter; no documents or no items give an
    empty result.

    Terms are known by a 64-bit hash. Pass 1 writes the blocks of documents,
    pass 2 counts the documents of each item term, pass 3 multiplies. What is
    broadcast is BROADCAST_BLOCKS blocks of items at most; a task holds a pair
    of blocks and k rows an item.
    """
    spark = docs.sparkSession
    number = lambda df, i, t: common.named(df, id=i, text=t).withColumn("id", F.col("id").cast("long"))
    right = blocks(number(docs, id_col, text_col), "documents-by-term", BLOCK_BYTES)
    asked = number(items, item_id, item_text)
    size = asked.agg(F.sum(common.bytes_of("text"))).first()[0] or 0
    # not more tasks than blocks, else each task would make a small block of its own
    left = blocks(asked.dropDuplicates(["id", "text"]).coalesce(1 + size // ITEM_BYTES), "items-by-term", ITEM_BYTES)
    shape = "item_id long, rank int, doc_id long, score long"
    sums = right.agg(F.sum("rows"), F.sum("words")).first()
    if not sums[0]:
        return spark.createDataFrame([], shape)
    n_docs, n_words = int(sums[0]), int(sums[1])
    pairs = _pairs(right, left)
    counts = pairs.mapInArrow(_frequencies, "task int, block long, at long, n long").groupBy("task", "block", "at").agg(F.sum("n").alias("n"))
    weight = F.floor(F.log((F.lit(2.0 * n_docs) + 2.0) / (F.lit(2.0) * F.col("n") + 1.0)) * 1000.0).cast("long")
    weights = counts.groupBy("task", "block").agg(F.collect_list(F.struct("at", weight.alias("w"))).alias("weights"))
    weighted = common.stored(left.join(weights, ["task", "block"]), "weighted-items")

    def multiply(batches):
        best: dict[tuple[int, int], _Best] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                one, two = _matrix(batch, r, "d_"), _matrix(batch, r, "i_")
                key = batch.column("task")[r].as_py(), batch.column("block")[r].as_py()
                if key not in best:
                    given = batch.column("i_weights")[r].values
                    weight = np.zeros(len(two["terms"]), np.int64)
                    weight[np.asarray(given.field("at"))] = np.asarray(given.field("w"))
                    best[key] = _Best(two, weight, once)
                best[key].merge(one, two, n_docs, n_words, k)
        for (task, block), b in best.items():
            width = [len(s) for s, _ in b.found]
            item = np.repeat(np.arange(len(b.ids)), width)
            if len(item):
                score, ids = (np.concatenate([f[x] for f in b.found]) for x in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), task, np.int32)), pa.array(np.full(len(item), block)), pa.array(item), pa.array(b.ids[item], mask=b.ids[item] == NO_ID), pa.array(ids, mask=ids == NO_ID), pa.array(score)], names=["task", "block", "item", "item_id", "doc_id", "score"])

    found = _pairs(right, weighted).mapInArrow(multiply, "task int, block long, item long, item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("task", "block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
