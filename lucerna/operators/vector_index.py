"""An inverted-file index of vectors with product-quantised codes (R3 at scale).

Vectors are dealt out to lists by their nearest centroid, and a list is a
partition on disk, so that a search reads only the lists near its questions. Of
each vector it first reads a code of a few bytes, from which scores come by table
look-up; only the best of these are scored again from the vectors themselves.
`retrieve.dense_search` is the exact scan.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lucerna.operators import index as I
from lucerna.operators import lineage
from lucerna.operators import retrieve as R

#: Vectors from which centroids and codebooks are fitted, at most; by the least hashes of their ids. All vectors are indexed.
SAMPLE = 65_536
ROUNDS = 15
#: Parts of a vector that have a code of one byte each.
PARTS = 16
CODES = 256
#: Most lists.
LISTS = 65_536
#: Lists that a question looks into, at least, and its share of all lists where they are few.
PROBES, PROBE_SHARE = 16, 0.25
#: Candidates of a question that are scored exactly, for each one that is wanted, at least.
REFINE = 20
#: Vectors of the sample that ask when the index is built, the neighbours that each wants, and the share of them that
#: the lists looked into must hold, and of those that the candidates must.
ASKING, WANTED, IN_LISTS, IN_CODES = 256, 10, 0.97, 0.985
#: Scores held at once while a batch is looked up.
CELLS = 1 << 22


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center of each row; equal ones by number."""
    step = max(1, CELLS // len(centers))
    half = (centers * centers).sum(1) / 2
    return np.concatenate([(x[k : k + step] @ centers.T - half).argmax(1) for k in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def _means(x: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """k-means after Lloyd; a center that loses its rows takes the row farthest from its own center."""
    centers = x[draw.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centers)
        count = np.bincount(own, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        lost = np.flatnonzero(count == 0)
        centers[count > 0] = sums[count > 0] / count[count > 0, None]
        if len(lost):
            far = np.argsort(-((x - centers[own]) ** 2).sum(1), kind="stable")
            centers[lost] = x[far[np.arange(len(lost)) % len(far)]]
    return centers


@dataclass
class Quantiser:
    """centers (lists, d) and, of each part of the rest, books (parts, codes, d / parts)."""

    centers: np.ndarray
    books: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, lists: int, parts: int, seed: int) -> Quantiser:
        draw = np.random.default_rng(seed)
        centers = _means(x, lists, draw)
        rest = (x - centers[_nearest(x, centers)]).reshape(len(x), parts, -1)
        return Quantiser(centers, np.stack([_means(np.ascontiguousarray(rest[:, p]), CODES, draw) for p in range(parts)]))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the codes of each row."""
        own = _nearest(x, self.centers)
        rest = (x - self.centers[own]).reshape(len(x), len(self.books), -1)
        return own, np.stack([_nearest(np.ascontiguousarray(rest[:, p]), book) for p, book in enumerate(self.books)], 1).astype(np.uint8)


def _tuned(x: np.ndarray, quantiser: Quantiser, n: int) -> tuple[int, int]:
    """(probes, refine) with which vectors of the sample find their neighbours in it.

    Where vectors fall into groups a few lists do; where they lie evenly most
    lists are needed. Candidates grow with the share of the rows that are in the
    sample, as that many more codes are as near.
    """
    asking = x[:ASKING]
    scores = asking @ x.T
    wanted = np.argpartition(-scores, min(WANTED, len(x)) - 1, axis=1)[:, :WANTED]
    own, codes = quantiser.encode(x)
    order = np.argsort(-(asking @ quantiser.centers.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    probes = int(np.quantile(np.take_along_axis(place, own[wanted], 1), IN_LISTS, method="higher")) + 1
    coded = quantiser.centers[own] + np.concatenate([book[codes[:, p]] for p, book in enumerate(quantiser.books)], 1)
    near = asking @ coded.T
    theirs = np.take_along_axis(near, wanted, 1)
    better = np.array([len(x) - np.searchsorted(np.sort(row), at, side="right") for row, at in zip(near, theirs)])
    refine = math.ceil((np.quantile(better, IN_CODES, method="higher") + 1) * n / len(x) / WANTED)
    return min(len(quantiser.centers), max(PROBES, probes)), max(REFINE, refine)


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float32)
    return flat.reshape(len(column), width or -1) if len(column) else np.zeros((0, width or 1), np.float32)


@dataclass
class VectorIndex:
    quantiser: Quantiser
    rows: DataFrame
    looked: int | None = None
    refine: int = REFINE

    @staticmethod
    def build(vectors: DataFrame, folder: str, lists: int | None = None, parts: int = PARTS, seed: int = 1) -> VectorIndex:
        """Indexes all rows of (chunk_id, source_type, embedding) in a new folder.

        There is about a list for each square root of the rows. Rows are dealt
        out by (list, hash of the id), so a list of any size is split between
        tasks. How many lists a search looks into, and how many candidates it
        scores exactly, is measured on the sample (`_tuned`). A null vector is left out. `parts` must divide the vectors'
        length.
        """
        spark = vectors.sparkSession
        rows = vectors.where("embedding IS NOT NULL").select("chunk_id", "source_type", F.col("embedding").cast("array<float>").alias("embedding"))
        n = rows.count()
        if not n:
            raise ValueError("no vector to index")
        hashed = rows.withColumn("_h", F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1 << 32)))
        # a little more than the sample, so that the sort is over no more than that
        sample = hashed.where(F.col("_h") < F.lit(int(min(1.0, 1.1 * SAMPLE / n + 64 / n) * (1 << 32)))).orderBy("_h", "chunk_id").limit(SAMPLE)
        x = np.array([r.embedding for r in sample.select("embedding").toLocalIterator()], np.float32)
        lists = lists or max(1, min(LISTS, len(x) // 8, math.isqrt(n)))
        quantiser = Quantiser.fit(x, lists, parts, seed)
        looked, refine = _tuned(x, quantiser, n)
        shared = spark.sparkContext.broadcast(quantiser)
        wide = x.shape[1]

        def assign(batches):
            for batch in batches:
                own, codes = shared.value.encode(_matrix(batch.column("embedding"), wide))
                coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), coded], names=[*batch.schema.names, "list", "code"])

        kind = rows.schema["chunk_id"].dataType.simpleString()
        placed = rows.mapInArrow(assign, f"chunk_id {kind}, source_type string, embedding array<float>, list int, code binary")
        placed.repartitionByRange(F.col("list"), F.xxhash64("chunk_id")).sortWithinPartitions("list", "chunk_id").write.partitionBy("list").parquet(f"{folder}/rows")
        spark.createDataFrame([(json.dumps({"centers": quantiser.centers.tolist(), "books": quantiser.books.tolist(), "probes": looked, "refine": refine}),)], "model string").coalesce(1).write.parquet(f"{folder}/model")
        return VectorIndex.load(spark, folder)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> VectorIndex:
        model = json.loads(spark.read.parquet(f"{folder}/model").first().model)
        return VectorIndex(Quantiser(np.array(model["centers"], np.float32), np.array(model["books"], np.float32)), spark.read.parquet(f"{folder}/rows"), model.get("probes"), model.get("refine", REFINE))

    def probes(self) -> int:
        if self.looked is not None:
            return self.looked
        lists = len(self.quantiser.centers)
        return min(lists, max(PROBES, math.ceil(PROBE_SHARE * min(lists, 4 * PROBES))))

    def search(self, questions: DataFrame, k: int, source_type: str | None = None, probes: int | None = None, refine: int | None = None, digits: int | None = None) -> DataFrame:
        """The k best of each question (qid, vector) by dot product: qid, chunk_id, score, rank; ties by chunk_id.

        Questions are a stated set and asked in blocks of retrieve.QUESTIONS,
        which go with the tasks. The files of lists that no question of a block
        looks into are not read; all rows of the others are looked up. A task
        keeps refine * k candidates a question. Scores are those of the exact
        scan; a row is missed if its list is not looked into or its code is
        beaten by that many others.
        """
        asked = questions.select("qid", "vector").where("vector IS NOT NULL")
        blocks = max(1, -(-asked.count() // R.QUESTIONS))
        parts = [asked] if blocks == 1 else [asked.where(F.pmod(F.xxhash64("qid"), F.lit(2 * blocks)) == b) for b in range(2 * blocks)]
        found = [self._best(part, k, source_type, probes or self.probes(), (refine or self.refine) * k, digits) for part in parts]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def _best(self, asked: DataFrame, k: int, source_type: str | None, probes: int, most: int, digits: int | None) -> DataFrame:
        spark = asked.sparkSession
        block = asked.toArrow()
        rows = self.rows if source_type is None else self.rows.where(F.col("source_type") == source_type)
        qid, chunk = (df.schema[c].dataType.simpleString() for df, c in ((asked, "qid"), (rows, "chunk_id")))
        schema = StructType.fromDDL(f"chunk_id {chunk}, qid {qid}, list int, near double")
        if not block.num_rows:
            return spark.createDataFrame([], f"qid {qid}, chunk_id {chunk}, score double, rank int")
        q = _matrix(block.column("vector").combine_chunks(), self.quantiser.centers.shape[1])
        step = max(1, CELLS // len(self.quantiser.centers))
        near = np.concatenate([np.argpartition(-(q[a : a + step] @ self.quantiser.centers.T), probes - 1, axis=1)[:, :probes] for a in range(0, len(q), step)])
        lists, order = near.ravel(), np.argsort(near.ravel(), kind="stable")
        by_list = {int(x): order[a:b] // probes for x, a, b in zip(*_groups(lists[order]))}
        shared = spark.sparkContext.broadcast((q, block.column("qid").combine_chunks(), by_list, self.quantiser))
        arrow = to_arrow_schema(schema)
        if len(by_list) < len(self.quantiser.centers):
            rows = rows.where(F.col("list").isin(sorted(by_list)))

        def look_up(batches):
            q, qids, by_list, quantiser = shared.value
            best: dict[int, list] = {}
            for batch in batches:
                own = np.asarray(batch.column("list"))
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(own), -1)
                ids = batch.column("chunk_id")
                place = np.argsort(np.asarray(pa.compute.sort_indices(ids)), kind="stable")
                for x, a, b in zip(*_groups(own[(order := np.argsort(own, kind="stable"))])):
                    at = order[a:b]
                    for lo in range(0, len(at), 4096):
                        _scores(q, by_list.get(int(x), ()), quantiser, int(x), codes, at[lo : lo + 4096], place, ids, most, best)
            for question, (score, held, own) in best.items():
                n = len(score)
                yield pa.RecordBatch.from_arrays([held, qids.take(pa.array(np.full(n, question))), pa.array(own, pa.int32()), pa.array(score, pa.float64())], schema=arrow)

        found = rows.select("chunk_id", "list", "code").mapInArrow(look_up, schema)
        near_best = I.top_k(found.withColumnRenamed("near", "score"), most).select("qid", "chunk_id", "list")
        near_best = I.small(lineage.cut(near_best))
        exact = rows.select("chunk_id", "list", "embedding").join(near_best, ["list", "chunk_id"]).join(F.broadcast(asked), "qid")
        return I.top_k(exact.select("qid", "chunk_id", R.dot("embedding", "vector").alias("score")), k, digits=digits)


def _groups(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values and where each begins and ends."""
    new = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, np.int64)
    return sorted_values[new], new, np.r_[new[1:], len(sorted_values)]


def _scores(q, asking, quantiser: Quantiser, own: int, codes, at, place, ids, most: int, best: dict) -> None:
    """Adds a list's rows to the best of each question that looks into it: near scores, ids and lists."""
    if not len(asking):
        return
    width = q.shape[1] // len(quantiser.books)
    step = max(1, CELLS // max(len(at), CODES * len(quantiser.books)))
    for lo in range(0, len(asking), step):
        some = np.asarray(asking[lo : lo + step])
        score = np.repeat((q[some] @ quantiser.centers[own])[:, None], len(at), 1)
        for p, book in enumerate(quantiser.books):
            score += (q[some, p * width : (p + 1) * width] @ book.T)[:, codes[at, p]]
        for row, question in enumerate(some.tolist()):
            mine, keep = score[row].astype(np.float64), at
            if len(keep) > most:
                cut = np.partition(mine, len(mine) - most)[len(mine) - most]
                hit = np.flatnonzero(mine >= cut)
                # of equal ones the least ids
                hit = hit[np.lexsort((place[keep[hit]], -mine[hit]))[:most]]
                mine, keep = mine[hit], keep[hit]
            held, lists = ids.take(pa.array(keep)), np.full(len(keep), own, np.int32)
            if question in best:
                before = best[question]
                mine, lists = np.concatenate([before[0], mine]), np.concatenate([before[2], lists])
                held = pa.concat_arrays([before[1], held])
                if len(mine) > most:
                    rank = np.argsort(np.asarray(pa.compute.sort_indices(held)), kind="stable")
                    hit = np.lexsort((rank, -mine))[:most]
                    mine, lists, held = mine[hit], lists[hit], held.take(pa.array(hit))
            best[question] = [mine, held, lists]


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(questions, wanted, found, recall): the share of the exact rows (qid, chunk_id) that were found."""
    hit = found.select("qid", "chunk_id", F.lit(1).alias("_hit"))
    rows = exact.select("qid", "chunk_id").join(hit, ["qid", "chunk_id"], "left")
    return rows.agg(F.count_distinct("qid").alias("questions"), F.count("*").alias("wanted"), F.count("_hit").alias("found"), (F.count("_hit") / F.count("*")).alias("recall"))
