"""Language-model scores of whole documents (operator 7)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm import common, recurrent, vec

#: Words with a place of their own in the recurrent model, and classes of its output.
WORDS, CLASSES = 1024, 24
#: Words whose counts are broadcast (12 bytes each); counts of rarer ones are joined.
TABLE = 1 << 18
#: Distinct words a task counts before it passes them on.
COUNTED = 600_000
#: A document is learned from in one of these rounds, by its place of 16; models are averaged after each.
ROUNDS = ((0, 1), (1, 5), (5, 16))
RATES = (0.02, 0.012, 0.006)
SEED = 11
#: Models merged at once; the driver gets at most this many.
FAN_IN = 64
_END_WORD = np.uint64(0xE0D0E0D0E0D0E0D1)  # stands for the end in counts; 64-bit hashes of words differ from it


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 10, is 0 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _hashes(data, offsets):
    lowered = vec.lower_ascii(data)
    starts, ends, first = vec.word_spans(lowered, offsets)
    return (vec.span_hashes(lowered, starts, ends) if len(starts) else np.zeros(0, np.uint64)), first


def _counted(batches):
    seen, counts, keys, ends = vec.Vocabulary(COUNTED), np.zeros(0, np.int64), [], 0

    def flush():
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(counts)], ["word", "n"])

    for part, data, offsets in vec.text_slices(batches):
        if seen.full():
            yield from flush()
            seen.clear()
            counts, keys = np.zeros(0, np.int64), []
        h, _ = _hashes(data, offsets)
        ends += part.num_rows
        index, new = seen.ids(h)
        keys.append(h[new])
        counts = np.concatenate([counts, np.zeros(len(new), np.int64)]) + np.bincount(index, minlength=seen.size)
    yield from flush()
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array(np.array([_END_WORD]).view(np.int64)), pa.array([ends], pa.int64())], ["word", "n"])


def word_counts(rows: DataFrame) -> DataFrame:
    """(word hash, n) over the training texts, the end included; tasks add up first."""
    return common.stored(rows.where("NOT held_out").select("text").mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


class Tables:
    """What tasks need of the counts: the commonest words with their counts, and the output's shape."""

    def __init__(self, counts: DataFrame) -> None:
        total = counts.agg(F.sum("n"), F.count("*")).first()
        self.tokens, self.distinct = int(total[0] or 0), int(total[1])
        end = np.array([_END_WORD]).view(np.int64)[0].item()
        ends = counts.where(F.col("word") == end).first()
        self.ends = int(ends.n) if ends else 0
        top = common.most_frequent(counts.where(F.col("word") != end), TABLE, "word").toPandas().sort_values(["n", "word"], ascending=[False, True])
        self.hash = top["word"].to_numpy(np.int64).view(np.uint64)
        self.n = top["n"].to_numpy(np.int64)
        self.words = min(WORDS, len(self.hash))
        common_n = self.n[: self.words]
        self.rare_tokens = self.tokens - self.ends - int(common_n.sum())
        self.rare_words = self.distinct - (1 if self.ends else 0) - self.words
        self.shape = recurrent.Shape(common_n.astype(np.float64), self.rare_tokens, self.ends, CLASSES)

    def find(self) -> vec.HashTable:
        table = vec.HashTable()
        table.add(self.hash, np.arange(len(self.hash)))
        return table


def _encode(shared):
    """Documents as ids of the model, with the parts of their sums over broadcast words and the hashes of the others."""

    def run(batches):
        t = shared.value
        table = t.find()
        log_n = np.log10(t.n + 0.1) if len(t.n) else np.zeros(0)
        rare = t.shape.size
        for part, data, offsets in vec.text_slices(batches):
            h, first = _hashes(data, offsets)
            found = table.find(h)
            known = found >= 0
            logs = np.where(known, log_n[np.maximum(found, 0)] if len(log_n) else 0.0, 0.0)
            outside = known & (found >= rare)
            ids = np.where(known & ~outside, found, rare).astype(np.int32)
            n = part.num_rows
            first_with_end = first + np.arange(n + 1)
            full = np.full(len(ids) + n, rare + 1, np.int32)
            mask = np.ones(len(full), bool)
            mask[first_with_end[1:] - 1] = False
            full[mask] = ids
            raw = full.astype("<u2").tobytes()
            cut = (first_with_end * 2).tolist()
            unknown = np.flatnonzero(~known)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(unknown, first), pa.int32()), pa.array(h[unknown].view(np.int64)))
            columns = [part.column("doc_id"), part.column("held_out"), pa.array(np.diff(first_with_end)), pa.array(vec.row_sums(known.astype(np.int64), first) + (t.ends > 0)), pa.array(_float_sums(logs, first) + math.log10(t.ends + 0.1)), pa.array(_float_sums(np.where(outside, logs, 0.0), first)), pa.array(vec.row_sums((ids == rare).astype(np.int64), first)), pa.array([raw[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base", "outside", "n_rare", "ids", "unknown"])

    return run


def _float_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Row sums that do not depend on the other rows of the batch."""
    out = np.zeros(len(first) - 1)
    full = np.flatnonzero(np.diff(first))
    if full.size:
        out[full] = np.add.reduceat(values, first[:-1][full])
    return out


def _id_batches(batches):
    for batch in batches:
        for part in vec.slices(batch, "ids", 8 << 20):
            values = part.column("ids").to_pylist()
            sizes = np.fromiter((len(v) // 2 for v in values), np.int64, len(values))
            yield part, np.frombuffer(b"".join(values), "<u2").astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])


def _train(shared, weights, rate):
    def run(batches):
        trainer = None
        for _, ids, first in _id_batches(batches):
            if len(ids):
                trainer = trainer or recurrent.Trainer(shared.value.shape, weights.value, rate)
                trainer.learn(ids, first, 256)
        if trainer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([float(trainer.seen)]), pa.array([recurrent.packed(trainer.w).astype("<f4").tobytes()], pa.binary())], ["tokens", "model"])

    return run


def _merge(group: pa.Table) -> pa.Table:
    weight, total = 0.0, 0.0
    for tokens, model in zip(group.column("tokens").to_pylist(), group.column("model").to_pylist()):
        weight, total = weight + tokens, total + tokens * np.frombuffer(model, "<f4").astype(np.float64)
    return pa.table({"tokens": [weight], "model": pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())})


def train(encoded: DataFrame, shared) -> dict[str, np.ndarray]:
    """One pass over all training documents: in each round every task learns from its share, then the models are averaged by tokens."""
    spark = encoded.sparkSession
    like = weights = shared.value.shape.first_weights(SEED)
    for (lo, hi), rate in zip(ROUNDS, RATES):
        share = encoded.where("NOT held_out").where(F.pmod(F.xxhash64("row"), F.lit(16)).between(lo, hi - 1))
        held = spark.sparkContext.broadcast(weights)
        models = common.stored(share.select("ids").mapInArrow(_train(shared, held, rate), "tokens double, model binary"), "models")
        n = models.count()
        while n > FAN_IN:  # a tree: no task and not the driver ever holds more than FAN_IN models
            groups = -(-n // FAN_IN)
            models = common.stored(models.groupBy(F.pmod(F.monotonically_increasing_id(), F.lit(groups)).alias("g")).applyInArrow(_merge, "tokens double, model binary"), "models")
            n = models.count()
        got = models.collect()
        if got:
            merged = _merge(pa.table({"tokens": [r.tokens for r in got], "model": pa.array([bytes(r.model) for r in got], pa.binary())}))
            weights = recurrent.unpacked(np.frombuffer(merged["model"][0].as_py(), "<f4"), like)
    return weights


def _score(shared, weights):
    def run(batches):
        runner = recurrent.Runner(shared.value.shape, weights.value)
        for part, ids, first in _id_batches(batches):
            columns = part.select([c for c in part.schema.names if c != "ids"])
            yield columns.append_column("nats", pa.array(runner.score(ids, first)))

    return run


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and model log10 likelihood of every whole text.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score. Tokens are words, A-Z lower-cased, and an end. A document is held
    out by its id; the others are all learned from. The model gives a class,
    then a word in it; the words without a place of their own are one class,
    in which a word has its smoothed share of that class's count. A null text
    is empty and has the end alone; a null id counts as empty text for the
    hold-out. Rows with equal ids stay apart; other columns are ignored; an
    empty table gives an empty result; with nothing to learn from, all counts
    are 0.
    """
    common.bounded(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held_out(F.col(f"`{id_col}`")).alias("held_out"))
    spark = docs.sparkSession
    id_type = rows.schema["doc_id"].dataType.simpleString()
    counts = word_counts(rows)
    shared = spark.sparkContext.broadcast(Tables(counts))
    t = shared.value
    shape = "held_out boolean, n_tokens long, n_known long, base double, outside double, n_rare long"
    encoded = rows.mapInArrow(_encode(shared), f"doc_id {id_type}, {shape}, ids binary, unknown array<long>")
    encoded = common.stored(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    weights = spark.sparkContext.broadcast(train(encoded, shared))

    # words outside the broadcast table: their counts by a join, their logs summed by row
    others = encoded.select("row", F.explode("unknown").alias("word")).groupBy("row", "word").count().withColumnRenamed("count", "times")
    joined = others.join(counts, "word", "left")
    log = F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))
    sums = joined.groupBy("row").agg(F.sum(F.col("times") * log).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"))

    scored = encoded.drop("unknown").mapInArrow(_score(shared, weights), f"doc_id {id_type}, {shape}, row long, nats double")
    full = scored.join(sums, "row", "left")
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    base = F.col("base") + more - F.col("n_tokens") * math.log10(t.tokens + 0.1 * (t.distinct + 1))
    within = F.col("outside") + more - F.col("n_rare") * math.log10(t.rare_tokens + 0.1 * (t.rare_words + 1))
    return full.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(t.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("nats") / math.log(10) + within).alias("score"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(common.table(spark, sf_dir, "documents"))
