"""BPE encoding and decoding (operator 8) and token counts (operator 10)."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm import automaton, bpe, common, vec

#: Entries of the broadcast table of frequent pre-tokens; 12 bytes each, so under 1 MB whatever the corpus.
FREQUENT = 32_768
#: Entries of each task's summary from which that table is chosen.
SUMMARY = FREQUENT
#: Distinct pre-tokens a task counts before it keeps only the most frequent.
COUNTED = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _decimals(size: int):
    """Every id as decimal digits and a comma, end to end; starts and widths."""
    text = [f"{i}," for i in range(size)]
    width = np.fromiter(map(len, text), np.int64, size)
    return np.frombuffer("".join(text).encode(), np.uint8), np.cumsum(width) - width, width


def digest(values: memoryview | bytes) -> str:
    return hashlib.sha256(values).hexdigest()


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Encodes whole texts with the merge automaton and decodes the ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by
    commas), decoded_sha256 (of the decoded text in UTF-8); with `texts` also
    `ids` (array of int) and `decoded`. A null text counts as empty: 0 tokens
    and the digests of nothing. Rows with equal or null ids stay apart; other
    columns are ignored. Special strings in a text are one id each.
    A text may be of any length; an empty table gives an empty result.
    """
    path = path or default_path()
    if not bpe.splits_by_pretoken(path):
        raise ValueError("the automaton needs byte-level BPE without a normalizer")
    rows = common.named(docs, doc_id=id_col, text=text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder, machine = automaton.automaton_encoder(path), automaton.compiled(path)
        digits, d_at, d_width = _decimals(len(machine.width))
        for part, data, offsets in vec.text_slices(batches):
            ids, first = encoder.encode(data, offsets)
            decoded, at = machine.decode(ids, first)
            width = d_width[ids]
            joined = memoryview(bpe.ragged(digits, d_at[ids], width))
            cut = np.concatenate([[0], np.cumsum(width)])[first].tolist()
            decoded_rows = memoryview(decoded)
            shown = [digest(joined[a : max(a, b - 1)]) for a, b in zip(cut[:-1], cut[1:])]
            raw = [decoded_rows[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            raw = [r if valid else bytes(r).decode("utf-8", "replace").encode() for r, valid in zip(raw, _valid(decoded, at))]
            columns = [part.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(shown), pa.array([digest(r) for r in raw])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if texts:
                columns += [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())), pa.array([bytes(r).decode() for r in raw])]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts
    return rows.mapInArrow(run, schema)


def _valid(data: np.ndarray, at: np.ndarray) -> list[bool]:
    """Whether each row's bytes are UTF-8: one check for the batch, row by row only if it fails."""
    try:
        data.tobytes().decode()
        return [True] * (len(at) - 1)
    except UnicodeDecodeError:
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            try:
                data[a:b].tobytes().decode()
                out.append(True)
            except UnicodeDecodeError:
                out.append(False)
        return out


def _heavy(batches):
    """A task's most frequent pre-tokens with their counts; memory is bounded by COUNTED."""
    seen = vec.Vocabulary(COUNTED)
    words: list[str] = []
    counts = np.zeros(0, np.int64)

    def best(n: int) -> np.ndarray:
        return np.argsort(-counts, kind="stable")[:n]

    for _, data, offsets in vec.text_slices(batches):
        if seen.full():
            top = best(COUNTED // 8)
            words, counts = [words[i] for i in top.tolist()], counts[top]
            seen.clear()
            raw = [w.encode() for w in words]
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            seen.ids(vec.span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, np.cumsum(size)))
            order = seen.table.find(vec.span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, np.cumsum(size)))
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            words, counts = [words[i] for i in back.tolist()], counts[back]
        starts, ends, _ = vec.pretoken_spans(data, offsets)
        index, new = seen.ids(vec.span_hashes(data, starts, ends))
        words += vec.strings(data, starts[new], ends[new])
        counts = np.concatenate([counts, np.zeros(len(new), np.int64)]) + np.bincount(index, minlength=seen.size)
    top = best(SUMMARY)
    yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in top.tolist()], pa.string()), pa.array(counts[top], pa.int64())], ["word", "n"])


def frequent_lengths(docs: DataFrame, path: str, size: int = FREQUENT):
    """(sorted hashes, token counts) of the corpus's frequent pre-tokens, at most `size`.

    Each task reads its rows once and passes on a summary of at most SUMMARY
    pre-tokens; the occurrences themselves are never shuffled.
    """
    summary = docs.mapInArrow(_heavy, "word string, n long")
    counts = common.stored(summary.groupBy("word").agg(F.sum("n").alias("n")), "frequent")
    words = sorted(r.word for r in common.most_frequent(counts, size, "word").select("word").collect())
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    raw = [w.encode() for w in words]
    width = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(width)
    hashes = vec.span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - width, ends)
    lengths = np.fromiter(map(len, bpe.library_words(path)(words)), np.int32, len(words))
    hashes, at = np.unique(hashes, return_index=True)
    return hashes, lengths[at]


@functools.cache
def _counter(path: str) -> bpe.PretokenEncoder:
    return bpe.PretokenEncoder(bpe.library_words(path), bpe.added_tokens(path))


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Frequent pre-tokens are looked up in a broadcast table of their lengths;
    others are encoded once by the worker and kept in its cache. Files that
    cannot be counted by pre-token (.model, or a .json with a normalizer) are
    encoded text by text. A null text has 0 bytes and 0 tokens. Equal and null
    ids stay apart; other columns are ignored.
    A text may be of any length; an empty table gives an empty result.
    """
    path = path or default_path()
    rows = common.named(docs, doc_id=id_col, text=text_col)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def result(part, offsets, counts):
        counts = np.asarray(counts, np.int64)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    if not bpe.splits_by_pretoken(path):

        def whole(batches):
            count = _whole_counter(path)
            for part, _, offsets in vec.text_slices(batches):
                yield result(part, offsets, count(vec.text_array(part.column("text")).to_pylist()))

        return rows.mapInArrow(whole, schema)

    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(rows.select("text"), path))

    def run(batches):
        hashes, lengths = shared.value
        front = vec.HashTable(17)
        front.add(hashes, lengths)
        encoder = _counter(path)
        for part, data, offsets in vec.text_slices(batches):
            starts, ends, first, h = encoder.spans(data, offsets)
            n = front.find(h)
            miss = np.flatnonzero(n < 0)
            if miss.size:
                index = encoder.encode_spans(data, starts[miss], ends[miss], h[miss])
                n[miss] = encoder.length[index]
            yield result(part, offsets, vec.row_sums(n, first))

    return rows.mapInArrow(run, schema)


def _whole_counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    words = bpe.library_words(path)
    return lambda texts: [len(x) for x in words(texts)]


def op8_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
