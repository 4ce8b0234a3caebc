"""Periodic runs of words in documents (operator 13).

The words of a slice of texts become integers by sorting them (no hash), and
`lyndon.runs` finds the runs of each document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm import common, lyndon, vec

#: Least words, and least periods, of a run.
LEAST, EXPONENT = 24, 3
#: Words of up to so many bytes are compared eight bytes at once, longer ones as byte strings.
LANES = 4

RUN = "start long, length long, period long"
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def ranks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """An integer for each word, the same for the same bytes only: its place among the distinct words, by length class, then bytes."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out, base = np.zeros(len(starts), np.int64), 0
    todo, known = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for lane in range(LANES):
        if not len(todo):
            return out
        value = np.zeros(len(todo), np.uint64)
        for k in range(8):
            at = 8 * lane + k
            here = np.where(size[todo] > at, padded[np.minimum(starts[todo] + at, len(data))], 0)
            value = (value << np.uint64(8)) | here.astype(np.uint64)
        # the length tells a padding from bytes of zero
        fits = np.where(size[todo] <= 8 * lane + 8, size[todo], 8 * lane + 9)
        order = np.lexsort((fits, value, known))
        new = np.ones(len(todo), bool)
        new[1:] = (value[order][1:] != value[order][:-1]) | (known[order][1:] != known[order][:-1]) | (fits[order][1:] != fits[order][:-1])
        known = np.empty(len(todo), np.int64)
        known[order] = np.cumsum(new) - 1
        done = size[todo] <= 8 * lane + 8
        out[todo[done]] = base + known[done]
        base += len(todo)
        todo, known = todo[~done], known[~done]
    raw = data.tobytes()
    long_words = [raw[a:b] for a, b in zip(starts[todo].tolist(), ends[todo].tolist())]
    last = None
    for k in sorted(range(len(todo)), key=long_words.__getitem__):
        if long_words[k] != last:
            base, last = base + 1, long_words[k]
        out[todo[k]] = base
    return out


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at each of a document's n places: in a tenth of the ids, some stretch repeats to the end. A null id has none."""
    place = np.arange(n)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        place[a:] = a + (place[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return place


def in_order(doc_id: int | None, n: int) -> np.ndarray:
    return np.arange(n)


def _dropped(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for start, length, period in found:
        out[start + period : start + length] = True
    return out


def _documents(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, places: Callable[[int | None, int], np.ndarray], least: int, exponent: int):
    """Of each row of a slice: its id, its runs, and its text without the words that repeat a run's first period, joined by one space."""
    starts, ends, first = vec.word_spans(data, offsets)
    symbol = ranks(data, starts, ends) if len(starts) else np.zeros(0, np.int64)
    # all texts with one blank for each gap: its words' bytes, and the byte before each word but the first
    kept = np.zeros(len(data) + 1, np.int64)
    kept[starts] += 1
    np.add.at(kept, ends, -1)
    kept = np.cumsum(kept[:-1]).astype(bool)
    inner = np.ones(len(starts), bool)
    inner[first[:-1][first[:-1] < first[1:]]] = False
    joined = data.copy()
    gap = starts[inner] - 1
    kept[gap], joined[gap] = True, 32
    at = np.concatenate([[0], np.cumsum(kept)])
    joined = joined[kept].tobytes()
    raw = data.tobytes()
    for row, doc_id in enumerate(part.column("doc_id").to_pylist()):
        lo, hi = int(first[row]), int(first[row + 1])
        place = places(doc_id, hi - lo)
        found = lyndon.runs(symbol[lo:hi][place].tolist(), least, exponent)
        if not found and place is not None and (hi == lo or place[-1] == hi - lo - 1):
            yield doc_id, found, joined[at[offsets[row]] : at[offsets[row + 1]]]
            continue
        left = lo + place[~_dropped(found, hi - lo)]
        yield doc_id, found, b" ".join(raw[a:b] for a, b in zip(starts[left].tolist(), ends[left].tolist()))


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of every whole text: doc_id, runs (array of struct<start, length, period>, in words, by start and period), collapsed.

    A run is a longest stretch of at least `least` words and `exponent` (2 or
    more) times its smallest period. `collapsed` is the text without the words
    of a run after its first period, joined by one space. A null text and one
    without words have no runs and an empty `collapsed`. Ids, of any kind, may
    be null or repeat; there is a row for each row. Extra and clashing columns
    don't matter, texts and words may be of any length, and an empty table gives
    an empty result. Time is linear in the words, but for sorting them.
    """
    rows = common.named(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part, data, offsets in vec.text_slices(batches):
            done = list(_documents(part, data, offsets, in_order, least, exponent))
            lists = [[dict(zip(("start", "length", "period"), r)) for r in found] for _, found, _ in done]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lists, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), pa.array([t.decode() for _, _, t in done], pa.string())], names=["doc_id", "runs", "collapsed"])

    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<{RUN.replace(' long', ': long')}>>, collapsed string")


def collapse(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns; a text with runs becomes its collapsed form, others stay as they are, null ones too."""
    common.bounded(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"), F.lit(None).cast("long").alias("doc_id"))

    def run(batches):
        for part, data, offsets in vec.text_slices(batches):
            done = [t.decode() if found else None for _, found, t in _documents(part, data, offsets, in_order, least, exponent)]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(done, pa.string())], names=["row", "collapsed"])

    done = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, collapsed string")
    return done.select(*(F.coalesce("collapsed", F.col(f"row.`{c}`")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def _digest(doc_id: int | None, found: list[tuple[int, int, int]], text: bytes) -> tuple:
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the runs of all documents, in a tenth of which a stretch is made to repeat first (`planted`)."""
    rows = common.named(common.table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")

    def run(batches):
        for part, data, offsets in vec.text_slices(batches):
            done = [_digest(*d) for d in _documents(part, data, offsets, planted, LEAST, EXPONENT)]
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=[c.split()[0] for c in DIGEST.split(", ")])

    return rows.mapInArrow(run, DIGEST)
