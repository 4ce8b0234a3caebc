"""Benchmark decontamination by BM25 with block-max WAND (operator 2).

The test items are the indexed side and every passage of every document is a
query. How many items hold a term, and their mean length, are counted over all
items, and the passages an item is sought in depend on the item's own length, so
scores do not depend on how the items are cut into indexes. Scores are BM25 divided by the item's score for its own text, so one
threshold suits items of all lengths. For a passage, blocks of items are
bounded by the sum of its terms' block maxima; terms that are too common to
matter alone (`tail`: their joint best over any item stays below the
threshold) are not followed, only their joint block maximum is added. A block
whose bound is under the threshold is skipped; the items of the others are
scored in full. That is WAND's pivot test made for all blocks and many passages
at once, with array operations in place of a cursor for each list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lucerna.llm import common, vec

K1, B = 1.2, 0.75
#: Least share of an item's own score, and least shares of the shingles of its question and of its answer.
THRESHOLD, OVERLAP = 0.5, 0.8
SHINGLE = 5
BLOCK = 8
#: Bytes of items in one broadcast index, and indexes that are asked in one scan of the documents; more items make more scans.
SEGMENT_BYTES = 16 << 20
AT_ONCE = 8
#: Least words of an item's class, and how much longer the items of the next class may be.
LEAST_REACH, STEP = 16, 4
#: Cells (passages x blocks) accumulated at once.
CELLS = 1 << 20

_IS_GAP = np.ones(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _IS_GAP[_lo:_hi] = False


def words(data: np.ndarray, offsets: np.ndarray):
    """Hashes of the words (runs of ASCII letters and digits and of other bytes from 128 on, A-Z lower-cased) and each row's first."""
    lowered = vec.lower_ascii(data)
    starts, ends, first = vec.word_spans(lowered, offsets, _IS_GAP)
    return (vec.span_hashes(lowered, starts, ends) if len(starts) else np.zeros(0, np.uint64)), first


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence or line is the answer, all before it the question; a single one is a question."""
    text = text.strip()
    cuts = [m.end() for m in re.finditer(r"[.?!]\s+|\n+", text)]
    return (text[: cuts[-1]], text[cuts[-1] :]) if cuts else (text, "")


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words, by its first word."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    factor = 1
    for k in range(size):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        out += vec.mix(h[k : len(h) - size + 1 + k] + np.uint64(k)) * np.uint64(factor)
    return out


def reach_of(n: int) -> int:
    """The length class of an item of n words: the words of the longest items of its class, which are half a passage."""
    reach = LEAST_REACH
    while reach < n:
        reach *= STEP
    return reach


class Index:
    """Items of one length class with the statistics of all items: how many hold each term (`df`, hashes to counts), how many there are, their mean length.

    Without them, the statistics are those of the given items.
    """

    def __init__(self, items: list[tuple[int, str]], df: tuple[np.ndarray, np.ndarray] | None = None, n_items: int = 0, mean: float = 0.0) -> None:
        parts = [split_item(t) for _, t in items]
        hashes = [[words(*vec.buffers(pa.array([x])))[0] for x in p] for p in parts]
        kept = [i for i, (q, a) in enumerate(hashes) if len(q) + len(a)]
        self.ids = [items[i][0] for i in kept]
        self.shingles = []  # of each item: (size, distinct shingles) of question and answer
        for i in kept:
            self.shingles.append([(n, np.unique(_grams(h, n))) for h in hashes[i] if (n := min(SHINGLE, len(h)))])
        full = [np.concatenate(hashes[i]) for i in kept]
        sizes = np.array([len(h) for h in full], np.int64)
        self.reach = reach_of(int(sizes.max())) if len(sizes) else 0
        if not kept:
            return
        item = np.repeat(np.arange(len(full)), sizes)
        self.terms, term = np.unique(np.concatenate(full), return_inverse=True)
        key, tf = np.unique(term * np.int64(len(full)) + item, return_counts=True)
        term, item = key // len(full), key % len(full)
        own = np.bincount(term, minlength=len(self.terms))
        held = own if df is None else df[1][np.searchsorted(df[0], self.terms)]
        n_items, mean = (len(full), sizes.mean()) if df is None else (n_items, mean)
        idf = np.log(1 + (n_items - held + 0.5) / (held + 0.5))
        score = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / mean))
        score /= np.bincount(item, score)[item]
        # postings by term: (item, impact), and by term and block: largest impact
        self.post_at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.post_item, self.post_score = item.astype(np.int32), score.astype(np.float32)
        self.blocks = (len(full) + BLOCK - 1) // BLOCK
        bkey = term * np.int64(self.blocks) + item // BLOCK
        new = np.flatnonzero(np.r_[True, bkey[1:] != bkey[:-1]])
        self.block_of, self.block_max = (bkey[new] % self.blocks).astype(np.int32), np.maximum.reduceat(score, new).astype(np.float32)
        self.block_at = np.searchsorted(bkey[new] // self.blocks, np.arange(len(self.terms) + 1))
        # the tail: commonest terms while their joint best for an item stays under half the threshold
        joint, self.tail = np.zeros(len(full)), np.zeros(len(self.terms), bool)
        for t in np.argsort(-own, kind="stable").tolist():
            its = slice(self.post_at[t], self.post_at[t + 1])
            grown = joint.copy()
            grown[item[its]] += score[its]
            if grown.max() >= THRESHOLD / 2:
                break
            joint, self.tail[t] = grown, True
        self.tail_max = np.maximum.reduceat(joint, np.arange(0, len(full), BLOCK)).astype(np.float32)
        self.tail_best = float(joint.max())

    def search(self, term: np.ndarray, first: np.ndarray, threshold: float):
        """(query, item, score) of all pairs at or above the threshold; `term` holds the distinct terms of each query."""
        n = len(first) - 1
        step = max(1, CELLS // self.blocks)
        out = []
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            t = term[first[lo] : first[hi]]
            q = vec.rows_of(first[lo : hi + 1])
            lead = ~self.tail[t]
            tl, ql = t[lead], q[lead]
            width = self.block_at[tl + 1] - self.block_at[tl]
            at = _expand(self.block_at[tl], width)
            cell = np.repeat(ql, width) * self.blocks + self.block_of[at]
            bound = np.bincount(cell, self.block_max[at], minlength=(hi - lo) * self.blocks).reshape(hi - lo, self.blocks)
            open_q, open_b = np.nonzero((bound > 0) & (bound + self.tail_max >= threshold - 1e-5))
            if not len(open_q):
                continue
            # score the open blocks in full: postings of their queries' terms that fall in them
            live = np.unique(open_q)
            slot = np.full(hi - lo, -1)
            slot[live] = np.arange(len(live))
            is_open = np.zeros((len(live), self.blocks), bool)
            is_open[slot[open_q], open_b] = True
            mine = slot[q] >= 0
            tm, qm = t[mine], slot[q[mine]]
            for a in range(0, len(live), max(1, step // BLOCK)):
                b = min(len(live), a + max(1, step // BLOCK))
                part = slice(*np.searchsorted(qm, [a, b]))
                width = self.post_at[tm[part] + 1] - self.post_at[tm[part]]
                at = _expand(self.post_at[tm[part]], width)
                qq, ii = np.repeat(qm[part], width), self.post_item[at]
                use = is_open[qq, ii // BLOCK]
                cell = (qq[use] - a).astype(np.int64) * len(self.ids) + ii[use]
                score = np.bincount(cell, self.post_score[at[use]], minlength=(b - a) * len(self.ids))
                hit = np.flatnonzero(score >= threshold)
                out.append((lo + live[a + hit // len(self.ids)], hit % len(self.ids), score[hit]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def overlaps(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        """Shares of the item's question and answer shingles that the passage's words hold; an empty part is held."""
        held = [1.0, 1.0]
        for k, (size, shingles) in enumerate(self.shingles[item]):
            held[k] = float(np.isin(shingles, _grams(passage, size)).mean())
        return held[0], held[1]


def _expand(starts: np.ndarray, width: np.ndarray) -> np.ndarray:
    ends = np.cumsum(width)
    return np.repeat(starts - (ends - width), width) + np.arange(int(ends[-1]) if len(ends) else 0)


_COUNTED = "uid long, n int, reach int, terms array<bigint>"


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes of the items, each of one length class and over at most SEGMENT_BYTES of them or one item.

    Spark counts terms and lengths over all items; the driver reads the items
    once, by class, id and text, and holds one index's at a time.
    """
    rows = common.named(items, i=id_col, t=text_col).where("t IS NOT NULL")

    def count(batches):
        at = TaskContext.get().partitionId() << 33
        for part, data, offsets in vec.text_slices(batches, "t"):
            h, first = words(data, offsets)
            n = np.diff(first)
            terms, own = vec.unique_by_row(h, first) if len(h) else (np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(terms.view(np.int64)))
            reach = pa.array([reach_of(x) for x in n.tolist()], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("i"), part.column("t"), pa.array(at + np.arange(len(n))), pa.array(n, pa.int32()), reach, lists], names=["i", "t", "uid", "n", "reach", "terms"])
            at += len(n)

    counted = common.stored(rows.mapInArrow(count, f"i {rows.schema['i'].dataType.simpleString()}, t string, {_COUNTED}").where("n > 0"), "items")
    n_items, mean = counted.agg(F.count("*"), F.avg("n")).first()
    each = counted.select("uid", F.explode("terms").alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    held = each.join(df, "term").groupBy("uid").agg(F.collect_list(F.struct("term", "df")).alias("held"))
    # ids and texts only, and counts of the items' own terms, come to the driver
    listed = common.stored(counted.select("uid", "i", "t", "reach").join(held, "uid"), "item-terms")

    def built(batch: list) -> Index:
        pairs = np.array([(x.term, x.df) for r in batch for x in r.held], np.int64)
        terms, at = np.unique(pairs[:, 0].view(np.uint64), return_index=True)
        return Index([(r.i, r.t) for r in batch], (terms, pairs[at, 1]), n_items, mean)

    batch, size = [], 0
    for r in listed.orderBy("reach", "i", "t").toLocalIterator():
        if batch and (r.reach != batch[0].reach or size > SEGMENT_BYTES):
            yield built(batch)
            batch, size = [], 0
        batch.append(r)
        size += len(r.t.encode())
    if batch:
        yield built(batch)
    common.dropped(counted, listed)


def _groups(found: Iterator[Index]) -> Iterator[list[Index]]:
    group = []
    for index in found:
        group.append(index)
        if len(group) == AT_ONCE:
            yield group
            group = []
    if group:
        yield group


def _matches(index: Index, table: vec.HashTable, h: np.ndarray, first: np.ndarray, threshold: float, overlap: float):
    """{(row, item): (score, question overlap, answer overlap)} of the verified leaks of a batch of words."""
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    if not len(h):
        return found
    # passages: windows of twice the class' longest items, half overlapping, so any item lies whole in one
    stride = index.reach
    n_windows = np.maximum(1, -(-np.diff(first) // stride) - 1)
    row_at = np.concatenate([[0], np.cumsum(n_windows)])
    row = vec.rows_of(first)
    pos = np.arange(len(h)) - first[row]
    term = table.find(h)
    hit = term >= 0
    t, w, r = term[hit].astype(np.int64), pos[hit] // stride, row[hit]
    last = n_windows[r] - 1
    now, before = row_at[r] + np.minimum(w, last), row_at[r] + np.maximum(w - 1, 0)
    both = now != before
    both &= w <= last + 1
    key = np.unique(np.concatenate([now, before[both]]) * len(index.terms) + np.concatenate([t, t[both]]))
    query, term_q = key // len(index.terms), key % len(index.terms)
    at = np.searchsorted(query, np.arange(row_at[-1] + 1))
    q, item, score = index.search(term_q, at, threshold)
    doc = np.searchsorted(row_at, q, side="right") - 1
    for k, i, d, s in zip(q.tolist(), item.tolist(), doc.tolist(), score.tolist()):
        lo = first[d] + (k - row_at[d]) * stride
        hi = first[d + 1] if k + 1 == row_at[d + 1] else lo + 2 * stride
        a, b = index.overlaps(i, h[lo:hi])
        if a >= overlap and b >= overlap and s > found.get((d, i), (0.0,))[0]:
            found[d, i] = (s, a, b)
    return found


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that hold test items: doc_id, item_id, score, question_overlap, answer_overlap; one row per pair.

    A pair is returned if in some passage the item's normalised BM25 score
    reaches `threshold` and at least `overlap` of the 5-word shingles of both
    its question and its answer occur. A passage is a window of twice the words
    of the longest items of the item's length class, so texts may be of any
    length. Texts and items that are null or have no words match nothing; no
    items or no documents give an empty result. Equal and null ids stay apart by
    row, and repeated rows are returned each; of equal scores of a pair one
    passage counts. Other columns are ignored.
    """
    rows = common.named(docs, doc_id=id_col, text=text_col)
    kind = items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {kind}, score double, question_overlap double, answer_overlap double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    out = rows.sparkSession.createDataFrame([], schema)
    for group in _groups(indexes(items, item_id, item_text)):
        shared = [rows.sparkSession.sparkContext.broadcast(index) for index in group]

        def run(batches, shared=shared):
            asked = [(x.value, _table(x.value)) for x in shared]
            for part, data, offsets in vec.text_slices(batches):
                h, first = words(data, offsets)
                for index, table in asked:
                    found = _matches(index, table, h, first, threshold, overlap)
                    if found:
                        order = sorted(found)
                        ids = part.column("doc_id").take(pa.array([d for d, _ in order]))
                        values = [found[k] for k in order]
                        yield pa.RecordBatch.from_arrays([ids, pa.array([index.ids[i] for _, i in order], arrow.field("item_id").type), *(pa.array([v[j] for v in values]) for j in range(3))], schema=arrow)

        out = out.union(rows.mapInArrow(run, schema))
    return out


def _table(index: Index) -> vec.HashTable:
    table = vec.HashTable()
    table.add(index.terms, np.arange(len(index.terms)))
    return table


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, that `leaks` would not return.

    Null and empty texts stay, as do all rows if there are no items; repeated
    rows stay or go together, whatever their ids. Texts may be of any length. Columns may have any names.
    An empty table gives an empty result.
    """
    common.bounded(docs.sparkSession)
    out = docs
    for group in _groups(indexes(items, item_id, item_text)):
        shared = [docs.sparkSession.sparkContext.broadcast(index) for index in group]

        def run(batches, shared=shared):
            asked = [(x.value, _table(x.value)) for x in shared]
            for part, data, offsets in vec.text_slices(batches):
                h, first = words(data, offsets)
                leaked = {d for index, table in asked for d, _ in _matches(index, table, h, first, threshold, overlap)}
                yield part.select(["row"]).filter(pa.array([d not in leaked for d in range(part.num_rows)]))

        rows = out.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
        out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")
    return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
