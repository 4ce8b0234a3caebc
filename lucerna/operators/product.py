"""Exact best rows by dot product, block by block (the kernel of `retrieve.dense_search`).

A block of questions meets a block of rows in a matrix product of single
precision. It only screens: a pair that could still be among the k best, by the
product's error bound, is scored again in double precision in the order of the
dimensions, as `retrieve.dot` does, and ranked by that score rounded as Spark rounds.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

#: Questions and rows of one product (8 MB of scores).
QUESTIONS, ROWS = 512, 4096
#: Pairs that are scored in double precision at once.
PAIRS = 1 << 16


def matrix(column: pa.Array, width: int, kind=np.float64) -> np.ndarray:
    return np.asarray(column.flatten(), kind).reshape(len(column), width)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half up on the shortest decimals, as Spark's round; only values near a half take the slow way."""
    scaled = x * 10.0**digits
    whole = np.floor(scaled)
    near = np.flatnonzero(np.abs(scaled - whole - 0.5) < 1e-4)
    out = np.rint(scaled) / 10.0**digits
    unit = Decimal(1).scaleb(-digits)
    for k in near.tolist():
        out[k] = float(Decimal(repr(float(x[k]))).quantize(unit, ROUND_HALF_UP))
    return out


def dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The product of rows i of a and j of b, added up from the first dimension to the last."""
    out = np.zeros(len(i))
    for lo in range(0, len(i), PAIRS):
        x, y, s = a[i[lo : lo + PAIRS]].T, b[j[lo : lo + PAIRS]].T, out[lo : lo + PAIRS]
        for d in range(a.shape[1]):
            s += x[d] * y[d]
    return out


class Best:
    """The k best rows of each of some questions, over the blocks of rows met so far; equal scores by id."""

    def __init__(self, questions: np.ndarray, k: int, digits: int | None) -> None:
        self.q, self.k, self.digits = questions, k, digits
        self.single = questions.astype(np.float32)
        self.norm = np.sqrt((questions * questions).sum(1))
        self.least = np.full(len(questions), -np.inf)
        self.of = self.score = self.key = self.ids = None

    def merge(self, rows: np.ndarray, single: np.ndarray, longest: float, ids: np.ndarray) -> None:
        scores = self.single @ single.T
        slack = 2e-7 * (self.q.shape[1] + 4) * self.norm * longest + (0 if self.digits is None else 0.51 * 10.0**-self.digits)
        least = self.least
        if self.of is None and len(ids) > self.k:
            # the k-th best by the product can be off by the slack, and so can those it is compared with
            least = np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - slack
        of, at = np.nonzero(scores >= (least - slack).astype(np.float32)[:, None])
        if not len(of):
            return
        score = dots(self.q, of, rows, at)
        key, own = (score if self.digits is None else rounded(score, self.digits)), ids[at]
        if self.of is not None:
            met = np.zeros(len(self.q), bool)
            met[of] = True
            old = met[self.of]
            stay = [x[~old] for x in (self.of, self.score, self.key, self.ids)]
            of, score, key, own = (np.concatenate([x[old], y]) for x, y in zip((self.of, self.score, self.key, self.ids), (of, score, key, own)))
        order = np.argsort(own, kind="stable")
        order = order[np.argsort(-key[order], kind="stable")]
        order = order[np.argsort(of[order], kind="stable")]
        first = np.searchsorted(of[order], np.arange(len(self.q)))
        place = np.arange(len(order)) - first[of[order]]
        last = order[place == self.k - 1]
        self.least[of[last]] = key[last]
        kept = order[place < self.k]
        new = [x[kept] for x in (of, score, key, own)]
        self.of, self.score, self.key, self.ids = new if self.of is None else [np.concatenate([a, b]) for a, b in zip(stay, new)]


def best(batches, q: np.ndarray, k: int, digits: int | None):
    """(question's place, ids, scores) of the k best of each question over all batches of (chunk_id, embedding), by groups of questions."""
    groups = [(lo, Best(q[lo : lo + QUESTIONS], k, digits)) for lo in range(0, len(q), QUESTIONS)]
    for batch in batches:
        wide = matrix(batch.column("embedding"), q.shape[1])
        ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
        for lo in range(0, len(wide), ROWS):
            rows = wide[lo : lo + ROWS]
            single, longest = rows.astype(np.float32), float(np.sqrt((rows * rows).sum(1).max()))
            for _, group in groups:
                group.merge(rows, single, longest, ids[lo : lo + ROWS])
    for lo, group in groups:
        if group.of is not None:
            yield lo + group.of, group.ids, group.score
