"""Byte-level BPE over batches of texts.

`PretokenEncoder` splits whole texts into pre-tokens with array kernels and
asks a back end only for pre-tokens that the worker has not met; the back end
is the tokenizers library (`library_words`) or the automaton (`automaton.py`).
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable

import numpy as np

from lucerna.llm import vec

#: Distinct pre-tokens a worker holds before its cache starts anew.
CACHE_WORDS = 1_500_000


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of flat[start:start + length]."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


@functools.cache
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def description(path: str) -> dict:
    """The whole file, which is large: callers keep only what they need of it."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@functools.cache
def splits_by_pretoken(path: str) -> bool:
    """Whether pre-tokens of the published pattern can be encoded one by one."""
    if not path.endswith(".json"):
        return False
    d = description(path)
    pre, model = d.get("pre_tokenizer") or {}, d["model"]
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in d.get("added_tokens") or [])
    return plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and d.get("normalizer") is None and not model.get("dropout")


@functools.cache
def added_tokens(path: str) -> dict[bytes, int]:
    return {t["content"].encode(): t["id"] for t in description(path).get("added_tokens") or []}


def library_words(path: str) -> Callable[[list[str]], list[list[int]]]:
    encode = library(path).encode_batch_fast
    return lambda words: [e.ids for e in encode(words, add_special_tokens=False)]


class PretokenEncoder:
    def __init__(self, words: Callable, added: dict[bytes, int], limit: int = CACHE_WORDS) -> None:
        self.words, self.added = words, added
        self.find_added = re.compile(b"|".join(re.escape(t) for t in sorted(added, key=lambda t: -len(t)))) if added else None
        self.vocabulary = vec.Vocabulary(limit)
        self.reset()

    def reset(self) -> None:
        self.vocabulary.clear()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def _keep(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        n, at = len(lengths), self.vocabulary.size - len(lengths)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(ids)] = ids
        ends = self.used + np.cumsum(lengths)
        self.start[at : at + n], self.length[at : at + n] = ends - lengths, lengths
        self.used += len(ids)

    def spans(self, data: np.ndarray, offsets: np.ndarray):
        """Pre-tokens with hashes; special strings are one each."""
        marks = [m.span() for m in self.find_added.finditer(data.tobytes())] if self.find_added else []
        if marks:  # none may reach over the end of a row
            row = np.searchsorted(offsets, [a for a, _ in marks], side="right")
            marks = [m for m, r in zip(marks, row) if m[1] <= offsets[r]]
        if not marks:
            starts, ends, first = vec.pretoken_spans(data, offsets)
            return starts, ends, first, vec.span_hashes(data, starts, ends)
        a, b = (np.array(x) for x in zip(*marks))
        cuts = np.unique(np.concatenate([offsets, a, b]))
        starts, ends, _ = vec.pretoken_spans(data, cuts)
        part = np.searchsorted(a, starts, side="right") - 1
        inside = (part >= 0) & (starts < b[part])
        keep = ~inside | (starts == a[np.maximum(part, 0)])
        ends = np.where(inside, b[part], ends)
        starts, ends = starts[keep], ends[keep]
        return starts, ends, np.searchsorted(starts, offsets), vec.span_hashes(data, starts, ends)

    def encode_spans(self, data, starts, ends, hashes) -> np.ndarray:
        """Index of each span in the cache."""
        if self.vocabulary.full():
            self.reset()
        index, new = self.vocabulary.ids(hashes)
        if new.size:
            words = vec.strings(data, starts[new], ends[new])
            special = {i: self.added[w.encode()] for i, w in enumerate(words) if w.encode() in self.added} if self.added else {}
            got = self.words(words)
            for i, t in special.items():
                got[i] = [t]
            lengths = np.fromiter(map(len, got), np.int64, len(got))
            self._keep(np.fromiter((t for ids in got for t in ids), np.int32, int(lengths.sum())), lengths)
        return index

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """(ids of all rows, index of each row's first id)."""
        starts, ends, first, hashes = self.spans(data, offsets)
        index = self.encode_spans(data, starts, ends, hashes)
        lengths = self.length[index]
        at = np.concatenate([[0], np.cumsum(lengths)])[first]
        return ragged(self.flat, self.start[index], lengths), at


@functools.cache
def library_encoder(path: str) -> PretokenEncoder:
    """The worker's encoder for a tokenizer file."""
    return PretokenEncoder(library_words(path), added_tokens(path))
