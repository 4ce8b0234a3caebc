"""Array kernels shared by the text operators.

A batch of texts is one UTF-8 byte array plus row offsets, as Arrow hands it
over, so splitting into words or pre-tokens and hashing them are numpy passes
over bytes; Python strings are made only for words not met before.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

CHUNK_BYTES = 1 << 20
_U = np.uint64

#: The ASCII white space of the word rule `[^\x20\x09-\x0D]+`.
WORD_SPACE = (9, 10, 11, 12, 13, 32)
#: Code points with the Unicode property White_Space.
UNICODE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(WORD_SPACE)] = True



def text_array(column: pa.Array) -> pa.Array:
    """Strings without nulls (a null text counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; offsets start at 0."""
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with at most `limit` bytes of text each, or one row."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    at, total = 0, np.concatenate([[0], np.cumsum(lengths)])
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_slices(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """(slice, bytes, offsets) for every slice of every batch."""
    for batch in batches:
        for part in slices(batch, column, limit):
            data, offsets = buffers(text_array(part.column(column)))
            yield part, data, offsets
    give_back()


def give_back() -> None:
    """Returns freed memory to the system, so that an idle worker holds little of it."""
    import ctypes

    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _IS_SPACE):
    """Starts and ends (bytes) of the words, and the index of each row's first word."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    blank = space[data]
    solid = ~blank
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = blank[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = blank[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def rows_of(first: np.ndarray) -> np.ndarray:
    """Row of each item, from the index of each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of an item value by row, exact for integers."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def code_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Length of each span in code points."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return lead[ends] - lead[starts]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads low-order differences."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Powers:
    """Powers of an odd multiplier and of its inverse, grown as longer inputs come."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)
        self.byte = mix(np.arange(1, 257, dtype=np.uint64))

    def get(self, n: int):
        if len(self.up) < n + 1:
            n = max(n + 1, CHUNK_BYTES + 1)
            inverse = pow(self.BASE, -1, 1 << 64)
            for name, base in (("up", self.BASE), ("down", inverse)):
                out = np.full(n, base, np.uint64)
                out[0] = 1
                with np.errstate(over="ignore"):
                    setattr(self, name, np.multiply.accumulate(out))
        return self.up, self.down


_powers = _Powers()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; never 0. Equal bytes have equal hashes in every process."""
    up, down = _powers.get(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_powers.byte[data] * up[: len(data)], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    h[h == 0] = 1
    return h


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = 5):
    """Hashes of every run of `size` words, and the index of each row's first.

    A row with fewer words has its whole sequence as its one shingle; a row
    without words has none.
    """
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n)])
    row = rows_of(at)
    begin = first[:-1][row] + np.arange(at[-1]) - at[:-1][row]
    out = np.zeros(at[-1], np.uint64)
    last = first[1:][row]
    factor = 1
    for k in range(size):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        pos = begin + k
        live = pos < last
        out[live] += mix(words[pos[live]] + _U(k)) * _U(factor)
    out = mix(out)
    out[out == 0] = 1
    return out, at


def unique_by_row(values: np.ndarray, first: np.ndarray):
    """Distinct values of each row, ascending within it, and first index by row."""
    row = rows_of(first)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[new], np.searchsorted(r[new], np.arange(len(first)))


class HashTable:
    """Open addressing from 64-bit hash to int32, all operations on whole arrays."""

    def __init__(self, bits: int = 12) -> None:
        self.clear(bits)

    def clear(self, bits: int = 12) -> None:
        self.bits, self.count = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.vals = np.full(1 << bits, -1, np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Values, -1 where absent."""
        slot = self._slot(h)
        key = self.keys[slot]
        out = np.where(key == h, self.vals[slot], np.int32(-1))
        todo = np.flatnonzero((key != h) & (key != 0))
        mask = (1 << self.bits) - 1
        slot = slot[todo]
        while todo.size:
            slot = (slot + 1) & mask
            key = self.keys[slot]
            same = key == h[todo]
            out[todo[same]] = self.vals[slot[same]]
            more = ~same & (key != 0)
            todo, slot = todo[more], slot[more]
        return out

    def add(self, h: np.ndarray, vals: np.ndarray) -> None:
        """Adds distinct absent hashes."""
        if (self.count + len(h)) * 2 > 1 << self.bits:
            bits = self.bits
            while (self.count + len(h)) * 2 > 1 << bits:
                bits += 1
            keys, old = self.keys[self.keys != 0], self.vals[self.keys != 0]
            self.clear(bits + 1)
            self._put(keys, old)
        self._put(h, np.asarray(vals, np.int32))

    def _put(self, h: np.ndarray, vals: np.ndarray) -> None:
        mask, slot = (1 << self.bits) - 1, self._slot(h)
        todo = np.arange(len(h))
        while todo.size:
            at = slot[todo]
            free = self.keys[at] == 0
            self.keys[at[free]] = h[todo[free]]
            won = free & (self.keys[at] == h[todo])
            self.vals[at[won]] = vals[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & mask
        self.count += len(h)


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point: 1 letter, 2 number, 3 white space, 4 other, as the tokenizers library has them.

    The regex package, whose Unicode version may be another, only proposes
    runs. The library splits a run of one class behind a character of that
    class nowhere; a run that it splits is halved until it does not.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    out = np.full(0x110000, 3, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    guess = np.full(0x110000, 4, np.uint8)
    chars, code = "".join(map(chr, points)), np.array(points)
    for value, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, chars):
            guess[code[m.start() : m.end()]] = value
    edges = np.flatnonzero(np.diff(guess[code])) + 1
    todo = [(lo, hi, int(guess[code[lo]])) for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(code)])]
    while todo:
        lo, hi, first = todo.pop()
        for value in sorted((1, 2, 4), key=lambda v: v != first):
            if (first != 3 or hi - lo == 1) and len(split({1: "a", 2: "1", 4: "!"}[value] + chars[lo:hi])) == 1:
                out[code[lo:hi]] = value
                break
            if hi - lo > 1:
                mid = (lo + hi) // 2
                todo += [(lo, mid, first), (mid, hi, first)]
                break
    return out


def pretoken_spans(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends (bytes) of the pre-tokens of byte-level BPE, and each row's first.

    The rule is the published split pattern: contractions, then runs of
    letters, numbers or other signs with one blank before them, then white
    space, whose last character goes to what follows if it is a blank.
    """
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    table = _classes()
    cls = table[data]
    lead = np.flatnonzero(data >= 0xC0)
    if lead.size:
        b0 = data[lead].astype(np.int64)
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        point = np.where(size == 2, b0 & 0x1F, np.where(size == 3, b0 & 0x0F, b0 & 0x07))
        for k in (1, 2, 3):
            has = size > k
            point[has] = (point[has] << 6) | (data[lead[has] + k] & 0x3F)
        kind = table[np.minimum(point, 0x10FFFF)]
        cls[lead] = kind
        for k in (1, 2, 3):
            has = size > k
            cls[lead[has] + k] = kind[has]
    edge = np.empty(n, bool)
    edge[0] = True
    edge[1:] = cls[1:] != cls[:-1]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    edge |= begins[:n]
    rs = np.flatnonzero(edge)
    re_ = np.append(rs[1:], n)
    rc = cls[rs]
    tok = edge
    joined = ~begins[re_]  # the next run is in the same row
    blank = np.flatnonzero((rc == 3) & joined)
    end = re_[blank]
    is_sp = data[end - 1] == 32
    tok[end[is_sp]] = False
    tok[end[is_sp] - 1] = True
    other = end[~is_sp] - 1
    while other.size and (back := (data[other] & 0xC0) == 0x80).any():
        other = other - back
    tok[other] = True
    apos = np.flatnonzero((rc == 4) & (re_ - rs == 1) & (data[rs] == 39) & tok[rs] & joined)
    apos = apos[rc[np.minimum(apos + 1, len(rc) - 1)] == 1]
    if apos.size:
        at, stop = re_[apos], re_[apos + 1]
        one = data[at]
        two = np.where(at + 1 < stop, data[np.minimum(at + 1, n - 1)], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        for hit, width in ((short, 1), (long, 2)):
            tok[at[hit]] = False
            cut = at[hit] + width
            tok[cut[cut < stop[hit]]] = True
    starts = np.flatnonzero(tok)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]


class Vocabulary:
    """Ids of words by hash with a bound on memory; `clear` starts anew when it is full."""

    def __init__(self, limit: int) -> None:
        self.table, self.limit, self.size = HashTable(), limit, 0

    def full(self) -> bool:
        return self.size > self.limit

    def clear(self) -> None:
        self.table.clear()
        self.size = 0

    def ids(self, hashes: np.ndarray):
        """(id of each hash, positions of the first occurrences of new ones in id order)."""
        out = self.table.find(hashes)
        miss = np.flatnonzero(out < 0)
        if miss.size == 0:
            return out, miss
        new, at, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
        fresh = np.arange(self.size, self.size + len(new), dtype=np.int32)
        self.table.add(new, fresh)
        self.size += len(new)
        out[miss] = fresh[back]
        return out, miss[at]
