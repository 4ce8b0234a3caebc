"""A deterministic automaton whose paths are exactly the BPE encodings.

Construction: start from one state with a loop for every byte and apply one
gadget for each merge (a, b), in order of rank. The gadget gives `a` a target
state of its own, a copy of the old one without its arc `b`, and adds an arc
`ab`, to where `b` leads, to every state that then has an arc `a`. After the
last merge a token sequence is accepted just if it is the encoding of its
bytes. All arcs with one label end in one state, so a state is named by the
label that leads to it. Written out, the arcs would number states x labels
(billions), so the compiled form keeps each gadget's effect: the rank at which
an arc was cut (`cut`), and for every label the two it was made of (`left`,
`right`) and its rank. Whether a state has an arc follows from these alone;
rows of the transition table are filled in as texts ask for them and then only
looked up.
"""

from __future__ import annotations

import functools

import numpy as np

from lucerna.llm import bpe, vec

#: Entries of the transition table that a worker holds before it starts anew.
TABLE_LIMIT = 1_000_000
#: Distinct pre-tokens that a worker holds beside it.
CACHE_WORDS = 500_000
_NEVER = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """Byte of each letter that vocabulary files write for it: printable bytes are themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


class MergeAutomaton:
    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        letters = byte_letters()
        size = max(vocabulary.values()) + 1
        self.label = [b""] * size
        for text, token in vocabulary.items():
            self.label[token] = bytes(letters[c] for c in text)
        self.left, self.right = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.rank = np.full(size, -1, np.int32)
        self.live = np.zeros(size, bool)
        for text, token in vocabulary.items():
            self.live[token] = len(text) == 1
        self.cuts: dict[int, int] = {}
        for rank, merge in enumerate(merges):
            a, b = merge if isinstance(merge, (list, tuple)) else merge.split(" ")
            self._gadget(rank, vocabulary[a], vocabulary[b], vocabulary[a + b])
        self._freeze()

    def _gadget(self, rank: int, a: int, b: int, ab: int) -> None:
        """One merge; a second way to the same label is not in published files."""
        if self.rank[ab] >= 0:
            raise ValueError("two merges make one label")
        joins = bool(self.live[a] and self.live[b] and self._arc(a, b))
        self.cuts[a << 32 | b] = rank
        self.left[ab], self.right[ab], self.rank[ab], self.live[ab] = a, b, rank, joins

    def _arc(self, x: int, t: int, before: int = _NEVER) -> bool:
        """Whether the state after x had arc t once all gadgets below rank `before` were applied."""
        while True:
            if self.cuts.get(x << 32 | t, _NEVER) < before:
                return False
            rx, rt = self.rank[x], self.rank[t]
            if rx < 0 and rt < 0:
                return True
            if rx > rt:  # x's state was copied from that of its right part
                x, before = self.right[x].item(), rx
            else:  # arc t was added where its left part was an arc
                t, before = self.left[t].item(), rt + 1

    def _freeze(self) -> None:
        pairs = np.fromiter(self.cuts, np.int64, len(self.cuts)).astype(np.uint64)
        self.cut = vec.HashTable()
        self.cut.add(vec.mix(pairs + np.uint64(1)), np.fromiter(self.cuts.values(), np.int32, len(self.cuts)))
        del self.cuts
        lengths = np.fromiter(map(len, self.label), np.int64, len(self.label))
        self.bytes = np.frombuffer(b"".join(self.label), np.uint8)
        self.width = lengths
        self.at = np.cumsum(lengths) - lengths
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for token in np.flatnonzero(self.live).tolist():
            node = 0
            for byte in self.label[token]:
                node = nodes.setdefault((node, byte), len(nodes) + 1)
            ends[node] = token
        key = np.fromiter((n << 8 | b for n, b in nodes), np.int64, len(nodes)).astype(np.uint64)
        self.next = vec.HashTable()
        self.next.add(vec.mix(key + np.uint64(1)), np.arange(1, len(nodes) + 1))
        self.ends = np.full(len(nodes) + 1, -1, np.int32)
        self.ends[list(ends)] = list(ends.values())
        self.table = vec.HashTable()

    def arcs(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Table look-up of whether state x has arc t; rows not met before are derived once."""
        if self.table.count > TABLE_LIMIT:
            self.table.clear()
        key = vec.mix((x.astype(np.uint64) << np.uint64(32) | t.astype(np.uint64)) + np.uint64(1))
        got = self.table.find(key)
        miss = np.flatnonzero(got < 0)
        if miss.size:
            new, at, back = np.unique(key[miss], return_index=True, return_inverse=True)
            value = self._derive(x[miss[at]].astype(np.int64), t[miss[at]].astype(np.int64)).astype(np.int32)
            self.table.add(new, value)
            got[miss] = value[back]
        return got == 1

    def _derive(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        todo, before = np.arange(len(x)), np.full(len(x), _NEVER, np.int64)
        while todo.size:
            cut = self.cut.find(vec.mix((x.astype(np.uint64) << np.uint64(32) | t.astype(np.uint64)) + np.uint64(1)))
            rx, rt = self.rank[x].astype(np.int64), self.rank[t].astype(np.int64)
            is_cut = (cut >= 0) & (cut < before)
            base = (rx < 0) & (rt < 0)
            out[todo[~is_cut & base]] = True
            go = ~is_cut & ~base
            todo, x, t, rx, rt = todo[go], x[go], t[go], rx[go], rt[go]
            newer = rx > rt
            before = np.where(newer, rx, rt + 1)
            x, t = np.where(newer, self.right[x], x), np.where(newer, t, self.left[np.where(newer, 0, t)])
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        """Labels of the accepted path of each word."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)
        starts = ends - size
        n = len(data)
        stop = np.repeat(ends, size)
        # all labels that match at all positions, found by one walk down the label tree
        at, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        found = []
        while at.size:
            key = vec.mix((node.astype(np.uint64) << np.uint64(8) | data[at + depth].astype(np.uint64)) + np.uint64(1))
            node = self.next.find(key).astype(np.int64)
            depth += 1
            ok = node >= 0
            at, node = at[ok], node[ok]
            hit = self.ends[node] >= 0
            found.append((at[hit], np.full(int(hit.sum()), depth), self.ends[node[hit]]))
            more = at + depth < stop[at]
            at, node = at[more], node[more]
        begin, wide, label = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        first = np.repeat(starts, size)
        reach = begin + wide - first[begin]
        order = np.argsort(reach, kind="stable")
        begin, wide, label, reach = begin[order], wide[order], label[order], reach[order]
        groups = np.searchsorted(reach, np.arange(1, (int(size.max()) if len(size) else 0) + 2))
        state = np.full(n + 1, -1, np.int64)  # label that ends just before; words are apart, so ends are stored at end - 1
        back = np.zeros(n + 1, np.int64)
        for lo, hi in zip(groups[:-1].tolist(), groups[1:].tolist()):
            if lo == hi:
                continue
            p, t = begin[lo:hi], label[lo:hi]
            fresh = p == first[p]
            ok = fresh.copy()
            inner = np.flatnonzero(~fresh)
            if inner.size:
                before = state[p[inner] - 1]
                live = before >= 0
                inner = inner[live]
                ok[inner] = self.arcs(before[live], t[inner])
            p, t = p[ok], t[ok]
            last = p + wide[lo:hi][ok] - 1
            state[last], back[last] = t, p
        out: list[list[int]] = [[] for _ in words]
        labels, froms = state, back
        for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            path = out[k]
            while b > a:
                path.append(int(labels[b - 1]))
                b = int(froms[b - 1])
            path.reverse()
        return out

    def decode(self, ids: np.ndarray, first: np.ndarray):
        """Bytes of the labels along each row's path, and each row's first byte."""
        width = self.width[ids]
        at = np.concatenate([[0], np.cumsum(width)])[first]
        return bpe.ragged(self.bytes, self.at[ids], width), at


@functools.cache
def compiled(path: str) -> MergeAutomaton:
    model = bpe.description(path)["model"]
    out = MergeAutomaton(model["vocab"], model["merges"])
    for text, token in bpe.added_tokens(path).items():  # arcs of special strings
        grow = token + 1 - len(out.width)
        if grow > 0:
            out.width, out.at = (np.concatenate([x, np.zeros(grow, np.int64)]) for x in (out.width, out.at))
        out.width[token], out.at[token] = len(text), len(out.bytes)
        out.bytes = np.concatenate([out.bytes, np.frombuffer(text, np.uint8)])
    return out


@functools.cache
def automaton_encoder(path: str) -> bpe.PretokenEncoder:
    return bpe.PretokenEncoder(compiled(path).encode, bpe.added_tokens(path), CACHE_WORDS)
