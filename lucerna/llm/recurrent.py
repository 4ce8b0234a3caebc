"""A gated recurrent language model with class-factored output, in numpy.

Documents run side by side in lanes; a lane takes the next document when one
ends, and its state starts anew there. Between windows of WINDOW steps the
state is carried on, so a document's likelihood covers all of it, while the
gradient is cut at the window's start.
"""

from __future__ import annotations

import heapq

import numpy as np

WINDOW = 32
HIDDEN = 16
CLIP = 1.0


class Shape:
    """Words 0..size-1 in order of frequency, `size` the rare class's token, size + 1 the end; size + 2 starts a document."""

    def __init__(self, counts: np.ndarray, rare: int, ends: int, classes: int) -> None:
        self.size = len(counts)
        mass = np.cumsum(np.sqrt(counts)) if self.size else np.zeros(0)
        group = np.minimum((mass / mass[-1] * classes).astype(np.int64), classes - 1) if self.size else np.zeros(0, np.int64)
        _, group = np.unique(group, return_inverse=True)
        n = int(group.max()) + 1 if self.size else 0
        # rare and end are classes of one member
        self.klass = np.concatenate([group, [n, n + 1]]).astype(np.int64)
        self.start = np.searchsorted(self.klass, np.arange(n + 3))
        self.classes = n + 2
        weight = np.concatenate([counts, [rare, ends]]) + 0.5
        total = np.bincount(self.klass, weight)
        self.class_bias = np.log(total / total.sum()).astype(np.float32)
        self.word_bias = np.log(weight / total[self.klass]).astype(np.float32)

    def first_weights(self, seed: int) -> dict[str, np.ndarray]:
        draw = np.random.default_rng(seed)
        normal = lambda *s, scale=0.1: (draw.standard_normal(s) * scale).astype(np.float32)
        h = HIDDEN
        return {
            "input": normal(self.size + 3, 3 * h),
            "state": normal(h, 3 * h, scale=h**-0.5),
            "bias": np.concatenate([np.full(h, -1.0), np.zeros(2 * h)]).astype(np.float32),
            "class_w": np.zeros((h, self.classes), np.float32),
            "class_b": self.class_bias.copy(),
            "word_w": normal(self.size + 2, h, scale=0.02),
            "word_b": self.word_bias.copy(),
        }


def lanes(lengths: np.ndarray, width: int):
    """(lane, first step) of each document: longest first, each to the lane that is free soonest."""
    width = max(1, min(width, len(lengths)))
    free = [(0, k) for k in range(width)]
    lane, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        used, k = free[0]
        lane[i], at[i] = k, used
        heapq.heapreplace(free, (used + int(lengths[i]), k))
    ends = np.zeros(width, np.int64)
    for used, k in free:
        ends[k] = used
    order = np.argsort(-ends, kind="stable")  # longest lanes first, so that those at work are a prefix
    place = np.empty(width, np.int64)
    place[order] = np.arange(width)
    return place[lane], at, ends[order]


def laid_out(ids: np.ndarray, first: np.ndarray, start: int, width: int):
    """Inputs, targets and document rows as (step, lane) arrays, and lanes at work by step."""
    lengths = np.diff(first)
    lane, at, ends = lanes(lengths, width)
    steps = int(ends[0]) if len(ends) else 0
    target = np.zeros((steps, len(ends)), np.int32)
    source = np.full((steps, len(ends)), start, np.int32)
    row = np.zeros((steps, len(ends)), np.int32)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(ids)) - first[:-1][doc] + at[doc]
    col = lane[doc]
    target[step, col], row[step, col] = ids, doc
    inner = np.ones(len(ids), bool)
    inner[first[:-1][lengths > 0]] = False
    source[step[inner], col[inner]] = ids[np.flatnonzero(inner) - 1]
    active = np.searchsorted(-ends, -np.arange(steps), side="left")
    return source, target, row, active


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    return 1 / (1 + np.exp(-x))


class Runner:
    def __init__(self, shape: Shape, weights: dict[str, np.ndarray]) -> None:
        self.shape, self.w = shape, weights

    def step(self, h: np.ndarray, source: np.ndarray):
        k = HIDDEN
        x = self.w["input"][source] + self.w["bias"]
        g = h @ self.w["state"]
        zr = _sigmoid(x[:, : 2 * k] + g[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        n = np.tanh(x[:, 2 * k :] + r * g[:, 2 * k :])
        return n + z * (h - n), (h, z, r, n, g[:, 2 * k :])

    def output(self, states: np.ndarray, target: np.ndarray, learn: bool = False):
        """log P of each target (natural); with `learn` also gradients of the mean loss."""
        s, w = self.shape, self.w
        klass = s.klass[target]
        logits = states @ w["class_w"] + w["class_b"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        total = p.sum(axis=1)
        each = np.arange(len(target))
        out = logits[each, klass] - np.log(total)
        grads = {}
        if learn:
            p /= total[:, None]
            p[each, klass] -= 1
            p /= len(target)
            grads = {"class_w": states.T @ p, "class_b": p.sum(axis=0), "word_w": np.zeros_like(w["word_w"]), "word_b": np.zeros_like(w["word_b"])}
            back = p @ w["class_w"].T
        order = np.argsort(klass, kind="stable")
        cuts = np.searchsorted(klass[order], np.arange(s.classes + 1))
        for c in range(s.classes):
            lo, hi = s.start[c], s.start[c + 1]
            mine = order[cuts[c] : cuts[c + 1]]
            if hi - lo < 2 or not mine.size:
                continue
            held = states[mine]
            logits = held @ w["word_w"][lo:hi].T + w["word_b"][lo:hi]
            logits -= logits.max(axis=1, keepdims=True)
            q = np.exp(logits)
            total = q.sum(axis=1)
            at = target[mine] - lo
            some = np.arange(len(mine))
            out[mine] += logits[some, at] - np.log(total)
            if learn:
                q /= total[:, None]
                q[some, at] -= 1
                q /= len(target)
                grads["word_w"][lo:hi] = q.T @ held
                grads["word_b"][lo:hi] = q.sum(axis=0)
                back[mine] += q @ w["word_w"][lo:hi]
        return (out, grads, back) if learn else out

    def score(self, ids: np.ndarray, first: np.ndarray, width: int = 512) -> np.ndarray:
        """Natural log likelihood of each document under the factored output."""
        source, target, row, active = laid_out(ids, first, self.shape.size + 2, width)
        total = np.zeros(len(first) - 1)
        h = np.zeros((source.shape[1], HIDDEN), np.float32)
        for t0 in range(0, len(source), WINDOW):
            states, targets, rows = [], [], []
            for t in range(t0, min(t0 + WINDOW, len(source))):
                n = active[t]
                src = source[t, :n]
                h = h[:n]
                h[src == self.shape.size + 2] = 0
                h, _ = self.step(h, src)
                states.append(h.copy())
                targets.append(target[t, :n])
                rows.append(row[t, :n])
            got = self.output(np.concatenate(states), np.concatenate(targets))
            total += np.bincount(np.concatenate(rows), got, minlength=len(total))
        return total


class Trainer(Runner):
    def __init__(self, shape: Shape, weights: dict[str, np.ndarray], rate: float) -> None:
        super().__init__(shape, {k: v.copy() for k, v in weights.items()})
        self.rate, self.steps = rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.square = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.seen, self.loss = 0, 0.0

    def learn(self, ids: np.ndarray, first: np.ndarray, width: int = 128) -> None:
        """One pass over the documents."""
        source, target, _, active = laid_out(ids, first, self.shape.size + 2, width)
        begin = self.shape.size + 2
        h = np.zeros((source.shape[1], HIDDEN), np.float32)
        for t0 in range(0, len(source), WINDOW):
            tape, states = [], []
            for t in range(t0, min(t0 + WINDOW, len(source))):
                n = active[t]
                src = source[t, :n]
                h = h[:n].copy()
                h[src == begin] = 0
                h, held = self.step(h, src)
                tape.append((src, held))
                states.append(h)
            goal = np.concatenate([target[t0 + k, : len(s)] for k, s in enumerate(states)])
            got, grads, back = self.output(np.concatenate(states), goal, True)
            self.loss -= float(got.sum())
            self.seen += len(goal)
            grads |= self._through_time(tape, back, begin)
            self._update(grads)

    def _through_time(self, tape, back, begin):
        k, w = HIDDEN, self.w
        at = len(back)
        later = np.zeros((0, k), np.float32)
        dx_all, src_all = [], []
        d_state = np.zeros_like(w["state"])
        for src, (h, z, r, n, gn) in reversed(tape):
            dh = back[at - len(src) : at].copy()
            at -= len(src)
            dh[: len(later)] += later
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dx = np.concatenate([dz, dr, dn], axis=1)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            d_state += h.T @ dg
            later = dh * z + dg @ w["state"].T
            later[src == begin] = 0
            dx_all.append(dx)
            src_all.append(src)
        dx, src = np.concatenate(dx_all), np.concatenate(src_all)
        order = np.argsort(src, kind="stable")
        s = src[order]
        cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        d_input = np.zeros_like(w["input"])
        d_input[s[cut]] = np.add.reduceat(dx[order], cut, axis=0)
        return {"input": d_input, "state": d_state, "bias": dx.sum(axis=0)}

    def _update(self, grads) -> None:
        self.steps += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = min(1.0, CLIP / (norm + 1e-9))
        a, b = 0.9, 0.99
        rate = self.rate * np.sqrt(1 - b**self.steps) / (1 - a**self.steps)
        for k, g in grads.items():
            g = g * np.float32(scale)
            m, v = self.mean[k], self.square[k]
            m += (1 - a) * (g - m)
            v += (1 - b) * (g * g - v)
            self.w[k] -= np.float32(rate) * m / (np.sqrt(v) + 1e-8)


def packed(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out
