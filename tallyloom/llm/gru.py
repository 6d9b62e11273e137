"""A small gated recurrent language model in numpy: truncated backpropagation, class-factored softmax.

Symbols are the frequent words, in classes of ``per_class``; the end of a document, a class of its own; and
bands of rarer words, each a class whose words share its probability by their counts.  A word's probability is
that of its class given the state, times, in the classes of frequent words, its softmax given the state.
"""

from __future__ import annotations

import numpy as np

HIDDEN, PER_CLASS, STEPS, LANES, RATE = 16, 32, 20, 256, 0.01


class Shape:
    """How many symbols there are: ``top`` frequent words, then the end, then ``bands`` bands."""

    def __init__(self, top: int, bands: int, hidden: int = HIDDEN, per_class: int = PER_CLASS):
        self.top, self.bands, self.hidden, self.per_class = top, bands, hidden, per_class
        self.word_classes = -(-top // per_class)
        self.symbols, self.classes = top + 1 + bands, self.word_classes + 1 + bands
        self.class_of = np.concatenate([np.arange(top) // per_class, np.arange(self.word_classes, self.classes)])

    def sizes(self) -> dict[str, tuple[int, ...]]:
        h = self.hidden
        return {"x": (self.symbols, 3 * h), "u": (h, 3 * h), "wc": (h, self.classes), "bc": (self.classes,), "ww": (self.word_classes, h, self.per_class), "bw": (self.word_classes, self.per_class)}


def unpack(flat: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, dims in shape.sizes().items():
        n = int(np.prod(dims))
        out[name], at = flat[at : at + n].reshape(dims), at + n
    return out


def initial(shape: Shape, counts: np.ndarray, seed: int) -> np.ndarray:
    """Weights that give each symbol its relative frequency, with small seeded recurrent parts."""
    rng, n = np.random.default_rng(seed), sum(int(np.prod(d)) for d in shape.sizes().values())
    flat = np.zeros(n, np.float32)
    p = unpack(flat, shape)
    p["x"][:] = rng.normal(0, 0.3, p["x"].shape)
    p["u"][:] = rng.normal(0, 0.3, p["u"].shape)
    p["wc"][:] = rng.normal(0, 0.05, p["wc"].shape)
    counts = counts + 0.5
    sums = np.bincount(shape.class_of, counts, shape.classes)
    p["bc"][:] = np.log(sums / sums.sum())
    p["bw"][:] = -30.0  # places of the last class without a word
    p["bw"].reshape(-1)[: shape.top] = np.log(counts[: shape.top])
    return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def lanes_of(lengths: np.ndarray, n: int) -> list[list[int]]:
    """Documents dealt out to at most ``n`` lanes of about equal length, longest first."""
    import heapq

    heap = [(0, k) for k in range(max(1, min(n, len(lengths))))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable").tolist():
        size, k = heap[0]
        out[k].append(d)
        heapq.heapreplace(heap, (size + int(lengths[d]), k))
    return out


def windows(symbols: np.ndarray, lengths: np.ndarray, end: int, n: int = LANES, steps: int = STEPS):
    """Yields (previous, next, starts, document, real) of ``steps`` times lanes, over whole documents in lanes.

    The state that a lane ends a window with is where its next window begins, unless a document starts.
    """
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    lanes = [np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in lane]) if lane else np.zeros(0, np.int64) for lane in lanes_of(lengths, n)]
    lanes.sort(key=len, reverse=True)
    document = np.repeat(np.arange(len(lengths)), lengths)
    first = np.zeros(len(symbols), bool)
    first[bounds[:-1]] = True
    longest = len(lanes[0]) if lanes else 0
    grid = np.full((longest, len(lanes)), -1, np.int64)
    for k, lane in enumerate(lanes):
        grid[: len(lane), k] = lane
    live = np.array([len(x) for x in lanes])
    for t in range(0, longest, steps):
        width = int((live > t).sum())  # lanes are sorted, so those that have ended are the last
        at = grid[t : t + steps, :width]
        real = at >= 0
        at = np.where(real, at, 0)
        starts = first[at] & real
        yield np.where(starts, end, symbols[at - 1]), symbols[at], starts, document[at], real


class Model:
    def __init__(self, flat: np.ndarray, shape: Shape):
        self.shape, self.flat = shape, flat.astype(np.float32).copy()
        self.p = unpack(self.flat, shape)

    def _run(self, x: np.ndarray, starts: np.ndarray, h: np.ndarray):
        """States after each step, and what backpropagation needs."""
        hidden, kept = self.shape.hidden, []
        a, u = self.p["x"][x], self.p["u"]
        out = np.empty((*x.shape, hidden), np.float32)
        for t in range(len(x)):
            h = np.where(starts[t][:, None], np.float32(0), h)
            g = h @ u
            zr = _sigmoid(a[t, :, : 2 * hidden] + g[:, : 2 * hidden])
            z, r = zr[:, :hidden], zr[:, hidden:]
            c = np.tanh(a[t, :, 2 * hidden :] + r * g[:, 2 * hidden :])
            kept.append((h, z, r, c, g[:, 2 * hidden :]))
            h = c + z * (h - c)
            out[t] = h
        return out, kept, h

    def _outputs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None):
        """Natural log probabilities of ``y`` given states ``h``; with ``grads``, adds to them and gives the states' too."""
        p, s = self.p, self.shape
        of = s.class_of[y]
        logits = h @ p["wc"] + p["bc"]
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        total = e.sum(axis=1)
        rows = np.arange(len(y))
        logp = logits[rows, of] - np.log(total)
        dh = None
        if grads is not None:
            e /= total[:, None]
            e[rows, of] -= 1
            grads["wc"] += h.T @ e
            grads["bc"] += e.sum(axis=0)
            dh = e @ p["wc"].T
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(s.word_classes + 1))
        for c in range(s.word_classes):
            own = order[bounds[c] : bounds[c + 1]]
            if not len(own):
                continue
            hc, place = h[own], y[own] - c * s.per_class
            inner = hc @ p["ww"][c] + p["bw"][c]
            inner -= inner.max(axis=1, keepdims=True)
            e = np.exp(inner)
            total, n = e.sum(axis=1), np.arange(len(own))
            logp[own] += inner[n, place] - np.log(total)
            if grads is not None:
                e /= total[:, None]
                e[n, place] -= 1
                grads["ww"][c] += hc.T @ e
                grads["bw"][c] += e.sum(axis=0)
                dh[own] += e @ p["ww"][c].T
        return logp, dh

    def score(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log probability of each document; the state runs through all of its windows."""
        out, h = np.zeros(len(lengths)), np.zeros((0, self.shape.hidden), np.float32)
        for x, y, starts, document, real in windows(symbols, lengths, self.shape.top, 2 * LANES):
            h = h[: x.shape[1]] if len(h) else np.zeros((x.shape[1], self.shape.hidden), np.float32)
            states, _, h = self._run(x, starts, h)
            logp, _ = self._outputs(states[real], y[real])
            out += np.bincount(document[real], logp, len(lengths))
        return out

    def train(self, symbols: np.ndarray, lengths: np.ndarray, rate: float = RATE) -> None:
        """One pass over the documents: Adam on windows, gradients cut at each window's beginning."""
        s, hidden = self.shape, self.shape.hidden
        flat = np.zeros_like(self.flat)
        grads, mean, square, n = unpack(flat, s), np.zeros_like(flat), np.zeros_like(flat), 0
        h = np.zeros((0, hidden), np.float32)
        lanes = min(LANES, max(16, len(symbols) // (300 * STEPS)))  # a small chunk still makes some hundred updates
        for x, y, starts, _, real in windows(symbols, lengths, s.top, lanes):
            h = h[: x.shape[1]] if len(h) else np.zeros((x.shape[1], hidden), np.float32)
            states, kept, h = self._run(x, starts, h)
            flat[:] = 0
            _, dh = self._outputs(states[real], y[real], grads)
            dstates = np.zeros(states.shape, np.float32)
            dstates[real] = dh
            da = np.zeros((*x.shape, 3 * hidden), np.float32)
            back = np.zeros((x.shape[1], hidden), np.float32)
            for t in range(len(x) - 1, -1, -1):
                before, z, r, c, gn = kept[t]
                d = dstates[t] + back
                dc = d * (1 - z) * (1 - c * c)
                dz = d * (before - c) * z * (1 - z)
                dr = dc * gn * r * (1 - r)
                da[t, :, :hidden], da[t, :, hidden : 2 * hidden], da[t, :, 2 * hidden :] = dz, dr, dc
                dg = np.concatenate([dz, dr, dc * r], axis=1)
                grads["u"] += before.T @ dg
                back = np.where(starts[t][:, None], np.float32(0), d * z + dg @ self.p["u"].T)
            order = np.argsort(x, axis=None, kind="stable")
            sorted_x = x.reshape(-1)[order]
            edges = np.flatnonzero(np.concatenate([[True], sorted_x[1:] != sorted_x[:-1]]))
            grads["x"][sorted_x[edges]] = np.add.reduceat(da.reshape(-1, 3 * hidden)[order], edges, axis=0)
            flat /= max(1, int(real.sum()))
            size = float(np.sqrt((flat * flat).sum()))
            if size > 1:
                flat /= size
            n += 1
            mean += 0.1 * (flat - mean)
            square += 0.01 * (flat * flat - square)
            self.flat -= rate * (mean / (1 - 0.9**n)) / (np.sqrt(square / (1 - 0.99**n)) + 1e-6)
