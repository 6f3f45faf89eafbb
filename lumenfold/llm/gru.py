"""A gated recurrent language model in numpy: training by truncated backpropagation through
time, and log-likelihood of whole documents with the state carried across windows.

The output softmax is factored: a class of the next token, then the token in its class.  The
last class has one member, any word outside the model's vocabulary.
"""

from __future__ import annotations

import heapq

import numpy as np

KEYS = ("emb", "wx", "u", "b", "wc", "bc", "wo", "bo")


def fresh(counts: np.ndarray, rest: float, size: int, per_class: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters for words of these counts (a multiple of per_class), and `rest` further
    tokens; the output starts as the unigram distribution."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n_classes = len(counts) // per_class
    by_class = counts.reshape(n_classes, per_class) + 0.5
    mass = np.append(by_class.sum(axis=1), rest + 0.5)
    near = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {
        "emb": near(len(counts) + 1, size),
        "wx": near(size, 3 * size),
        "u": near(size, 3 * size),
        "b": np.zeros(3 * size, np.float32),
        "wc": near(size, n_classes + 1),
        "bc": np.log(mass / mass.sum()).astype(np.float32),
        "wo": near(n_classes, size, per_class),
        "bo": np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in KEYS])


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in KEYS:
        out[k] = np.asarray(values[at : at + like[k].size], np.float32).reshape(like[k].shape)
        at += like[k].size
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def lanes(lengths: np.ndarray, n: int) -> tuple[list[list[int]], np.ndarray]:
    """Documents dealt to at most n lanes of about equal length, longest lane first; their lengths."""
    heap = [(0, i, []) for i in range(min(n, max(1, len(lengths))))]
    for d in np.argsort(-lengths, kind="stable").tolist():
        total, i, docs = heapq.heappop(heap)
        docs.append(d)
        heapq.heappush(heap, (total + int(lengths[d]), i, docs))
    heap.sort(key=lambda x: (-x[0], x[1]))
    return [x[2] for x in heap], np.array([x[0] for x in heap])


def windows(tokens: np.ndarray, offsets: np.ndarray, end: int, n_lanes: int, steps: int):
    """Windows (given, wanted, first, place) of shape (steps, live lanes): the token before (the
    end mark at a start), the token, whether it starts a document, and its place in tokens.
    A window holds the lanes that have a token in its first step; place is -1 past a lane's end."""
    lengths = np.diff(offsets)
    dealt, totals = lanes(lengths, n_lanes)
    # places in the order of lanes, so that one very long lane takes no more than its tokens
    by_lane = [np.arange(offsets[d], offsets[d + 1]) for docs in dealt for d in docs]
    at = np.concatenate([*by_lane, np.zeros(1, np.int64)])
    base = np.cumsum(totals) - totals
    start = np.zeros(len(tokens) + 1, bool)
    start[offsets[:-1][lengths > 0]] = True
    before = np.concatenate([[end], tokens[:-1]]) if len(tokens) else tokens
    before = np.where(start[:-1], end, before)
    for t in range(0, int(totals[0]), steps):
        live = int((totals > t).sum())
        row = np.arange(t, min(t + steps, int(totals[0])))[:, None]
        p = np.where(row < totals[:live], at[np.minimum(base[:live] + row, len(at) - 1)], -1)
        q = np.maximum(p, 0)
        yield before[q], tokens[q], start[q] & (p >= 0), p


class Model:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        self.size = p["u"].shape[0]
        self.n_classes, _, self.per_class = p["wo"].shape

    def _states(self, h: np.ndarray, given: np.ndarray, first: np.ndarray, keep: bool):
        p, n = self.p, self.size
        x = p["emb"][given]
        gx = x @ p["wx"] + p["b"]
        out = np.empty((*given.shape, n), np.float32)
        trace = []
        for t in range(len(given)):
            if first[t].any():
                h = np.where(first[t][:, None], np.float32(0), h)
            hu = h @ p["u"]
            zr = _sigmoid(gx[t, :, : 2 * n] + hu[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = r * hu[:, 2 * n :]
            c += gx[t, :, 2 * n :]
            np.tanh(c, out=c)
            if keep:
                trace.append((h, zr, c, hu[:, 2 * n :]))
            h = h - c
            h *= z
            h += c
            out[t] = h
        return h, out, x, trace

    def _output(self, h: np.ndarray, wanted: np.ndarray, grad: bool):
        """Natural log-probability of each wanted token, for rows h; and gradients."""
        p, k = self.p, self.per_class
        n = len(wanted)
        cls = np.minimum(wanted // k, self.n_classes)
        logits = h @ p["wc"] + p["bc"]
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        total = e.sum(axis=1)
        rows = np.arange(n)
        score = logits[rows, cls] - np.log(total)
        g, dh = None, None
        if grad:
            d = e / total[:, None]
            d[rows, cls] -= 1
            g = {"wc": h.T @ d, "bc": d.sum(axis=0), "wo": np.zeros_like(p["wo"]), "bo": np.zeros_like(p["bo"])}
            dh = d @ p["wc"].T
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(self.n_classes + 1))
        for c in range(self.n_classes):
            own = order[edges[c] : edges[c + 1]]
            if not len(own):
                continue
            hc = h[own]
            logits = hc @ p["wo"][c] + p["bo"][c]
            logits -= logits.max(axis=1, keepdims=True)
            e = np.exp(logits)
            total = e.sum(axis=1)
            at, word = np.arange(len(own)), wanted[own] - c * k
            score[own] += logits[at, word] - np.log(total)
            if grad:
                d = e / total[:, None]
                d[at, word] -= 1
                g["wo"][c] = hc.T @ d
                g["bo"][c] = d.sum(axis=0)
                dh[own] += d @ p["wo"][c].T
        return score, g, dh

    def loss_and_grad(self, h, given, wanted, first, live):
        """(sum of negative log-probabilities, gradients, last state) of one window; live: which
        of its cells count."""
        p, n = self.p, self.size
        last, out, x, trace = self._states(h, given, first, True)
        cells = np.flatnonzero(live.ravel())
        score, g, dh_cells = self._output(out.reshape(-1, n)[cells], wanted.ravel()[cells], True)
        dh_out = np.zeros((live.size, n), np.float32)
        dh_out[cells] = dh_cells
        dh_out = dh_out.reshape(*live.shape, n)
        dg = np.empty((*given.shape, 3 * n), np.float32)
        dhu = np.empty_like(dg)
        dh = np.zeros_like(h)
        for t in range(len(given) - 1, -1, -1):
            before, zr, c, hun = trace[t]
            z, r = zr[:, :n], zr[:, n:]
            dh = dh + dh_out[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (before - c) * z * (1 - z)
            dr = dc * hun * r * (1 - r)
            dg[t, :, :n], dg[t, :, n : 2 * n], dg[t, :, 2 * n :] = dz, dr, dc
            dhu[t, :, : 2 * n] = dg[t, :, : 2 * n]
            dhu[t, :, 2 * n :] = dc * r
            dh *= z
            dh += dhu[t] @ p["u"].T
            if first[t].any():
                dh[first[t]] = 0
        befores = np.stack([x[0] for x in trace]).reshape(-1, n)
        g["u"] = befores.T @ dhu.reshape(-1, 3 * n)
        flat_dg = dg.reshape(-1, 3 * n)
        g["wx"] = x.reshape(-1, n).T @ flat_dg
        g["b"] = flat_dg.sum(axis=0)
        dx = flat_dg @ p["wx"].T
        ids = given.ravel()
        order = np.argsort(ids, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) > 0]))
        g["emb"] = np.zeros_like(p["emb"])
        g["emb"][ids[order][start]] = np.add.reduceat(dx[order], start, axis=0)
        return -float(score.sum(dtype=np.float64)), g, last

    def log_likelihood(self, tokens: np.ndarray, offsets: np.ndarray, end: int, n_lanes: int = 384, steps: int = 24) -> np.ndarray:
        """Natural log-probability of each token, the state carried through each document."""
        out = np.zeros(len(tokens))
        h = None
        for given, wanted, first, place in windows(tokens, offsets, end, n_lanes, steps):
            h = np.zeros((given.shape[1], self.size), np.float32) if h is None else h[: given.shape[1]]
            h, states, _, _ = self._states(h, given, first, False)
            cells = np.flatnonzero(place.ravel() >= 0)
            score, _, _ = self._output(states.reshape(-1, self.size)[cells], wanted.ravel()[cells], False)
            out[place.ravel()[cells]] = score
        return out


class Trainer:
    """Adam over windows of `steps` tokens; gradients stop at a window's start, states don't."""

    def __init__(self, p: dict[str, np.ndarray], rate: float = 0.01, n_lanes: int = 384, steps: int = 24):
        self.model = Model({k: v.copy() for k, v in p.items()})
        self.rate, self.n_lanes, self.steps = rate, n_lanes, steps
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.t, self.seen = 0, 0

    def learn(self, tokens: np.ndarray, offsets: np.ndarray, end: int) -> None:
        h = None
        for given, wanted, first, place in windows(tokens, offsets, end, self.n_lanes, self.steps):
            h = np.zeros((given.shape[1], self.model.size), np.float32) if h is None else h[: given.shape[1]]
            live = place >= 0
            _, g, h = self.model.loss_and_grad(h, given, wanted, first, live)
            n = int(live.sum())
            self.seen += n
            self.t += 1
            fix = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t) * min(1.0, n / 2048)
            for k, w in self.model.p.items():
                d = g[k] / np.float32(n)
                self.m[k] += np.float32(0.1) * (d - self.m[k])
                self.v[k] += np.float32(0.001) * (d * d - self.v[k])
                w -= np.float32(fix) * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-8))
