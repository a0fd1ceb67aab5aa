"""A gated recurrent language model in numpy, with a class-factored softmax.

P(word | h) = P(class | h) P(word | class, h).  Frequent words sit in small
classes and rare ones in large, about as many classes as the root of the
number of words, so a token costs little however large the vocabulary is.
Documents run side by side in lanes; the state is carried from window to
window and starts anew with each document, so a document's log-likelihood is
that of its whole text, while gradients go back through one window at a time.
Arrays have features first and lanes last, so each gate is one block.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN = 16
WINDOW, LANES = 32, 512
#: Tokens whose classes are scored at once: they stay in the cache.
BLOCK = 2048
#: In training, longer documents are cut into parts that start with an empty state, so that no lane outlasts the others.
SEGMENT = 1024
RATE = 0.2
MATRICES = ("x", "u", "wc", "bc", "ww", "bw")


def class_edges(counts: np.ndarray, tails: int = 0) -> np.ndarray:
    """Where classes begin, and the number of entries at the end.

    counts: of words by falling frequency, and of the last ``tails`` entries,
    which are classes of their own.  The root of the counts is shared out evenly.
    """
    n = len(counts) - tails
    own = np.zeros(0, np.int64)
    if n:
        mass = np.cumsum(np.sqrt(np.maximum(counts[:n].astype(np.float64), 1)))
        k = max(1, round(n**0.5))
        number = np.minimum((mass / mass[-1] * k).astype(np.int64), k - 1)
        own = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    return np.concatenate([own, np.arange(n, len(counts) + 1)]).astype(np.int64)


def init(counts: np.ndarray, tails: int = 0, seed: int = 11) -> dict[str, np.ndarray]:
    """Parameters whose output is the unigram distribution, and Adagrad's sums of squares (names with a q before)."""
    rng = np.random.default_rng(seed)
    edges = class_edges(counts, tails)
    classes, words = len(edges) - 1, len(counts)
    p = np.maximum(counts.astype(np.float64), 0.5)
    by_class = np.add.reduceat(p, edges[:-1])
    f = lambda *shape, s: (rng.normal(size=shape) * s).astype(np.float32)
    out = {
        "x": f(words + 1, 3 * HIDDEN, s=0.3),  # what a word adds to the gates, biases included; the last row begins a text
        "u": f(3 * HIDDEN, HIDDEN, s=1 / np.sqrt(HIDDEN)),
        "wc": f(classes, HIDDEN, s=0.02),
        "bc": np.log(by_class / p.sum()).astype(np.float32),
        "ww": f(words, HIDDEN, s=0.02),
        "bw": np.log(p / np.repeat(by_class, np.diff(edges))).astype(np.float32),
    }
    return out | {f"q{k}": np.full_like(out[k], 1e-6) for k in MATRICES} | {"edges": edges}


def in_lanes(docs: list[np.ndarray], lanes: int, begin: int, segment: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(target, previous, document, fresh), steps by lanes, longest lane first.

    document is -1 where a lane has ended; previous is ``begin`` where a document begins; fresh where the state starts anew.
    """
    parts = [(d, a, min(len(x), a + (segment or len(x)))) for d, x in enumerate(docs) for a in range(0, len(x), segment or len(x))]
    lanes = max(1, min(lanes, len(parts)))
    heap = [(0, i) for i in range(lanes)]
    own: list[list[tuple[int, int, int]]] = [[] for _ in range(lanes)]
    for part in sorted(parts, key=lambda p: p[1] - p[2]):
        load, i = heapq.heappop(heap)
        own[i].append(part)
        heapq.heappush(heap, (load + part[2] - part[1], i))
    size = [sum(b - a for _, a, b in ps) for ps in own]
    order = sorted(range(lanes), key=lambda i: -size[i])
    shape = (max(size, default=0), lanes)
    target, previous, document, fresh = np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.full(shape, -1, np.int32), np.zeros(shape, bool)
    for lane, i in enumerate(order):
        at = 0
        for d, a, b in own[i]:
            n = b - a
            target[at : at + n, lane] = docs[d][a:b]
            previous[at, lane] = docs[d][a - 1] if a else begin
            previous[at + 1 : at + n, lane] = docs[d][a : b - 1]
            document[at : at + n, lane] = d
            fresh[at, lane] = True
            at += n
    return target, previous, document, fresh


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; by exp, which numpy has at a third of tanh's cost."""
    np.negative(x, x)
    np.exp(x, x)
    x += 1
    return np.reciprocal(x, x)


def _softmax(x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each column: the exponentials' sum, with the exponentials in x's place, and the log-probability of entry own."""
    every = np.arange(x.shape[1])
    x -= x.max(axis=0)
    lp = x[own, every]
    np.exp(x, x)
    s = x.sum(axis=0)
    lp -= np.log(s)
    return s, lp


def _error(x: np.ndarray, s: np.ndarray, own: np.ndarray, scale: np.float32) -> np.ndarray:
    """In place: the shares of the exponentials x, less one at own, times scale."""
    x *= scale / s
    x[own, np.arange(x.shape[1])] -= scale
    return x


def _forward(p: dict[str, np.ndarray], previous: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States of a window (HIDDEN, steps, lanes) and the last one; keep gets what the backward pass needs, in the same shape."""
    n1, n2 = HIDDEN, 2 * HIDDEN
    steps, lanes = previous.shape
    out = np.empty((HIDDEN, steps, lanes), h.dtype)
    if keep is not None:
        keep.update({k: np.empty_like(out) for k in ("h", "z", "r", "n", "hn")})
    gx = np.ascontiguousarray(p["x"][previous.ravel()].T).reshape(3 * HIDDEN, steps, lanes)
    starts = fresh.any(axis=1)
    for t in range(steps):
        if starts[t]:
            h = h * ~fresh[t]
        gh = p["u"] @ h
        zr = _sigmoid(gx[:n2, t] + gh[:n2])
        z, r, hn = zr[:n1], zr[n1:], gh[n2:]
        n = r * hn
        n += gx[n2:, t]
        n *= 2
        n = _sigmoid(n)
        n *= 2
        n -= 1
        if keep is not None:
            keep["h"][:, t], keep["z"][:, t], keep["r"][:, t], keep["n"][:, t], keep["hn"][:, t] = h, z, r, n, hn
        new = h - n
        new *= z
        new += n
        out[:, t] = h = new
    return out, h


def _backward(u: np.ndarray, keep: dict, fresh: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs (3 HIDDEN, steps, lanes) and of u; out: those of the states."""
    n1, n2 = HIDDEN, 2 * HIDDEN
    h, z, r, n, hn = (keep[k] for k in ("h", "z", "r", "n", "hn"))
    rest = 1 - z
    to_n = rest * (1 - n * n)
    rest *= z
    rest *= h - n  # to z
    to_r = (1 - r) * r
    to_r *= hn
    gx, gh = np.empty((3 * HIDDEN, *out.shape[1:]), out.dtype), np.empty((3 * HIDDEN, *out.shape[1:]), out.dtype)
    back = np.zeros_like(out[:, 0])
    starts = fresh.any(axis=1)
    for t in range(out.shape[1] - 1, -1, -1):
        back += out[:, t]
        own = gh[:, t]
        an = np.multiply(back, to_n[:, t], out=gx[n2:, t])
        np.multiply(back, rest[:, t], out=own[:n1])
        np.multiply(an, to_r[:, t], out=own[n1:n2])
        np.multiply(an, r[:, t], out=own[n2:])
        back *= z[:, t]
        back += u.T @ own
        if starts[t]:
            back *= ~fresh[t]
    gx[:n2] = gh[:n2]
    return gx, gh.reshape(3 * HIDDEN, -1) @ h.reshape(HIDDEN, -1).T


def _by_class(p: dict[str, np.ndarray], y: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where to find the tokens, class by class: order, the class of each, and where each class begins in it."""
    edges = p["edges"]
    number = np.repeat(np.arange(len(edges) - 1), np.diff(edges)).astype(np.uint16)
    c = np.where(on, number[y], np.uint16(65535))
    order = np.argsort(c, kind="stable")[: int(on.sum())]
    c = c[order]
    return order, c, np.searchsorted(c, np.arange(len(edges)))


def log_likelihoods(p: dict[str, np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """The natural log-likelihood of each document, an array of word numbers that isn't empty."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    target, previous, document, fresh = in_lanes(docs, LANES, len(p["bw"]))
    edges = p["edges"]
    h = np.zeros((HIDDEN, target.shape[1]), np.float32)
    with np.errstate(over="ignore"):
        for at in range(0, len(target), WINDOW):
            live = int((document[at] >= 0).sum())
            part = slice(at, at + WINDOW)
            states, h = _forward(p, previous[part, :live], fresh[part, :live], h[:, :live])
            y, d = target[part, :live].ravel(), document[part, :live].ravel()
            order, c, first = _by_class(p, y, d >= 0)
            s, y, d = states.reshape(HIDDEN, -1)[:, order], y[order], d[order]
            lp = np.empty(len(y))
            for a in range(0, len(y), BLOCK):
                x = p["wc"] @ s[:, a : a + BLOCK]
                x += p["bc"][:, None]
                lp[a : a + BLOCK] = _softmax(x, c[a : a + BLOCK])[1]
            for k in np.flatnonzero((first[1:] > first[:-1]) & (np.diff(edges) > 1)).tolist():
                a, b, e, f = first[k], first[k + 1], edges[k], edges[k + 1]
                x = p["ww"][e:f] @ s[:, a:b]
                x += p["bw"][e:f, None]
                lp[a:b] += _softmax(x, y[a:b] - e)[1]
            total += np.bincount(d, weights=lp, minlength=len(docs))
    return total


def gradients(p: dict[str, np.ndarray], target: np.ndarray, previous: np.ndarray, fresh: np.ndarray, on: np.ndarray, h: np.ndarray) -> tuple[dict[str, tuple], np.ndarray, float]:
    """By name, (rows, gradient) pairs over a window; the last state; and the summed log-likelihood.

    All windows are scaled alike, so the few lanes that outlast the others weigh no more than their tokens.
    """
    keep: dict = {}
    states, last = _forward(p, previous, fresh, h, keep)
    edges, scale = p["edges"], np.float32(1 / (WINDOW * LANES))
    order, c, first = _by_class(p, target.ravel(), on.ravel())
    s, y = states.reshape(HIDDEN, -1)[:, order], target.ravel()[order]
    g: dict[str, list] = {k: [] for k in MATRICES}
    total, ds = 0.0, np.empty_like(s)
    for a in range(0, len(y), BLOCK):
        part, own = s[:, a : a + BLOCK], c[a : a + BLOCK]
        x = p["wc"] @ part
        x += p["bc"][:, None]
        e, lp = _softmax(x, own)
        total += float(lp.sum())
        d = _error(x, e, own, scale)
        gw, gb = (d @ part.T, d.sum(axis=1)) if not a else (gw + d @ part.T, gb + d.sum(axis=1))
        ds[:, a : a + BLOCK] = p["wc"].T @ d
    g["wc"].append((slice(None), gw))
    g["bc"].append((slice(None), gb))
    for k in np.flatnonzero((first[1:] > first[:-1]) & (np.diff(edges) > 1)).tolist():
        a, b, rows = first[k], first[k + 1], slice(int(edges[k]), int(edges[k + 1]))
        w, part, own = p["ww"][rows], s[:, a:b], y[a:b] - rows.start
        x = w @ part
        x += p["bw"][rows, None]
        e, lp = _softmax(x, own)
        total += float(lp.sum())
        d = _error(x, e, own, scale)
        g["ww"].append((rows, d @ part.T))
        g["bw"].append((rows, d.sum(axis=1)))
        ds[:, a:b] += w.T @ d
    out = np.zeros((HIDDEN, states.shape[1] * states.shape[2]), ds.dtype)
    out[:, order] = ds
    out = out.reshape(states.shape)
    gx, gu = _backward(p["u"], keep, fresh, out)
    g["u"].append((slice(None), gu))
    words = previous.ravel()
    order = np.argsort(words.astype(np.uint16) if len(p["x"]) <= 65536 else words, kind="stable")
    words = words[order]
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    g["x"].append((words[first], np.add.reduceat(np.ascontiguousarray(gx.reshape(3 * HIDDEN, -1).T)[order], first, axis=0)))
    return g, last, total


class Trainer:
    """Adagrad over windows; batches of documents come as they are read."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = {k: v.copy() for k, v in p.items()}
        self.tokens = 0

    def learn(self, docs: list[np.ndarray]) -> float:
        """One pass; returns the mean log-likelihood of a token, each before it was learnt from."""
        if not docs:
            return 0.0
        p = self.p
        target, previous, document, fresh = in_lanes(docs, LANES, len(p["bw"]), SEGMENT)
        h = np.zeros((HIDDEN, target.shape[1]), np.float32)
        total = n = 0
        with np.errstate(over="ignore"):
            for at in range(0, len(target), WINDOW):
                live = int((document[at] >= 0).sum())
                part = slice(at, at + WINDOW)
                on = document[part, :live] >= 0
                g, h, ll = gradients(p, target[part, :live], previous[part, :live], fresh[part, :live], on, h[:, :live])
                total, n = total + ll, n + int(on.sum())
                for k, pairs in g.items():
                    for rows, v in pairs:
                        s = p[f"q{k}"][rows] + v * v
                        p[f"q{k}"][rows] = s
                        p[k][rows] -= RATE * v / np.sqrt(s)
        self.tokens += n
        return total / max(1, n)


def _names(p: dict[str, np.ndarray]) -> list[str]:
    return [k for k in sorted(p) if k != "edges"]


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in _names(p)])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """flat in the shapes of like."""
    out, at = {"edges": like["edges"]}, 0
    for k in _names(like):
        n = like[k].size
        out[k] = flat[at : at + n].astype(np.float32).reshape(like[k].shape)
        at += n
    return out
