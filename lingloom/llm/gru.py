"""A small gated recurrent language model in numpy, with a class-factored output and truncated backpropagation.

Codes: 0 .. TOP-1 words of their own, in classes of PER_CLASS; then GROUPS classes of rarer words, GROUPS classes of words
seen once, and one code for unseen words. A word of the latter classes has its share of the class's counts as probability;
an unseen word has what each class of words seen once keeps for it.

Arrays are laid out with features along the first axis and tokens along the second, so that sums over features run over
whole rows; softmaxes are taken in stretches of tokens that stay in the cache.
"""

from __future__ import annotations

import heapq
import numpy as np

TOP, PER_CLASS, GROUPS = 4096, 64, 8
OWN_CLASSES = TOP // PER_CLASS
CLASSES = OWN_CLASSES + 2 * GROUPS
UNSEEN = TOP + 2 * GROUPS
START = UNSEEN + 1
HIDDEN = 16
#: name, shape of the parameters, in the order in which they are laid out flat
SHAPES = {
    "x": (3 * HIDDEN, START + 1),  # input, by code
    "u": (3 * HIDDEN, HIDDEN),  # recurrent
    "c": (CLASSES, HIDDEN),
    "cb": (CLASSES, 1),
    "o": (OWN_CLASSES, PER_CLASS, HIDDEN),
    "ob": (OWN_CLASSES, PER_CLASS, 1),
}
N_PARAMETERS = sum(int(np.prod(s)) for s in SHAPES.values())
#: Tokens of a stretch.
STRETCH = 2048
#: Updates that a call of train() makes at least, as far as its tokens go.
UPDATES = 16


def class_of(code: np.ndarray) -> np.ndarray:
    return np.where(code < TOP, code // PER_CLASS, code - TOP + OWN_CLASSES)


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(word_counts: np.ndarray, class_counts: np.ndarray, seed: int = 7) -> np.ndarray:
    """Parameters that give every word its training frequency, with small random weights."""
    flat = np.zeros(N_PARAMETERS, np.float32)
    p, rng = views(flat), np.random.default_rng(seed)
    for name, scale in (("x", 0.3), ("u", 0.2), ("c", 0.05), ("o", 0.05)):
        p[name][:] = rng.normal(0, scale, SHAPES[name])
    p["cb"][:, 0] = np.log(class_counts + 0.5)
    p["cb"][:] -= p["cb"].max()
    p["ob"][:, :, 0] = np.log(word_counts.reshape(OWN_CLASSES, PER_CLASS) + 0.01)
    p["ob"][:] -= p["ob"].max(1, keepdims=True)
    return flat


def step(p: dict, x: np.ndarray, h: np.ndarray) -> tuple:
    """The next state from the input part x of the gates, and what backpropagation needs."""
    g = p["u"] @ h
    zr = x[: 2 * HIDDEN] + g[: 2 * HIDDEN]
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += 1.0
    np.reciprocal(zr, out=zr)
    z, r, m = zr[:HIDDEN], zr[HIDDEN:], g[2 * HIDDEN :]
    n = r * m
    n += x[2 * HIDDEN :]
    n *= -2.0  # tanh by way of exp, which numpy has a faster form of
    np.exp(n, out=n)
    n += 1.0
    np.divide(2.0, n, out=n)
    n -= 1.0
    new = h - n
    new *= z
    new += n
    return new, z, r, m, n


def _softmax(a: np.ndarray, target: np.ndarray) -> np.ndarray:
    """a as probabilities, in place, and the log of each column's at target."""
    a -= a.max(0)
    own = a[target, np.arange(len(target))]
    np.exp(a, out=a)
    total = a.sum(0)
    a /= total
    return own - np.log(total)


def _by_class(own: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Tokens in order of their class, and the stretches of each class of words of their own in that order."""
    order = np.argsort(own.astype(np.int16), kind="stable")
    edges = np.searchsorted(own[order], np.arange(OWN_CLASSES + 1)).tolist()
    return order[: edges[-1]], [(k, slice(at, min(at + STRETCH, edges[k + 1]))) for k in range(OWN_CLASSES) for at in range(edges[k], edges[k + 1], STRETCH)]


def _with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.concatenate([weights, bias], -1)


def log_probabilities(p: dict, h: np.ndarray, target: np.ndarray, unseen: np.ndarray) -> np.ndarray:
    """Natural log of class times word of every target, without the unigram shares of rarer words. h: states with a last row
    of ones; unseen: the log of what each class of words seen once keeps for an unseen word."""
    own = class_of(target)
    out, room = np.empty(len(target), np.float32), np.empty(max(CLASSES, PER_CLASS) * STRETCH, np.float32)
    c, o, kept = _with_bias(p["c"], p["cb"]), _with_bias(p["o"], p["ob"]), np.exp(unseen)[:, None]
    for at in range(0, len(target), STRETCH):
        part = slice(at, min(at + STRETCH, len(target)))
        n = part.stop - at
        a = np.matmul(c, h[:, part], out=room[: CLASSES * n].reshape(CLASSES, n))
        out[part] = _softmax(a, np.minimum(own[part], CLASSES - 1))
        new = np.flatnonzero(target[part] == UNSEEN)
        if len(new):
            out[at + new] = np.log((a[OWN_CLASSES + GROUPS :, new] * kept).sum(0) + 1e-30)
    order, parts = _by_class(own)
    mine, word = np.take(h, order, axis=1), target[order]
    of_word = np.empty(len(order), np.float32)
    for k, part in parts:
        n = part.stop - part.start
        a = np.matmul(o[k], mine[:, part], out=room[: PER_CLASS * n].reshape(PER_CLASS, n))
        of_word[part] = _softmax(a, word[part] - k * PER_CLASS)
    out[order] += of_word
    return out


def in_lanes(lengths: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents dealt to lanes, one after the other, and lanes side by side in time: for every step's tokens in turn, the
    token's place in the documents' concatenation; the number of lanes at work at every step; whether a document begins."""
    heap = [(0, k) for k in range(min(lanes, len(lengths)))]
    dealt: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable").tolist():
        total, k = heapq.heappop(heap)
        dealt[k].append(d)
        heapq.heappush(heap, (total + int(lengths[d]), k))
    totals = np.zeros(len(heap), np.int64)
    for total, k in heap:
        totals[k] = total
    by_length = np.argsort(-totals, kind="stable")
    n_steps = int(totals.max(initial=0))
    at_work = np.searchsorted(-totals[by_length], -np.arange(n_steps), "left")
    offset = np.cumsum(at_work) - at_work
    first = np.cumsum(lengths) - lengths
    place, begins = np.empty(int(totals.sum()), np.int64), np.zeros(int(totals.sum()), bool)
    for column, k in enumerate(by_length.tolist()):
        docs = np.array(dealt[k], np.int64)
        n = lengths[docs]
        to = offset[: totals[k]] + column
        starts = np.cumsum(n) - n
        place[to] = np.repeat(first[docs] - starts, n) + np.arange(totals[k])
        begins[to[starts]] = True
    return place, at_work, begins


def score(flat: np.ndarray, codes: np.ndarray, lengths: np.ndarray, unseen: np.ndarray, lanes: int = 512, batch: int = 1 << 14) -> np.ndarray:
    """Natural log probability of every token of the documents laid end to end (codes, lengths); the state is carried from
    a document's first token to its last."""
    p = views(flat)
    place, at_work, begins = in_lanes(lengths, lanes)
    target = codes[place]
    before = np.where(begins, START, codes[np.maximum(place - 1, 0)])
    keep = (~begins).astype(np.float32)
    out = np.empty(len(codes), np.float32)
    h = np.zeros((HIDDEN, int(at_work[0]) if len(at_work) else 0), np.float32)
    edges = np.r_[0, np.cumsum(at_work)].tolist()
    first = 0
    while first < len(at_work):
        last = first + 1
        while last < len(at_work) and edges[last + 1] - edges[first] <= batch:
            last += 1
        low, high = edges[first], edges[last]
        x, held = np.take(p["x"], before[low:high], axis=1), np.ones((HIDDEN + 1, high - low), np.float32)
        for k in range(first, last):
            a, b = edges[k] - low, edges[k + 1] - low
            h = step(p, x[:, a:b], h[:, : b - a] * keep[low + a : low + b])[0]
            held[:HIDDEN, a:b] = h
        out[place[low:high]] = log_probabilities(p, held, target[low:high], unseen)
        first = last
    return out


def _gradient(p: dict, inputs: np.ndarray, targets: np.ndarray, begins: np.ndarray, h: np.ndarray, grad: dict) -> np.ndarray:
    """Writes the gradient of the mean loss of a window (steps x lanes) to grad; returns the state after it."""
    steps, lanes = inputs.shape
    x = np.take(p["x"], inputs.reshape(-1), axis=1).reshape(3 * HIDDEN, steps, lanes)
    goes_on = (~begins).astype(np.float32)
    kept, states = [], np.ones((HIDDEN + 1, steps, lanes), np.float32)
    for t in range(steps):
        h = h * goes_on[t]
        new, z, r, m, n = step(p, x[:, t], h)
        kept.append((h, z, r, m, n))
        states[:HIDDEN, t] = h = new
    flat, target = states.reshape(HIDDEN + 1, -1), targets.reshape(-1)
    share, own = np.float32(1.0 / len(target)), class_of(target)
    dh, room = np.empty((HIDDEN, len(target)), np.float32), np.empty(max(CLASSES, PER_CLASS) * STRETCH, np.float32)

    def backward(weights: np.ndarray, states: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the mean loss of a softmax: of its weights, with the bias, and of the states."""
        n = len(target)
        d = np.matmul(weights, states, out=room[: len(weights) * n].reshape(len(weights), n))
        _softmax(d, target)
        d[target, np.arange(n)] -= 1.0
        d *= share
        return d @ states.T, weights[:, :HIDDEN].T @ d

    c, of_c = _with_bias(p["c"], p["cb"]), 0.0
    for at in range(0, len(target), STRETCH):
        part = slice(at, at + STRETCH)
        of_weights, dh[:, part] = backward(c, flat[:, part], own[part])
        of_c = of_c + of_weights
    grad["c"][:], grad["cb"][:] = of_c[:, :HIDDEN], of_c[:, HIDDEN:]
    o, of_o = _with_bias(p["o"], p["ob"]), np.zeros((OWN_CLASSES, PER_CLASS, HIDDEN + 1), np.float32)
    order, parts = _by_class(own)
    mine, word, of_mine = np.take(flat, order, axis=1), target[order], np.empty((HIDDEN, len(order)), np.float32)
    for k, part in parts:
        of_weights, of_mine[:, part] = backward(o[k], mine[:, part], word[part] - k * PER_CLASS)
        of_o[k] += of_weights
    grad["o"][:], grad["ob"][:] = of_o[..., :HIDDEN], of_o[..., HIDDEN:]
    dh[:, order] += of_mine
    dh = dh.reshape(HIDDEN, steps, lanes)
    later, grad["u"][:] = np.zeros_like(h), 0.0
    dx, dg = np.empty((3 * HIDDEN, steps, lanes), np.float32), np.empty((3 * HIDDEN, lanes), np.float32)
    for t in range(steps - 1, -1, -1):
        old, z, r, m, n = kept[t]
        g = dh[:, t] + later
        dn = g * (1 - z) * (1 - n * n)
        dg[:HIDDEN] = g * (old - n) * z * (1 - z)
        dg[HIDDEN : 2 * HIDDEN] = dn * m * r * (1 - r)
        dg[2 * HIDDEN :] = dn
        dx[:, t] = dg
        dg[2 * HIDDEN :] *= r
        grad["u"] += dg @ old.T
        later = (g * z + p["u"].T @ dg) * goes_on[t]
    codes = inputs.reshape(-1)
    for k, row in enumerate(dx.reshape(3 * HIDDEN, -1)):
        grad["x"][k] = np.bincount(codes, weights=row, minlength=START + 1)
    return h


def train(flat: np.ndarray, codes: np.ndarray, begins: np.ndarray, lanes: int = 512, window: int = 16, rate: float = 0.01) -> np.ndarray:
    """One pass of Adam over the tokens, cut into lanes and windows; gradients stop at window borders, states do not. Where
    the lanes do not divide the tokens, some lanes begin with the last token of the one before."""
    flat = flat.copy()
    lanes = max(1, min(lanes, len(codes) // (window * UPDATES)))
    steps = -(-len(codes) // lanes)
    if not steps:
        return flat
    place = np.arange(steps)[:, None] + np.arange(lanes) * (len(codes) - steps) // max(1, lanes - 1)
    targets, starts = codes[place], begins[place]
    starts[0] = True
    inputs = np.where(starts, START, np.roll(targets, 1, axis=0))
    p, h = views(flat), np.zeros((HIDDEN, lanes), np.float32)
    first, second, gradient, scratch = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
    for i, at in enumerate(range(0, steps, window), 1):
        h = _gradient(p, inputs[at : at + window], targets[at : at + window], starts[at : at + window], h, views(gradient))
        gradient *= np.float32(min(1.0, 1.0 / (float(np.sqrt(gradient @ gradient)) + 1e-9)))
        first *= 0.9
        first += np.multiply(gradient, np.float32(0.1), out=scratch)
        gradient *= gradient
        second *= 0.99
        second += np.multiply(gradient, np.float32(0.01), out=scratch)
        np.sqrt(np.multiply(second, np.float32(1 / (1 - 0.99**i)), out=scratch), out=scratch)
        scratch += np.float32(1e-6)
        np.divide(first, scratch, out=scratch)
        scratch *= np.float32(rate / (1 - 0.9**i))
        flat -= scratch
    return flat
