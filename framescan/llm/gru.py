"""A gated recurrent language model over word ids, in numpy.

Tokens come as three numbers: ``inp`` (row of the input table), ``cls`` (its
output class) and ``word`` (its place among the words of a head class, -1 for
tail classes).  The state before a token predicts its class by softmax and, in
a head class, the word within the class by a second softmax.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 1024  # rows of logits that stay in the cache


@dataclass
class Shape:
    n_inputs: int
    n_classes: int
    n_head: int  # head classes come first
    per_class: int
    hidden: int = 24


def start(shape: Shape, class_counts: np.ndarray, word_counts: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights; biases that give each class and head word its share in the counts."""
    rng = np.random.default_rng(seed)
    h = shape.hidden
    words = np.log(np.maximum(word_counts, 0.5)).reshape(shape.n_head, shape.per_class)
    words[word_counts.reshape(words.shape) <= 0] = -30.0
    p = {  # x, u: update gate, reset gate, candidate
        "x": rng.normal(0, 0.3, (3, shape.n_inputs, h)),
        "u": rng.normal(0, 1 / np.sqrt(h), (3, h, h)),
        "c": rng.normal(0, 0.05, (h, shape.n_classes)),
        "cb": np.log(np.maximum(class_counts, 0.5) / max(1.0, class_counts.sum())),
        "w": rng.normal(0, 0.05, (shape.n_head, h, shape.per_class)),
        "wb": words - np.log(np.exp(words).sum(axis=1, keepdims=True)),
    }
    p["x"][0] -= 1.0  # gates begin rather closed
    return {k: v.astype(np.float32) for k, v in p.items()}


def _step(u: np.ndarray, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the next state, the candidate's recurrent part); ``x``, the inputs' rows, becomes the gates and the candidate."""
    from_state = np.matmul(h, u)
    gates, c = x[:2], x[2]
    gates += from_state[:2]
    gates *= 0.5
    np.tanh(gates, out=gates)  # the logistic function
    gates *= 0.5
    gates += 0.5
    c += gates[1] * from_state[2]
    np.tanh(c, out=c)
    new = c - h
    new *= gates[0]
    new += h
    return new, from_state[2]


def _bounded(states: np.ndarray, *weights: np.ndarray) -> bool:
    """Whether no logit of the states can be so large that its exponential overflows; the weights' columns with their bias in the last row."""
    longest = np.sqrt(np.einsum("ij,ij->i", states, states).max(initial=0))
    return all(longest * np.sqrt(np.einsum("...ij,...ij->...j", w, w).max(initial=0)) < 80 for w in weights)


def _with_one(states: np.ndarray) -> np.ndarray:
    """The states with a one each, for the bias."""
    out = np.empty((len(states), states.shape[1] + 1), states.dtype)
    out[:, :-1] = states
    out[:, -1] = 1
    return out


def _joined(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classes and of the head words, the bias in the last row."""
    return np.concatenate([p["c"], p["cb"][None]]), np.concatenate([p["w"], p["wb"][:, None]], axis=1)


def _exp_sums(logits: np.ndarray, at: np.ndarray, bounded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability of one column a row, row sums); ``logits`` become their exponentials, up to a factor a row."""
    if not bounded and not (np.abs(logits).max(initial=0) < 80):  # else no exponential can overflow
        logits -= logits.max(axis=1, keepdims=True)
    chosen = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], logits.dtype)
    return chosen - np.log(sums), sums


def _softmax_gradient(logits: np.ndarray, at: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
    """(the loss of each row, a factor of each row); ``logits`` times the factors become its gradient."""
    log, sums = _exp_sums(logits, at, bounded)
    logits[np.arange(len(at)), at] -= sums
    return -log, (1 / sums)[:, None]


def _head_blocks(cls: np.ndarray, n_head: int, size: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, rows, which of them are real) of blocks of ``size`` rows; all rows of head classes are in one block each, by class."""
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    counts = np.bincount(cls, minlength=n_head)[:n_head]
    blocks = -(-counts // size)
    kinds = np.repeat(np.arange(n_head), blocks)
    ends = np.cumsum(counts)
    within = np.arange(len(kinds)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = ((ends - counts)[kinds] + within * size)[:, None] + np.arange(size)
    return kinds, order[np.minimum(at, len(cls) - 1)], at < ends[kinds][:, None]


def _segment_sums(rows: np.ndarray, first: np.ndarray, few: int = 8) -> np.ndarray:
    """Sums of the rows from each of ``first`` to the next; segments of a few rows are added together, longer ones one by one."""
    n = np.diff(first, append=len(rows))
    out = rows[first]
    for j in range(1, few):
        more = np.flatnonzero(n > j)
        if not len(more):
            break
        out[more] += rows[first[more] + j]
    for i in np.flatnonzero(n > few).tolist():
        out[i] = rows[first[i] : first[i] + n[i]].sum(axis=0)
    return out


def _by_class(cls: np.ndarray, n_head: int):
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(n_head + 1))
    for k in range(n_head):
        if bounds[k] < bounds[k + 1]:
            yield k, order[bounds[k] : bounds[k + 1]]


def log_probs(p: dict[str, np.ndarray], states: np.ndarray, cls: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Natural log-probability of each token's class, and word in a head class, given the state before it."""
    out = np.empty(len(cls), np.float64)
    states, (c, w) = _with_one(states), _joined(p)
    bounded = _bounded(states, c, w)
    room = np.empty((BLOCK, c.shape[1]), states.dtype)
    for i in range(0, len(cls), BLOCK):
        part = slice(i, i + BLOCK)
        logits = np.matmul(states[part], c, out=room[: len(cls) - i])
        out[part] = _exp_sums(logits, cls[part], bounded)[0]
    for k, rows in _by_class(cls, len(w)):
        out[rows] += _exp_sums(states[rows] @ w[k], word[rows], bounded)[0]
    return out


def score(p: dict[str, np.ndarray], docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], window: int = 32, group: int = 2048) -> np.ndarray:
    """Natural log-probability of each document (inp, cls, word arrays), the state carried from window to window."""
    total = np.zeros(len(docs))
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i][0]))
    for g in range(0, len(order), group):
        ids = order[g : g + group]
        lengths = np.array([len(docs[i][0]) for i in ids])
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        inp, cls, word = (np.concatenate([docs[i][k] for i in ids]) for k in range(3))
        h = np.zeros((len(ids), p["u"].shape[-1]), p["u"].dtype)
        for t0 in range(0, int(lengths[0]) if len(lengths) else 0, window):
            states, at, owner = [], [], []
            for t in range(t0, min(t0 + window, int(lengths[0]))):
                n = int(np.searchsorted(-lengths, -t, side="left"))  # documents longer than t
                h = h[:n]
                states.append(h)
                at.append(first[:n] + t)
                owner.append(n)
                h = _step(p["u"], h, p["x"].take(inp[at[-1]], axis=1))[0]
            where = np.concatenate(at)
            log = log_probs(p, np.concatenate(states), cls[where], word[where])
            who = np.concatenate([np.arange(n) for n in owner])
            total[ids[: owner[0]]] += np.bincount(who, log, owner[0])
    return total


def gradients(p: dict[str, np.ndarray], h: np.ndarray, inp: np.ndarray, cls: np.ndarray, word: np.ndarray, fresh: np.ndarray):
    """Loss (sum), gradients and last state of one window; arrays are steps x streams. ``fresh``: a document begins, the state is cleared.  The gradient of the inputs' rows is given for the rows met only, listed before the state."""
    steps, streams = inp.shape
    n = h.shape[1]
    u = p["u"]
    gates = np.ascontiguousarray(p["x"].transpose(1, 0, 2).take(inp.ravel(), axis=0).transpose(1, 0, 2)).reshape(3, steps, streams, n)
    any_fresh = fresh.any(axis=1)
    before, recurrent = np.empty((steps, streams, n), u.dtype), np.empty((steps, streams, n), u.dtype)
    for t in range(steps):
        before[t] = h
        if any_fresh[t]:
            before[t, fresh[t]] = 0
        h, recurrent[t] = _step(u, before[t], gates[:, t])
    states = before.reshape(-1, n)
    flat_cls, flat_word = cls.ravel(), word.ravel()
    g = {"u": None}
    d_states = np.empty_like(states)
    loss = 0.0
    with_one, (c, w) = _with_one(states), _joined(p)
    bounded = _bounded(with_one, c, w)
    by_class = np.zeros_like(c)
    room = np.empty((BLOCK, c.shape[1]), u.dtype)
    for i in range(0, len(states), BLOCK):
        part = slice(i, i + BLOCK)
        d = np.matmul(with_one[part], c, out=room[: len(states) - i])
        log, factor = _softmax_gradient(d, flat_cls[part], bounded)
        loss += float(log.sum())
        by_class += (with_one[part] * factor).T @ d
        np.matmul(d, p["c"].T, out=d_states[part])
        d_states[part] *= factor
    g["c"], g["cb"] = by_class[:-1], by_class[-1]
    by_word = np.zeros_like(w)
    kinds, rows, real = _head_blocks(flat_cls, len(w))
    if len(kinds):  # all head classes at once
        held, own_w = with_one[rows], w[kinds]
        d = np.matmul(held, own_w)
        log, factor = _softmax_gradient(d.reshape(-1, d.shape[2]), flat_word[rows].ravel(), bounded)
        loss += float((log * real.ravel()).sum())
        d *= factor.reshape(real.shape)[:, :, None] * real[:, :, None]
        starts = np.flatnonzero(np.diff(kinds, prepend=-1))
        by_word[kinds[starts]] = _segment_sums(np.matmul(held.transpose(0, 2, 1), d), starts)
        d_states[rows[real]] += np.matmul(d, own_w[:, :-1].transpose(0, 2, 1))[real]
    g["w"], g["wb"] = by_word[:, :-1], by_word[:, -1]
    d_states = d_states.reshape(steps, streams, n)
    z, r, c = gates
    keep = 1 - z
    by_z = (c - before) * z * keep
    by_c = z * (1 - c * c)
    by_r = recurrent * r * (1 - r)
    d_h = np.zeros((streams, n), u.dtype)
    d_u = np.empty((steps, streams, 3 * n), u.dtype)  # of what the state adds to the gates and the candidate
    d_in = np.empty_like(d_u)  # of the inputs' rows
    back = u.transpose(0, 2, 1).reshape(3 * n, n)
    for t in range(steps - 1, -1, -1):
        at_u, d_c = d_u[t], d_in[t, :, 2 * n :]
        np.multiply(d_h, by_c[t], out=d_c)
        np.multiply(d_h, by_z[t], out=at_u[:, :n])
        np.multiply(d_c, by_r[t], out=at_u[:, n : 2 * n])
        np.multiply(d_c, r[t], out=at_u[:, 2 * n :])
        d_h *= keep[t]
        d_h += d_states[t]
        d_h += at_u @ back
        if any_fresh[t]:
            d_h[fresh[t]] = 0
    d_in[:, :, : 2 * n] = d_u[:, :, : 2 * n]
    g["u"] = (states.T @ d_u.reshape(-1, 3 * n)).reshape(n, 3, n).transpose(1, 0, 2)
    order = np.argsort(inp.ravel().astype(np.uint16 if len(p["x"][0]) <= 1 << 16 else np.int32), kind="stable")
    own, first = np.unique(inp.ravel()[order], return_index=True)
    g["x"] = _segment_sums(d_in.reshape(-1, 3 * n).take(order, axis=0), first).reshape(-1, 3, n).transpose(1, 0, 2)
    return loss, g, own, h


def _streams(lengths: list[int], streams: int, window: int) -> tuple[np.ndarray, int]:
    """(first token of each stream and the end, whole steps): streams differ by one token at most, so that none is left over."""
    total = sum(lengths)
    streams = max(1, min(streams, total // window))
    steps, more = divmod(total, streams)
    return np.arange(streams) * steps + np.minimum(np.arange(streams), more), steps


def train(p: dict[str, np.ndarray], docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], streams: int = 128, window: int = 16, rate: float = 0.2) -> dict[str, np.ndarray]:
    """One pass of truncated backpropagation with Adagrad over every token of the documents, joined to ``streams`` long streams."""
    p = {k: v.copy() for k, v in p.items()}
    if not docs:
        return p
    lengths = [len(d[0]) for d in docs]
    inp, cls, word = (np.concatenate([d[k] for d in docs]) for k in range(3))
    first, steps = _streams(lengths, streams, window)
    fresh = np.zeros(len(inp), bool)
    fresh[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = True
    fresh[first] = True
    rows = np.ascontiguousarray(p["x"].transpose(1, 0, 2))  # a word's three rows side by side
    p["x"] = rows.transpose(1, 0, 2)
    seen = {k: np.full_like(rows if k == "x" else v, 1e-2) for k, v in p.items()}
    h = np.zeros((len(first), p["u"].shape[-1]), np.float32)

    def learn(h: np.ndarray, at: np.ndarray) -> np.ndarray:
        a = [x[at] for x in (inp, cls, word, fresh)]
        _, g, own, h = gradients(p, h, *a)
        scale = np.float32(100 / at.size)
        for k, v in g.items():
            weights, at_rows = p[k], slice(None)
            if k == "x":  # the input rows of other words have no gradient
                weights, at_rows, v = rows, own, v.transpose(1, 0, 2)
            v *= scale  # sums of a window's tokens, per hundred
            np.clip(v, -1, 1, out=v)
            root = seen[k][at_rows]
            root = root + v * v
            seen[k][at_rows] = root
            v *= np.float32(rate)
            v /= np.sqrt(root)
            weights[at_rows] -= v
        return h

    for t in range(0, steps, window):
        h = learn(h, first + np.arange(t, min(t + window, steps))[:, None])
    more = len(inp) - steps * len(first)  # the first streams have one token more
    if more:
        learn(h[:more], first[None, :more] + steps)
    p["x"] = np.ascontiguousarray(p["x"])
    return p
