"""A gated recurrent language model in numpy with a class-factored output, for words in the order of their ids.

Ids: 0 .. WORDS - 1 are frequent words (0 ends a text), then one id for each class of rarer words. The output is
a softmax over classes, then, for frequent words, one over the words of the class; how probable a rarer word is
within its class does not depend on the state and is left to the caller.
"""

from __future__ import annotations

import numpy as np

WORDS = 2048
SIZE = 64  # frequent words in a class; class k holds the ids k * SIZE and following
FREQUENT = WORDS // SIZE
RARE = 96  # classes of rarer words
CLASSES = FREQUENT + RARE
EMBED = 16
STATE = 24
WINDOW = 32  # steps through which errors are carried back
STREAMS = 128  # pieces of a stream side by side, at most; fewer where each would have under STEPS windows
STEPS = 32
SHAPES = {
    "embed": (WORDS + RARE, EMBED),
    "gates_in": (EMBED, 3 * STATE),
    "gates_state": (STATE, 3 * STATE),
    "gates_bias": (3 * STATE,),
    "class_out": (STATE, CLASSES),
    "class_bias": (CLASSES,),
    "word_out": (WORDS, STATE),
    "word_bias": (WORDS,),
}
PARAMETERS = sum(int(np.prod(s)) for s in SHAPES.values())


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the parameters in one flat array."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def start(word_counts: np.ndarray, rare_counts: np.ndarray, seed: int = 11) -> np.ndarray:
    """Parameters whose output is the distribution of single words, whatever the state."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(PARAMETERS, np.float32)
    p = unpack(flat)
    for name in ("embed", "gates_in", "gates_state"):
        p[name][:] = rng.normal(0, SHAPES[name][0] ** -0.5 if name != "embed" else 0.5, SHAPES[name])
    p["gates_bias"][:STATE] = 1.0  # keep the state at first
    words = word_counts + 0.5
    groups = words.reshape(FREQUENT, SIZE).sum(axis=1)
    p["word_bias"][:] = np.log(words)
    p["class_bias"][:] = np.log(np.concatenate([groups, rare_counts + 0.5]))
    p["class_bias"] -= p["class_bias"].max()
    return flat


def classes_of(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < WORDS, ids // SIZE, ids - WORDS + FREQUENT)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def gate_table(p: dict[str, np.ndarray]) -> np.ndarray:
    return p["embed"] @ p["gates_in"] + p["gates_bias"]


def _gate_inputs(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The inputs' part of the gates for `ids` (steps, streams), as (steps, gates, streams)."""
    rows = table.take(ids.reshape(-1), axis=0).reshape(*ids.shape, 3 * STATE)
    return np.ascontiguousarray(rows.transpose(0, 2, 1))


def advance(state: np.ndarray, a: np.ndarray, u: np.ndarray) -> np.ndarray:
    """One step: the next state from the input's part of the gates and the state, a row a stream.

    Fastest on transposed arrays, where the slices of each gate lie together.
    """
    s = (u.T @ state.T).T
    zr = _sigmoid(a[:, : 2 * STATE] + s[:, : 2 * STATE])
    new = np.tanh(a[:, 2 * STATE :] + zr[:, STATE:] * s[:, 2 * STATE :])
    return new + zr[:, :STATE] * (state - new)


def _logits(states: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Outputs less the largest of each column; a column a state."""
    x = weights @ states
    x += bias[:, None]
    x -= x.max(axis=0)
    return x


def _grouped(of: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Places of the frequent words in order of class, and each class with its range there."""
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(FREQUENT + 1)).tolist()
    return order[: cuts[-1]], [(k, cuts[k], cuts[k + 1]) for k in range(FREQUENT) if cuts[k] < cuts[k + 1]]


def log_likelihood(p: dict[str, np.ndarray], states: np.ndarray, ids: np.ndarray, rows: int = 4096) -> np.ndarray:
    """Natural log-probability of each id after its state: of the class, and of a frequent word within it.

    Worked through `rows` at a time, which fit a cache.
    """
    out = np.empty(len(ids), np.float32)
    weights = np.ascontiguousarray(p["class_out"].T)
    for at in range(0, len(ids), rows):
        h, part = states[at : at + rows].T, ids[at : at + rows]
        of = classes_of(part)
        x = _logits(h, weights, p["class_bias"])
        ll = x[of, np.arange(len(part))]
        ll -= np.log(np.exp(x, out=x).sum(axis=0))
        order, groups = _grouped(of)
        h, words, within = h[:, order], part[order], np.empty(len(order), np.float32)
        for k, a, b in groups:
            own = slice(k * SIZE, (k + 1) * SIZE)
            x = _logits(h[:, a:b], p["word_out"][own], p["word_bias"][own])
            within[a:b] = x[words[a:b] - k * SIZE, np.arange(b - a)]
            within[a:b] -= np.log(np.exp(x, out=x).sum(axis=0))
        ll[order] += within
        out[at : at + rows] = ll
    return out


def score(flat: np.ndarray, texts: list[np.ndarray], together: int = 512, window: int = 64) -> np.ndarray:
    """Natural log-probability of each text (ids, the last one 0) under the model, classes of rare words only.

    Texts of like length run side by side; the state goes on from window to window until a text ends.
    """
    p = unpack(flat)
    table, u = gate_table(p), p["gates_state"]
    total = np.zeros(len(texts))
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(texts), together):
        group = order[at : at + together]
        size = lengths[group]  # falling
        state, before = np.zeros((STATE, len(group)), np.float32).T, np.zeros(len(group), np.int64)
        for left in range(0, int(size[0]), window):
            live = int(np.searchsorted(-size, -left, side="left"))  # texts longer than `left`
            width = int(min(window, size[0] - left))
            ids = np.full((width, live), -1, np.int64)
            for j in range(live):
                part = texts[group[j]][left : left + width]
                ids[: len(part), j] = part
            before = before[:live]
            seen = np.vstack([before[None], np.maximum(ids[:-1], 0)])
            inputs, states = _gate_inputs(table, seen), np.zeros((STATE, width, live), np.float32)
            for t in range(width):
                # texts that have ended stay at the right and are cut off
                n = int(np.searchsorted(-size[:live], -(left + t), side="left"))
                if n < len(state):
                    state = np.asfortranarray(state[:n])
                state = advance(state, inputs[t, :, :n].T, u)
                states[:, t, :n] = state.T
            before = np.maximum(ids[-1], 0)
            row, col = np.nonzero(ids >= 0)
            ll = log_likelihood(p, states[:, row, col].T, ids[row, col])
            total[group[:live]] += np.bincount(col, ll, live)
    return total


def _softmax_errors(x: np.ndarray, right: np.ndarray, share: float) -> np.ndarray:
    """Gradients at the outputs `x` (a column a state), in place; `right` is the output that came."""
    np.exp(x, out=x)
    x *= share / x.sum(axis=0)
    x[right, np.arange(len(right))] -= share
    return x


def _errors(p: dict, states: np.ndarray, ids: np.ndarray, grad: dict) -> np.ndarray:
    """Gradients of the mean loss over the outputs; adds those of the output weights, hands back the states'.

    States are columns, here and in what is handed back.
    """
    share, of = np.float32(1 / len(ids)), classes_of(ids)
    d = _softmax_errors(_logits(states, np.ascontiguousarray(p["class_out"].T), p["class_bias"]), of, share)
    grad["class_out"] += states @ d.T
    grad["class_bias"] += d.sum(axis=1)
    back = p["class_out"] @ d
    order, groups = _grouped(of)
    h, words = states[:, order], ids[order]
    inner = np.empty_like(h)
    for k, a, b in groups:
        own = slice(k * SIZE, (k + 1) * SIZE)
        w = p["word_out"][own]
        d = _softmax_errors(_logits(h[:, a:b], w, p["word_bias"][own]), words[a:b] - k * SIZE, share)
        grad["word_out"][own] += d @ h[:, a:b].T
        grad["word_bias"][own] += d.sum(axis=1)
        inner[:, a:b] = w.T @ d
    back[:, order] += inner
    return back


def train(flat: np.ndarray, stream: np.ndarray, rate: float) -> np.ndarray:
    """One pass of truncated backpropagation over a stream of texts (ids, each text ending with 0), by Adam.

    The stream is cut into up to STREAMS pieces side by side, filled up from its start, so that every id is learnt.
    States go on from window to window, errors only back to a window's start; a state is cleared where a text ends.
    """
    flat = flat.copy()
    if not len(stream):
        return flat
    streams = min(STREAMS, max(min(32, len(stream)), len(stream) // (WINDOW * STEPS)))
    length = -(-len(stream) // streams)
    y = np.resize(stream, streams * length)
    x = np.concatenate([[0], y[:-1]]).reshape(streams, length).T
    y = y.reshape(streams, length).T
    p = unpack(flat)
    m, v, step = np.zeros_like(flat), np.zeros_like(flat), 0
    state = np.zeros((STATE, streams), np.float32)
    for left in range(0, length, WINDOW):
        xs, ys = x[left : left + WINDOW], y[left : left + WINDOW]
        width = len(xs)
        u_t = np.ascontiguousarray(p["gates_state"].T)
        carries_on = (xs != 0).astype(np.float32)
        gates = _gate_inputs(gate_table(p), xs)  # becomes what the gates let through
        z, r, new = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :]
        olds, subs, states = (np.empty((width, STATE, streams), np.float32) for _ in range(3))
        for t in range(width):
            old = np.multiply(state, carries_on[t], out=olds[t])
            s, zr = u_t @ old, gates[t, : 2 * STATE]
            zr += s[: 2 * STATE]
            zr[:] = _sigmoid(zr)
            subs[t] = s[2 * STATE :]
            new[t] += r[t] * subs[t]
            np.tanh(new[t], out=new[t])
            state = np.add(new[t], z[t] * (old - new[t]), out=states[t])
        step_grad = np.zeros_like(flat)
        grad = unpack(step_grad)
        columns = np.ascontiguousarray(states.transpose(1, 0, 2)).reshape(STATE, -1)
        outer = _errors(p, columns, ys.reshape(-1), grad).reshape(STATE, width, streams)
        to_new, to_z, to_r = (1 - z) * (1 - new * new), (olds - new) * z * (1 - z), subs * r * (1 - r)
        carried = np.zeros((STATE, streams), np.float32)
        inputs, through = np.empty_like(gates), np.empty_like(gates)
        for t in range(width - 1, -1, -1):
            dh, da, ds = outer[:, t] + carried, inputs[t], through[t]
            np.multiply(dh, to_z[t], out=da[:STATE])
            dn = np.multiply(dh, to_new[t], out=da[2 * STATE :])
            np.multiply(dn, to_r[t], out=da[STATE : 2 * STATE])
            ds[: 2 * STATE] = da[: 2 * STATE]
            np.multiply(dn, r[t], out=ds[2 * STATE :])
            carried = (dh * z[t] + p["gates_state"] @ ds) * carries_on[t]
        grad["gates_state"] += np.matmul(olds, through.transpose(0, 2, 1)).sum(axis=0)
        da, ids = np.ascontiguousarray(inputs.transpose(0, 2, 1)).reshape(-1, 3 * STATE), xs.reshape(-1)
        grad["gates_bias"] += da.sum(axis=0)
        grad["gates_in"] += p["embed"].take(ids, axis=0).T @ da
        cells = (ids[:, None] * EMBED + np.arange(EMBED)).reshape(-1)
        grad["embed"] += np.bincount(cells, (da @ p["gates_in"].T).reshape(-1), p["embed"].size).reshape(-1, EMBED)
        norm = float(np.sqrt((step_grad**2).sum()))
        step_grad *= min(1.0, 1.0 / (norm + 1e-9))
        step += 1
        m += 0.1 * (step_grad - m)
        v += 0.01 * (step_grad**2 - v)
        flat -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return flat
