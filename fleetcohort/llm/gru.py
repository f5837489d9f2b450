"""Gated recurrent language model in numpy: class-factored softmax, truncated backpropagation.

Words are numbered by falling frequency. The first ``n_own`` have an input vector and output
weights of their own; the others share those of their class, and within such a class a word's
probability is its share of the class's counts. The last class stands for all words without a
number. P(word) = P(class | state) * P(word | class, state).

Documents run in lanes, one after another; the state is zero where a document begins and is
carried from window to window inside it, so a document of any length is read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN, WINDOW, RATE = 16, 16, 0.08
#: What Adagrad's sums of squares start at. Many lanes make gradients small, so this is smaller.
LEAST_SQUARES = 1e-8
OWN_CLASSES, SHARED_CLASSES = 14, 8
F32 = np.float32


def classes_of(counts: np.ndarray, n_own: int, own_classes: int, shared_classes: int) -> np.ndarray:
    """Class of each numbered word: neighbours in frequency, classes of like summed root."""
    out = []
    base = 0
    for part, wanted in ((counts[:n_own], own_classes), (counts[n_own:], shared_classes)):
        if not len(part):
            continue
        mass = np.cumsum(np.sqrt(np.maximum(part.astype(float), 1e-9)))
        number = np.minimum((mass / mass[-1] * wanted).astype(np.int64), wanted - 1)
        _, number = np.unique(number, return_inverse=True)  # no empty classes
        out.append(number + base)
        base += int(number.max()) + 1
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


@dataclass
class Layout:
    """What is fixed before learning: classes, their members, shares inside shared classes."""

    counts: np.ndarray  # of the numbered words, falling
    n_own: int
    unnumbered: float  # tokens without a number

    def __post_init__(self) -> None:
        n_own = self.n_own = min(self.n_own, len(self.counts))
        self.of_word = classes_of(self.counts, n_own, OWN_CLASSES, SHARED_CLASSES)
        self.own_classes = int(self.of_word[:n_own].max()) + 1 if n_own else 0
        self.rest = int(self.of_word.max()) + 1 if len(self.counts) else 0  # the last class
        self.n_classes = self.rest + 1
        self.low = np.searchsorted(self.of_word[:n_own], np.arange(self.own_classes))
        self.high = np.searchsorted(self.of_word[:n_own], np.arange(self.own_classes), side="right")
        totals = np.bincount(self.of_word, weights=self.counts, minlength=self.n_classes)
        totals[self.rest] = self.unnumbered + 1
        self.totals = totals
        # Only an end token that no training document has is counted zero times.
        seen = np.maximum(self.counts, 0.5)
        self.log_share = np.log(seen / np.maximum(totals[self.of_word], 0.5))
        # Input row of each numbered word; words of shared classes share a row.
        self.row = np.where(
            np.arange(len(self.counts)) < n_own,
            np.arange(len(self.counts)),
            n_own + self.of_word - self.own_classes,
        )
        self.n_rows = n_own + self.n_classes - self.own_classes

    def rows(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= 0, self.row[ids] if len(self.row) else 0, self.n_rows - 1)

    def classes(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= 0, self.of_word[ids] if len(self.of_word) else 0, self.rest)


NAMES = ["x", "u", "wc", "bc", "wo", "bo"]


def start(layout: Layout, seed: int = 3, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """First parameters: small random weights; biases that give the words' overall shares."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(F32)
    share = np.maximum(layout.totals, 0.5) / layout.totals.sum()
    return {
        "x": small(layout.n_rows, 3 * hidden),
        "u": small(hidden, 3 * hidden) * F32(2),
        "wc": small(hidden, layout.n_classes) * F32(0.1),
        "bc": np.log(share).astype(F32),
        "wo": small(layout.n_own, hidden) * F32(0.1),
        "bo": np.log(np.maximum(layout.counts[: layout.n_own], 1)).astype(F32),
    }


def lanes(texts: list[np.ndarray], wanted: int) -> list[list[int]]:
    """Documents dealt to lanes, the longest first to the shortest lane; longest lane first."""
    import heapq

    n = max(1, min(wanted, len(texts)))
    heap = [(0, k) for k in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        total, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (total + len(texts[i]), k))
    return sorted(out, key=lambda own: -sum(len(texts[i]) for i in own))


def _laid_out(layout: Layout, texts: list[np.ndarray], wanted: int):
    """All lanes side by side, each array of steps by lanes: ids (-3 past a lane's end), their
    classes, input rows (``n_rows`` where a document begins) and documents; and lanes' sizes."""
    dealt = lanes(texts, wanted)
    sizes = np.array([sum(len(texts[i]) for i in own) for own in dealt], dtype=np.int64)
    ids, docs = (np.full((len(dealt), int(sizes[0])), -3, dtype=np.int32) for _ in range(2))
    for k, own in enumerate(dealt):
        if sizes[k]:
            ids[k, : sizes[k]] = np.concatenate([texts[i] for i in own])
            docs[k, : sizes[k]] = np.repeat(own, [len(texts[i]) for i in own])
    row, fresh = np.empty_like(ids), np.ones(ids.shape, dtype=bool)
    np.not_equal(docs[:, 1:], docs[:, :-1], out=fresh[:, 1:])
    row[:, 1:] = layout.rows(ids[:, :-1])
    row[fresh] = layout.n_rows
    flat = (ids, layout.classes(ids).astype(np.int16), row.astype(np.int32), docs)
    return *(np.ascontiguousarray(x.T) for x in flat), sizes


def _windows(layout: Layout, texts: list[np.ndarray], wanted: int, steps: int):
    """Windows of all lanes: number of lanes, then what ``_laid_out`` gives, step after step."""
    if not texts:
        return
    *laid, sizes = _laid_out(layout, texts, wanted)
    for at in range(0, int(sizes[0]), steps):
        active = int((sizes > at).sum())
        yield active, *(np.ascontiguousarray(x[at : at + steps, :active]).ravel() for x in laid)


class Room:
    """Arrays that each window uses again, by name: fresh memory costs more than the sums in it."""

    def __init__(self, dtype: np.dtype) -> None:
        self.dtype, self.held = dtype, {}

    def __call__(self, name: str, rows: int, columns: int) -> np.ndarray:
        size = rows * columns
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, dtype=self.dtype)
        return self.held[name][:size].reshape(rows, columns)


def _forward(p: dict, layout: Layout, row: np.ndarray, h: np.ndarray, room: Room, keep: dict | None):
    """States after each step of a window, before the target is seen, one column each. ``h``
    (hidden by lanes) is carried on. ``keep`` gets what the way back needs."""
    hidden, n = h.shape
    size = len(row)
    table = np.concatenate((p["x"], np.zeros_like(p["x"][:1])))
    given = room("given", n, 3 * hidden)
    begins = row == layout.n_rows
    u = np.ascontiguousarray(p["u"].T)
    out, gates = room("out", hidden, size), room("gates", 3 * hidden, n)
    if keep is not None:
        x = room("x", 3 * hidden, size)
        held, prior = room("held", hidden, size), room("prior", hidden, size)
        keep |= {"z": x[:hidden], "r": x[hidden : 2 * hidden], "new": x[2 * hidden :]}
        keep |= {"held": held, "prior": prior, "begins": begins}
    for at in range(0, size, n):
        now = slice(at, at + n)
        begin = begins[now]
        if begin.any():
            h = np.where(begin, h.dtype.type(0), h)
        np.matmul(u, h, out=gates)
        np.take(table, row[now], axis=0, out=given, mode="clip")
        if keep is not None:
            prior[:, now] = h
            held[:, now] = gates[2 * hidden :]
        zr, new = gates[: 2 * hidden], gates[2 * hidden :]
        zr += given.T[: 2 * hidden]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        new *= zr[hidden:]
        new += given.T[2 * hidden :]
        np.tanh(new, out=new)
        if keep is not None:
            x[:, now] = gates
        h = h - new
        h *= zr[:hidden]
        h += new
        out[:, now] = h
    return out, h


def _bounded(weights: np.ndarray, bias: np.ndarray, axis: int) -> bool:
    """Whether logits stay so small that their exponentials need no shift; states lie in -1 to 1."""
    return float((np.abs(weights).sum(axis=axis) + np.abs(bias)).max(initial=0)) < 60


def _softmax(logits: np.ndarray, wanted: np.ndarray, shift: bool):
    """Log probability of the wanted row of each column, and all columns' probabilities times
    their totals, and those totals; overwrites ``logits``."""
    if shift:
        logits -= logits.max(axis=0)
    own = logits[wanted, np.arange(logits.shape[1])].astype(np.float64)
    np.exp(logits, out=logits)
    total = logits.sum(axis=0)
    return own - np.log(total), logits, total


def _outputs(
    p: dict, layout: Layout, h: np.ndarray, ids: np.ndarray, classes: np.ndarray, room: Room,
    grads: dict | None, tokens: int = 0,
):
    """Natural log probability of each id given its state (a column); with ``grads``, adds
    gradients of the negative log-likelihood over ``tokens`` and returns that by state as well."""
    hidden, size = h.shape
    logits = np.matmul(np.ascontiguousarray(p["wc"].T), h, out=room("logits", layout.n_classes, size))
    logits += p["bc"][:, None]
    logp, d, total = _softmax(logits, classes, not _bounded(p["wc"], p["bc"], 0))
    dh, n = None, h.dtype.type(tokens)
    if grads is not None:
        d /= total * n
        d[classes, np.arange(len(ids))] -= 1 / n
        grads["wc"] += h @ d.T
        grads["bc"] += d.sum(axis=1)
        dh = np.matmul(p["wc"], d, out=room("dh", hidden, size))
    shared = np.flatnonzero((ids >= 0) & (classes >= layout.own_classes))
    logp[shared] += layout.log_share[ids[shared]]
    order = np.argsort(classes, kind="stable")
    bounds = np.searchsorted(classes[order], np.arange(layout.own_classes + 1))
    order = order[: bounds[-1]]
    inner_id = ids[order]
    sorted_h = np.take(h, order, axis=1, out=room("sorted", hidden, len(order)), mode="clip")
    inner_logp, shift = np.zeros(len(order)), not _bounded(p["wo"], p["bo"], 1)
    back = room("back", hidden, len(order))
    for c in range(layout.own_classes):
        low, high = int(layout.low[c]), int(layout.high[c])
        mine = slice(int(bounds[c]), int(bounds[c + 1]))
        if mine.start == mine.stop:
            continue
        weights, state = p["wo"][low:high], sorted_h[:, mine]
        wanted = inner_id[mine] - low
        logits = weights @ state
        logits += p["bo"][low:high, None]
        inner_logp[mine], d, total = _softmax(logits, wanted, shift)
        if grads is not None:
            d /= total * n
            d[wanted, np.arange(len(wanted))] -= 1 / n
            grads["wo"][low:high] += d @ state.T
            grads["bo"][low:high] += d.sum(axis=1)
            np.matmul(weights.T, d, out=back[:, mine])
    logp[order] += inner_logp
    if grads is not None:
        dh[:, order] += back
    return logp, dh


def log_likelihood(p: dict, layout: Layout, texts: list[np.ndarray], n_lanes: int = 384) -> np.ndarray:
    """Natural log-likelihood of each text, the part inside the unnumbered class left out."""
    out = np.zeros(len(texts))
    h = np.zeros((p["u"].shape[0], max(1, min(n_lanes, len(texts)))), dtype=p["u"].dtype)
    room = Room(h.dtype)
    for n, ids, classes, row, doc in _windows(layout, texts, n_lanes, WINDOW):
        states, h = _forward(p, layout, row, h[:, :n], room, None)
        real = slice(None) if ids.min() > -3 else np.flatnonzero(ids > -3)
        logp, _ = _outputs(p, layout, states[:, real], ids[real], classes[real], room, None)
        out += np.bincount(doc[real], weights=logp, minlength=len(texts))
    return out


class Trainer:
    """Adagrad over windows of truncated backpropagation."""

    def __init__(self, layout: Layout, parameters: dict[str, np.ndarray]) -> None:
        self.layout = layout
        self.p = {k: v.copy() for k, v in parameters.items()}
        self.seen = {k: np.full(v.shape, LEAST_SQUARES, dtype=F32) for k, v in parameters.items()}
        self.tokens = 0

    def learn(self, texts: list[np.ndarray], n_lanes: int = 32) -> None:
        layout, p = self.layout, self.p
        hidden = p["u"].shape[0]
        h = np.zeros((hidden, max(1, min(n_lanes, len(texts)))), dtype=p["u"].dtype)
        room, tokens = Room(h.dtype), WINDOW * h.shape[1]
        for n, ids, classes, row, _ in _windows(layout, texts, n_lanes, WINDOW):
            kept: dict[str, np.ndarray] = {}
            states, h = _forward(p, layout, row, h[:, :n], room, kept)
            grads = {k: np.zeros_like(v) for k, v in p.items() if k != "x"}
            real = slice(None) if ids.min() > -3 else np.flatnonzero(ids > -3)
            # A token weighs the same in the windows of the longest lanes, which have few.
            _, d = _outputs(p, layout, states[:, real], ids[real], classes[real], room, grads, tokens)
            dstates = d
            if not isinstance(real, slice):
                dstates = np.zeros_like(states)
                dstates[:, real] = d
            dx = self._back(kept, dstates, n, room)
            # From here on the candidate's part is what its gate takes from the state.
            at = np.flatnonzero(np.bincount(row, minlength=layout.n_rows + 1)[:-1])
            row = row.astype(np.intp)
            by_row = [np.bincount(row, weights=d, minlength=layout.n_rows)[at] for d in dx]
            dx[2 * hidden :] *= kept["r"]
            grads["u"] += kept["prior"] @ dx.T
            for name, g in grads.items():
                self._step(name, slice(None), g)
            self._step("x", at, np.stack(by_row, axis=1).astype(h.dtype))
            self.tokens += len(ids[real])

    def _back(self, kept: dict, dstates: np.ndarray, n: int, room: Room) -> np.ndarray:
        """Gradients by the inputs of gates and candidate."""
        hidden, size = dstates.shape
        u, z, r, new = self.p["u"], kept["z"], kept["r"], kept["new"]
        by_new, by_z, by_r = (room(f"by_{k}", hidden, size) for k in "nzr")
        # For the candidate (1 - z)(1 - new^2), for z (prior - new) z (1 - z), for r held r (1 - r).
        np.subtract(1, z, out=by_z)
        np.multiply(new, new, out=by_new)
        np.subtract(1, by_new, out=by_new)
        by_new *= by_z
        by_z *= z
        np.subtract(kept["prior"], new, out=by_r)
        by_z *= by_r
        np.subtract(1, r, out=by_r)
        by_r *= r
        by_r *= kept["held"]
        dx, gates = room("dx", 3 * hidden, size), room("gates", 3 * hidden, n)
        dh = np.zeros((hidden, n), dtype=u.dtype)
        for at in range(size - n, -1, -n):
            now = slice(at, at + n)
            dh += dstates[:, now]
            np.multiply(dh, by_z[:, now], out=gates[:hidden])
            np.multiply(dh, by_new[:, now], out=gates[2 * hidden :])
            np.multiply(gates[2 * hidden :], by_r[:, now], out=gates[hidden : 2 * hidden])
            dx[:, now] = gates
            gates[2 * hidden :] *= r[:, now]
            dh *= z[:, now]
            dh += u @ gates
            begin = kept["begins"][now]
            if begin.any():
                dh[:, begin] = 0
        return dx

    def _step(self, name: str, at, g: np.ndarray) -> None:
        np.clip(g, -1, 1, out=g)
        self.seen[name][at] += g * g
        self.p[name][at] -= F32(RATE) * g / np.sqrt(self.seen[name][at])


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in NAMES]).astype(F32)


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in NAMES:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(F32)
        at += like[k].size
    return out
