"""A small causal self-attention model over subword classes, in numpy.

One layer, one head: the query, key, value and own vector of a token are rows of tables, attention has a learned bias by
distance, and the sum of what is attended to and the token's own vector gives the next token's group, and its class in that
group. Both start from smoothed counts of what follows the token; attention learns the rest. A class is a frequent subword or a band of
rarer ones; in a band subwords have their smoothed share of its counts. Gradients are written out; Adam steps.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np

GROUPS, MEMBERS, BANDS, WIDTH, HALF = 32, 32, 64, 16, 16
CLASSES = GROUPS * MEMBERS
BOUND = np.float32(40)
#: Query, key, value and own vector of a class, as they lie in its row.
VECTORS = ("q", "k", "v", "u")


class Vocabulary:
    """Classes of ids by count, each id's log probability in its class, and how often classes follow one another.

    The last id is the end of a text. Bands part the rarer ids that begin a word from the others, by count. ``follow`` has
    counts of (class before, class after); classes with like neighbours share a group.
    """

    def __init__(self, counts: np.ndarray, begins: np.ndarray):
        counts = np.asarray(counts, np.float64)
        n = len(counts)
        singles = min(CLASSES - BANDS, n)
        order = np.lexsort((np.arange(n), -counts))
        self.cls = np.empty(n, np.int16)
        self.cls[order[:singles]] = np.arange(singles)
        for part, own in enumerate((begins, ~begins)):  # bands of equal mass
            rest = order[singles:][own[order[singles:]]]
            if len(rest):
                mass = np.cumsum(counts[rest] + 0.5)
                band = np.minimum((mass - counts[rest] - 0.5) / mass[-1] * (BANDS // 2), BANDS // 2 - 1).astype(np.int16)
                self.cls[rest] = CLASSES - BANDS + part * (BANDS // 2) + band
        total = np.bincount(self.cls, weights=counts + 0.5, minlength=CLASSES)
        self.inner = np.log((counts + 0.5) / total[self.cls])
        self.prior = (total + 0.5) / (total + 0.5).sum()
        self.arrange(np.zeros((CLASSES, CLASSES)))

    def arrange(self, follow: np.ndarray) -> None:
        """Groups of the classes, and log probabilities of the group and of the class in it after each class."""
        own = follow.sum(axis=0)
        near = np.sqrt((follow.T + 1e-9) / (own[:, None] + 1e-9 * CLASSES))
        parts = [np.arange(CLASSES)]
        while len(parts) < GROUPS:  # halve each along its main direction
            halves = []
            for p in parts:
                x = near[p] - near[p].mean(axis=0)
                d = np.ones(CLASSES)
                for _ in range(20):
                    d = x.T @ (x @ d)
                    d /= np.linalg.norm(d) + 1e-30
                o = p[np.lexsort((p, x @ d))]
                halves += [o[: len(o) // 2], o[len(o) // 2 :]]
            parts = halves
        self.group, self.member = np.empty(CLASSES + 1, np.int64), np.empty(CLASSES + 1, np.int64)
        for g, p in enumerate(parts):
            self.group[p], self.member[p] = g, np.arange(len(p))
        self.group[CLASSES] = self.member[CLASSES] = 0
        kinds = (follow > 0).sum(axis=1, keepdims=True) + 1
        p = (follow + kinds * self.prior) / (follow.sum(axis=1, keepdims=True) + kinds)
        p = np.concatenate([p, self.prior[None]])[:, np.concatenate(parts)].reshape(-1, GROUPS, MEMBERS)
        by_group = p.sum(axis=2)
        self.groups, self.members = (np.ascontiguousarray(np.log(x), np.float32) for x in (by_group, p / by_group[:, :, None]))
        # the same in forms that are quick to look up and to sort by
        self.flat, self.short = self.members.reshape(-1, MEMBERS), self.group.astype(np.uint8)


@lru_cache(1)
def one_thread() -> None:
    """Keeps the matrix library of this process to one thread: the matrices here are small, and more threads would only wait for one another."""
    try:
        with open("/proc/self/maps") as f:
            libs = {line.split()[-1] for line in f if "openblas" in line}
        for lib in map(ctypes.CDLL, libs):
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if (fn := getattr(lib, name, None)) is not None:
                    fn(1)
    except OSError:  # another system or library: its own setting holds
        pass


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    table = lambda s, *shape: rng.normal(0, s, shape).astype(np.float32)
    rows = (CLASSES + 1, WIDTH)  # the last row is padding
    return {"q": table(0.3, *rows), "k": table(0.3, *rows), "v": table(0.3, *rows), "u": table(0.1, *rows), "bias": np.zeros(2 * HALF, np.float32), "out": table(0.05, WIDTH, GROUPS), "in": table(0.05, GROUPS, WIDTH, MEMBERS)}


def _mask(rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances from each of the last ``rows`` of ``cols`` places to all, and which are not later."""
    d = np.arange(cols - rows, cols)[:, None] - np.arange(cols)
    return np.maximum(d, 0), d >= 0


def _exp(logits: np.ndarray) -> np.ndarray:
    """In place, of at most BOUND: a look at the largest is quicker than a pass that cuts nothing."""
    if logits.size and not logits.max() <= BOUND:
        np.minimum(logits, BOUND, out=logits)
    return np.exp(logits, out=logits)


def _sums(a: np.ndarray) -> np.ndarray:
    """Over the last axis; a product is quicker than a sum over a short axis."""
    return (a.reshape(-1, a.shape[-1]) @ np.ones(a.shape[-1], a.dtype)).reshape(a.shape[:-1])


def _table(m: dict) -> np.ndarray:
    """All four vectors of a class in one row, so that one look-up finds them."""
    return np.concatenate([m[k] for k in VECTORS], axis=1)


def _attend(table: np.ndarray, bias: np.ndarray, x: np.ndarray, rows: int):
    """Attention of the last ``rows`` places over windows of classes (windows, places), unnormalised, its sums, what is attended to, and the result. Padding is class CLASSES."""
    d, causal = _mask(rows, x.shape[1])
    own = table.take(x, axis=0)
    q, k, v, u = (own[:, at:, i * WIDTH : (i + 1) * WIDTH] for i, at in enumerate((-rows, 0, 0, -rows)))
    q = q * np.float32(WIDTH**-0.5)
    s = q @ k.transpose(0, 2, 1)
    s += np.where(causal, bias[d], -np.inf).astype(s.dtype)  # 0 exactly, as products of numbers near it are slow
    _exp(s)
    pad = x == CLASSES
    some = np.flatnonzero(pad.any(axis=1))  # few windows have any
    s[some] *= (~pad[some])[:, None, :].astype(s.dtype)
    total = _sums(s)
    total += np.float32(1e-20)
    met = s @ v
    met /= total[:, :, None]
    z = met + u
    np.tanh(z, out=z)
    return q, k, v, s, total, met, z


def log_probabilities(m: dict, voc: Vocabulary, x: np.ndarray, y: np.ndarray, rows: int, table: np.ndarray | None = None) -> np.ndarray:
    """log P(class y) after each of the last ``rows`` places of the windows x (0 where y is padding). ``table``: that of the model, if made before."""
    z = _attend(_table(m) if table is None else table, m["bias"], x, rows)[-1].reshape(-1, WIDTH)
    last, t = x[:, -rows:].ravel(), y.ravel()
    ok = np.flatnonzero(t != CLASSES)
    ok = ok[np.argsort(voc.short[t[ok]], kind="stable")]  # the places of each group together
    z, last, t = z[ok], last[ok].astype(np.int64), t[ok]
    own = voc.group[t]
    at = np.searchsorted(own, np.arange(GROUPS + 1)).tolist()
    row = np.arange(len(t))
    logits = z @ m["out"]
    logits += voc.groups.take(last, axis=0)
    lp = np.minimum(logits[row, own], BOUND)
    lp -= np.log(_sums(_exp(logits)))
    logits = voc.flat.take(last * GROUPS + own, axis=0)
    for g in range(GROUPS):
        if at[g + 1] > at[g]:
            logits[at[g] : at[g + 1]] += z[at[g] : at[g + 1]] @ m["in"][g]
    lp += np.minimum(logits[row, voc.member[t]], BOUND)
    lp -= np.log(_sums(_exp(logits)))
    out = np.zeros(y.size, z.dtype)
    out[ok] = lp
    return out.reshape(y.shape)


def _sum_rows(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sums of the rows of each class."""
    width = own.shape[1]
    out = np.zeros((CLASSES + 1) * width, own.dtype)
    np.add.at(out, (x.astype(np.int64)[:, None] * width + np.arange(width)).ravel(), own.ravel())
    return out.reshape(-1, width)


def _by_class(x: np.ndarray, *grads: np.ndarray) -> list[np.ndarray]:
    """Of each of the gradients the sums over the places of each class."""
    return np.split(_sum_rows(x, np.concatenate([g.reshape(-1, WIDTH) for g in grads], axis=1)), len(grads), axis=1)


def step(m: dict, voc: Vocabulary, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of what follows the last places of the windows (y == CLASSES: nothing to predict) and its gradients."""
    loss, table, *g = _step(_table(m), m["bias"], m["out"], m["in"], voc, x, y)
    return loss, dict(zip(VECTORS, np.split(table, len(VECTORS), axis=1), strict=True)) | dict(zip(("bias", "out", "in"), g, strict=True))


def _step(table: np.ndarray, bias: np.ndarray, to_groups: np.ndarray, to_members: np.ndarray, voc: Vocabulary, x: np.ndarray, y: np.ndarray):
    """Loss, and the gradients of the table, the bias and both outputs."""
    rows = y.shape[1]
    d, _ = _mask(rows, x.shape[1])
    q, k, v, s, total, met, z = _attend(table, bias, x, rows)
    z, last, t = z.reshape(-1, WIDTH), x[:, -rows:].ravel(), y.ravel()
    ok = np.flatnonzero(t != CLASSES)
    ok = ok[np.argsort(voc.short[t[ok]], kind="stable")]  # the places of each group together
    flat, before, t = z[ok], last[ok].astype(np.int64), t[ok]
    own = voc.group[t]
    at = np.searchsorted(own, np.arange(GROUPS + 1)).tolist()
    parts = [(i, slice(at[i], at[i + 1])) for i in range(GROUPS) if at[i + 1] > at[i]]
    weight = flat.dtype.type(1 / max(len(t), 1))

    def errors(logits, pick):
        """Loss, and the logits' gradients in their place."""
        spot = np.arange(len(t)) * logits.shape[1] + pick
        sums = _sums(_exp(logits))
        line = logits.ravel()
        loss = -float(np.log(line.take(spot) / sums + 1e-30).sum() * weight)
        logits *= (weight / sums)[:, None]
        line[spot] -= weight
        return loss

    p = flat @ to_groups
    p += voc.groups.take(before, axis=0)
    loss = errors(p, own)
    d_groups, d_members = flat.T @ p, np.zeros_like(to_members)
    df = p @ to_groups.T
    for i, part in parts:
        np.matmul(flat[part], to_members[i], out=p[part])
    p += voc.flat.take(before * GROUPS + own, axis=0)
    loss += errors(p, voc.member[t])
    by = np.empty_like(df)
    for i, part in parts:
        f, e = flat[part], p[part]
        np.matmul(f.T, e, out=d_members[i])
        np.matmul(e, to_members[i].T, out=by[part])
    df += by
    df *= 1 - flat * flat
    dz = np.zeros_like(z)
    dz[ok] = df
    dz = dz.reshape(len(x), rows, WIDTH)
    grad = np.zeros((*x.shape, 4 * WIDTH), z.dtype)
    grad[:, -rows:, 3 * WIDTH :] = dz
    mean = _sums(dz * met)  # the mean of what attention gains, by its sums of values
    dz /= total[:, :, None]
    mean /= total
    grad[:, :, 2 * WIDTH : 3 * WIDTH] = s.transpose(0, 2, 1) @ dz
    ds = dz @ v.transpose(0, 2, 1)
    ds -= mean[:, :, None]
    ds *= s
    grad[:, -rows:, :WIDTH] = ds @ k
    grad[:, -rows:, :WIDTH] *= np.float32(WIDTH**-0.5)
    grad[:, :, WIDTH : 2 * WIDTH] = ds.transpose(0, 2, 1) @ q
    d_bias = np.bincount(d.ravel(), weights=ds.sum(axis=0).ravel(), minlength=2 * HALF).astype(flat.dtype)
    return loss, _sum_rows(x.ravel(), grad.reshape(-1, 4 * WIDTH)), d_bias, d_groups, d_members


def fit(m: dict, voc: Vocabulary, x: np.ndarray, y: np.ndarray, steps: int, rate: float, size: int = 64, seed: int = 3) -> dict:
    """Adam over the windows in a fixed shuffled order, again from the start where steps are left; the rate falls to a tenth."""
    one_thread()
    if not len(x):
        return {k: v.copy() for k, v in m.items()}
    parts = [_table(m), m["bias"], m["out"], m["in"]]
    shapes, cuts = [v.shape for v in parts], np.cumsum([v.size for v in parts])[:-1]
    flat = np.concatenate([v.ravel() for v in parts])  # all weights in one row; parts are views of it
    parts = [v.reshape(shape) for v, shape in zip(np.split(flat, cuts), shapes, strict=True)]
    # moments over 0.1 and 0.01, which spares a pass each
    first, second, by = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
    order = np.random.default_rng(seed).permutation(len(x))
    for i in range(steps):
        at = order[(i * size + np.arange(min(size, len(x)))) % len(x)]
        g = np.concatenate([v.ravel() for v in _step(*parts, voc, x[at], y[at])[1:]])
        now = rate * (1 - 0.9 * i / steps)
        root = (0.01 / (1 - 0.99 ** (i + 1))) ** 0.5
        first *= 0.9
        first += g
        second *= 0.99
        g *= g
        second += g
        np.sqrt(second, out=by)
        by += 1e-8 / root
        np.divide(first, by, out=by)
        by *= 0.1 * now / (1 - 0.9 ** (i + 1)) / root
        flat -= by
    own = dict(zip(VECTORS, np.split(parts[0], len(VECTORS), axis=1), strict=True)) | dict(zip(("bias", "out", "in"), parts[1:], strict=True))
    return {k: np.ascontiguousarray(own[k]) for k in m}


def stream(voc: Vocabulary, ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Targets (the ids and an end after each text), their classes, the class before each, and where texts start (n + 1)."""
    n = np.diff(offsets) + 1
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    target = np.full(int(at[-1]), end, np.int64)
    target[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
    y = voc.cls[target]
    x = np.empty(len(y), np.int16)  # what comes before each target: the end of the text before, or the token before
    x[1:] = y[:-1]
    x[at[:-1]] = voc.cls[end]
    return target, y, x, at


def spans(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts that start at these places: the first and last place of each one's text, and its first target."""
    blocks = -(-np.diff(at) // HALF)
    k = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    lo, hi = np.repeat(at[:-1], blocks), np.repeat(at[1:], blocks)
    return lo, hi, lo + k * HALF


def windows(x: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray):
    """Classes before (2 * HALF a window) and targets' classes (HALF), with the targets' places and which are in the text."""
    spot = start[:, None] + np.arange(-HALF, HALF)
    ok = (spot >= lo[:, None]) & (spot < hi[:, None])
    w = np.where(ok, x[np.where(ok, spot, 0)], CLASSES).astype(np.int64)
    mine, good = spot[:, HALF:], ok[:, HALF:]
    return w, np.where(good, y[np.where(good, mine, 0)], CLASSES).astype(np.int64), mine, good


def stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of 2 * HALF places of texts that start at these places, to learn from: each place is in one of them. First places, and where their texts end."""
    n = -(-np.diff(at) // (2 * HALF))
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(at[:-1], n) + 2 * HALF * k, np.repeat(at[1:], n)


def cut(x: np.ndarray, y: np.ndarray, start: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes before and targets' classes of stretches (rows)."""
    spot = start[:, None] + np.arange(2 * HALF)
    ok = spot < hi[:, None]
    spot = np.where(ok, spot, 0)
    return np.where(ok, x[spot], np.int16(CLASSES)), np.where(ok, y[spot], np.int16(CLASSES))


def score(m: dict, voc: Vocabulary, ids: np.ndarray, offsets: np.ndarray, end: int, block: int = 256) -> np.ndarray:
    """Natural log probability of each sequence with its end.

    Windows of 2 * HALF places overlap by half: each token is scored once, after HALF to 2 * HALF - 1 places or all there are.
    """
    one_thread()
    target, y, x, at = stream(voc, ids, offsets, end)
    out, table = voc.inner[target], _table(m)
    lo, hi, start = spans(at)
    for i in range(0, len(start), block):
        w, t, mine, good = windows(x, y, lo[i : i + block], hi[i : i + block], start[i : i + block])
        out[mine[good]] += log_probabilities(m, voc, w, t, HALF, table)[good]
    return np.add.reduceat(out, at[:-1]) if len(at) > 1 else np.zeros(0)
