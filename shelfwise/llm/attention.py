"""A causal self-attention model over subword ids in numpy: forward pass, gradients, Adam.

The next id is predicted as its class, times its share of the class (a softmax of two levels). Class scores are a
table by the id just before and the class of the one before that, counted over the whole training corpus, plus what
one attention layer over the window adds to it. Shares are counts as well, after the two ids before where all are
frequent, backed off to the id just before and to those of the class alone; so only the small attention part has to
be fitted by gradients.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Ids of a window, and how many of them are scored; the others are context shared with the window before.
WINDOW = 32
SCORED = 24
CONTEXT = WINDOW - SCORED
WIDTH = 32
CLASSES = 64
#: Windows of a training step, and of those computed at a time, whose arrays stay in a core's cache.
BATCH = 64
BLOCK = 64
#: Ids with rows of their own; others share rows by their value.
TOP = 4_096
RARE = 256
ROWS = TOP + RARE
#: The most frequent ids, after which class scores also go by the class of the id before them.
PAIRED = 1_024
CONTEXTS = PAIRED * CLASSES + ROWS
#: What tables by two ids, by one id and by none weigh against the counts of the finer table.
FINE, COARSE = 15.0, 5.0
#: Groups of the id before, for shares: the most frequent ids by themselves, others by class.
BEFORE = 512
BACKOFF = 5.0
#: Shares by two ids: of so many most frequent ids, after so many most frequent ids and groups of the id before those.
NEXT, LAST, EARLIER = 1_024, 256, 16


@dataclass
class Vocabulary:
    """What corpus counts give: rows and classes of ids, shares within classes, class scores by context."""

    row: np.ndarray  # of each id
    cls: np.ndarray  # of each id
    share: np.ndarray  # log of each id's share of its class
    before: np.ndarray  # group of each id as the one before
    pair: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))  # log share of ids with rows of their own, by group before
    rest: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))  # what the others' shares are multiplied by
    after: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))  # class scores [CONTEXTS, CLASSES]
    fine: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))  # log shares [NEXT, LAST * EARLIER] by two ids
    begin: int = 0  # stands before a text's first id

    def context(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Place in ``after`` by the id just before and the one before that."""
        row = self.row[one]
        return np.where(row < PAIRED, row * CLASSES + self.cls[two], PAIRED * CLASSES + row)


def set_after(voc: Vocabulary, moves: np.ndarray) -> None:
    """Class scores from counts [CONTEXTS, CLASSES]: contexts of two ids back off to one, and that to none."""
    two = moves[: PAIRED * CLASSES].reshape(PAIRED, CLASSES, CLASSES)
    one = moves[PAIRED * CLASSES :].astype(np.float64)
    one[:PAIRED] += two.sum(1)
    back = one.sum(0) + (np.bincount(voc.cls, minlength=CLASSES) > 0)  # classes without ids get no share
    one += COARSE * back / back.sum()
    one /= one.sum(1, keepdims=True)
    log = lambda x: np.log(np.maximum(x, 1e-30)).astype(np.float32)
    voc.after = np.empty((CONTEXTS, CLASSES), np.float32)
    voc.after[PAIRED * CLASSES :] = log(one)
    for r in range(PAIRED):
        x = two[r] + FINE * one[r]
        voc.after[r * CLASSES : (r + 1) * CLASSES] = log(x / x.sum(1, keepdims=True))


def rows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids by frequency, row of each id)."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    row = TOP + np.arange(len(counts)) % RARE
    row[order[:TOP]] = np.arange(min(TOP, len(counts)))
    return order, row


def vocabulary(counts: np.ndarray, classes: np.ndarray, begin: int = 0, add: float = 0.1) -> Vocabulary:
    """Shares with ``add`` more of every id, so that each class sums to one over all ids that it holds."""
    total = np.bincount(classes, counts + add, CLASSES)
    row = rows_of(counts)[1]
    own = BEFORE - CLASSES
    return Vocabulary(row.astype(np.int32), classes.astype(np.int32), np.log((counts + add) / total[classes]).astype(np.float32), np.where(row < own, row, own + classes).astype(np.int32), begin=begin)


def set_pairs(voc: Vocabulary, pairs: np.ndarray) -> None:
    """Shares after each group, from counts [TOP, BEFORE] of ids with rows of their own."""
    ids = np.empty(TOP, np.int64)
    own = np.flatnonzero(voc.row < TOP)
    ids[voc.row[own]] = own
    ids = ids[: len(own)]
    cls, pairs = voc.cls[ids], pairs[: len(own)]
    total = np.zeros((CLASSES, BEFORE))
    np.add.at(total, cls, pairs)
    voc.pair, voc.rest = np.zeros((TOP, BEFORE), np.float32), np.zeros((CLASSES, BEFORE), np.float32)
    voc.pair[: len(own)] = np.log((pairs + BACKOFF * np.exp(voc.share[ids].astype(np.float64))[:, None]) / (total[cls] + BACKOFF))
    voc.rest[:] = np.log(BACKOFF / (total + BACKOFF))


def set_fine(voc: Vocabulary, triples: np.ndarray) -> None:
    """Shares after two ids, from counts [NEXT, LAST * EARLIER], backed off to the pairs that are set. Together these
    ids keep the share of their class that they have by pairs."""
    own = np.flatnonzero(voc.row < NEXT)
    cls = np.zeros(NEXT, np.int64)
    cls[voc.row[own]] = voc.cls[own]
    total = np.zeros((CLASSES, LAST * EARLIER))
    np.add.at(total, cls, triples)
    base = np.exp(voc.pair[:NEXT, :LAST].astype(np.float64))
    mass = np.zeros((CLASSES, LAST))
    np.add.at(mass, cls, base)
    mass = np.maximum(mass[cls], 1e-30)
    voc.fine = np.empty((NEXT, LAST * EARLIER), np.float32)
    for g in range(EARLIER):
        at = slice(g, None, EARLIER)
        voc.fine[:, at] = np.log(np.maximum(mass * (triples[:, at] + BACKOFF * base / mass) / (total[cls][:, at] + BACKOFF), 1e-30))


def shares(voc: Vocabulary, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Log of each target's share of its class after the ids just before."""
    row, cls, group = voc.row[target], voc.cls[target], voc.before[one]
    out = voc.pair[np.minimum(row, TOP - 1), group]
    rare = np.flatnonzero(row >= TOP)
    out[rare] = voc.share[target[rare]] + voc.rest[cls[rare], group[rare]]
    last = voc.row[one]
    at = np.flatnonzero((last < LAST) & (row < NEXT))
    out[at] = voc.fine[row[at], last[at] * EARLIER + voc.cls[two[at]] % EARLIER]
    return out


def cluster(counts: np.ndarray, left: np.ndarray, right: np.ndarray, seed: int = 5) -> np.ndarray:
    """Class of every id: frequent ids by what stands around them (k-means), others by frequency.

    ``left`` and ``right`` [TOP, groups] count hashed neighbours of the ids with rows of their own.
    """
    order, _ = rows_of(counts)
    rare = CLASSES // 8
    cls = np.empty(len(counts), np.int64)
    mass = np.cumsum(counts[order] + 0.1)
    cls[order] = CLASSES - rare + np.minimum((mass / mass[-1] * rare).astype(np.int64), rare - 1)
    top = order[: min(TOP, int((counts > 0).sum()))]
    k = CLASSES - rare
    if len(top) <= k:
        cls[top] = np.arange(len(top))
        return cls
    x = np.concatenate([np.sqrt(part[: len(top)] / np.maximum(part[: len(top)].sum(1, keepdims=True), 1)) for part in (left, right)], 1).astype(np.float32)
    weight = np.sqrt(counts[top])
    centre = x[:k].copy()
    for _ in range(12):
        near = ((centre**2).sum(1)[None, :] - 2 * x @ centre.T).argmin(1)
        for j in range(k):
            own = near == j
            if own.any():
                centre[j] = np.average(x[own], 0, weight[own])
    cls[top] = near
    return cls


def fresh(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shape = {"e": (ROWS, WIDTH), "p": (WINDOW, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "q": (WIDTH, WIDTH), "r": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "b": (WIDTH,), "c": (WIDTH, CLASSES), "d": (CLASSES,)}
    out = {n: (rng.standard_normal(s) * (0.1 if n in "ep" else WIDTH**-0.5)).astype(np.float32) for n, s in shape.items()}
    out["c"] *= 0.1
    out["b"] *= 0
    out["d"] *= 0
    return out


def earlier(voc: Vocabulary, ids: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The id before the one just before every scored position [n, SCORED]."""
    return np.where(there[:, CONTEXT - 1 : -1], ids[:, CONTEXT - 1 : -1], voc.begin)


def prepared(w: dict[str, np.ndarray], voc: Vocabulary) -> dict[str, np.ndarray]:
    """Weights for scoring: keys and values, queries and rests are taken from tables by id and by place, as one layer
    is linear up to there. ``clip`` tells whether attention or class scores could get too large for an exponential."""
    key_value = np.concatenate([w["k"], w["v"] @ w["o"]], 1)
    query_rest = np.concatenate([w["q"] * np.float32(WIDTH**-0.5), w["r"]], 1)
    place = w["p"][CONTEXT:] @ query_rest
    place[:, WIDTH:] += w["b"]
    out = {"kv": w["e"] @ key_value, "kv_at": w["p"] @ key_value, "qr": w["e"] @ query_rest, "qr_at": place, "c": w["c"], "after": voc.after + w["d"]}
    out["clip"] = np.array([_farthest(out["kv"], out["kv_at"], out["qr"], out["qr_at"]) > 50, (np.abs(w["c"]).sum(0) + np.abs(w["d"])).max() > 60])
    return out


def _farthest(kv: np.ndarray, kv_at: np.ndarray, qr: np.ndarray, qr_at: np.ndarray) -> float:
    """What no product of a query and a key, taken from these tables by id and by place, is above."""
    norm = lambda x: float(np.linalg.norm(x[:, :WIDTH], axis=1).max())
    return (norm(kv) + norm(kv_at)) * (norm(qr) + norm(qr_at))


class Room:
    """Arrays that are used again from batch to batch."""

    def __init__(self, kind: np.dtype | type = np.float32):
        self.kind, self.held = kind, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, self.kind)
        return self.held[name][:size].reshape(shape)


_ONES = np.ones((max(WINDOW, CLASSES), 1), np.float32)
_MAY = (np.arange(WINDOW)[None, :] <= np.arange(CONTEXT, WINDOW)[:, None]).astype(np.float32)


def log_probs(w: dict[str, np.ndarray], voc: Vocabulary, ids: np.ndarray, targets: np.ndarray, there: np.ndarray, room: Room | None = None) -> np.ndarray:
    """Natural log of the probability of each target [n, SCORED] after the ids [n, WINDOW] up to its place; ``w`` is
    prepared."""
    n, room = len(ids), room or Room()
    rows = voc.row[ids]
    kv = w["kv"].take(rows, 0, out=room("kv", n, WINDOW, 2 * WIDTH), mode="clip")
    kv += w["kv_at"]
    qr = w["qr"].take(rows[:, CONTEXT:], 0, out=room("qr", n, SCORED, 2 * WIDTH), mode="clip")
    qr += w["qr_at"]
    score = np.matmul(qr[:, :, :WIDTH], kv[:, :, :WIDTH].transpose(0, 2, 1), out=room("score", n, SCORED, WINDOW))
    if w["clip"][0]:
        np.minimum(score, 50, out=score)
    np.exp(score, out=score)
    score *= _MAY
    if not there.all():
        score *= there[:, None, :]
    total = np.matmul(score.reshape(-1, WINDOW), _ONES[:WINDOW], out=room("total", n * SCORED, 1))
    total += 1e-30
    z = np.matmul(score, kv[:, :, WIDTH:], out=room("z", n, SCORED, WIDTH))
    z /= total.reshape(n, SCORED, 1)
    z += qr[:, :, WIDTH:]
    z /= np.add(np.abs(z, out=room("abs", n, SCORED, WIDTH)), 1, out=room("abs", n, SCORED, WIDTH))
    logits = np.matmul(z.reshape(n * SCORED, WIDTH), w["c"], out=room("logits", n * SCORED, CLASSES))
    one, two = ids[:, CONTEXT:].ravel(), earlier(voc, ids, there).ravel()
    logits += w["after"].take(voc.context(one, two), 0, out=room("after", n * SCORED, CLASSES), mode="clip")
    if w["clip"][1]:
        np.minimum(logits, 80, out=logits)
    target = targets.ravel()
    picked = logits[np.arange(len(logits)), voc.cls[target]]
    np.exp(logits, out=logits)
    return (picked - np.log(np.matmul(logits, _ONES[:CLASSES], out=total)[:, 0]) + shares(voc, target, one, two)).reshape(targets.shape)


def gradients(w: dict[str, np.ndarray], voc: Vocabulary, ids: np.ndarray, targets: np.ndarray, there: np.ndarray, scored: np.ndarray, room: Room | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean class loss over the ``scored`` places and its gradient.

    Keys, values, queries and rests of a batch are taken from tables of its distinct rows, as in ``prepared``, and their
    gradients are added up there, so that matrices meet each distinct row once. BLOCK windows are computed at a time.
    """
    kind = w["e"].dtype
    room, ones = room or Room(kind), _ONES.astype(kind, copy=False)
    rows = voc.row[ids]
    there_is = np.zeros(ROWS, bool)
    there_is[rows] = True
    own = np.flatnonzero(there_is)
    rank = np.empty(ROWS, np.int64)
    rank[own] = np.arange(len(own))
    at, tail = rank[rows], rank[rows[:, CONTEXT:]]
    context, cls = voc.context(ids[:, CONTEXT:], earlier(voc, ids, there)), voc.cls[targets]
    n = max(1, int(scored.sum()))

    scale = np.asarray(WIDTH**-0.5, kind)
    key_value = np.concatenate([w["k"], w["v"] @ w["o"]], 1)
    query_rest = np.concatenate([w["q"] * scale, w["r"]], 1)
    e, last = w["e"][own], w["p"][CONTEXT:]
    kv_of, qr_of, kv_at, qr_at = e @ key_value, e @ query_rest, w["p"] @ key_value, last @ query_rest
    qr_at[:, WIDTH:] += w["b"]
    far = _farthest(kv_of, kv_at, qr_of, qr_at) > 50
    large = (np.abs(w["c"]).sum(0) + np.abs(w["d"])).max() > 60
    two = np.result_type(kind, np.complex64)  # two neighbours are added as one complex number
    cell = np.arange(len(own) * WIDTH // 2).reshape(-1, WIDTH // 2)
    of = {x: np.zeros(len(own) * WIDTH, kind) for x in "kvqr"}  # gradients by row, and by place
    by = {x: np.zeros((WINDOW if x in "kv" else SCORED) * WIDTH, kind) for x in "kvqr"}
    g, loss = {"c": np.zeros_like(w["c"]), "d": np.zeros_like(w["d"])}, 0.0
    for lo in range(0, len(ids), BLOCK):
        part = slice(lo, lo + BLOCK)
        size = len(ids[part])
        flat = size * SCORED
        kv = kv_of.take(at[part], 0, out=room("kv", size, WINDOW, 2 * WIDTH), mode="clip")
        kv += kv_at
        qr = qr_of.take(tail[part], 0, out=room("qr", size, SCORED, 2 * WIDTH), mode="clip")
        qr += qr_at
        k, v, q = kv[:, :, :WIDTH], kv[:, :, WIDTH:], qr[:, :, :WIDTH]
        a = np.matmul(q, k.transpose(0, 2, 1), out=room("a", size, SCORED, WINDOW))
        if far:
            np.minimum(a, 50, out=a)
        np.exp(a, out=a)
        a *= _MAY
        if not there[part].all():
            a *= there[part][:, None, :]
        total = np.matmul(a.reshape(-1, WINDOW), ones[:WINDOW], out=room("total", flat, 1))
        total += 1e-30
        np.reciprocal(total, out=total)
        a *= total.reshape(size, SCORED, 1)
        z = np.matmul(a, v, out=room("z", size, SCORED, WIDTH))
        z += qr[:, :, WIDTH:]
        slope = np.abs(z, out=room("slope", size, SCORED, WIDTH))
        slope += 1
        np.reciprocal(slope, out=slope)
        z *= slope  # z = h / (1 + |h|)
        p = np.matmul(z.reshape(flat, WIDTH), w["c"], out=room("p", flat, CLASSES))
        p += w["d"]
        p += voc.after.take(context[part].ravel(), 0, out=room("after", flat, CLASSES) if voc.after.dtype == kind else None, mode="clip")
        if large:
            p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        total = np.matmul(p, ones[:CLASSES], out=total)
        np.reciprocal(total, out=total)
        target = np.arange(flat) * CLASSES + cls[part].ravel()
        weight = scored[part].ravel().astype(kind)
        loss -= float((np.log(np.maximum(p.ravel()[target] * total[:, 0], 1e-12)) * weight).sum())
        weight /= n
        total[:, 0] *= weight
        p *= total
        p.ravel()[target] -= weight
        g["c"] += z.reshape(flat, WIDTH).T @ p
        g["d"] += p.sum(0)
        dh = np.matmul(p, w["c"].T, out=room("dh", flat, WIDTH)).reshape(size, SCORED, WIDTH)
        dh *= slope
        dh *= slope
        dv = np.matmul(a.transpose(0, 2, 1), dh, out=room("dv", size, WINDOW, WIDTH))
        ds = np.matmul(dh, v.transpose(0, 2, 1), out=room("ds", size, SCORED, WINDOW))
        ds *= a
        a *= np.matmul(ds.reshape(-1, WINDOW), ones[:WINDOW], out=total).reshape(size, SCORED, 1)
        ds -= a
        dq = np.matmul(ds, k, out=room("dq", size, SCORED, WIDTH))
        dk = np.matmul(ds.transpose(0, 2, 1), q, out=room("dk", size, WINDOW, WIDTH))
        cells, tails = cell.take(at[part].ravel(), 0).ravel(), cell.take(tail[part].ravel(), 0).ravel()
        for x, d, where in (("k", dk, cells), ("v", dv, cells), ("q", dq, tails), ("r", dh, tails)):
            np.add.at(of[x].view(two), where, d.reshape(-1).view(two))
            by[x] += d.reshape(size, -1).sum(0)
    dkv_of, dqr_of = (np.concatenate([of[x].reshape(-1, WIDTH) for x in xs], 1) for xs in ("kv", "qr"))
    dkv_at, dqr_at = (np.concatenate([by[x].reshape(-1, WIDTH) for x in xs], 1) for xs in ("kv", "qr"))
    dkv, dqr = e.T @ dkv_of + w["p"].T @ dkv_at, e.T @ dqr_of + last.T @ dqr_at
    g |= {"k": dkv[:, :WIDTH], "v": dkv[:, WIDTH:] @ w["o"].T, "o": w["v"].T @ dkv[:, WIDTH:]}
    g |= {"q": dqr[:, :WIDTH] * scale, "r": dqr[:, WIDTH:], "b": dqr_at[:, WIDTH:].sum(0)}
    g["p"] = dkv_at @ key_value.T
    g["p"][CONTEXT:] += dqr_at @ query_rest.T
    g["e"] = np.zeros_like(w["e"])
    g["e"][own] = dkv_of @ key_value.T + dqr_of @ query_rest.T
    return loss / n, g


def fit(w: dict[str, np.ndarray], voc: Vocabulary, windows: np.ndarray, rate: float, epochs: int = 1, batch: int = BATCH, seed: int = 1) -> tuple[dict[str, np.ndarray], float]:
    """Adam over ``windows`` [n, WINDOW + 1] (padding is -1, at both ends); returns weights and the last mean loss."""
    flat, cuts = np.concatenate([w[n].ravel() for n in w]), np.cumsum([w[n].size for n in w])[:-1]
    w = {n: x.reshape(w[n].shape) for n, x in zip(w, np.split(flat, cuts), strict=True)}  # parts of one array
    m, s, by, slope = (np.zeros_like(flat) for _ in range(4))
    slopes = dict(zip(w, np.split(slope, cuts), strict=True))
    rng, step, losses, room = np.random.default_rng(seed), 0, [0.0], Room(flat.dtype)
    for _ in range(epochs):
        losses = [0.0]
        for at in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // batch)):
            if not len(at):
                continue
            part = windows[at]
            there = part[:, :-1] >= 0
            loss, g = gradients(w, voc, np.maximum(part[:, :-1], 0), np.maximum(part[:, CONTEXT + 1 :], 0), there, there[:, CONTEXT:] & (part[:, CONTEXT + 1 :] >= 0), room)
            losses.append(loss)
            step += 1
            for n in w:
                slopes[n][:] = g[n].ravel()
            np.subtract(slope, m, out=by)
            by *= 0.1
            m += by
            np.square(slope, out=by)
            by -= s
            by *= 0.01
            s += by
            np.multiply(s, 1 / (1 - 0.99**step), out=by)
            np.sqrt(by, out=by)
            by += 1e-8
            np.divide(m, by, out=by)
            by *= rate / (1 - 0.9**step)
            flat -= by
    return w, float(np.mean(losses[1:] or [0.0]))


def document_windows(ids: np.ndarray, count: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs [n, WINDOW], targets [n, SCORED], there, scored, row): windows of many documents at once.

    ``begin`` stands before each document's first id. Every id is the target of one place.
    """
    n = -(-count // SCORED)
    row = np.repeat(np.arange(len(count)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    base = (np.cumsum(count) - count)[row]
    place = k[:, None] * SCORED - CONTEXT + np.arange(WINDOW)[None, :]  # of the id that this input predicts
    size = count[row][:, None]
    there = (place >= 0) & (place < size)
    at = np.clip(base[:, None] + place, 0, max(len(ids) - 1, 0))
    targets = ids[at[:, CONTEXT:]]
    inputs = np.where(place > 0, ids[np.maximum(at - 1, 0)], begin)
    return np.where(there, inputs, 0), targets, there, there[:, CONTEXT:], row
