"""A small causal self-attention model over all subword ids, in numpy: training and batched scoring.

The HEAD most frequent ids are predicted in two steps: they are dealt to clusters of alike ones, a cluster
comes first and then a place there.  All other ids, the tail, are one more cluster of the first step,
inside which a tail cluster and a place there are predicted in two more steps.  Every id has an embedding
of its own.  Each step adds to the log-probabilities of the corpus's pairs of classes (a tail id counts
with its tail cluster there) a correction from one layer of causal self-attention (with a bias for each
distance) and a feed-forward layer.  Probabilities of all ids add up to 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

WIDTH, INNER = 32, 64
CLUSTERS, PLACES = 32, 32
HEAD = CLUSTERS * PLACES
TAIL = 222
CONTEXT, STRIDE = 32, 24
BATCH_WINDOWS = 128
_FAR = np.float32(-1e9)


@dataclass
class Classes:
    """class_of[id]: cluster * PLACES + place, or TAIL_FROM + tail cluster * places + place there.

    The rows of the tables are the HEAD, a tail id that isn't told apart, START, and the tail clusters.
    """

    class_of: np.ndarray
    by_cluster: np.ndarray  # [rows, CLUSTERS + 1] log-probability of the next cluster; the last is the tail
    by_place: np.ndarray  # [rows, CLUSTERS, PLACES] log-probability of the next place in each cluster
    by_tail: np.ndarray  # [rows, tail clusters] log-probability of the next tail cluster
    tail_place: np.ndarray  # [tail clusters, places] log-probability of the places; unused ones have _FAR

    def rows_of(self, classes: np.ndarray) -> np.ndarray:
        return np.where(classes < TAIL_FROM, classes, TAIL_FROM + (classes - TAIL_FROM) // len(self.tail_place))


START = HEAD + 1
TAIL_FROM = HEAD + 2


def tail_side(ids: int) -> int:
    """Tail clusters, and places in each, that hold the ids beside the head; at least TAIL."""
    return max(TAIL, math.isqrt(max(0, ids - HEAD - 1)) + 1)


def tail_slots(head: np.ndarray, counts: np.ndarray, signatures: np.ndarray) -> np.ndarray:
    """tail cluster * places + place of every id, -1 for the head; ids of alike neighbours come into one cluster.

    ``signatures`` are sums over an id's neighbours.  The ids are cut into strips along the first principal
    direction, and each strip is ordered along the second one; ids that never occur come last.
    """
    side = tail_side(len(counts))
    slots = np.full(len(counts), -1, dtype=np.int64)
    tail = np.setdiff1d(np.arange(len(counts)), head)
    unseen = counts[tail] == 0
    alike = signatures[tail] / (counts[tail, None] + 10.0)
    alike = alike - alike[~unseen].mean(axis=0) if not unseen.all() else alike
    _, vectors = np.linalg.eigh(alike[~unseen].T @ alike[~unseen])
    one, two = alike @ vectors[:, -1], alike @ vectors[:, -2]
    order = np.lexsort((tail, one, unseen))
    strip = np.empty(len(tail), dtype=np.int64)
    strip[order] = np.arange(len(tail)) // (side * max(1, math.isqrt(-(-int((~unseen).sum()) // side))))
    slots[tail[np.lexsort((tail, two, strip, unseen))]] = np.arange(len(tail))
    return slots


def head_ids(counts: np.ndarray) -> np.ndarray:
    """The HEAD most frequent ids; ties go to the smaller id."""
    return np.lexsort((np.arange(len(counts)), -counts))[:HEAD]


def _logs(table: np.ndarray) -> np.ndarray:
    return np.where(table > 0, np.log(np.maximum(table, 1e-300)), _FAR).astype("f4")


def arrange(head: np.ndarray, counts: np.ndarray, pairs: np.ndarray, slots: np.ndarray | None = None) -> Classes:
    """Classes from the ids' counts and the counts of pairs of rows, in the order of ``head``.

    Column HEAD of ``pairs`` counts the whole tail; the tail clusters' rows and columns may be missing.
    ``slots`` are those of tail_slots, else the tail is taken in the order of the ids.

    Ids that follow alike ids come into one cluster: they are ordered along the first direction of the
    pair table's columns.
    """
    smooth = counts + 0.1
    side = tail_side(len(counts))
    if slots is None:
        slots = tail_slots(head, counts * 0, np.zeros((len(counts), 2)))
    tail = slots >= 0
    places = np.zeros(side * side)
    places[slots[tail]] = smooth[tail]
    places = places.reshape(side, side)
    pairs = np.pad(pairs, [(0, TAIL_FROM + side - n) for n in pairs.shape])
    unigram = np.append(smooth[head], max(places.sum(), 0.1))
    unigram = unigram / unigram.sum()
    # pairs are shrunk towards the unigram distribution
    follow = pairs[:, : HEAD + 1] + 20.0 * unigram
    follow /= follow.sum(axis=1, keepdims=True)
    lift = np.sqrt(follow[:HEAD, :HEAD]) - np.sqrt(unigram[:HEAD])
    gram = lift.T @ lift
    _, vectors = np.linalg.eigh(gram / max(np.abs(gram).max(), 1e-12))
    order = np.lexsort((np.arange(HEAD), vectors[:, -1]))
    class_of = np.where(tail, TAIL_FROM + slots, 0).astype(np.int32)
    class_of[head[order]] = np.arange(HEAD)
    rows = np.concatenate([order, np.arange(HEAD, len(follow))])
    table = np.concatenate([follow[rows][:, order], follow[rows][:, HEAD:]], axis=1)
    grouped = table[:, :HEAD].reshape(len(rows), CLUSTERS, PLACES)
    mass = grouped.sum(axis=2)
    in_tail = places.sum(axis=1)
    tail_follow = pairs[rows, TAIL_FROM:] + 20.0 * in_tail / max(in_tail.sum(), 0.1)
    tail_follow /= np.maximum(tail_follow.sum(axis=1, keepdims=True), 1e-9)
    return Classes(
        class_of, np.log(np.concatenate([mass, table[:, HEAD:]], axis=1)).astype("f4"), np.log(grouped / mass[:, :, None]).astype("f4"),
        _logs(tail_follow), _logs(places / np.maximum(in_tail, 1e-9)[:, None]),
    )


def new_parameters(seed: int = 0, side: int = TAIL) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def draw(*shape, scale=None):
        return (rng.standard_normal(shape) * (scale if scale is not None else shape[0] ** -0.5)).astype("f4")

    return {
        "embed": draw(TAIL_FROM + side * side, WIDTH, scale=0.5),
        "distance": np.zeros(CONTEXT, dtype="f4"),
        "query": draw(WIDTH, WIDTH), "key": draw(WIDTH, WIDTH), "value": draw(WIDTH, WIDTH), "mix": draw(WIDTH, WIDTH, scale=0.1),
        "up": draw(WIDTH, INNER), "up_bias": np.zeros(INNER, dtype="f4"), "down": draw(INNER, WIDTH, scale=0.1),
        "cluster": draw(WIDTH, CLUSTERS + 1, scale=0.02),
        "place": draw(CLUSTERS, WIDTH, PLACES, scale=0.02),
        "tail": draw(WIDTH, side, scale=0.02),
        "tail_place": np.zeros((side, WIDTH, side), dtype="f4"),
    }


_ROWS, _COLUMNS = np.indices((CONTEXT, CONTEXT))
_CAUSAL = _ROWS >= _COLUMNS
_DISTANCE = np.where(_CAUSAL, _ROWS - _COLUMNS, 0)


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def _states(p: dict, inputs: np.ndarray) -> tuple:
    """States after the layer for [windows, CONTEXT] classes, and what the gradient needs."""
    e = p["embed"][inputs]
    q, k, v = e @ p["query"], e @ p["key"], e @ p["value"]
    weights = q @ k.transpose(0, 2, 1)
    weights *= np.float32(WIDTH**-0.5)
    weights += np.where(_CAUSAL, p["distance"][_DISTANCE], _FAR)
    _softmax(weights)
    z = weights @ v
    h1 = z @ p["mix"]
    h1 += e
    u = h1 @ p["up"]
    u += p["up_bias"]
    np.maximum(u, 0, out=u)
    return h1 + u @ p["down"], (e, q, k, v, weights, z, h1, u)


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of one column in each row; overwrites ``logits``."""
    logits -= logits.max(axis=1, keepdims=True)
    picked = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    return picked - np.log(logits.sum(axis=1))


def _by_cluster(clusters: np.ndarray, number: int = CLUSTERS):
    """(cluster, places of its rows) of the rows of the first clusters."""
    order = np.argsort(clusters, kind="stable")
    edges = np.searchsorted(clusters[order], np.arange(number + 1))
    for c in np.flatnonzero(np.diff(edges)):
        yield c, order[edges[c] : edges[c + 1]]


def _steps(target: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster of each target, rows of the told-apart tail, their tail clusters and places there)."""
    rows = np.flatnonzero(target >= TAIL_FROM)
    return np.minimum(target, HEAD) // PLACES, rows, *np.divmod(target[rows] - TAIL_FROM, side)


def _class_logs(p: dict, classes: Classes, h: np.ndarray, current: np.ndarray, target: np.ndarray) -> np.ndarray:
    clusters, tail, tail_clusters, tail_places = _steps(target, len(classes.tail_place))
    current = classes.rows_of(current)
    logs = _log_softmax_at(classes.by_cluster[current] + h @ p["cluster"], clusters)
    for c, rows in _by_cluster(clusters):
        logits = classes.by_place[current[rows], c] + h[rows] @ p["place"][c]
        logs[rows] += _log_softmax_at(logits, target[rows] - c * PLACES)
    if len(tail):
        h = h[tail]
        logs[tail] += _log_softmax_at(classes.by_tail[current[tail]] + h @ p["tail"], tail_clusters)
        for c, rows in _by_cluster(tail_clusters, len(classes.tail_place)):
            logs[tail[rows]] += _log_softmax_at(classes.tail_place[c] + h[rows] @ p["tail_place"][c], tail_places[rows])
    return logs


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first position, first and last scored place) of the windows over texts of these lengths.

    Windows overlap by CONTEXT - STRIDE places; only the first window of a text scores those.
    """
    n = 1 + np.maximum(0, -(-(lengths - CONTEXT) // STRIDE))
    text = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = nth * STRIDE
    return text, first, np.where(nth > 0, CONTEXT - STRIDE, 0), np.minimum(CONTEXT, lengths[text] - first)


def score_texts(p: dict, classes: Classes, texts: list[np.ndarray], batch: int = BATCH_WINDOWS) -> np.ndarray:
    """Natural log-probability of each text's ids; a text is a non-empty array of ids."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ids = np.concatenate(texts)
    target = classes.class_of[ids]
    begins = np.cumsum(lengths) - lengths
    source = np.concatenate([[START], target[:-1]])
    source[begins] = START
    source = np.concatenate([source, np.full(CONTEXT, START, dtype=source.dtype)])
    text, first, scored_from, scored_to = windows(lengths)
    at = begins[text] + first
    place = np.arange(CONTEXT)
    logs = np.zeros(len(ids))
    for a in range(0, len(at), batch):
        part = slice(a, a + batch)
        where = at[part, None] + place
        inputs = source[where]
        scored = (place >= scored_from[part, None]) & (place < scored_to[part, None])
        h, _ = _states(p, inputs)
        places = where[scored]
        logs[places] = _class_logs(p, classes, h[scored], inputs[scored], target[places])
    return np.add.reduceat(logs, begins)


def _gradients(p: dict, classes: Classes, inputs: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
    """Mean loss over all places and its gradient."""
    h, (e, q, k, v, weights, z, h1, u) = _states(p, inputs)
    n = inputs.size
    flat, current, wanted = h.reshape(n, WIDTH), classes.rows_of(inputs.ravel()), target.ravel()
    clusters, tail, tail_clusters, tail_places = _steps(wanted, len(classes.tail_place))
    g = {name: np.zeros_like(x) for name, x in p.items()}
    prob = _softmax(classes.by_cluster[current] + flat @ p["cluster"])
    loss = -np.log(prob[np.arange(n), clusters] + 1e-30).sum()
    prob[np.arange(n), clusters] -= 1
    g["cluster"] = flat.T @ prob / n
    dh = prob @ p["cluster"].T
    for c, rows in _by_cluster(clusters):
        prob = _softmax(classes.by_place[current[rows], c] + flat[rows] @ p["place"][c])
        at = (np.arange(len(rows)), wanted[rows] - c * PLACES)
        loss -= np.log(prob[at] + 1e-30).sum()
        prob[at] -= 1
        g["place"][c] = flat[rows].T @ prob / n
        dh[rows] += prob @ p["place"][c].T
    if len(tail):
        prob = _softmax(classes.by_tail[current[tail]] + flat[tail] @ p["tail"])
        at = (np.arange(len(tail)), tail_clusters)
        loss -= np.log(prob[at] + 1e-30).sum()
        prob[at] -= 1
        g["tail"] = flat[tail].T @ prob / n
        dh[tail] += prob @ p["tail"].T
        for c, rows in _by_cluster(tail_clusters, len(classes.tail_place)):
            prob = _softmax(classes.tail_place[c] + flat[tail[rows]] @ p["tail_place"][c])
            at = (np.arange(len(rows)), tail_places[rows])
            loss -= np.log(prob[at] + 1e-30).sum()
            prob[at] -= 1
            g["tail_place"][c] = flat[tail[rows]].T @ prob / n
            dh[tail[rows]] += prob @ p["tail_place"][c].T
    dh = (dh / n).astype("f4")
    flat_u = u.reshape(n, INNER)
    du = (dh @ p["down"].T) * (flat_u > 0)
    g["down"], g["up"], g["up_bias"] = flat_u.T @ dh, h1.reshape(n, WIDTH).T @ du, du.sum(axis=0)
    dh1 = dh + du @ p["up"].T
    g["mix"] = z.reshape(n, WIDTH).T @ dh1
    dz = (dh1 @ p["mix"].T).reshape(z.shape)
    dw = dz @ v.transpose(0, 2, 1)
    ds = weights * (dw - (dw * weights).sum(axis=2, keepdims=True))
    np.add.at(g["distance"], _DISTANCE[_CAUSAL], ds.sum(axis=0)[_CAUSAL])
    ds *= np.float32(WIDTH**-0.5)
    dq, dk, dv = ds @ k, ds.transpose(0, 2, 1) @ q, weights.transpose(0, 2, 1) @ dz
    flat_e = e.reshape(n, WIDTH)
    de = dh1
    for name, d in (("query", dq), ("key", dk), ("value", dv)):
        d = d.reshape(n, WIDTH)
        g[name] = flat_e.T @ d
        de = de + d @ p[name].T
    current = inputs.ravel()
    order = np.argsort(current, kind="stable")
    heads = np.flatnonzero(np.diff(current[order], prepend=-1))
    g["embed"][current[order][heads]] = np.add.reduceat(de[order], heads, axis=0)
    return loss / n, g


def without_effect(p: dict) -> dict:
    """Parameters that leave the log-probabilities of the pairs as they are."""
    return {name: np.zeros_like(x) if name in ("cluster", "place", "tail", "tail_place") else x for name, x in p.items()}


def weight_shape(name: str, x: np.ndarray) -> tuple[int, ...]:
    """Embeddings and places are averaged by what was seen of their class or cluster, all others by the places."""
    return (len(x) if name in ("embed", "place", "tail_place") else 1, *[1] * (x.ndim - 1))


def train(
    classes: Classes, blocks: list[np.ndarray], p: dict, begin: float = 0.0, end: float = 1.0, batch: int = BATCH_WINDOWS, rate: float = 8e-3, seed: int = 0
) -> tuple[dict, dict]:
    """Adam over the blocks in random windows, once, from a copy of ``p``: (parameters, weights for averages).

    A block is the id before it (the number of ids before a text) and its ids.  The rate falls to a tenth
    over the whole training, of which this is the part from ``begin`` to ``end``.
    """
    p = {name: x.copy() for name, x in p.items()}
    class_of = np.append(classes.class_of, START)
    target = class_of[np.concatenate([b[1:] for b in blocks])]
    source = class_of[np.concatenate([b[:-1] for b in blocks])]
    count = len(target) // CONTEXT
    if not count:
        source = np.concatenate([source, np.full(CONTEXT, START)])
        target = np.concatenate([target, np.full(CONTEXT, HEAD)])
        count = 1
    side = len(classes.tail_place)
    clusters, _, tail_clusters, _ = _steps(target, side)
    seen = {
        "embed": np.bincount(source, minlength=len(p["embed"])), "place": np.bincount(clusters, minlength=CLUSTERS)[:CLUSTERS],
        "tail_place": np.bincount(tail_clusters, minlength=side),
    }
    weights = {name: seen.get(name, np.array([len(target)])).reshape(weight_shape(name, x)) for name, x in p.items()}
    rng = np.random.default_rng(seed)
    steps = -(-count // batch)
    first, second = ({name: np.zeros_like(x) for name, x in p.items()} for _ in range(2))
    step = 0
    starts = rng.permutation(count) * CONTEXT + int(rng.integers(0, max(1, len(target) - count * CONTEXT + 1)))
    for a in range(0, count, batch):
        where = starts[a : a + batch, None] + np.arange(CONTEXT)
        _, g = _gradients(p, classes, source[where], target[where])
        step += 1
        pace = rate * (1 - 0.9 * (begin + (end - begin) * step / steps))
        # of the two large tables only the rows in the batch move
        moved = {"embed": np.unique(source[where]), "tail_place": np.unique(_steps(target[where].ravel(), side)[2])}
        for name, grad in g.items():
            at = moved.get(name, slice(None))
            grad, one, two = grad[at], first[name][at], second[name][at]
            one += 0.1 * (grad - one)
            two += 0.01 * (grad * grad - two)
            first[name][at], second[name][at] = one, two
            p[name][at] -= (pace * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)).astype("f4")
    return p, weights
