"""Links between texts by products of dense blocks.

Texts over a small vocabulary resemble each other in a share of all pairs that does not shrink with the
table, so neither the links nor the candidates of a filter may be written down.  The texts are dealt to
blocks; each pair of blocks is a task that multiplies tiles of its texts.  A tile is told in single
precision, and what lies within ``NEAR`` of the threshold again in double precision.  What leaves a task
grows with its texts (a text's number of links, or the links that join its groups) or is the pairs themselves.

A product is at most the sum, over groups of terms, of the products of the two norms within the group.
Texts of a kind stand together, so that bound leaves out most tiles of texts of different kinds, and only
terms of both sides are multiplied.  Kinds and groups come from a few texts; they tell how much is saved, not
what is found.

With an unbounded vocabulary the frequent terms have a column each and the others share ``FOLDED - FREQUENT``
columns: a text has its norm there, so the product is again an upper bound, and what exceeds the threshold is
told by the terms themselves.

The products grow with the square of the texts; rows moved grow with the texts times the number of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import reach_workers, saved

#: Vocabularies up to this size are compared by dense products.
DENSE_TERMS = 4_096
BLOCK_TEXTS = 1 << 17
#: Columns of unbounded vocabularies, and how many of them are of one term; their texts are longer.
FOLDED, FREQUENT = 2_048, 1_024
FOLDED_TEXTS = 1 << 15
ROWS, COLUMNS = 1_024, 4_096
NEAR = 2e-5
#: Kinds of texts and as many groups of terms, from so many texts.
KINDS, KIND_TEXTS = 64, 4_000
#: Rows of a batch of pairs.
PAIRS = 1 << 16


def text_rows(vectors: DataFrame) -> DataFrame:
    """One row a text: (rep, t, tf, idf, norm), the numbers of its terms and what their weights are made of."""
    # as many terms as the vocabulary was limited to
    numbers = vectors.select("term").distinct().withColumn("_t", (F.row_number().over(Window.orderBy("term")) - 1).cast("short"))
    pairs = vectors.join(F.broadcast(saved(numbers)), "term")
    lists = pairs.groupBy("rep").agg(F.collect_list(F.struct("_t", F.col("tf").cast("int").alias("tf"), "idf")).alias("l"), F.first("norm").alias("norm"))
    return lists.select("rep", F.col("l._t").alias("t"), F.col("l.tf").alias("tf"), F.col("l.idf").alias("idf"), "norm")


def folded_rows(vectors: DataFrame) -> DataFrame:
    """One row a text: (rep, t, tf, norm); terms are numbered from the most frequent on, and those of one text alone are left out."""
    lists = vectors.groupBy("rep").agg(F.collect_list(F.when(F.col("df") > 1, F.struct(F.col("term").cast("int").alias("t"), F.col("tf").cast("int").alias("tf")))).alias("l"), F.first("norm").alias("norm"))
    return lists.select("rep", F.col("l.t").alias("t"), F.col("l.tf").alias("tf"), "norm")


def _idf(rows: DataFrame) -> np.ndarray:
    """The second factor of the weights, by the number of the term; as many as the vocabulary was limited to."""
    found = rows.select(F.explode(F.arrays_zip("t", "idf")).alias("x")).select("x.t", "x.idf").distinct().collect()
    out = np.zeros(max((r["t"] for r in found), default=0) + 1)
    for r in found:
        out[r["t"]] = r["idf"]
    return out


def _ends(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _flat(ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``at``, where) of the terms of the texts at ``at``."""
    sizes = ends[at + 1] - ends[at]
    which = np.repeat(np.arange(len(at)), sizes)
    return which, np.arange(len(which)) + np.repeat(ends[at] - _ends(sizes)[:-1], sizes)


class _Block:
    """Texts in the order of their kinds; ``columns`` and ``weights`` of one text lie together.

    ``terms``: the numbers of the terms, if several of them share a column.
    """

    def __init__(self, rep, sizes, columns, weights, width, groups, terms=None, beside=()):
        self.rep, self.width, self.beside = rep, width, beside
        self.ends, self.columns, self.weights = _ends(sizes), columns, weights
        self.terms, self.term_ends, self.term_weights = terms, self.ends, weights
        text = np.repeat(np.arange(len(rep)), sizes)
        if terms is not None and len(text):
            place, of = np.unique(text * width + columns, return_inverse=True)
            self.weights = np.sqrt(np.bincount(of, weights * weights))
            text, self.columns = place // width, (place % width).astype("i2")
            self.ends = _ends(np.bincount(text, minlength=len(rep)))
        kinds = int(groups.max()) + 1
        squares = np.bincount(text * kinds + groups[self.columns], self.weights * self.weights, len(rep) * kinds)
        self.profile = np.sqrt(squares).astype("f4").reshape(len(rep), kinds)

    def __len__(self):
        return len(self.rep)

    def dense(self, at: np.ndarray, kind: str = "f4") -> np.ndarray:
        out = np.zeros((len(at), self.width), kind)
        which, where = _flat(self.ends, at)
        out[which, self.columns[where]] = self.weights[where]
        return out


def _by_terms(left: _Block, right: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the texts at i and j from the terms they share."""
    out = np.zeros(len(i))
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else []
    for start, end in zip(starts, [*starts[1:], len(i)]):
        a = slice(left.term_ends[i[start]], left.term_ends[i[start] + 1])
        terms, weights = left.terms[a], left.term_weights[a]
        by = np.argsort(terms)
        terms, weights = terms[by], weights[by]
        for part in range(start, end, 512):
            at = j[part : min(part + 512, end)]
            which, where = _flat(right.term_ends, at)
            found = right.terms[where]
            place = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
            parts = np.where(terms[place] == found, weights[place] * right.term_weights[where], 0.0)
            out[order[part : part + len(at)]] = np.bincount(which, parts, len(at))
    return out


def _products(left: _Block, right: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the texts at i and j in double precision."""
    if left.terms is not None:
        return _by_terms(left, right, i, j)
    x, at_x = np.unique(i, return_inverse=True)
    y, at_y = np.unique(j, return_inverse=True)
    if len(x) * len(y) <= 40 * len(i):
        a, b = left.dense(x, "f8"), right.dense(y, "f8")
        both = a.any(axis=0) & b.any(axis=0)
        return (a[:, both] @ b[:, both].T)[at_x, at_y]
    out = np.empty(len(i))
    for k in range(0, len(i), 2_000):
        part = slice(k, k + 2_000)
        out[part] = np.einsum("ij,ij->i", left.dense(i[part], "f8"), right.dense(j[part], "f8"))
    return out


def _told(left, right, x, y, product, near, threshold) -> np.ndarray:
    """Which pairs of the texts at x and y are above the threshold, of those in ``near``."""
    maybe = (product > threshold - NEAR) & near
    # a bound tells only what is below
    sure = np.zeros_like(maybe) if left.terms is not None else maybe & (product > threshold + NEAR)
    i, j = np.nonzero(maybe ^ sure)
    sure[i, j] = _products(left, right, x[i], y[j]) > threshold
    return sure


def _tiles(left: _Block, right: _Block, threshold: float, wanted=None):
    """(places in the left block, in the right block, which of these pairs are above the threshold) of all tiles that have
    any candidates; a block with itself above the diagonal.

    ``wanted(near, rows, columns)`` drops pairs from ``near`` and tells rows that differ from the others in what is left.
    """
    for r in range(0, len(left), ROWS):
        rows = np.arange(r, min(r + ROWS, len(left)))
        a = None
        for c in range(r if left is right else 0, len(right), COLUMNS):
            columns, b = np.arange(c, min(c + COLUMNS, len(right))), None
            near = left.profile[rows] @ right.profile[columns].T > threshold - NEAR
            if left is right:
                near &= rows[:, None] < columns[None, :]
            apart = np.zeros(len(rows), bool) if wanted is None else wanted(near, rows, columns)
            for part in (apart, ~apart):
                x = np.flatnonzero(near.any(axis=1) & part)
                y = np.flatnonzero(near[x].any(axis=0))
                if not len(y):
                    continue
                a = left.dense(rows) if a is None else a
                b = right.dense(columns) if b is None else b
                both = np.flatnonzero(a[x].any(axis=0) & b[y].any(axis=0))
                product = a[np.ix_(x, both)] @ b[np.ix_(y, both)].T
                yield rows[x], columns[y], _told(left, right, rows[x], columns[y], product, near[np.ix_(x, y)], threshold)


def _counts(left: _Block, right: _Block, thresholds):
    """How many texts of the other block each text is linked with, for each threshold."""
    least = min(thresholds)
    here, there = np.zeros((len(thresholds), len(left)), np.int64), np.zeros((len(thresholds), len(right)), np.int64)
    for x, y, over in _tiles(left, right, least):
        for k, threshold in enumerate(thresholds):
            if threshold > least:
                i, j = np.nonzero(over)
                above = np.zeros_like(over)
                above[i, j] = _products(left, right, x[i], y[j]) > threshold
            else:
                above = over
            here[k, x] += above.sum(axis=1)
            there[k, y] += above.sum(axis=0)
    made = [np.concatenate([left.rep, right.rep]), *np.concatenate([here, there], axis=1)]
    found = np.max(made[1:], axis=0) > 0
    yield pa.RecordBatch.from_arrays([pa.array(x[found]) for x in made], names=["rep", *[f"n{k}" for k in range(len(thresholds))]])


def _pairs(left: _Block, right: _Block, thresholds):
    """The pairs themselves; beside the numbers of the texts stand their keys and copies."""
    # those of a text's place among both blocks
    keys, copies = (pa.concat_arrays([a, b]) for a, b in zip(left.beside, right.beside))
    for x, y, over in _tiles(left, right, thresholds[0]):
        i, j = np.nonzero(over)
        similarity = _products(left, right, x[i], y[j])
        for k in range(0, len(i), PAIRS):
            a, b = x[i[k : k + PAIRS]], y[j[k : k + PAIRS]]
            turned = left.rep[a] > right.rep[b]
            at = np.where(turned, b + len(left), a), np.where(turned, a, b + len(left))
            made = [keys.take(pa.array(at[0])), keys.take(pa.array(at[1])), pa.array(similarity[k : k + PAIRS]), copies.take(pa.array(at[0])), copies.take(pa.array(at[1]))]
            yield pa.RecordBatch.from_arrays(made, names=["id_1", "id_2", "similarity", "copies_1", "copies_2"])


class _Forest:
    """Groups of the texts of a task."""

    def __init__(self, n: int):
        self.group = np.arange(n)
        self.parent = self.group.copy()

    def _root(self, x: int) -> int:
        while (up := self.parent[x]) != x:
            self.parent[x] = x = self.parent[up]
        return x

    def join(self, over: np.ndarray, rows: np.ndarray, columns: np.ndarray):
        """Links that join groups, as many as there are groups less."""
        while True:
            cross = over & (self.group[rows][:, None] != self.group[columns][None, :])
            # one link of each text that has any, so the groups that are left halve at least
            i, j = np.flatnonzero(cross.any(axis=1)), np.flatnonzero(cross.any(axis=0))
            if not len(i):
                return
            for a, b in zip(np.concatenate([i, cross[:, j].argmax(axis=0)]), np.concatenate([cross[i].argmax(axis=1), j])):
                x, y = self._root(rows[a]), self._root(columns[b])
                if x != y:
                    self.parent[max(x, y)] = min(x, y)
                    yield rows[a], columns[b]
            self.group = self.parent
            while not np.array_equal(up := self.parent[self.group], self.group):
                self.group = up
            self.parent = self.group.copy()


def _joining(earlier: bool):
    """Links that join the texts' groups; with ``earlier`` also one to an earlier text for each text that has any."""

    def links(left: _Block, right: _Block, thresholds):
        shift = 0 if left is right else len(left)
        rep = np.concatenate([left.rep, right.rep]) if shift else left.rep
        forest, first, pairs = _Forest(len(rep)), np.full(len(rep), -1), []

        def wanted(near, rows, columns):
            to = columns + shift
            here, there = forest.group[rows], forest.group[to]
            tells = here[:, None] != there[None, :]
            if earlier:
                later = rep[rows][:, None] < rep[to][None, :]
                tells |= (later & (first[to] < 0)[None, :]) | (~later & (first[rows] < 0)[:, None])
            near &= tells
            names, sizes = np.unique(there, return_counts=True)
            return here == names[sizes.argmax()]

        for x, y, over in _tiles(left, right, thresholds[0], wanted):
            to = y + shift
            pairs.extend(forest.join(over, x, to))
            if not earlier:
                continue
            later = rep[x][:, None] < rep[to][None, :]
            for before, of, others in ((over & later, to, x), ((over & ~later).T, x, to)):
                new = before.any(axis=0) & (first[of] < 0)
                first[of[new]] = others[before[:, new].argmax(axis=0)]
        later = np.flatnonzero(first >= 0)
        i, j = np.array(pairs, np.int64).reshape(-1, 2).T
        a, b = rep[np.concatenate([i, first[later]])], rep[np.concatenate([j, later])]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["id_1", "id_2"])

    return links


class _Kinds:
    """Directions around which the texts lie, in an order in which neighbours resemble each other, and a group for each column."""

    def __init__(self, some: np.ndarray, width: int):
        centres = some[np.random.default_rng(0).permutation(len(some))[:KINDS]]
        for _ in range(10):
            nearest = (some @ centres.T).argmax(axis=1) if len(centres) else np.zeros(0, int)
            for k in range(len(centres)):
                middle = some[nearest == k].sum(axis=0)
                if length := np.linalg.norm(middle):
                    centres[k] = middle / length
        left, order = list(range(1, len(centres))), [0][: len(centres)]
        while left:
            order.append(left.pop(int((centres[left] @ centres[order[-1]]).argmax())))
        self.centres = centres[order]
        self.groups = self.centres.argmax(axis=0) if len(order) else np.zeros(width, int)

    def of(self, block: _Block) -> np.ndarray:
        out = np.zeros(len(block), np.int32)
        for k in range(0, len(block), ROWS):
            at = np.arange(k, min(k + ROWS, len(block)))
            if len(self.centres):
                out[at] = (block.dense(at) @ self.centres.T).argmax(axis=1)
        return out


class _Plan:
    """How the rows of text_rows or folded_rows become blocks; ``beside`` are columns that go with them.

    ``steps``, for folded rows: the first number of the terms of each document frequency, ascending, and their second factor.
    """

    def __init__(self, rows: DataFrame, steps=None, beside=()):
        self.rows, self.steps, self.beside, self.n = rows, steps, list(beside), rows.count()
        self.idf = _idf(rows) if steps is None else None
        self.width = len(self.idf) if steps is None else FOLDED
        none = np.zeros(self.width, int)
        read, every = self.reader(none), max(1, self.n // KIND_TEXTS)
        some = rows.where(F.pmod(F.xxhash64("rep"), F.lit(every)) == 0).limit(2 * KIND_TEXTS).select("rep", "t", "tf", "norm").toArrow()
        held = read(some.column(0).to_numpy(), [c.chunks or [pa.array([], c.type)] for c in some.columns[1:]])
        self.kinds = _Kinds(held.dense(np.arange(len(held))), self.width)

    def reader(self, groups: np.ndarray):
        """A function that makes a block of (rep, held t, tf and norm, held columns of ``beside``)."""
        steps, idf, width = self.steps, self.idf, self.width

        def block(rep, parts, beside=()) -> _Block:
            t, tf, norm = (pa.concat_arrays(p) for p in parts)
            sizes, terms = np.diff(t.offsets.to_numpy()), t.flatten().to_numpy()
            if steps is None:
                factor, columns = idf[terms], terms
            else:
                factor = steps[1][np.searchsorted(steps[0], terms, "right") - 1]
                # the rest is dealt out by the bits of a product
                shared = (terms.astype("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(width - FREQUENT)
                columns = np.where(terms < FREQUENT, terms, FREQUENT + shared.astype("i4"))
            # the same product and quotient as in the vectors
            weights = tf.flatten().to_numpy() * factor / np.repeat(norm.to_numpy(), sizes)
            return _Block(rep, sizes, columns, weights, width, groups, None if steps is None else terms, beside)

        return block

    def dealt(self) -> DataFrame:
        """Each row once for every pair of blocks that its own is part of, sorted by pairs, blocks and kinds in tasks."""
        kinds, names = self.kinds, ["rep", "t", "tf", "norm", *self.beside]
        read = self.reader(kinds.groups)

        def kind(batches):
            for batch in batches:
                if batch.num_rows:
                    made = read(batch.column(0).to_numpy(), [[c] for c in batch.columns[1:4]])
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds.of(made))], names=[*names, "kind"])

        rows = self.rows.select(*names)
        marked = saved(rows.mapInArrow(kind, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", kind int"))
        # enough pairs for every core, and blocks of bounded size
        cores = rows.sparkSession.sparkContext.defaultParallelism
        most = min(BLOCK_TEXTS if self.steps is None else FOLDED_TEXTS, math.ceil(self.n / math.sqrt(10 * cores)) or 1)
        sizes = {r["kind"]: r["count"] for r in marked.groupBy("kind").count().collect()}
        first, parts, blocks, room = [], [], 0, 0
        for k in range(max(sizes, default=0) + 1):
            n = sizes.get(k, 0)
            if n > room + most / 4:
                # a large kind fills blocks of its own
                cut = max(1, round(n / most))
                first.append(blocks)
                blocks, room = blocks + cut, most - n if cut == 1 else 0
            else:
                cut, room = 1, room - n
                first.append(max(blocks - 1, 0))
            parts.append(cut)
        listed = [F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("kind") + 1) for xs in (first, parts)]
        own = marked.withColumn("own", (listed[0] + F.pmod(F.xxhash64("rep"), listed[1])).cast("int"))
        each = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))
        keyed = each.select(F.least("own", "_other").alias("low"), F.greatest("own", "_other").alias("high"), "own", *names, "kind")
        return keyed.repartition(max(blocks, 1) * (max(blocks, 1) + 1), "low", "high").sortWithinPartitions("low", "high", "own", "kind", "rep")

    def paired(self, compare, thresholds):
        """Rows in the order of (low, high, own, kind, rep): ``compare`` on each pair of blocks."""
        read = self.reader(self.kinds.groups)

        def told(low, high, held):
            sides = []
            for name in {low, high}:
                of = [columns for own, columns in held if own == name]
                if of:
                    rep, *columns = zip(*of)
                    sides.append((name, read(np.concatenate([r.to_numpy() for r in rep]), columns[:3], [pa.concat_arrays(c) for c in columns[3:]])))
            sides.sort(key=lambda s: s[0])
            if len(sides) == 2 or low == high:
                yield from compare(sides[0][1], sides[-1][1], thresholds)

        def run(batches):
            at, held = None, []
            for batch in batches:
                low, high, own = (batch.column(k).to_numpy() for k in range(3))
                change = (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (own[1:] != own[:-1])
                starts = np.flatnonzero(np.append(True, change)) if len(low) else []
                for start, end in zip(starts, [*starts[1:], len(low)]):
                    key = low[start], high[start]
                    if key != at:
                        if held:
                            yield from told(*at, held)
                        at, held = key, []
                    held.append((own[start], batch.slice(start, end - start).columns[3:-1]))
            if held:
                yield from told(*at, held)

        return run


def _compared(rows: DataFrame, compare, thresholds, schema: str, **how) -> DataFrame:
    reach_workers(rows.sparkSession)
    plan = _Plan(rows, **how)
    return plan.dealt().mapInArrow(plan.paired(compare, tuple(thresholds)), schema)


def joining_links(rows: DataFrame, threshold: float, earlier: bool = True) -> DataFrame:
    """(id_1 < id_2): links between texts of text_rows, numbered by ``rep`` (long), enough to tell their components and,
    with ``earlier``, which texts have a similar one before them."""
    return _compared(rows, _joining(earlier), [threshold], "id_1 long, id_2 long").distinct()


def link_numbers(rows: DataFrame, thresholds) -> DataFrame:
    """(rep, n0, n1, ...): how many other texts have a cosine above each threshold, for texts with any."""
    names = [f"n{k}" for k in range(len(thresholds))]
    found = _compared(rows, _counts, thresholds, ", ".join(["rep long", *[f"{n} long" for n in names]]))
    return found.groupBy("rep").agg(*[F.sum(n).alias(n) for n in names])


def linked_pairs(rows: DataFrame, threshold: float, key: str, copies: str, steps=None) -> DataFrame:
    """(id_1, id_2, similarity, copies_1, copies_2): the pairs above the threshold, named by their ``key`` in the order of ``rep``.

    They leave the tasks that find them and are not moved again.
    """
    kinds = dict(rows.dtypes)
    schema = f"id_1 {kinds[key]}, id_2 {kinds[key]}, similarity double, copies_1 {kinds[copies]}, copies_2 {kinds[copies]}"
    return _compared(rows, _pairs, [threshold], schema, steps=steps, beside=(key, copies))
