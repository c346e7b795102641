"""Single linkage by a minimum spanning tree, built in Borůvka's rounds over a box tree.

In each round every component finds its shortest edge to another one, all of these join the tree, and the
components that they tie together become one; so there are at most log2(points) rounds.  A leaf of the box
tree and the next one along its curve give every component a first edge (some point is followed by one of
another component), whose length bounds the search: pairs of leaves farther apart than the bounds of all
their components, or within a single component, are dropped on the way down.  The rest are compared inside
tasks, and each pair of leaves returns one edge a component.

Equal lengths go to the smaller point numbers, so no round can close a circle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators import boxes
from tabloom.operators.graph import connected_components
from tabloom.operators.ordered import POS, positioned
from tabloom.session import cut_lineage

_EDGES = pa.schema([("comp", pa.int64()), ("square", pa.float64()), ("u", pa.int64()), ("v", pa.int64()), ("other", pa.int64())])


def _shortest(p, comp, x, q, other, y):
    """The shortest edge of each component of points ``p`` to a point of ``q`` in another one."""
    square = np.zeros((len(p), len(q)))
    for i in range(x.shape[1]):
        step = x[:, i, None] - y[None, :, i]
        square += step * step
    square[comp[:, None] == other[None, :]] = np.inf
    at = square.argmin(axis=1)  # points are sorted: the first of equal ones has the smallest number
    best = square[np.arange(len(p)), at]
    found = np.flatnonzero(np.isfinite(best))
    u, v = np.minimum(p, q[at]), np.maximum(p, q[at])
    order = found[np.lexsort((v[found], u[found], best[found], comp[found]))]
    order = order[np.append(True, comp[order][1:] != comp[order][:-1])[: len(order)]]
    return comp[order], best[order], u[order], v[order], other[at[order]]


def _comparer(d: int):
    """Rows in the order of (a, b, p): points of leaves a and b."""

    def compare(a, b, columns) -> pa.RecordBatch:
        leaf, p, comp, *xs = columns
        x = np.stack(xs, axis=1)
        sides = [(p[leaf == s], comp[leaf == s], x[leaf == s]) for s in (a, b)]
        found = [_shortest(*sides[0], *sides[1])] + ([_shortest(*sides[1], *sides[0])] if a != b else [])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], schema=_EDGES)

    def run(batches):
        at, held = None, []
        for batch in batches:
            a, b, *columns = (c.to_numpy() for c in batch.columns)
            if not len(a):
                continue
            starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            for start, end in zip(starts, np.append(starts[1:], len(a))):
                if (a[start], b[start]) != at:
                    if held:
                        yield compare(*at, [np.concatenate(c) for c in zip(*held)])
                    at, held = (a[start], b[start]), []
                held.append([c[start:end] for c in columns])
        if held:
            yield compare(*at, [np.concatenate(c) for c in zip(*held)])

    return run


def _compared(pairs: DataFrame, points: DataFrame, d: int) -> DataFrame:
    xs = [f"x{i}" for i in range(d)]
    one = pairs.join(points, F.col("a") == F.col("leaf"))
    two = pairs.where("a <> b").join(points, F.col("b") == F.col("leaf"))
    rows = one.union(two).select("a", "b", "leaf", "p", "comp", *xs)
    dealt = rows.repartition("a", "b").sortWithinPartitions("a", "b", "p")
    return dealt.mapInArrow(_comparer(d), "comp long, square double, u long, v long, other long")


def _roots(ties: DataFrame) -> DataFrame:
    """(comp, root): each component points to the one at its chosen edge; two that chose each other end the path.

    Paths are halved by joins until all end, so a path of n components takes log2(n) steps.
    """
    back = ties.select(F.col("comp").alias("other"), F.col("other").alias("_back"))
    jumps = cut_lineage(ties.join(back, "other").select("comp", F.when((F.col("_back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("root")))
    while True:
        on = jumps.select(F.col("comp").alias("root"), F.col("root").alias("_next"))
        further = cut_lineage(jumps.join(on, "root").select("comp", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_moved")))
        if not further.where("_moved").head(1):
            return further.drop("_moved")
        jumps = further.drop("_moved")


def _least(edges: DataFrame) -> DataFrame:
    best = edges.groupBy("comp").agg(F.min(F.struct("square", "u", "v", "other")).alias("e"))
    return cut_lineage(best.select("comp", "e.*"))


def spanning_tree(points: DataFrame, d: int, leaf: int = boxes.LEAF) -> DataFrame:
    """(u, v, square): the edges of the minimum spanning tree of ``points`` (p, leaf, x0, x1, ...)."""
    xs = [f"x{i}" for i in range(d)]
    current, tree_edges = points.withColumn("comp", F.col("p")), []
    while True:
        current = cut_lineage(current)
        sides = [f(x).alias(f"{e}{i}") for i, x in enumerate(xs) for e, f in (("lo", F.min), ("hi", F.max))]
        leaves = current.groupBy(F.col("leaf").alias("node")).agg(*sides, F.min("comp").alias("low"), F.max("comp").alias("high"))
        nodes = current.select(F.col("leaf").alias("a")).distinct()
        along = nodes.select("a", F.col("a").alias("b")).union(nodes.join(nodes.select((F.col("a") - 1).alias("b")), F.col("a") == F.col("b")).select("a", (F.col("a") + 1).alias("b")))
        first = _least(_compared(along, current, d))
        if not first.head(1):
            break  # one component
        bounds = current.select("leaf", "comp").distinct().join(first.select("comp", "square"), "comp").groupBy(F.col("leaf").alias("node")).agg(F.max("square").alias("bound"))
        tree = boxes.levels(leaves.join(bounds, "node"), d, {"low": F.min, "high": F.max, "bound": F.max})
        alone = (F.col("a_low") == F.col("a_high")) & (F.col("b_low") == F.col("b_high")) & (F.col("a_low") == F.col("b_low"))
        near = ~alone & (boxes.gap(d) <= F.greatest("a_bound", "b_bound"))
        rest = boxes.close_nodes(tree, near).where("b_node > a_node + 1").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
        chosen = _least(first.union(_compared(rest, current, d)))
        tree_edges.append(chosen.select("u", "v", "square").distinct())
        current = current.join(_roots(chosen.select("comp", "other")), "comp").drop("comp").withColumnRenamed("root", "comp")
    edges = points.sparkSession.createDataFrame([], "u long, v long, square double")
    for e in tree_edges:
        edges = edges.union(e)
    return cut_lineage(edges.distinct())


class SingleLinkage:
    """The merge tree of a table's rows; ``labels`` cuts it into any number of clusters."""

    def __init__(self, df: DataFrame, key: str, cols: list, leaf: int = boxes.LEAF):
        d = len(cols)
        xs = [f"x{i}" for i in range(d)]
        self.rows = cut_lineage(df.select(F.col(key).alias("_k"), *[c.cast("double").alias(x) for c, x in zip(cols, xs)]).na.drop())
        distinct = self.rows.groupBy(*xs).agg(F.min("_k").alias("_first"))
        placed = positioned(distinct.withColumn("_z", boxes.curve(distinct, xs)), ["_z", *xs])
        self.points = cut_lineage(placed.select(F.col(POS).alias("p"), F.floor(F.col(POS) / leaf).alias("leaf"), *xs, "_first"))
        self.xs = xs
        self.tree = spanning_tree(self.points.drop("_first"), d, leaf)

    def labels(self, k: int) -> DataFrame:
        """(_k, label): the tree without its k - 1 longest edges; clusters are numbered by their first key."""
        longest = self.tree.orderBy(F.desc("square"), F.desc("u"), F.desc("v")).limit(k - 1)
        kept = self.tree.join(longest, ["u", "v"], "left_anti")
        parts = connected_components(kept.select(F.col("u").alias("id_1"), F.col("v").alias("id_2")))
        named = self.points.join(parts.withColumnRenamed("node", "p"), "p", "left").withColumn("part", F.coalesce("component", "p"))
        named = cut_lineage(named.select(*self.xs, "_first", "part"))
        firsts = positioned(named.groupBy("part").agg(F.min("_first").alias("_first")), "_first")
        numbered = named.join(firsts.select("part", F.col(POS).cast("int").alias("label")), "part")
        return self.rows.join(numbered.select(*self.xs, "label"), self.xs).select("_k", "label")
