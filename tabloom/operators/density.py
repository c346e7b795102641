"""The steps of DBSCAN on points in blocks along a space-filling curve, for any number of columns.

A block is compared in one task, so a point that has enough neighbours in its own block is core without meeting any
other.  Only points that are still open meet the blocks that their box can reach: those with too few neighbours yet,
core points outside the largest component, and points that are not core.  No pair of points leaves a task: counts,
pairs of components and labels do.  Distances are sums of squares in the order of the columns, as in SQL.

Points are (POS, x0, x1, ...) and what a step needs beside; POS is their place on the curve.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators import boxes
from tabloom.operators.graph import connected_components
from tabloom.operators.ordered import POS, positioned
from tabloom.session import cut_lineage, reach_workers

#: Leaves of a block, and of a block of points that meet others; rows compared with a leaf at a time.
BLOCK_LEAVES, ASKED_LEAVES, CHUNK = 64, 512, 1024
#: About so many core points meet all blocks first, so that few are outside the largest component afterwards.
LINKING = 4096


def _columns(table: pa.Table, d: int) -> np.ndarray:
    return np.stack([table.column(f"x{i}").to_numpy() for i in range(d)])


def _near(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """[points of a, points of b]: whether they are within the squared distance; both are [columns, points]."""
    out = np.zeros((a.shape[1], b.shape[1]))
    with np.errstate(invalid="ignore", over="ignore"):
        for x, y in zip(a, b):
            step = x[:, None] - y
            step *= step
            out += step
        return out <= limit


def _reaching(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Places of the points of ``a`` whose distance to the box of ``b`` is within the limit."""
    gap = np.zeros(a.shape[1])
    with np.errstate(invalid="ignore", over="ignore"):
        for x, low, high in zip(a, b.min(axis=1), b.max(axis=1)):
            gap += np.maximum(0.0, np.maximum(low - x, x - high)) ** 2
        return np.flatnonzero(gap <= limit)


def _met(asked: np.ndarray, others: np.ndarray, limit: float, leaf: int, keep=lambda rows, part: rows):
    """(rows of ``asked``, slice of ``others``, which are near) of all that may be; ``keep`` drops rows that needn't meet a slice."""
    for begin in range(0, others.shape[1], leaf):
        part = slice(begin, begin + leaf)
        rows = keep(_reaching(asked, others[:, part], limit), part)
        for at in range(0, len(rows), CHUNK):
            some = rows[at : at + CHUNK]
            yield some, part, _near(asked[:, some], others[:, part], limit)


def _crowded(d: int, limit: float, least: int, leaf: int) -> Callable:
    """(POS, enough) of a block: whether a point has enough neighbours in the block; leaves beside its own come first."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(POS)
        x, w = _columns(table, d), table.column("w").to_numpy()
        seen = np.where(w >= least, w, 0)
        begins = range(0, len(w), leaf)
        for own in begins:
            todo = own + np.flatnonzero(seen[own : own + leaf] < least)
            for begin in sorted(begins, key=lambda b: abs(b - own)):
                if not len(todo):
                    break
                seen[todo] += _near(x[:, todo], x[:, begin : begin + leaf], limit) @ w[begin : begin + leaf]
                todo = todo[seen[todo] < least]
        return pa.table({POS: table.column(POS), "enough": pa.array(seen >= least)})

    return run


def _joined(d: int, limit: float) -> Callable:
    """(POS, comp) of a block's core points: the first POS that is reached within the block."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(POS)
        x, pos = _columns(table, d), table.column(POS).to_numpy()
        comp, rest = pos.copy(), np.arange(len(pos))
        while len(rest):
            first, rest = rest[0], rest[1:]
            todo = np.array([first])
            while len(todo) and len(rest):
                hit = _near(x[:, todo[:CHUNK]], x[:, rest], limit).any(axis=0)
                found, rest = rest[hit], rest[~hit]
                comp[found] = pos[first]
                todo = np.concatenate([todo[CHUNK:], found])
        return pa.table({POS: pos, "comp": comp})

    return run


def _counted(d: int, limit: float, leaf: int) -> Callable:
    """(POS, n): weights of the neighbours in a block."""

    def run(asked: pa.Table, others: pa.Table) -> pa.Table:
        others = others.sort_by(POS)
        w, n = others.column("w").to_numpy(), np.zeros(len(asked), dtype=np.int64)
        for rows, part, near in _met(_columns(asked, d), _columns(others, d), limit, leaf):
            n[rows] += near @ w[part]
        return pa.table({POS: asked.column(POS), "n": n})

    return run


def _touching(d: int, limit: float, leaf: int) -> Callable:
    """(id_1, id_2): different components with core points near each other."""

    def run(asked: pa.Table, others: pa.Table) -> pa.Table:
        others = others.sort_by(POS)
        mine, theirs = asked.column("comp").to_numpy(), others.column("comp").to_numpy()
        found: set = set()

        def keep(rows, part):
            one = theirs[part]
            return rows[mine[rows] != one[0]] if (one == one[0]).all() else rows

        for rows, part, near in _met(_columns(asked, d), _columns(others, d), limit, leaf, keep):
            for comp in np.unique(theirs[part]):
                ties = near[:, theirs[part] == comp].any(axis=1)
                found.update((int(c), int(comp)) for c in np.unique(mine[rows[ties]]) if c != comp)
        pairs = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
        return pa.table({"id_1": pairs[:, 0], "id_2": pairs[:, 1]})

    return run


def _reached(d: int, limit: float, leaf: int) -> Callable:
    """(POS, label): the smallest label of a near core point, where there is one."""

    def run(asked: pa.Table, others: pa.Table) -> pa.Table:
        others = others.sort_by(POS)
        none = np.iinfo(np.int32).max
        labels, best = others.column("label").to_numpy(), np.full(len(asked), none, dtype=np.int32)
        for rows, part, near in _met(_columns(asked, d), _columns(others, d), limit, leaf):
            best[rows] = np.minimum(best[rows], np.where(near, labels[part], none).min(axis=1))
        hit = best < none
        return pa.table({POS: asked.column(POS).to_numpy()[hit], "label": best[hit]})

    return run


class Points:
    """Points of a table on the curve, and their searches by blocks."""

    def __init__(self, points: DataFrame, d: int, eps: float, leaf: int):
        reach_workers(points.sparkSession)
        self.xs, self.d, self.limit, self.leaf = [f"x{i}" for i in range(d)], d, eps * eps, leaf
        placed = positioned(points.withColumn("_z", boxes.curve(points, self.xs)), ["_z", *self.xs])
        self.rows = cut_lineage(placed.drop("_z").withColumn("block", F.floor(F.col(POS) / (BLOCK_LEAVES * leaf))))

    def _boxes(self, rows: DataFrame, block: str, prefix: str) -> DataFrame:
        sides = [f(f"x{i}").alias(f"{prefix}{e}{i}") for i in range(self.d) for e, f in (("lo", F.min), ("hi", F.max))]
        return rows.groupBy(block).agg(*sides)

    def _meet(self, asked: DataFrame, others: DataFrame, step: Callable, schema: str) -> DataFrame:
        """``step`` of each block of ``asked`` with each block of ``others`` whose box is within reach."""
        asked = positioned(asked.withColumnRenamed(POS, "_at"), "_at")
        asked = cut_lineage(asked.withColumn("ablock", F.floor(F.col(POS) / (ASKED_LEAVES * self.leaf))).drop(POS).withColumnRenamed("_at", POS))
        # one row a block on either side
        close = boxes.gap(self.d) <= self.limit
        pairs = cut_lineage(self._boxes(asked, "ablock", "a_").join(self._boxes(others, "block", "b_"), close).select("ablock", "block"))
        left, right = asked.join(pairs, "ablock"), others.join(pairs, "block")
        # both sides may come from the same rows, so one gets columns of its own
        right = right.select(*[F.col(c).alias(c) for c in right.columns])
        return left.groupBy("ablock", "block").cogroup(right.groupBy("ablock", "block")).applyInArrow(step(self.d, self.limit, self.leaf), schema)

    def core(self, least: int) -> DataFrame:
        """(POS) of the points with neighbours of at least this weight, themselves included."""
        near_by = self.rows.select("block", POS, "w", *self.xs).groupBy("block")
        known = cut_lineage(near_by.applyInArrow(_crowded(self.d, self.limit, least, self.leaf), f"{POS} long, enough boolean"))
        asked = self.rows.join(known.where("NOT enough"), POS).select(POS, *self.xs)
        counts = self._meet(asked, self.rows.select("block", POS, "w", *self.xs), _counted, f"{POS} long, n long")
        more = counts.groupBy(POS).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        return cut_lineage(known.where("enough").select(POS).union(more.select(POS)))

    def components(self, core: DataFrame) -> DataFrame:
        """``core`` points (POS, block, x0, ...) with ``comp``, equal for those that are linked by near core points."""
        inside = core.select("block", POS, *self.xs).groupBy("block").applyInArrow(_joined(self.d, self.limit), f"{POS} long, comp long")
        found = cut_lineage(core.join(inside, POS))
        apart = max(1, found.count() // LINKING)
        found = self._linked(found, found.where(F.xxhash64(POS) % apart == 0))
        if apart == 1:
            return found
        # of two near points of different components one at least is outside the largest
        most = found.groupBy("comp").count().orderBy(F.desc("count"), "comp").first()["comp"]
        return self._linked(found, found.where(F.col("comp") != most))

    def _linked(self, found: DataFrame, asked: DataFrame) -> DataFrame:
        edges = self._meet(asked.select(POS, "comp", *self.xs), found.select("block", POS, "comp", *self.xs), _touching, "id_1 long, id_2 long")
        parts = connected_components(edges)
        joined = found.join(parts, F.col("comp") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "comp"))
        return cut_lineage(joined.select(*found.columns))

    def border(self, asked: DataFrame, core: DataFrame) -> DataFrame:
        """(POS, label) of the points near a core point: its smallest ``label``."""
        found = self._meet(asked.select(POS, *self.xs), core.select("block", POS, "label", *self.xs), _reached, f"{POS} long, label int")
        return found.groupBy(POS).agg(F.min("label").alias("label"))
