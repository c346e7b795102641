"""A packed tree of boxes for distance searches in any number of columns.

Rows are sorted by a space-filling curve (the columns' bits in turn, after a squashing that outliers don't
spoil) and cut into leaves of equal size; every node above holds ``FANOUT`` neighbours of the level below.  So
the depth follows the number of rows, equal or crowded points don't matter, and the tree is built by one
ordering and small aggregates.  Searches go down level by level as equi joins on the parent: only children
whose box can still be near enough are kept.  The top level has at most ``FANOUT`` boxes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.columns import total
from tabloom.session import cut_lineage

LEAF, FANOUT = 256, 32
_BITS = 60


def curve(df: DataFrame, cols: list[str]) -> Column:
    """The place of a row on the curve; columns beyond the sixtieth don't count."""
    cols = cols[:_BITS]
    bits = min(20, _BITS // len(cols))
    quarters = df.agg(*[F.percentile_approx(F.col(c), [0.25, 0.5, 0.75], 1000).alias(c) for c in cols]).first()
    codes = []
    for c in cols:
        low, middle, high = quarters[c] or (0.0, 0.0, 0.0)
        t = (F.col(c) - F.lit(middle)) / F.lit((high - low) or 1.0)
        codes.append(F.floor((F.lit(0.5) + t / (F.lit(2.0) * (1 + F.abs(t)))) * F.lit(float((1 << bits) - 1))).cast("long"))
    parts = [F.shiftleft(F.shiftright(code, b).bitwiseAND(F.lit(1).cast("long")), b * len(cols) + i) for b in range(bits) for i, code in enumerate(codes)]
    return total(parts)


def edges(d: int, prefix: str = "") -> list[str]:
    return [f"{prefix}{e}{i}" for i in range(d) for e in ("lo", "hi")]


def levels(leaves: DataFrame, d: int, extra: dict[str, Callable] | None = None) -> list[DataFrame]:
    """(node, parent, lo0, hi0, ..., extras) of each level from the leaves up; ``leaves`` lacks ``parent``.

    ``extra`` maps further columns to the aggregate that carries them up.
    """
    aggs = [f(c).alias(c) for c, f in [(f"{e}{i}", g) for i in range(d) for e, g in (("lo", F.min), ("hi", F.max))] + list((extra or {}).items())]
    out, current = [], leaves
    while True:
        current = cut_lineage(current.withColumn("parent", F.floor(F.col("node") / FANOUT)))
        out.append(current)
        if (current.agg(F.max("node")).first()[0] or 0) < FANOUT:
            return out
        current = current.groupBy("parent").agg(*aggs).withColumnRenamed("parent", "node")


def gap(d: int, a: str = "a_", b: str = "b_") -> Column:
    """Squared distance between two boxes."""
    sides = [F.greatest(F.lit(0.0), F.col(f"{b}lo{i}") - F.col(f"{a}hi{i}"), F.col(f"{a}lo{i}") - F.col(f"{b}hi{i}")) for i in range(d)]
    return total([s * s for s in sides])


def span(d: int, a: str = "a_", b: str = "b_") -> Column:
    """Squared distance of the farthest points of two boxes."""
    sides = [F.greatest(F.col(f"{a}hi{i}") - F.col(f"{b}lo{i}"), F.col(f"{b}hi{i}") - F.col(f"{a}lo{i}")) for i in range(d)]
    return total([s * s for s in sides])


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns})


def close_nodes(tree: list[DataFrame], near: Column) -> DataFrame:
    """(a_node <= b_node, and the columns of both): pairs of leaves that are ``near`` on every level.

    ``near`` is a condition on two nodes' columns, prefixed by a_ and b_, that holds for parents if it holds
    for any of their children.
    """
    ordered = F.col("a_node") <= F.col("b_node")
    top = tree[-1].withColumn("all", F.lit(0))
    pairs = prefixed(top, "a_").join(prefixed(top, "b_"), F.col("a_all") == F.col("b_all")).where(ordered & near)
    for level in reversed(tree[:-1]):
        above = pairs.select(F.col("a_node").alias("up_a"), F.col("b_node").alias("up_b"))
        down = above.join(prefixed(level, "a_"), F.col("up_a") == F.col("a_parent")).join(prefixed(level, "b_"), F.col("up_b") == F.col("b_parent"))
        pairs = cut_lineage(down.where(ordered & near).drop("up_a", "up_b"))
    return pairs


def reached_leaves(tree: list[DataFrame], asked: DataFrame, d: int) -> DataFrame:
    """``asked`` (with columns x0, x1, ... and the squared radius ``reach``) and, for each leaf within reach, its ``leaf``."""
    near = total([F.greatest(F.lit(0.0), F.col(f"lo{i}") - F.col(f"x{i}"), F.col(f"x{i}") - F.col(f"hi{i}")) ** 2 for i in range(d)]) <= F.col("reach")
    found = asked.withColumn("up", F.lit(0).cast("long"))
    top = tree[-1].withColumn("parent", F.lit(0).cast("long"))
    for depth, level in enumerate([top, *reversed(tree[:-1])]):
        boxes = level.select("node", "parent", *edges(d))
        boxes = F.broadcast(boxes) if depth < 2 else boxes  # at most FANOUT and FANOUT^2 rows
        found = found.join(boxes, F.col("up") == F.col("parent")).where(near).drop("up", "parent", *edges(d)).withColumnRenamed("node", "up")
    return found.withColumnRenamed("up", "leaf")
