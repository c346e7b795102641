"""Pairwise moments of many numeric columns in one pass.

A task holds, for every pair of columns, sums over its rows in which both are present.  They are taken
about a value of the task's own (the first that it meets in each column), so large offsets cost no digits, and moved
to a common one when tasks are merged.  A task returns one row per column; a column's rows are merged by a
shuffle on its number, one row at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sums of a pair (i, j) over the rows with both: their number, x_i, x_j, x_i^2, x_j^2, x_i x_j, non-finite values.
_SUMS = ["n", "a", "b", "aa", "bb", "ab", "bad"]
#: A variance below this share of the sum of squares is rounding.
_ROUNDING = 1e-13

_LIST = pa.list_(pa.float64())
_ROWS = pa.schema([("i", pa.int32()), ("centre", _LIST), *[(s, _LIST) for s in _SUMS]])


class _Sums:
    def __init__(self, width: int):
        self.centre = np.full(width, np.nan)
        self.held = [np.zeros((width, width)) for _ in _SUMS]

    def add(self, values: np.ndarray, present: np.ndarray) -> None:
        """``values`` is rows x columns, anything where not ``present``."""
        finite = np.isfinite(values) & present
        unknown = np.isnan(self.centre) & finite.any(axis=0)
        if unknown.any():
            self.centre[unknown] = values[finite.argmax(axis=0), np.arange(values.shape[1])][unknown]
        x = np.where(finite, values - np.nan_to_num(self.centre), 0.0)
        m, square = present.astype(np.float64), x * x
        made = [m.T @ m, x.T @ m, m.T @ x, square.T @ m, m.T @ square, x.T @ x]
        if (present & ~finite).any():
            bad = (present & ~finite).astype(np.float64)
            made.append(bad.T @ m + m.T @ bad)
        for h, s in zip(self.held, made):
            h += s

    def batch(self) -> pa.RecordBatch:
        width = len(self.centre)
        offsets = pa.array(np.arange(width + 1, dtype=np.int32) * width)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(h.ravel())) for h in (np.tile(np.nan_to_num(self.centre), (width, 1)), *self.held)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), *lists], schema=_ROWS)


def _moved(sums: list[np.ndarray], own: float, step: float, others: np.ndarray) -> list[np.ndarray]:
    """The sums of one column's row, taken about centres that are ``step`` and ``others`` lower."""
    n, a, b, aa, bb, ab, bad = sums
    return [n, a + n * step, b + n * others, aa + 2 * step * a + n * step**2, bb + 2 * others * b + n * others**2, ab + step * b + others * a + n * step * others, bad]


def _summer(width: int):
    def run(batches):
        sums = _Sums(width)
        for batch in batches:
            if batch.num_rows:
                present = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
                sums.add(np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1), present)
        if width:
            yield sums.batch()

    return run


_CORRELATIONS = pa.schema([("i", pa.int32()), ("r", _LIST)])


def _correlations(i: int, sums: list[np.ndarray]) -> pa.RecordBatch:
    """Null where fewer than two rows hold both or one of them does not vary, not a number where a value is none."""
    n, a, b, aa, bb, ab, bad = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        one, two = aa - a * a / n, bb - b * b / n
        r = (ab - a * b / n) / np.sqrt(one * two)
        known = (n > 1) & (one > _ROUNDING * aa) & (two > _ROUNDING * bb)
    r = np.clip(r, -1.0, 1.0)
    r[i] = 1.0
    r = [float("nan") if w else float(v) if k else None for v, k, w in zip(r, known, (bad > 0) & (n > 1))]
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([r], _LIST)], schema=_CORRELATIONS)


def _merger(batches):
    """Rows in the order of their columns."""
    at, centre, held = None, None, None
    for batch in batches:
        columns = [batch.column(0).to_pylist(), *[[np.array(v) for v in c.to_pylist()] for c in batch.columns[1:]]]
        for i, own, *sums in zip(*columns):
            if i != at:
                if at is not None:
                    yield _correlations(at, held)
                at, centre, held = i, own, sums
                continue
            shift = own - centre
            held = [h + s for h, s in zip(held, _moved(sums, own[i], shift[i], shift))]
    if at is not None:
        yield _correlations(at, held)


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, correlation): Pearson correlations of columns ``cols[i]`` and ``cols[j]``, pairwise complete."""
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    sums = numbers.mapInArrow(_summer(len(cols)), "i int, centre array<double>, " + ", ".join(f"{s} array<double>" for s in _SUMS))
    merged = sums.repartition("i").sortWithinPartitions("i").mapInArrow(_merger, "i int, r array<double>")
    return merged.select("i", F.posexplode("r").alias("j", "correlation"))
