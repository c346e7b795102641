import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import hard_negatives as hn

SCHEMA = "embedding array<float>, vec_id long, label int, row int, dim string"


def brute(rows, scale=256):
    """All scores in Python integers."""
    kept = []
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(scale * float(np.float32(x))) for x in v]
        if sum(x * x for x in w) < 2**62:
            kept.append((i, label, w))
    out = []
    for n, (i, label, v) in enumerate(kept):
        if i % 10:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m, other == label) for m, (j, other, w) in enumerate(kept) if m != n and len(w) == len(v)]
        scored.sort()
        for s, j, _, _ in [x for x in scored if x[3]][:5]:
            hard = [x for x in scored if not x[3] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, j, k, x[1], -s, -x[0]) for k, x in enumerate(hard, 1)]
    return sorted(out)


def corpus():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((4, 24))
    rows = [(i, int(rng.integers(4)), v) for i, v in enumerate((centres[rng.integers(4, size=400)] + 0.7 * rng.standard_normal((400, 24))).tolist())]
    rows += [(1000 + i, 1, rows[20][2]) for i in range(30)] + [(1100 + i, 2, rows[20][2]) for i in range(30)]  # ties
    rows += [(2000 + i, i % 3, rng.standard_normal(130).tolist()) for i in range(40)] + [(2100, 0, [1.0]), (2110, 0, [2.0]), (2120, 1, [1.5])]
    rows += [(None, 1, rows[0][2]), (3000, None, rows[0][2]), (3010, 1, None), (3020, 1, []), (3030, 1, [0.0] * 24), (3040, 1, [float("nan")] * 24)]
    rows += [(3050, 1, [float("inf")] * 24), (3060, 1, [None] + rows[0][2][1:]), (3070, 2, [1e30] * 24), (3080, 2, [-x for x in rows[0][2]]), (10, 3, rows[10][2]), (30, rows[30][1], rows[30][2])]
    return rows


@pytest.mark.parametrize("blocks", [(hn.ANCHORS, hn.ROWS), (3, 50)])
def test_equals_brute_force(spark, blocks):
    rows = corpus()
    frame = spark.createDataFrame([(v, i, label, 1, "x") for i, label, v in rows], SCHEMA).repartition(6)
    got = hn.mine(frame, F.col("vec_id") % 10 == 0, anchor_block=blocks[0], row_part=blocks[1]).collect()
    got = sorted(tuple(r) for r in got)
    want = brute(rows)
    # rows of one id (10 and 30 are repeated) may come in any order
    assert [r for r in got if r[0] not in (10, 30) and not {10, 30} & {r[1], r[3]}] == [r for r in want if r[0] not in (10, 30) and not {10, 30} & {r[1], r[3]}]
    assert len(got) == len(want) and [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert len(got) > 500


def test_bounds_hold_and_narrow():
    rng = np.random.default_rng(2)
    for dim in (1, 7, 64, 130):
        v = np.floor(256 * rng.standard_normal((300, dim))).astype(np.int64)
        v[:5] = 0
        v[5:40] = v[40] + rng.integers(-3, 4, (35, dim))
        least, most = hn.Planes(v[:60]).bounds(*hn.encode(v))
        exact = v[:60] @ v.T
        assert (least <= exact).all() and (exact <= most).all()
        lengths = np.sqrt((v.astype(float) ** 2).sum(axis=1))
        assert (most - least)[20:, 20:].mean() < 1.6 * (lengths[20:60, None] * lengths[None, 20:]).mean()


def test_empty_and_lone(spark):
    assert hn.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame([([1.0, 2.0], 0, 1, 1, "x"), ([1.0, 2.0], 5, 2, 1, "x")], SCHEMA)
    assert hn.mine(one, F.col("vec_id") % 10 == 0).count() == 0
