import numpy as np

from tabloom.llm.embedding_dedup import near_duplicates


def brute(rows):
    """Links by comparing all pairs, components by propagating the smallest id."""
    usable = [(i, l, np.array(v, dtype=float)) for i, l, v in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i, _, _ in rows}
    for a, (i, l, v) in enumerate(usable):
        for j, m, w in usable[a + 1 :]:
            if l == m and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                near[i].add(j)
                near[j].add(i)
    root = {i: i for i in near}
    changed = True
    while changed:
        changed = False
        for i in near:
            least = min([root[i], *(root[j] for j in near[i])])
            if least < root[i]:
                root[i], changed = least, True
    return {i: (len(near[i]), root[i], root[i] == i) for i in near}


def vectors():
    rng = np.random.default_rng(5)
    rows = []
    for g in range(30):  # groups of near copies, some at the edge of the threshold
        base = rng.standard_normal(32)
        for _ in range(6):
            rows.append(((base + rng.standard_normal(32) * rng.choice([0.02, 0.14, 0.2])).astype("f4").tolist(), g % 3))
    hot = rng.standard_normal(32)
    rows += [((hot + rng.standard_normal(32) * 0.01).astype("f4").tolist(), 1) for _ in range(150)]
    rows += [(hot.astype("f4").tolist(), 1)] * 60  # copies
    rows += [(None, 1), ([], 1), ([0.0] * 32, 1), ([None] + [1.0] * 31, 1), ([float("nan")] * 32, 1), ([float("inf")] + [1.0] * 31, 1), (hot.astype("f4").tolist(), None), (hot.astype("f4").tolist(), 7), (hot.astype("f4").tolist()[:16], 1)]
    return [(i, l, v) for i, (v, l) in enumerate(rows)]


def test_equals_all_pairs(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, l, v, "x") for i, l, v in rows], "vec_id long, label int, embedding array<float>, node string").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df, block=40).collect()}
    want = brute(rows)
    assert len(got) == len(rows) and got == want
    assert max(n for n, _, _ in want.values()) > 200


def test_null_ids_and_empty_table(spark):
    schema = "vec_id long, label int, embedding array<float>"
    df = spark.createDataFrame([(None, 1, [1.0, 0.0]), (5, 1, [1.0, 0.0]), (4, 1, [1.0, 0.01]), (None, 2, [1.0, 1.0])], schema)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, 0, 0, True), (0, 2, 4, False), (4, 2, 4, True), (5, 2, 4, False)]
    assert near_duplicates(df.limit(0)).count() == 0
