import numpy as np
import xxhash
from pyspark.sql import functions as F

from tabloom.llm.simhash import components, fingerprint, keep_one, links, segments


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, distance=4):
    values = np.array(values, dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    label = np.arange(len(values))
    while True:
        least = np.where(near, label[None, :], len(values)).min(axis=1)
        if (least == label).all():
            return label
        label = least


TEXTS = [None, "", " \n", "one", "One", "a b c", "A  B\nC", "a b c d e f g", "é É ß x y z w", "The cat sat on the mat and the dog sat on the rug " * 3]


def test_fingerprints():
    for t in TEXTS:
        assert fingerprint(t or "") % (1 << 64) == plain_fingerprint(t)


def test_every_link_once(spark):
    rng = np.random.default_rng(2)
    values = set()
    for _ in range(25):  # balls around centres, up to 5 bits away
        centre = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(12):
            v = centre
            for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for distance in (4, 3, 1):
        got = links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance).collect()
        pairs = [frozenset((r.id_1 % (1 << 64), r.id_2 % (1 << 64))) for r in got]
        want = {frozenset((a, b)) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= distance}
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert len(segments(4)) == 3


def corpus():
    rng = np.random.default_rng(4)
    rows = [(10 + i, t) for i, t in enumerate(TEXTS)]
    for g in range(12):
        words = [f"w{x}" for x in rng.integers(0, 500, 300)]
        for k in range(5):
            changed = list(words)
            if k:
                changed[int(rng.integers(0, 300))] = "changed"
            rows.append((1000 - 20 * g - k, " ".join(changed)))
    return rows + [(2000 + i, "the very same text in many rows of the table") for i in range(200)]


def test_components_equal_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int").repartition(6)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in components(docs).collect()}
    rows = sorted(rows, key=lambda r: r[0])
    values = [plain_fingerprint(t) for _, t in rows]
    label = plain_components(values)
    assert got == {i: (v, rows[label[n]][0]) for n, ((i, _), v) in enumerate(zip(rows, values))}
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[x][0] for x in label})


def test_null_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "some words here"), (None, "some words here"), (None, "quite another set of words"), (7, "a text of seven"), (7, "a text of seven"), (7, "not the same at all, is it")], "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in keep_one(docs).collect())
    assert kept == sorted([(0, "some words here"), (0, "quite another set of words"), (7, "a text of seven"), (7, "not the same at all, is it")])
    assert components(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0
    assert components(docs.select(F.lit(1).alias("doc_id"), "text")).count() == 6


def test_index_entries_are_not_broadcast(spark, tmp_path):
    # few fingerprints have many entries, whose number the size estimate of a table does not show
    spark.range(500).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/distinct")
    found = links(spark.read.parquet(f"{tmp_path}/distinct"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 0
