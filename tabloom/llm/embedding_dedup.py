"""Near-duplicate vectors: sign hashing in several tables, exact cosine, distributed components.

Vectors are compared only with those of the same label and length.  Equal vectors become one node with a
number of copies.  Each of TABLES tables hashes a node to the signs of its products with PLANES random
hyperplanes; nodes that meet in a bucket are compared exactly, in double precision.  A pair counts only in
the first table in which it meets, which both nodes' signatures tell, so links need no deduplication and
pairs are never written out: a task returns the number of links of each node and a spanning forest of
the links that it found.  Two vectors of cosine 0.98 meet with probability
1 - (1 - (1 - acos(0.98) / pi) ** 16) ** 24, above 0.9999; nearer ones more surely.

A bucket of more than BLOCK nodes is cut into blocks, and each pair of blocks is a piece of work of its
own, so no task holds more than two blocks of a bucket at a time.  Buckets of one node, most of them, are
dropped before any vector is moved.

Edge cases: a vector that is null, empty or all zero or that has a null or non-finite component links
with nothing, as does one whose label is null.  Repeated rows are copies and link with each other.  A
null vec_id links like any other but names no component (null if no other id is there).  An empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import batched, skewed_join, written
from tabloom.operators.graph import connected_components

MIN_COSINE = 0.98
TABLES, PLANES, SEED = 24, 16, 17
BLOCK = 1024

_KEYS = ["label", "dim", "table", "sig", "low", "high"]


def signatures(vectors: np.ndarray, tables: int, planes: int, seed: int) -> np.ndarray:
    """One number per vector and table, from the signs of products with random hyperplanes."""
    normals = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((tables * planes, vectors.shape[1]))
    signs = (vectors @ normals.T > 0).reshape(len(vectors), tables, planes)
    return signs @ (1 << np.arange(planes, dtype=np.int64))


def _signer(tables: int, planes: int, seed: int):
    def run(batches):
        for batch in batches:
            found = batch.column(1).to_pylist()
            sigs: list = [None] * len(found)
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(found):
                by_length.setdefault(len(v), []).append(i)
            for places in by_length.values():
                for i, s in zip(places, signatures(np.array([found[i] for i in places]), tables, planes, seed)):
                    sigs[i] = s.tolist()
            columns = [batch.column(0), pa.array(map(len, found), pa.int64()), pa.array(sigs, pa.list_(pa.int64())), pa.array([np.array(v, dtype="<f8").tobytes() for v in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "dim", "sigs", "vector"])

    return run


def _forest(size: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links a-b."""
    root = list(range(size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def compare_block(vectors: np.ndarray, sigs: np.ndarray, blocks: np.ndarray, table: int, low: int, high: int, min_cosine: float):
    """Places (a, b), a < b, of the links of one bucket's pair of blocks that no earlier table has found."""
    norms = np.linalg.norm(vectors, axis=1)
    first, second = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    cosines = vectors[first] @ vectors[second].T / (norms[first][:, None] * norms[second][None, :])
    i, j = np.nonzero(cosines >= min_cosine)
    a, b = first[i], second[j]
    if low == high:
        a, b = a[i < j], b[i < j]
    met = (sigs[a, :table] == sigs[b, :table]).any(axis=1)
    return a[~met], b[~met]


def _comparer(min_cosine: float):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def work(key, rows):
        nodes = np.array([r[0] for r in rows])
        copies = np.array([r[1] for r in rows])
        a, b = compare_block(
            np.stack([np.frombuffer(r[4], dtype="<f8") for r in rows]), np.array([r[3] for r in rows]),
            np.array([r[2] for r in rows]), key[2], key[4], key[5], min_cosine,
        )
        if not len(a):
            return []
        links = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
        out = [(int(nodes[x]), int(links[x]), None) for x in np.flatnonzero(links)]
        return out + [(int(nodes[x]), 0, int(nodes[y])) for x, y in _forest(len(rows), a, b)]

    def run(batches):
        """Rows in the order of their keys; one bucket's pair of blocks is held at a time."""
        at, held = None, []
        for batch in batches:
            made = []
            columns = [c.to_pylist() for c in batch.columns]
            for key, row in zip(zip(*columns[:6]), zip(*columns[6:])):
                if key != at:
                    if len(held) > 1:
                        made += work(at, held)
                    at, held = key, []
                held.append(row)
            yield _frame(made)
        yield _frame(work(at, held) if len(held) > 1 else [])

    def _frame(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], schema=schema)

    return run


def _usable(vector):
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def links(nodes: DataFrame, min_cosine: float = MIN_COSINE, tables: int = TABLES, planes: int = PLANES, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(node, links, other): numbers of linked rows, to be added up by node, and the edges of spanning forests.

    ``nodes`` has node, label, vector (array of doubles) and copies, each vector of a label once.
    """
    signed = batched(nodes.select("node", "vector"), _signer(tables, planes, seed), "node long, dim long, sigs array<long>, vector binary")
    signed = written(signed.join(nodes.select("node", "label", "copies"), "node"), "signed")
    rows = signed.select("node", "label", "dim", F.posexplode("sigs").alias("table", "sig"))
    bucket = ["label", "dim", "table", "sig"]
    sizes = rows.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block))
    busy = rows.join(sizes, bucket)
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = busy.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("node", *bucket, "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    dealt = placed.join(signed.select("node", "copies", "sigs", "vector"), "node").repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    return batched(dealt.select(*_KEYS, "node", "copies", "block", "sigs", "vector"), _comparer(min_cosine), "node long, links long, other long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", **how) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; ``how`` goes to ``links``."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("vector"))
    usable = _usable(F.col("vector")) & F.col("label").isNotNull()
    nodes = rows.where(usable).groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = written(links(nodes, **how), "links")
    edges = found.where("other is not null").select(F.col("node").alias("id_1"), F.col("other").alias("id_2"))
    joined = connected_components(edges)
    member = joined.join(nodes.select("node", "least"), "node")
    roots = member.groupBy("component").agg(F.min("least").alias("root"))
    rooted = member.select("node", "component").join(roots, "component").select("node", "root")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    told = nodes.join(rooted, "node", "left").join(counts, "node", "left").select(
        F.col("label").alias("label_of"), F.col("vector").alias("vector_of"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "least").alias("root"), "copies",
    )
    out = skewed_join(rows, written(told, "told"), {"label": "label_of", "vector": "vector_of"}, "copies", "left")
    component = F.when(F.col("label_of").isNull(), F.col("vec_id")).otherwise(F.col("root"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
