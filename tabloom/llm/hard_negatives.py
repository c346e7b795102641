"""Hard negatives: for each anchor and each of its nearest rows of the same label, the nearest rows of other
labels whose score is a given share of the positive's.

Vectors become whole numbers (``floor(scale * x)``) and scores are their exact inner products.  Most pairs
are not scored but bounded:

* A fixed random rotation turns every vector.  Its code is the signs of the turned components; beside it
  stand its length and its alignment, the cosine between the turned vector and the code vector (the signs
  divided by the root of their number).
* The anchor's turned components are rounded to ``PLANES`` bits, kept as bit planes.  Counting the ones that
  a plane and a code share gives the anchor's product with the code vector, up to the rounding.
* A vector is its length times (alignment * code vector + residual).  The first part estimates the score,
  and the anchor's product with the residual is at most the length of the residual times that of what the
  code vector leaves of the anchor (Cauchy-Schwarz).  So the score surely lies in an interval, and only
  rows whose interval can still reach the best k are scored.

Anchors and rows meet in pieces of about ``ANCHORS`` anchors and ``ROWS`` rows, dealt out by hashes, whatever
their labels are; a piece holds its anchors, the best so far and one batch of rows at a time.

Edge cases: rows whose id, label or vector is null, whose vector is empty or has a null or non-finite
component, or whose whole-number vector is 2^31 long or longer (its scores may not fit a long) take no part.
Vectors of different lengths are never compared.  A zero vector scores 0 with all.  Rows that repeat an id
are rows of their own.  An anchor without positives, or a positive without negatives, gives no rows; an empty
table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import batched, written

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
PLANES, SEED = 6, 29
ANCHORS, ROWS = 2048, 8192
#: What rounding of doubles may add to a bound, as a share of the product of the lengths.
SLACK = 1e-9


@lru_cache(8)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    return np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))[0]


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code words, lengths, alignments) of vectors of one size."""
    turned = vectors.astype(np.float64) @ rotation(vectors.shape[1])
    bits = np.packbits(turned > 0, axis=1, bitorder="little")
    codes = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
    codes[:, : bits.shape[1]] = bits
    length = np.sqrt((turned**2).sum(axis=1))
    alignment = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1]) / np.maximum(length, 1e-300)
    return codes.view(np.uint64), length, np.minimum(alignment, 1.0)


class Planes:
    """Anchors as bit planes of their rounded, turned components."""

    def __init__(self, vectors: np.ndarray):
        self.dim = vectors.shape[1]
        turned = vectors.astype(np.float64) @ rotation(self.dim)
        self.low = turned.min(axis=1)
        top = (1 << PLANES) - 1
        self.step = np.maximum((turned.max(axis=1) - self.low) / top, 1e-300)
        rounded = np.rint((turned - self.low[:, None]) / self.step[:, None]).clip(0, top).astype(np.int64)
        self.total = rounded.sum(axis=1)
        self.error = np.sqrt(((turned - self.low[:, None] - self.step[:, None] * rounded) ** 2).sum(axis=1))
        self.square = (turned**2).sum(axis=1)
        words = -(-self.dim // 64)
        self.planes = np.zeros((PLANES, len(vectors), words), np.uint64)
        for b in range(PLANES):
            bits = np.packbits((rounded >> b) & 1, axis=1, bitorder="little")
            padded = np.zeros((len(vectors), words * 8), np.uint8)
            padded[:, : bits.shape[1]] = bits
            self.planes[b] = padded.view(np.uint64)

    def bounds(self, codes: np.ndarray, length: np.ndarray, alignment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) possible score of each anchor with each row."""
        shared = np.zeros((len(self.low), len(codes)))
        for b, plane in enumerate(self.planes):
            for w in range(plane.shape[1]):
                shared += float(1 << b) * np.bitwise_count(plane[:, w, None] & codes[None, :, w])
        ones = np.bitwise_count(codes).sum(axis=1).astype(np.float64)
        signs = self.low[:, None] * (2 * ones - self.dim) + self.step[:, None] * (2 * shared - self.total[:, None])
        product = signs / np.sqrt(self.dim)  # with the code vector
        least = np.maximum(np.abs(product) - self.error[:, None], 0)
        rest = np.sqrt(np.maximum(self.square[:, None] - least**2, 0))
        residual = np.sqrt(np.maximum(1 - alignment**2, 0) + 1e-15)
        width = length * (alignment * self.error[:, None] + residual * rest) + SLACK * (1 + length * np.sqrt(self.square)[:, None])
        estimate = length * alignment * product
        return estimate - width, estimate + width


class _Best:
    """The first k rows of each question, by descending score, then by id and row."""

    def __init__(self, questions: int, k: int):
        self.k, self.questions = k, questions
        self.held = [np.zeros(0, np.int64) for _ in range(4)]  # question, score, id, row
        self.least = np.full(questions, -np.inf)

    def add(self, question: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(question):
            return
        q, s, i, r = (np.concatenate(c) for c in zip(self.held, (question, score, ids, rows)))
        order = np.lexsort((r, i, -s, q))
        q, s, i, r = q[order], s[order], i[order], r[order]
        counts = np.bincount(q, minlength=self.questions)
        rank = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
        last = rank == self.k - 1
        self.least[q[last]] = s[last]
        keep = rank < self.k
        self.held = [q[keep], s[keep], i[keep], r[keep]]


class _Piece:
    """The anchors of one piece of work; ``wanted`` holds, for each anchor, the scores of its positives."""

    def __init__(self, dim: int, rows, labels, vectors, wanted, k: int):
        self.rows, self.labels = np.array(rows, np.int64), np.array(labels, np.int64)
        self.vectors = np.stack([np.frombuffer(v, "<i4") for v in vectors]).astype(np.int64)
        self.planes = Planes(self.vectors)
        self.ranges = None
        if wanted is not None:
            most = max(map(len, wanted), default=0)
            self.ranges = np.full((len(rows), most, 2), np.iinfo(np.int64).max)
            self.ranges[:, :, 1] = np.iinfo(np.int64).min  # no score lies between
            for a, scores in enumerate(wanted):
                for p, score in enumerate(scores):
                    self.ranges[a, p] = -(-LOW * score // 100), HIGH * score // 100
        self.width = 1 if wanted is None else self.ranges.shape[1]
        self.best = _Best(len(rows) * self.width, k)

    def consider(self, ids, rows, labels, vectors, codes, length, alignment) -> None:
        least, most = self.planes.bounds(codes, length, alignment)
        same = self.labels[:, None] == labels[None, :]
        if self.ranges is None:
            allowed = same & (self.rows[:, None] != rows[None, :])
            hopeful = allowed & (most >= self._reach(least, allowed, 0))
        else:
            hopeful = np.zeros(same.shape, bool)
            for p in range(self.width):
                low, high = self.ranges[:, p, 0, None].astype(np.float64), self.ranges[:, p, 1, None].astype(np.float64)
                within = ~same & (most >= low) & (least <= high)
                sure = within & (least >= low) & (most <= high)
                hopeful |= within & (most >= self._reach(least, sure, p))
        a, r = np.nonzero(hopeful)
        for part in range(0, len(a), 1 << 18):
            i, j = a[part : part + (1 << 18)], r[part : part + (1 << 18)]
            score = np.einsum("ij,ij->i", self.vectors[i], vectors[j])
            if self.ranges is None:
                self.best.add(i, score, ids[j], rows[j])
                continue
            for p in range(self.width):
                hit = (score >= self.ranges[i, p, 0]) & (score <= self.ranges[i, p, 1])
                self.best.add(i[hit] * self.width + p, score[hit], ids[j[hit]], rows[j[hit]])

    def _reach(self, least: np.ndarray, sure: np.ndarray, p: int) -> np.ndarray:
        """A score that k rows surely reach: of those so far, or by the least scores of this batch."""
        reach = self.best.least[p :: self.width].copy()
        k = self.best.k
        if sure.shape[1] >= k:
            kth = np.partition(np.where(sure, least, -np.inf), -k, axis=1)[:, -k]
            reach = np.maximum(reach, kth)
        return reach[:, None]


_BEST = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("score", pa.int64()), ("other", pa.int64()), ("other_row", pa.int64())])
BEST = "anchor long, place int, score long, other long, other_row long"


def _worker(k: int):
    """Rows in the order of (dim, block, part, kind): a piece's anchors come before its rows."""

    def told(piece: _Piece | None) -> pa.RecordBatch:
        held = piece.best.held if piece else [np.zeros(0, np.int64)] * 4
        q, s, i, r = held
        width = piece.width if piece else 1
        anchor = piece.rows[q // width] if piece else q
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array((q % max(width, 1)).astype(np.int32)), pa.array(s), pa.array(i), pa.array(r)], schema=_BEST)

    def run(batches):
        at, anchors, piece = None, [], None
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            keys = np.stack([columns[c].to_numpy() for c in ("dim", "block", "part", "kind")]).T
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else []
            for start, end in zip(starts, [*starts[1:], len(keys)]):
                if tuple(keys[start][:3]) != at:
                    if piece is not None:
                        yield told(piece)
                    at, anchors, piece = tuple(keys[start][:3]), [], None
                part = {c: v.slice(start, end - start) for c, v in columns.items()}
                if keys[start][3] == 0:
                    anchors += zip(*(part[c].to_pylist() for c in ("row", "label", "vector", "scores")))
                    continue
                if anchors:
                    rows, labels, vectors, scores = zip(*anchors)
                    piece = _Piece(at[0], rows, labels, vectors, None if scores[0] is None else scores, k)
                    anchors = []
                if piece is not None and piece.width:
                    vectors, codes = (np.stack([np.frombuffer(v, t) for v in part[c].to_pylist()]) for c, t in (("vector", "<i4"), ("code", "<u8")))
                    rest = (part[c].to_numpy() for c in ("length", "alignment"))
                    piece.consider(*(part[c].to_numpy() for c in ("vec_id", "row", "label")), vectors.astype(np.int64), codes, *rest)
        yield told(piece)

    return run


def _encoder(scale: float):
    def run(batches):
        for batch in batches:
            ids, labels = batch.column(0), batch.column(1)
            found = [np.array(v, np.float64) for v in batch.column(2).to_pylist()]
            out: list = [None] * len(found)
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(found):
                by_size.setdefault(len(v), []).append(i)
            for size, places in by_size.items():
                with np.errstate(over="ignore"):
                    whole = np.floor(np.stack([found[i] for i in places]) * scale)
                    fits = (whole**2).sum(axis=1) < 2.0**62
                codes, length, alignment = encode(np.where(fits[:, None], whole, 0))
                for i, w, c, n, a, ok in zip(places, whole, codes, length, alignment, fits):
                    if ok:
                        out[i] = (size, w.astype("<i4").tobytes(), c.tobytes(), n, a)
            kept = [i for i, o in enumerate(out) if o]
            dims, vectors, codes, lengths, alignments = zip(*(out[i] for i in kept)) if kept else [()] * 5
            take = pa.array(kept, pa.int64())
            columns = [ids.take(take), labels.take(take), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary()), pa.array(codes, pa.binary()), pa.array(lengths, pa.float64()), pa.array(alignments, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "dim", "vector", "code", "length", "alignment"])

    return run


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def _encoded(vectors: DataFrame, vec_id: str, label: str, embedding: str, scale: float) -> DataFrame:
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector")))
    made = batched(rows, _encoder(scale), "vec_id long, label long, dim int, vector binary, code binary, length double, alignment double")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "codes")


def _best(rows: DataFrame, anchors: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of every piece; ``anchors`` has ``scores``, null to look for positives."""
    common = ["dim", "block", "part", "kind", "row", "vec_id", "label", "vector"]
    asked = anchors.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("row"), "blocks")).withColumn("kind", F.lit(0))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = rows.join(sizes, "dim").withColumn("part", F.pmod(F.xxhash64("row"), "parts")).withColumn("kind", F.lit(1))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    all_ = dealt.select(*common, "code", "length", "alignment", F.lit(None).cast("array<long>").alias("scores")).unionByName(
        asked.select(*common, F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("length"), F.lit(None).cast("double").alias("alignment"), "scores")
    )
    key = ["dim", "block", "part"]
    return batched(all_.repartition(*key).sortWithinPartitions(*key, "kind"), _worker(k), BEST)


def mine(
    vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding",
    scale: float = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, anchor_block: int = ANCHORS, row_part: int = ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``vec_id``.  Negatives score ``LOW`` to ``HIGH`` per cent of the positive.
    """
    rows = _encoded(vectors, vec_id, label, embedding, scale)
    anchors = rows.where(is_anchor)
    sizes = rows.groupBy("dim").agg(F.count("*").alias("rows"), F.count_if(is_anchor).alias("anchors")).where("anchors > 0")
    sizes = sizes.select("dim", F.ceil(F.col("anchors") / anchor_block).alias("blocks"), F.ceil(F.col("rows") / row_part).alias("parts"))
    none = F.lit(None).cast("array<long>").alias("scores")
    found = _best(rows, anchors.select("*", none), sizes, positives)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "other", "other_row")
    near = written(found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives), "positives")

    listed = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "score"))).alias("s"))
    asked = anchors.join(listed.select(F.col("anchor").alias("row"), F.col("s.score").alias("scores")), "row")
    hard = _best(rows, asked.select(*rows.columns, "scores"), sizes, negatives)
    ranked = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "other", "other_row")
    hard = hard.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
    hard = hard.select("anchor", (F.col("place") + 1).alias("nth"), "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.select("anchor", "nth", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = hard.join(named, ["anchor", "nth"]).join(ids, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
