"""Exact duplicates by a tree merge of sorted digest runs.

A digest entry is (SHA-256 of the normalised text, verification, number of rows, row that stays).  The
verification is the text's length in bytes and its XXH64: entries of equal digests are merged only if
these agree too.  Every task turns its rows into sorted runs in which each digest stands once.  Then runs
are merged in binomial rounds: in each round FAN_IN neighbouring nodes send their runs to one of them,
until one node is left.  All rounds work on many ranges of the digest at once, so no node ever holds
more than one range; a merge reads its runs in digest order (Spark's external sort) and holds one entry
at a time.  A group of copies is one entry per run after the first step, however large it is.

Which row stays: the one with the smallest document id, or the largest by ``keep="largest"``; among rows
of that same id the first in reading order.

Edge cases: a null text counts as empty; null document ids lose against any other (a group of null ids
keeps one of its rows, and ``keep_id`` is null); repeated rows are told apart, one stays; an empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import batched, cut_lineage, skewed_join

FAN_IN = 8
RUN_ENTRIES = 100_000
RANGES, RANGE_ENTRIES = 256, 1_000_000

_DIGESTS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_bytes", pa.int64()), ("check", pa.int64()), ("row", pa.int64())])
_ENTRIES = pa.schema([("node", pa.int64()), ("digest", pa.binary()), ("n_bytes", pa.int64()), ("check", pa.int64()), ("size", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64())])
DIGESTS = "doc_id long, digest binary, n_bytes long, check long, row long"
ENTRIES = "node long, digest binary, n_bytes long, check long, size long, keep_id long, keep_row long"


def _digests(batches):
    """One row per input row; ``row`` numbers them over all tasks."""
    at = TaskContext.get().partitionId() << 40
    for batch in batches:
        texts = [(t or "").encode().lower() for t in batch.column(1).to_pylist()]  # bytes: lowers A-Z only
        columns = [
            batch.column(0).cast(pa.int64()),
            pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
            pa.array(map(len, texts), pa.int64()),
            pa.array([xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts], pa.int64()),
            pa.array(range(at, at + len(texts)), pa.int64()),
        ]
        at += len(texts)
        yield pa.RecordBatch.from_arrays(columns, schema=_DIGESTS)


def _better(largest: bool):
    """Whether entry a's row stays rather than b's; both are (id, row)."""

    def better(a, b):
        if a[0] is None or b[0] is None:
            return b[0] is None and (a[0] is not None or a[1] < b[1])
        if a[0] != b[0]:
            return (a[0] > b[0]) == largest
        return a[1] < b[1]

    return better


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENTRIES)], schema=_ENTRIES)


def _first_runs(largest: bool):
    better = _better(largest)

    def run(batches):
        node = TaskContext.get().partitionId()
        held: dict[tuple, list] = {}

        def sorted_run():
            return _frame([(node, *key, size, *row) for key, (size, row) in sorted(held.items())])

        for batch in batches:
            ids, digests, sizes, checks, rows = (c.to_pylist() for c in batch.columns)
            for doc_id, key, row in zip(ids, zip(digests, sizes, checks), rows):
                entry = held.get(key)
                if entry is None:
                    held[key] = [1, (doc_id, row)]
                else:
                    entry[0] += 1
                    if better((doc_id, row), entry[1]):
                        entry[1] = (doc_id, row)
            if len(held) >= RUN_ENTRIES:
                yield sorted_run()
                held.clear()
        if held:
            yield sorted_run()

    return run


def _merge_runs(largest: bool):
    """Entries in the order of range, node, digest and verification: neighbours that agree become one."""
    better = _better(largest)

    def run(batches):
        last, size, kept = None, 0, None
        for batch in batches:
            made = []
            node, digest, n_bytes, check, sizes, ids, rows = (c.to_pylist() for c in batch.columns)
            for key, n, row in zip(zip(node, digest, n_bytes, check), sizes, zip(ids, rows)):
                if key == last:
                    size += n
                    if better(row, kept):
                        kept = row
                    continue
                if last is not None:
                    made.append((*last, size, *kept))
                last, size, kept = key, n, row
            if made:
                yield _frame(made)
        if last is not None:
            yield _frame([(*last, size, *kept)])

    return run


def merged_runs(digests: DataFrame, keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """One entry per text: (digest, n_bytes, check, size, keep_id, keep_row)."""
    largest = keep == "largest"
    runs = batched(digests, _first_runs(largest), ENTRIES)
    total = digests.agg(F.count("*").alias("n"), F.max(F.shiftright("row", 40)).alias("last")).first()
    ranges = max(RANGES, -(-total["n"] // RANGE_ENTRIES))
    # the digest's first six hex digits deal the entries out evenly
    part = F.floor(F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("long") * ranges / F.lit(1 << 24))
    nodes = (total["last"] or 0) + 1
    while True:
        sent = runs.withColumn("node", F.floor(F.col("node") / fan_in)).withColumn("part", part)
        order = ["part", "node", "digest", "n_bytes", "check"]
        runs = batched(sent.repartition("part", "node").sortWithinPartitions(*order).drop("part"), _merge_runs(largest), ENTRIES)
        nodes = -(-nodes // fan_in)
        if nodes == 1:
            return runs.drop("node")
        runs = cut_lineage(runs)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal if they are identical after lower-casing A-Z.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    digests = cut_lineage(batched(narrow, _digests, DIGESTS))
    groups = cut_lineage(merged_runs(digests, keep, fan_in)).where("size > 1")  # all others stand alone
    key = ["digest", "n_bytes", "check"]
    groups = groups.select(*[F.col(k).alias(f"{k}_of") for k in key], "size", "keep_id", "keep_row")
    joined = skewed_join(digests, groups, {k: f"{k}_of" for k in key}, "size", "left")
    alone = F.col("size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
