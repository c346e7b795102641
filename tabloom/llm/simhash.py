"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into SEGMENTS = 3 segments.  Two fingerprints with at most 4 differing bits
have a segment with at most one (4 // 3), so that segment is equal, or equal but for one wildcard bit.
The index holds, for each segment, its value and one variant per bit with that bit deleted; variants
keep the deleted bit beside them.  Values meet equal values, variants meet those with the other bit,
so an index entry never meets a pair again through another wildcard.  The equality join verifies the
distance inside the join, and takes a pair only at the first segment that can find it: each link comes
out once.  Any distance works; the segments are then as many as keep one of them within one bit.

Copies share one fingerprint and stand in the index once, so a group of copies costs one row.  The text
is read once and never shuffled; only fingerprints are.  Components come from alternating star
contraction, which aggregates and joins hubs without gathering them.

Edge cases: a null text counts as empty and has fingerprint zero, as has a text of white space; it links
like any other fingerprint.  Fewer words than a shingle make one shingle of all words.  A null document
id is never named as a component but gets the one of its fingerprint (null if all ids of the component
are null).  Repeated rows each give a row.  An empty table gives an empty result.  Other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import all_columns, batched, skewed_join, written
from tabloom.operators.graph import connected_components

SHINGLE_WORDS, MAX_DISTANCE, SEED = 4, 4, 42
FINGERPRINT_BITS = 64

#: Bit counts of a byte, for summing bits by the byte's value.
_BITS_OF_BYTE = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)
_COLUMNS = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every run of ``words`` words, as the rows of bytes of little-endian numbers."""
    found = text.encode().lower().split()  # bytes: A-Z and the white space of the contract only
    joined = b" ".join(found)
    if len(found) <= words:
        parts = [joined] if found else []
    else:
        ends = np.cumsum([len(w) + 1 for w in found])
        starts = np.concatenate([[0], ends[:-1]])[: len(found) - words + 1]
        parts = [joined[a:b] for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(p, SEED) for p in parts], dtype="<u8").view(np.uint8).reshape(-1, 8)


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The 64 majority bits as a signed number; a bit set in exactly half of the hashes is 0."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    seen = np.bincount((hashes + _COLUMNS).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BITS_OF_BYTE).ravel()
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprinter(words: int):
    def run(batches):
        for batch in batches:
            made = [fingerprint(t or "", words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.int64())], names=["doc_id", "h", "fp"])

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, h, fp): a hash of the text and its signed 64-bit fingerprint, for every row."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    return batched(narrow, _fingerprinter(shingle_words), "doc_id long, h long, fp long")


def segments(max_distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments: the fewest, at least two, for which one differs by at most one bit."""
    count = max(2, max_distance // 2 + 1)
    edges = [FINGERPRINT_BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _value(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _entries(fp: Column, cut: list[tuple[int, int]], bit: int) -> Column:
    """Index entries of one side: the plain segment, and its variants whose deleted bit was ``bit`` (else null).

    An entry is one number: the segment and the wildcard in the high bits, the rest of the segment below.
    """
    entries = []
    for number, (low, width) in enumerate(cut):
        value = _value(fp, low, width)
        entries.append(F.lit(number * 65 << 48).bitwiseOR(value))
        for j in range(width):
            rest = F.lit(number * 65 + 1 + j << 48).bitwiseOR(value.bitwiseAND(F.lit(~(1 << j))))
            entries.append(F.when(F.getbit(fp, F.lit(low + j)) == bit, rest))
    return F.array(*entries)


def _first_meeting(a: Column, b: Column, cut: list[tuple[int, int]]) -> Column:
    """Number of the first segment in which two fingerprints differ by at most one bit."""
    found = F.lit(len(cut))
    for number, (low, width) in reversed(list(enumerate(cut))):
        found = F.when(F.bit_count(_value(a.bitwiseXOR(b), low, width)) <= 1, F.lit(number)).otherwise(found)
    return found


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(id_1, id_2): every pair of different values of ``fp`` with at most ``max_distance`` differing bits, once.

    ``distinct`` holds each fingerprint once.
    """
    cut = segments(max_distance)
    left = distinct.select(F.col("fp").alias("id_1"), F.explode(_entries(F.col("fp"), cut, 0)).alias("entry")).where("entry is not null")
    right = distinct.select(F.col("fp").alias("id_2"), F.explode(_entries(F.col("fp"), cut, 1)).alias("entry_2")).where("entry_2 is not null")
    a, b = F.col("id_1"), F.col("id_2")
    segment = F.floor(F.shiftright("entry", 48) / 65)
    plain = F.shiftright("entry", 48) % 65 == 0
    near = (
        (F.bit_count(a.bitwiseXOR(b)) <= max_distance)
        & (_first_meeting(a, b, cut) == segment)
        & (~plain | (a < b))  # equal segments meet in both orders
    )
    # Spark sizes the exploded entries like the fingerprints they come from and would broadcast them
    return left.join(right.hint("merge"), (F.col("entry") == F.col("entry_2")) & near).select("id_1", "id_2")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, h, fp, group, component_id) for every row.

    ``component_id`` is the smallest document id reachable over links, ``group`` the smallest fingerprint,
    ``h`` a hash of the text.
    """
    marked = written(fingerprints(docs, doc_id, text, shingle_words), "fingerprints")
    smallest = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    joined = connected_components(links(smallest.select("fp"), max_distance))
    # only fingerprints that link with others stand in ``joined``
    linked = joined.join(smallest, joined["node"] == smallest["fp"]).select("fp", "component", "least")
    roots = linked.groupBy("component").agg(F.min("least").alias("root"))
    named = linked.select("fp", "component").join(roots, "component").select(F.col("fp").alias("fp_2"), "component", "root")
    final = smallest.join(named, F.col("fp") == F.col("fp_2"), "left").select(
        F.col("fp").alias("fp_1"), F.coalesce("component", "fp").alias("group"), F.coalesce("root", "least").alias("component_id"), "copies"
    )
    return skewed_join(marked, written(final, "groups"), {"fp": "fp_1"}, "copies").select("doc_id", "h", "fp", "group", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each group, with all columns: the one of the smallest document id (null last).

    Rows of that same id are told apart by a hash of the text, and of rows that repeat both any one stays.
    """
    found = components(docs, doc_id, text, **how)
    keys = found.groupBy("group", "doc_id", "h").agg(F.count("*").alias("rows"))
    first = keys.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "rows")).alias("k"))
    prefix = "kept"
    while any(c.lower().startswith(f"{prefix}_") for c in docs.columns):
        prefix += "x"
    first = written(first.select(F.col("k.doc_id").alias(f"{prefix}_id"), F.col("k.h").alias(f"{prefix}_h"), F.col("k.rows").alias(f"{prefix}_rows")), "kept")
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(f"{prefix}_id")) & (F.xxhash64(text) == F.col(f"{prefix}_h"))
    alone = docs.join(first.where(F.col(f"{prefix}_rows") == 1), same, "left_semi")
    again = docs.join(first.where(F.col(f"{prefix}_rows") > 1), same).drop(f"{prefix}_rows").dropDuplicates([f"{prefix}_id", f"{prefix}_h"])
    return alone.unionByName(again.select(*all_columns(docs)))
