"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs n * LINEAR + n * n * QUADRATIC: the layers grow with the tokens, attention
inside a document with their square.  Documents are taken in descending length; each goes to the
sequence of lowest cost so far that still has room for it.  One that fits nowhere whole is cut over the
roomiest sequences.  The number of sequences is the least possible, so all of them end up full.

Packing runs in the tasks that read the documents, a group of at most GROUP_SEQUENCES sequences at a
time, and moves no rows: what a task holds is bounded by the group and its longest document.  All
groups but a task's last are cut to whole sequences.  The last one's remainder is dealt to sequences
whose lengths are powers of two, which need no padding.

Edge cases: a null or empty text is its end id alone; repeated rows are packed each by itself; ties in
length go by document id (null first) and then by place in the group; a document longer than a sequence
first fills whole sequences of its own; an empty table gives no pieces.  Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import batched
from tabloom.llm.pieces import encoder

SEQUENCE_TOKENS = 4096
GROUP_SEQUENCES = 512
LINEAR, QUADRATIC = 1.0, 1.0 / 2048

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES_WITH_IDS = PIECES + ", ids binary"


def piece_cost(length, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return length * linear + length * length * quadratic


def powers_of_two(n: int) -> list[int]:
    """The powers of two that add up to ``n``, largest first."""
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


def assign(lengths: list[int], capacities: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; the capacities add up to the lengths.

    ``lengths`` must be in descending order.
    """
    size = np.array(capacities, dtype=np.int64)
    room, cost, pieces = size.copy(), np.zeros(len(size)), []

    def put(doc: int, start: int, length: int, at: int) -> None:
        pieces.append((doc, start, length, at, int(size[at] - room[at])))
        room[at] -= length
        cost[at] += piece_cost(length)

    for doc, length in enumerate(lengths):
        start = 0
        while start < length:
            left = length - start
            fits = room >= left
            if fits.any():
                at = int(np.where(fits, cost, np.inf).argmin())
                put(doc, start, left, at)
                break
            at = int(room.argmax())
            took = int(room[at])
            put(doc, start, took, at)
            start += took
    return pieces


class _Group:
    """Documents of a task that are packed together."""

    def __init__(self, tokens: int, with_ids: bool):
        self.tokens, self.with_ids = tokens, with_ids
        self.parts: list[tuple] = []  # (doc_id, place in the task, start of the part, ids as bytes, tokens of the document)
        self.held = 0
        self.next_sequence = TaskContext.get().partitionId() << 32
        self.place = 0

    def add(self, doc_id, ids: bytes):
        total, full, place = len(ids) // 4, 0, self.place
        self.place += 1
        while total - full >= self.tokens:  # whole sequences of a long document
            yield self._row(doc_id, full, ids[full * 4 : (full + self.tokens) * 4], total, self.next_sequence, 0)
            self.next_sequence += 1
            full += self.tokens
        if full < total:
            self.parts.append((doc_id, place, full, ids[full * 4 :], total))
            self.held += total - full

    def _row(self, doc_id, start, ids, total, sequence, offset):
        row = (doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset)
        return (*row, ids) if self.with_ids else row

    def pack(self, last: bool):
        """Pack what is held; before the task's end the last document is cut so that all sequences are full."""
        rest = []
        if not last and (over := self.held % self.tokens):
            doc_id, place, start, ids, total = self.parts.pop()
            while len(ids) // 4 <= over:
                rest.append((doc_id, place, start, ids, total))
                over -= len(ids) // 4
                doc_id, place, start, ids, total = self.parts.pop()
            cut = len(ids) - over * 4
            if over:
                rest.append((doc_id, place, start + cut // 4, ids[cut:], total))
            self.parts.append((doc_id, place, start, ids[:cut], total))
        parts = sorted(self.parts, key=lambda p: (-len(p[3]), p[0] is not None, p[0] or 0, p[1]))
        lengths = [len(p[3]) // 4 for p in parts]
        total = sum(lengths)
        capacities = [self.tokens] * (total // self.tokens) + powers_of_two(total % self.tokens)
        for doc, at, length, sequence, offset in assign(lengths, capacities):
            doc_id, _, start, ids, tokens = parts[doc]
            yield self._row(doc_id, start + at, ids[at * 4 : (at + length) * 4], tokens, self.next_sequence + sequence, offset)
        self.next_sequence += len(capacities)
        self.parts, self.held = rest, sum(len(p[3]) // 4 for p in rest)


def _packer(path: str, end_id: int, tokens: int, group_sequences: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([(n, pa.int64()) for n in names] + ([("ids", pa.binary())] if with_ids else []))

    def frame(rows):
        columns = list(zip(*rows)) or [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        encode = encoder(path, space_led=False, special=True).encode_bytes
        end = np.array([end_id], dtype="<u4").tobytes()
        group = _Group(tokens, with_ids)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.extend(group.add(doc_id, encode(text or "") + end))
                if group.held >= tokens * group_sequences:
                    rows.extend(group.pack(last=False))
            yield frame(rows)
        yield frame(list(group.pack(last=True)))

    return run


def pack_documents(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2,
    sequence_tokens: int = SEQUENCE_TOKENS, group_sequences: int = GROUP_SEQUENCES, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence; ``with_ids`` adds its ids.

    ``vocabulary`` is a tokenizers file whose pre-tokens never span white space.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = PIECES_WITH_IDS if with_ids else PIECES
    return batched(narrow, _packer(vocabulary, end_id, sequence_tokens, group_sequences, with_ids), schema)
