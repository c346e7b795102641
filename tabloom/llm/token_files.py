"""Token files: ids packed by Simple-8b, written in document order and read back block by block.

A word of 64 bits holds a selector in its top 4 bits and, in the low 60, as many ids as the selector
says, the first one lowest.  An id of more than 60 bits is an escape: the selector ESCAPE, and the next
word holds the id as it is.  A block holds whole documents; the offsets beside it (the number of words,
escapes and ids, the documents' lengths and the shard's ids before it) let a reader decode any block
alone, all selectors at once.  The container is Parquet, so that Spark writes and reads it on any store:
one row per block, one range of document ids per shard.

Edge cases: a null text is an empty one, an empty text still gets its end id, null document ids come
first, rows of equal document ids are ordered by their texts, an empty table gives an empty file set.
Other columns of the input are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm.common import batched
from tabloom.llm.pieces import encoder

#: Fixed values of the format: ids in a word by selector, and the bits of each (selector 0 is the escape).
COUNTS = np.array([1, 240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
ESCAPE = 0

BLOCK_IDS = 1 << 16
#: Pieces of texts that a writing task keeps encoded (about 210 MB).
KEPT_PIECES = 1_200_000
BLOCKS = "shard long, block long, ids_before long, n_ids long, n_words long, n_escapes long, doc_ids array<long>, lengths array<long>, words binary"


def _fits(widths: np.ndarray, bits: int, count: int) -> np.ndarray:
    """True where the ``count`` ids from a place on all have at most ``bits`` bits."""
    reach, ok = 1, widths <= bits
    while reach < count and ok.any():
        step = min(reach, count - reach)
        ok[:-step] &= ok[step:]
        ok[-step:] = False
        reach += step
    return ok


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id; of longer ones from the high half, which a double holds exactly."""
    high = (ids >> np.uint64(32)).astype(np.uint32)
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, low) if high.any() else low


def pack(ids: np.ndarray) -> tuple[np.ndarray, int]:
    """(words, number of escapes) for an array of unsigned ids; each word takes as many ids as fit.

    Only selectors whose bits some but not all ids need are tried at each place; the rest fit nowhere or
    everywhere.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, dtype=np.uint64), 0
    ids = np.concatenate([ids.astype(np.uint64), np.zeros(int(COUNTS.max()), dtype=np.uint64)])
    widths = _bit_lengths(ids).astype(np.int8)
    most = int(widths.max())
    choice = np.zeros(len(ids), dtype=np.int8)
    for selector in range(len(COUNTS) - 1, 0, -1):  # the last one to fit holds the most ids
        if BITS[selector] >= most:
            choice[: len(ids) - int(COUNTS[selector]) + 1] = selector
        else:
            np.copyto(choice, np.int8(selector), where=_fits(widths, int(BITS[selector]), int(COUNTS[selector])))
    # the words' places, from the first on: twice as many at a time, by jumps of twice as many words
    jump = np.minimum(np.arange(len(choice)) + COUNTS[choice], n).astype(np.int32)
    starts = np.zeros(1, dtype=np.int32)
    while starts[-1] < n:
        starts = np.concatenate([starts, jump.take(starts)])
        jump = jump.take(jump)
    starts = starts[starts < n]
    selectors = choice[starts]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors):
        if selector == ESCAPE or not BITS[selector]:
            continue
        here = np.flatnonzero(selectors == selector)
        first, word = starts[here], words[here]
        for k in range(COUNTS[selector]):
            word |= ids[first + k] << np.uint64(k * BITS[selector])
        words[here] = word
    escaped = np.flatnonzero(selectors == ESCAPE)
    return np.insert(words, escaped + 1, ids[starts[escaped]]), len(escaped)


def _without_raw(words: np.ndarray, n_escapes: int) -> tuple[np.ndarray, np.ndarray]:
    """(words that have a selector, the raw ids of the escapes in order)."""
    if not n_escapes:
        return words, words[:0]
    raw = np.zeros(len(words), dtype=bool)
    after = -1
    for at in np.flatnonzero(words >> np.uint64(60) == ESCAPE).tolist():
        if at > after:  # else it is itself the raw id of the escape before
            after = at + 1
            raw[after] = True
    return words[~raw], words[raw]


def unpack(words: np.ndarray, n_ids: int, n_escapes: int = 0) -> np.ndarray:
    """The ids of one block: places of all words by one running sum, then one step for each selector."""
    words, raw = _without_raw(words, n_escapes)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selectors])
    starts = ends - COUNTS[selectors]
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for selector in np.unique(selectors):
        here = np.flatnonzero(selectors == selector)
        if selector == ESCAPE:
            out[starts[here]] = raw
        elif BITS[selector]:
            shifts = np.arange(COUNTS[selector], dtype=np.uint64) * np.uint64(BITS[selector])
            mask = np.uint64((1 << int(BITS[selector])) - 1)
            out[starts[here][:, None] + np.arange(COUNTS[selector])] = words[here][:, None] >> shifts & mask
    return out[:n_ids]


def _block_writer(path: str, end_id: int, block_ids: int):
    """Arrow batches of (document id, text), in order, to rows of blocks."""

    def run(batches):
        shard = TaskContext.get().partitionId()
        encode = encoder(path, space_led=True, special=True, pieces=KEPT_PIECES).encode_bytes
        end = np.array([end_id], dtype="<u4").tobytes()
        docs, held, size, block, before = [], [], 0, 0, 0

        def row():
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            words, escapes = pack(ids)
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "block": block, "ids_before": before, "n_ids": len(ids), "n_words": len(words), "n_escapes": escapes,
                  "doc_ids": docs, "lengths": [len(h) // 4 for h in held], "words": words.astype("<u8").tobytes()}], schema=_BLOCK_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(doc_id)
                held.append(encode(text or "") + end)
                size += len(held[-1]) // 4
                if size >= block_ids:
                    yield row()
                    before, block = before + size, block + 1
                    docs, held, size = [], [], 0
        if docs:
            yield row()

    return run


_BLOCK_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("shard", "block", "ids_before", "n_ids", "n_words", "n_escapes")]
    + [("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("words", pa.binary())]
)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``text`` with a byte-level vocabulary, append ``end_id`` and write blocks in ascending ``doc_id`` order.

    The one shuffle deals the texts out by ranges of the document id; a range is a shard.
    """
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    batched(ordered, _block_writer(vocabulary, end_id, block_ids), BLOCKS).write.mode("errorifexists").option("compression", "zstd").parquet(folder)


def _document_reader(batches):
    """Decode each block by itself; a row per document with its ids."""
    for batch in batches:
        for block in batch.to_pylist():
            ids = unpack(np.frombuffer(block["words"], dtype="<u8"), block["n_ids"], block["n_escapes"]).astype("<u4")
            ends = np.cumsum(block["lengths"])
            starts = ends - block["lengths"]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(block["doc_ids"], pa.int64()),
                    "shard": pa.array([block["shard"]] * len(ends), pa.int64()),
                    "start": pa.array(starts + block["ids_before"], pa.int64()),
                    "n_tokens": pa.array(block["lengths"], pa.int64()),
                    "ids": pa.array([ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()),
                }
            )


def _digest_reader(batches):
    for batch in _document_reader(batches):
        crc = pa.array([zlib.crc32(x) for x in batch.column(4).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], crc], names=["doc_id", "shard", "start", "n_tokens", "ids_crc32"])


def _numbered(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Add the ids of the shards before to ``start``; one row per shard stands in the running sum."""
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    joined = documents.join(F.broadcast(first), "shard")  # one row per shard, as many as write tasks
    return joined.withColumn("start", F.col("start") + F.col("first")).drop("first", "shard")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids as little-endian unsigned 32-bit integers) from the files."""
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    return _numbered(blocks, blocks.mapInArrow(_document_reader, "doc_id long, shard long, start long, n_tokens long, ids binary"))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    return _numbered(blocks, blocks.mapInArrow(_digest_reader, "doc_id long, shard long, start long, n_tokens long, ids_crc32 long"))
