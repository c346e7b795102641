"""Language-model scores of whole texts, beside an add-one unigram score.

Words are runs of anything but white space, after lower-casing A-Z; each text ends with one end token.

* Word counts of all training texts are a Spark aggregate.  The most frequent words (a bounded number of
  bounded length) go to the scoring tasks; the counts of the rest are joined by a shuffle on the word.
* The attention model works on byte-level BPE ids of " word"s and an end id, so its probabilities are
  those of word sequences.  Adjacent ids are counted over all training texts, across words and from the
  start to the end id: combined in the tasks, then summed by Spark.  The network is fitted to blocks of ids
  of all training texts in ROUNDS rounds.  A round takes TRAIN_SHARE of the blocks, and at least about
  ``train_tokens`` tokens, by ranges of a hash that go once around: a large corpus is learned from once as a
  whole, a small one up to ROUNDS times.  Blocks are dealt to tasks of about SHARD_TOKENS; in a round every
  task goes on from the same parameters, and their average, weighted by what a task has seen of each id,
  is summed in tasks.  Only that average, of bounded size, comes to the driver.  Then every text is scored
  whole in overlapping windows, each token once.

Edge cases: a null text counts as empty and is its end token; without training texts all words have
probability 1 / 1 in the base score and the model is uniform over its classes; a null document id is a
training text; repeated rows are scored each; an empty table gives an empty result.  Other columns are
not read.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm import attention
from tabloom.llm.common import batched, written
from tabloom.llm.pieces import encoder

ROUNDS = 8
TRAIN_TOKENS, TRAIN_SHARE = 4_000_000, 1 / ROUNDS
BLOCK, SHARD_TOKENS = 256, 1_000_000
COUNTER_PAIRS = 1 << 20
CHUNK = 1 << 16
SIGNS = 16
FREQUENT_WORDS, FREQUENT_LENGTH = 150_000, 64
COUNTER_WORDS = 200_000
SCORE_TOKENS = 1 << 17

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_VOCABULARY = pa.schema([("word", pa.string()), ("n", pa.int64())])


def words_of(text: str | None) -> list[str]:
    """Words of a text, lower-cased from A to Z."""
    return [w for w in (text or "").encode().translate(_NORMAL).decode().split(" ") if w]


def _count_words(batches):
    """(word, n) of a task's texts; the counter is handed on whenever it is large."""
    seen: Counter = Counter()

    def frame():
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], schema=_VOCABULARY)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(words_of(text))
            if len(seen) >= COUNTER_WORDS:
                yield frame()
                seen.clear()
    if seen:
        yield frame()


def vocabulary(training: DataFrame) -> DataFrame:
    """(word, n) of all training texts; ``training`` has ``text``."""
    counted = batched(training.select("text"), _count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return written(counted, "vocabulary")


def frequent_words(vocab: DataFrame, most: int = FREQUENT_WORDS, longest: int = FREQUENT_LENGTH) -> DataFrame:
    """(word, n) of the words whose count reaches a bound that at most ``most`` words reach."""
    level = F.floor(F.log2("n") * 8)  # eighths of an octave: a few hundred levels at any size
    short = vocab.where(F.length("word") <= longest).select("word", "n", level.alias("level"))
    bound, held = None, 0
    for row in sorted(short.groupBy("level").agg(F.count("*").alias("words")).collect(), reverse=True):
        held += row["words"]
        if held > most:
            break
        bound = row["level"]
    return short.where(F.lit(False) if bound is None else F.col("level") >= bound).select("word", "n")


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def _count_pairs(path: str, ids: int, end_id: int):
    """Adjacent ids of a task's texts as (before * (ids + 1) + id, n); ``ids`` stands before a text."""

    def run(batches):
        encode = _ids_of(path, end_id)
        keys, counts, held, rows = [], [], [], 0

        def frame(found, n):
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

        def combine():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return _merged([*keys, found], [*counts, n])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = encode(words_of(text)).astype(np.int64)
                held.append(np.concatenate([[ids], found[:-1]]) * (ids + 1) + found)
                rows += len(found)
                if rows >= COUNTER_PAIRS:
                    found, n = combine()
                    keys, counts, held, rows = [found], [n], [], 0
                    if len(found) >= COUNTER_PAIRS:
                        yield frame(found, n)
                        keys, counts = [], []
        if held:
            yield frame(*combine())
        elif keys:
            yield frame(keys[0], counts[0])

    return run


def adjacent_pairs(training: DataFrame, path: str, ids: int, end_id: int) -> DataFrame:
    """(pair, n) of all adjacent ids of the training texts, see _count_pairs; ``training`` has ``text``."""
    counted = batched(training.select("text"), _count_pairs(path, ids, end_id), "pair long, n long")
    return written(counted.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")


def _class_pairs(class_of: np.ndarray, ids: int, side: int):
    """Pairs of classes; ``class_of`` has a last place for what stands before a text."""

    def run(batches):
        total = np.zeros(side * side)
        for batch in batches:
            pair, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            total += np.bincount(class_of[pair // (ids + 1)] * side + class_of[pair % (ids + 1)], n, side * side)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at].astype(np.int64), pa.int64())], names=["id", "n"])

    return run


def _gathered(df: DataFrame, size: int) -> np.ndarray:
    """Sums by id as one array; ``size`` bounds the rows that come to the driver."""
    out = np.zeros(size)
    rows = df.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return out


def _signatures(row_of: np.ndarray, ids: int, signs: np.ndarray):
    """Sums of random signs of the classes before and after each id."""

    def run(batches):
        total = np.zeros((ids + 1, 2 * signs.shape[1]))
        for batch in batches:
            pair, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            before, after = pair // (ids + 1), pair % (ids + 1)
            np.add.at(total[:, : signs.shape[1]], after, signs[row_of[before]] * n[:, None])
            np.add.at(total[:, signs.shape[1] :], before, signs[row_of[after]] * n[:, None])
        at = np.flatnonzero(total[:ids].any(axis=1))
        data = [x.tobytes() for x in total[at].astype("<f4")]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(data, pa.binary())], names=["chunk", "data"])

    return run


def corpus_classes(pairs: DataFrame, ids: int) -> tuple[attention.Classes, np.ndarray]:
    """The model's classes and the log-probabilities of pairs from the adjacent ids of the whole corpus; the ids' counts."""
    counts = _gathered(pairs.select((F.col("pair") % (ids + 1)).alias("id"), "n"), ids)
    head = attention.head_ids(counts)
    place = np.full(ids + 1, attention.HEAD, dtype=np.int64)
    place[head] = np.arange(attention.HEAD)
    place[ids] = attention.START
    signs = np.random.default_rng(0).choice([-1.0, 1.0], (attention.TAIL_FROM, SIGNS))
    signatures = np.zeros((ids, 2 * SIGNS))
    sums = batched(pairs, _signatures(place, ids, signs), "chunk long, data binary")
    for row in batched(sums.repartition("chunk"), _summed, "chunk long, data binary").collect():
        signatures[row["chunk"]] = np.frombuffer(row["data"], dtype="<f4")
    slots = attention.tail_slots(head, counts, signatures)
    tail_side = attention.tail_side(ids)
    side = attention.TAIL_FROM + tail_side
    place[:ids] = np.where(slots >= 0, attention.TAIL_FROM + slots // tail_side, place[:ids])
    table = _gathered(batched(pairs, _class_pairs(place, ids, side), "id long, n long"), side * side).reshape(side, side)
    table[:, attention.HEAD] = table[:, attention.TAIL_FROM :].sum(axis=1)
    return attention.arrange(head, counts, table, slots), counts


def _ids_of(path: str, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def ids(words: list[str]) -> np.ndarray:
        return np.frombuffer(encoder(path, space_led=True).encode_words(words) + end, dtype="<u4")

    return ids


def _small(x) -> bytes:
    """For the way to the tasks, which leaves a file with each of them; what no text has reached is zero."""
    return zlib.compress(pickle.dumps(x), 1)


def _whole(x: bytes):
    return pickle.loads(zlib.decompress(x))


def sample_share(tokens: float, train_tokens: int) -> float:
    """The share of the blocks that a round learns from: all of a small corpus, TRAIN_SHARE of a large one."""
    return min(1.0, max(TRAIN_SHARE, train_tokens / max(tokens, 1)))


def block_hashes(pick: int, blocks: int) -> np.ndarray:
    """A well-mixed unsigned 64-bit number for each block of a text."""
    x = np.uint64(pick & (1 << 64) - 1) + np.arange(1, blocks + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def id_type(ids: int) -> str:
    """Kept blocks hold ids in 16 bits where these and ``ids`` itself, what stands before a text, fit."""
    return "<u2" if ids < 1 << 16 else "<u4"


def _blocks(path: str, ids: int, end_id: int, kind: str = "<u4"):
    """(pick, the id before and the ids of a block) of all blocks; ``pick`` is a 40-bit hash of the row and the block."""

    def run(batches):
        encode = _ids_of(path, end_id)
        for batch in batches:
            picks, made = [], []
            for text, pick in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.concatenate([np.array([ids], dtype="<u4"), encode(words_of(text))])
                begins = range(0, len(found) - 1, BLOCK)
                picks.extend((block_hashes(pick, len(begins)) >> np.uint64(24)).tolist())
                found = found.astype(kind)
                made.extend(found[i : i + BLOCK + 1].tobytes() for i in begins)
            yield pa.RecordBatch.from_arrays([pa.array(picks, pa.int64()), pa.array(made, pa.binary())], names=["pick", "ids"])

    return run


def of_round(blocks: DataFrame, part: int, share: float) -> DataFrame:
    """The blocks of a round: a range of hashes that begins where as many rounds as there were would end."""
    begin = part * (1 << 40) // ROUNDS
    return blocks.where(F.pmod(F.col("pick") - begin, F.lit(1 << 40)) < math.ceil(share * (1 << 40)))


def _trainer(classes: Broadcast, parameters: dict, part: int, kind: str = "<u4"):
    """Goes on from the parameters over a task's blocks; hands on weighted parameters and weights in chunks."""
    small = _small(parameters)

    def run(batches):
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        if not rows:
            return
        blocks = [np.frombuffer(i, dtype=kind).astype("<u4") for _, i in sorted(rows)]
        made, weights = attention.train(_whole(classes.value), blocks, _whole(small), part / ROUNDS, (part + 1) / ROUNDS, seed=part)
        flat = np.concatenate([x.ravel() for name in made for x in (made[name] * weights[name], weights[name])]).astype("<f4")
        chunks = range(0, len(flat), CHUNK)
        data = [flat[i : i + CHUNK].tobytes() for i in chunks]
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(data, pa.binary())], names=["chunk", "data"])

    return run


def _summed(batches):
    """Sums of the chunks of equal number, which are all in this task."""
    total: dict = {}
    for batch in batches:
        for chunk, data in zip(*(c.to_pylist() for c in batch.columns)):
            numbers = np.frombuffer(data, dtype="<f4")
            total[chunk] = total[chunk] + numbers if chunk in total else numbers.astype("f8")
    data = [x.astype("<f4").tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(data, pa.binary())], names=["chunk", "data"])


def _averaged(chunks: DataFrame, old: dict) -> dict:
    """The weighted average of the tasks' parameters; those without weight stay."""
    rows = batched(chunks.repartition("chunk"), _summed, "chunk long, data binary").collect()
    if not rows:
        return old
    flat = np.concatenate([np.frombuffer(r["data"], dtype="<f4") for r in sorted(rows)])
    new, at = {}, 0
    for name, x in old.items():
        shape = attention.weight_shape(name, x)
        total, at = flat[at : at + x.size].reshape(x.shape), at + x.size
        weight, at = flat[at : at + math.prod(shape)].reshape(shape), at + math.prod(shape)
        new[name] = np.where(weight > 0, total / np.maximum(weight, 1e-9), x).astype("f4")
    return new


@dataclass
class Model:
    """What the scoring tasks need; all of bounded size."""

    classes: attention.Classes
    parameters: dict
    frequent: dict[str, float]
    end_score: float
    end_known: int


def fit(training: DataFrame, path: str, ids: int, end_id: int, train_tokens: int) -> tuple[attention.Classes, dict]:
    """``training`` has text and pick, a hash of the row, so that the blocks of copies are picked one by one."""
    classes, counts = corpus_classes(adjacent_pairs(training, path, ids, end_id), ids)
    tokens = counts.sum()
    if not tokens:
        return classes, attention.without_effect(attention.new_parameters(side=attention.tail_side(ids)))
    share = sample_share(tokens, train_tokens)
    kind = id_type(max(ids, end_id))
    blocks = written(batched(training.select("text", "pick"), _blocks(path, ids, end_id, kind), "pick long, ids binary"), "blocks")
    shards = max(1, math.ceil(share * tokens / SHARD_TOKENS))
    parameters = attention.new_parameters(side=attention.tail_side(ids))
    parameters["embed"][classes.class_of[counts == 0]] = 0  # never trained
    shared = training.sparkSession.sparkContext.broadcast(_small(classes))
    for part in range(ROUNDS):
        trained = batched(of_round(blocks, part, share).repartition(shards), _trainer(shared, parameters, part, kind), "chunk long, data binary")
        parameters = _averaged(trained, parameters)
    return classes, parameters


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<string>, rare_n array<long>"
_SCORED_ARROW = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.string())), ("rare_n", pa.list_(pa.int64()))]
)


def _scorer(model: Model, path: str, end_id: int):
    small = _small(model)

    def run(batches):
        model = _whole(small)
        at = TaskContext.get().partitionId() << 40
        ids, frequent = _ids_of(path, end_id), model.frequent
        held, tokens = [], 0

        def frame():
            nonlocal at
            scores = attention.score_texts(model.parameters, model.classes, [h[-1] for h in held]) / math.log(10)
            columns = [range(at, at + len(held)), *list(zip(*held))[:5], scores, *list(zip(*held))[5:7]]
            at += len(held)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCORED_ARROW)], schema=_SCORED_ARROW)

        for batch in batches:
            for doc_id, held_out, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                values = list(map(frequent.get, words))
                rare = Counter([w for w, v in zip(words, values) if v is None])
                known = [v for v in values if v is not None]
                held.append((doc_id, held_out, len(words) + 1, len(known) + model.end_known, math.fsum(known) + model.end_score, list(rare), list(rare.values()), ids(words)))
                tokens += len(held[-1][-1])
                if tokens >= SCORE_TOKENS:
                    yield frame()
                    held, tokens = [], 0
        if held:
            yield frame()

    return run


def score_documents(
    docs: DataFrame, held_out: Column, path: str, ids: int, end_id: int, doc_id: str = "doc_id", text: str = "text", train_tokens: int = TRAIN_TOKENS
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``held_out`` is a condition on ``docs``; rows where it is not true are learned from.  ``path`` is a
    byte-level BPE file of ``ids`` ids, ``end_id`` the one that stands for the end.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    training = narrow.where(~F.col("held_out")).select("text", F.xxhash64(F.monotonically_increasing_id()).alias("pick"))
    n_texts = training.count()
    vocab = vocabulary(training)
    total = vocab.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n, v = total["n"] + n_texts, total["v"] + (n_texts > 0)
    classes, parameters = fit(training, path, ids, end_id, train_tokens)
    frequent = frequent_words(vocab).toArrow()
    norm = math.log10(n + v + 1)
    known = {w: math.log10(c + 1) - norm for w, c in zip(frequent.column(0).to_pylist(), frequent.column(1).to_pylist())}
    model = Model(classes, parameters, known, math.log10(n_texts + 1) - norm, int(n_texts > 0))
    marked = written(batched(narrow, _scorer(model, path, end_id), _SCORED), "scored")
    rare = marked.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("of")).select("row", F.col("of.rare").alias("rare"), F.col("of.rare_n").alias("times"))
    counted = rare.join(vocab.select("word", F.col("n")), F.col("rare") == F.col("word"), "left")
    sums = counted.groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1) - F.lit(norm))).alias("more_base"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
    )
    out = marked.drop("rare", "rare_n").join(sums.withColumnRenamed("row", "row_of"), F.col("row") == F.col("row_of"), "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
    )
