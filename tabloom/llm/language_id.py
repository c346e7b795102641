"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are n-grams of 1 to 3 characters of the lower-cased text, in which everything but letters is
one space, hashed to FEATURES buckets.  Document frequencies are counted over all training texts.  The
weights are fitted by follow-the-regularised-leader with elastic-net penalties, one text at a time, on a
bounded sample of labelled texts (``sample_texts``, shared evenly by the languages); a temperature is
then fitted on the quarter of the sample that training has not seen.

Edge cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if there is
nothing to learn from; rows without a label are not learned from; repeated rows each count; an empty
table gives an empty result.  Predictions read the text only.  ``keep_identified`` hands on all columns.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import batched

FEATURE_BITS = 15
FEATURES = 1 << FEATURE_BITS
STEP = 1 << 20
PICKS = 1 << 40
SAMPLE_TEXTS = 6000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
UNKNOWN = "und"
#: Texts predicted with less are not kept.
MIN_SCORE = 0.3

#: Odd multipliers of the hash, one for each length.
_FACTORS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]

_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Table of all code points, made once per worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def features(text: str | None, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text's n-grams; empty if it has no letter.  Long texts are read in steps."""
    text = (text or "").lower()
    counts, after_letter, any_letter = np.zeros(FEATURES, dtype=np.int64), False, False
    space = np.array([32], dtype=np.uint64)
    last = space  # the last characters before the step
    for at in range(0, len(text), step):
        points = np.frombuffer(text[at : at + step].encode("utf-32-le"), dtype="<u4")
        letter = _is_letter()[points]
        kept = letter | np.concatenate([[after_letter], letter[:-1]])  # one space for each run of others
        after_letter, any_letter = bool(letter[-1]), any_letter or bool(letter.any())
        new = np.where(letter, points, 32).astype(np.uint64)[kept]
        last = _add_grams(counts, last, new)
    if not any_letter:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if after_letter:
        _add_grams(counts, last, space)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _add_grams(counts: np.ndarray, last: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Count the n-grams that end in ``new``; returns the last two characters."""
    points = np.concatenate([last, new])
    grams = [points, points[:-1] << np.uint64(21) | points[1:], points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]]
    ending = [g[max(0, len(g) - len(new)) :] * f >> np.uint64(64 - FEATURE_BITS) for g, f in zip(grams, _FACTORS)]
    counts += np.bincount(np.concatenate(ending).astype(np.int64), minlength=FEATURES)
    return points[-2:]


@dataclass
class LanguageModel:
    """All of bounded size: FEATURES times the number of languages."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def vector(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[found]
        return x / max(np.sqrt(x @ x), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        found, counts = features(text)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        logits = (self.vector(found, counts) @ self.weights[found] + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _document_frequencies(batches):
    total, texts = np.zeros(FEATURES, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found, _ = features(text)
            total[found] += 1
            texts += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([texts, *total[at].tolist()], pa.int64())], names=["bucket", "n"])


def _sample_features(batches):
    for batch in batches:
        made = [features(t) for t in batch.column(0).to_pylist()]
        columns = [pa.array([m[k].astype("<i4").tobytes() for m in made], pa.binary()) for k in range(2)]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *columns], names=["label", "pick", "found", "counts"])


def ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) by FTRL-proximal steps; weights whose pull stays below L1 are exactly zero."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def solved(rows):
        pull = z[rows]
        return np.where(np.abs(pull) <= L1, 0.0, -(pull - np.sign(pull) * L1) / ((BETA + np.sqrt(n[rows])) / ALPHA + L2))

    for _ in range(epochs):
        for (found, x), label in zip(vectors, labels):
            rows, x = np.append(found, FEATURES), np.append(x, 1.0)  # the last row is the bias
            w = solved(rows)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            seen = n[rows]
            n[rows] = seen + g * g
            z[rows] += g - (np.sqrt(n[rows]) - np.sqrt(seen)) / ALPHA * w
    w = solved(np.arange(FEATURES + 1))
    return w[:-1].astype("f4"), w[-1].astype("f4")


def fitted_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log-loss, on a fine grid between 1/20 and 20.

    The right class is wanted with (n + 1) / (n + 2) only, else texts that are all right would call for
    certainty.
    """
    n, classes = logits.shape
    if not n or classes == 1:
        return 1.0
    rest = 1 / (n + 2)

    def loss(t):
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
        right = x[np.arange(n), labels]
        return -((1 - rest) * right + rest * (x.sum(axis=1) - right) / (classes - 1)).mean()

    return float(min(np.exp(np.linspace(-3, 3, 241)), key=loss))


def _trainer(languages: list[str], idf: np.ndarray, epochs: int):
    def run(batches):
        model = LanguageModel(languages, idf, np.zeros((FEATURES, len(languages)), "f4"), np.zeros(len(languages), "f4"), 1.0)
        train, test = [], []
        for batch in batches:
            for label, pick, found, counts in zip(*(c.to_pylist() for c in batch.columns)):
                found, counts = np.frombuffer(found, dtype="<i4"), np.frombuffer(counts, dtype="<i4")
                if len(found):
                    part = test if pick & 3 == 0 else train
                    part.append((pick, found, model.vector(found, counts), languages.index(label)))
        train.sort(key=lambda r: r[0])
        train = train or test
        model.weights, model.bias = ftrl([(f, x) for _, f, x, _ in train], [r[3] for r in train], len(languages), epochs)
        if test:
            logits = np.stack([x @ model.weights[f] + model.bias for _, f, x, _ in test])
            model.temperature = fitted_temperature(logits, np.array([r[3] for r in test]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return run


def sample_limit(share: float, n: int) -> int:
    """The picks below it, out of PICKS, are about ``share`` of ``n`` rows; never none."""
    return math.ceil(min(1.0, share / n) * PICKS)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_texts: int = SAMPLE_TEXTS, epochs: int = EPOCHS) -> LanguageModel:
    """Learn from the rows with a text and a label; the sample holds about ``sample_texts`` of them."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("label")).where("text is not null and label is not null")
    frequencies = batched(rows.select("text"), _document_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(frequencies.column(0).to_pylist(), frequencies.column(1).to_pylist()))
    texts = counts.pop(-1, 0)
    df = np.zeros(FEATURES)
    df[list(counts)] = list(counts.values())
    idf = (np.log((1 + texts) / (1 + df)) + 1).astype("f4")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], idf, np.zeros((FEATURES, 0), "f4"), np.zeros(0, "f4"), 1.0)
    share = sample_texts / len(languages)
    limits = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, sample_limit(share, n))])
    picked = rows.withColumn("pick", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PICKS)))  # by row: copies are picked one by one
    sample = picked.where(F.col("pick") < F.element_at(limits, F.col("label")))
    made = batched(sample.select("text", "label", "pick"), _sample_features, "label string, pick long, found binary, counts binary")
    # the sample is bounded, so one task may hold it
    model = batched(made.repartition(1), _trainer(languages, idf, epochs), "model binary").collect()
    return pickle.loads(model[0]["model"]) if model else LanguageModel([], idf, np.zeros((FEATURES, 0), "f4"), np.zeros(0, "f4"), 1.0)


def _predictor(model: LanguageModel, width: int):
    """Adds (prediction, score) to batches whose last column is the text; the text is dropped."""

    def run(batches):
        for batch in batches:
            made = [model.predict(t) for t in batch.column(width).to_pylist()]
            names = [*batch.schema.names[:width], "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=names)

    return run


def identify(docs: DataFrame, model: LanguageModel, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return batched(narrow, _predictor(model, 2), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows, with all columns, whose text has a letter and a prediction of at least ``min_score``."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            made = [model.predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in made], pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots can't go through Arrow
    return batched(plain, run, plain.schema).toDF(*docs.columns)
