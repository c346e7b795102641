import random

import numpy as np
from pyspark.sql import functions as F

from tabloom.llm.language_id import FEATURES, features, fitted_temperature, ftrl, identify, keep_identified, train

SYLLABLES = {"aa": ["ka", "mo", "tu", "ri"], "bb": ["sch", "ung", "ver", "ü"], "cc": ["ción", "que", "ll", "ñ"]}


def rows(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(list(SYLLABLES))
        words = ["".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 60))]
        out.append((i, " ".join(words), lang if i % 9 else None, lang))
    return out


def test_held_out_accuracy_and_undetermined(spark):
    data = rows(400, 1) + [(900, None, "aa", "und"), (901, "12 34 !?", "bb", "und"), (902, "", None, "und"), (None, "kamotu rika", "aa", "aa")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score string").repartition(3)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(docs.where(~F.coalesce(held, F.lit(False))))
    assert model.languages == ["aa", "bb", "cc"] and (model.weights == 0).mean() > 0.5
    got = identify(docs, model, held).collect()
    want = {i: x for i, _, _, x in data}
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {900, 901, 902}
    assert np.mean([r.lang_pred == want[r.doc_id] for r in got if r.held_out]) > 0.97
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, *_ in data} - {900, 901, 902}


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert identify(docs, train(docs), F.lit(False)).first().lang_pred == "und"
    assert identify(docs.limit(0), train(docs.limit(0)), F.lit(False)).count() == 0


def test_features_do_not_depend_on_steps():
    text = "Ab, cd-ef  gh!ünder 12 " * 40
    whole, counts = features(text)
    for step in (1, 2, 7, 64):
        found, other = features(text, step)
        assert (found == whole).all() and (other == counts).all()
    assert len(features("... 12")[0]) == 0


def test_training_parts():
    rng = np.random.default_rng(0)
    vectors = [(np.array([k, 10 + int(rng.integers(5))]), np.array([0.8, 0.6])) for k in (0, 1) * 100]
    weights, _ = ftrl(vectors, [0, 1] * 100, 2)
    assert weights.shape == (FEATURES, 2) and weights[0, 0] > weights[0, 1] and weights[1, 1] > weights[1, 0] and not weights[100].any()
    logits = rng.standard_normal((4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert 2.5 < fitted_temperature(logits * 3, labels) < 3.6


def test_large_languages_are_learned_from():
    from tabloom.llm.language_id import PICKS, sample_limit

    for n in (10, 40_000_000, 10**12):
        assert 0 < sample_limit(30, n) <= PICKS and abs(sample_limit(30, n) / PICKS * n - min(30, n)) < 1
