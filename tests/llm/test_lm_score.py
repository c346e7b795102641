import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tabloom.llm import attention
from tabloom.llm.lm_score import score_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def small_classes(rng, size=3000):
    counts = rng.integers(0, 50, size).astype(float)
    head = attention.head_ids(counts)
    pairs = rng.integers(0, 4, (attention.HEAD + 2, attention.HEAD + 2)).astype(float)
    return attention.arrange(head, counts, pairs)


def test_probabilities_add_up():
    rng = np.random.default_rng(1)
    classes = small_classes(rng)
    p = attention.new_parameters()
    before = rng.integers(0, 3000, 20)
    ends = attention.score_texts(p, classes, [np.append(before, i) for i in range(3000)])
    rest = attention.score_texts(p, classes, [before])[0]
    assert abs(np.exp(ends - rest).sum() - 1) < 1e-3


def test_windows_score_each_token_once():
    lengths = np.array([1, 31, 32, 33, 56, 57, 500])
    text, first, a, b = attention.windows(lengths)
    for t, n in enumerate(lengths):
        places = [p for w in np.flatnonzero(text == t) for p in range(first[w] + a[w], first[w] + b[w])]
        assert sorted(places) == list(range(n))


def test_windows_equal_one_text_at_a_time():
    rng = np.random.default_rng(2)
    classes, p = small_classes(rng), attention.new_parameters()
    texts = [rng.integers(0, 3000, n) for n in (1, 40, 200, 3)]
    together = attention.score_texts(p, classes, texts, batch=3)
    assert np.allclose(together, [attention.score_texts(p, classes, [t])[0] for t in texts], atol=1e-3)


def test_gradient_is_the_slope():
    rng = np.random.default_rng(3)
    classes, p = small_classes(rng), attention.new_parameters()
    p = {k: v.astype("f8") for k, v in p.items()}
    inputs, target = rng.integers(0, attention.HEAD, (2, attention.CONTEXT)), rng.integers(0, attention.HEAD + 1, (2, attention.CONTEXT))
    _, g = attention._gradients(p, classes, inputs, target)
    for name in p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        slope = (attention._gradients(up, classes, inputs, target)[0] - attention._gradients(down, classes, inputs, target)[0]) / 2e-3
        assert abs(slope - g[name][at]) < 0.02 * abs(slope) + 1e-5, name


def corpus():
    rnd = random.Random(5)
    syllables = ["ka", "mo", "tu", "ri", "sen", "lor", "an", "ex"]
    words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(250)]
    rows = [(i, " ".join(rnd.choice(words) + rnd.choice(["", "", ".", ","]) for _ in range(rnd.randint(0, 120)))) for i in range(220)]
    return rows + [(900, None), (901, ""), (902, "\n\t "), (903, "Été x ÀB unseen" + " tail" * 3000), (None, "no id at all"), (5, "same id again"), (904, "x" * 3000)]


def test_base_score_and_model(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double").repartition(4)
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = score_documents(docs, held, PATH, ids=50257, end_id=50256, train_tokens=40_000).collect()
    words = [(t or "").encode().lower().split() for _, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter()
    for w, h in zip(words, out):
        if not h:
            counts.update([*w, None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((i if i is not None else -1, h, len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in [*w, None]), 6)) for (i, _), w, h in zip(rows, words, out))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    assert all(r.score < 0 for r in got)
    ordinary = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.score for r in ordinary) > sum(r.base_score for r in ordinary) * 1.15
    shuffled = spark.createDataFrame([(1, "ak om ut ir")], "doc_id long, text string")
    assert score_documents(shuffled, F.lit(True), PATH, ids=50257, end_id=50256).first().base_score == 0
    assert score_documents(docs.limit(0), F.lit(True), PATH, ids=50257, end_id=50256).count() == 0


def test_pairs_of_all_texts_across_words(spark):
    from tabloom.llm.lm_score import adjacent_pairs
    from tabloom.llm.pieces import encoder

    texts = ["the cat sat", "The cat", None, "sat the cat", "unheardof " * 50]
    got = adjacent_pairs(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), PATH, 50257, 50256)
    want = Counter()
    for t in texts:
        ids = [i for w in (t or "").lower().split() for i in np.frombuffer(encoder(PATH, True).encode_word(w), "<u4").tolist()] + [50256]
        want.update(zip([50257, *ids], ids))
    assert {divmod(r.pair, 50258): r.n for r in got.collect()} == want


def test_sample_grows_with_the_corpus():
    from tabloom.llm.lm_score import sample_share

    assert sample_share(10**6, 4 * 10**6) == 1
    assert sample_share(10**10, 4 * 10**6) * 10**10 > 10**9


def test_average_of_several_tasks(spark):
    from tabloom.llm import lm_score

    rng = np.random.default_rng(4)
    classes, p = small_classes(rng), attention.new_parameters()
    blocks = [np.concatenate([[3000], rng.integers(0, 3000, 64)]).astype("<u4") for _ in range(6)]
    frame = spark.createDataFrame([(i, bytearray(b.tobytes())) for i, b in enumerate(blocks)], "pick long, ids binary").repartition(2)
    shards = [[np.frombuffer(r.ids, "<u4") for r in sorted(rows)] for rows in frame.rdd.glom().collect()]
    got = lm_score._averaged(lm_score.batched(frame, lm_score._trainer(spark.sparkContext.broadcast(lm_score._small(classes)), p, 0), "chunk long, data binary"), p)
    made = [attention.train(classes, s, p, 0, 1 / lm_score.ROUNDS) for s in shards if s]
    for name in p:
        weight = sum(w[name] for _, w in made)
        want = np.where(weight > 0, sum(x[name] * w[name] for x, w in made) / np.maximum(weight, 1), p[name])
        assert np.allclose(got[name], want, atol=1e-4), name


def test_tail_ids_are_told_apart():
    rng = np.random.default_rng(6)
    counts = np.append(np.full(attention.HEAD, 100.0), np.full(1500, 5.0))
    size = len(counts)
    classes = attention.arrange(attention.head_ids(counts), counts, np.zeros((attention.HEAD + 2,) * 2))
    assert len(set(classes.class_of.tolist())) == size
    a, b, c, d = attention.HEAD + np.array([10, 700, 300, 1200])
    blocks = [np.concatenate([[size], np.tile([a, c] if i % 2 else [b, d], 64)]).astype("<u4") for i in range(200)]
    p = attention.new_parameters()
    for _ in range(4):
        p, _ = attention.train(classes, blocks, p)
    after_a, after_b = (attention.score_texts(p, classes, [np.array([x, c]), np.array([x, d])]) for x in (a, b))
    assert after_a[0] - after_a[1] > 2 and after_b[1] - after_b[0] > 2
    ends = attention.score_texts(p, classes, [np.append([a, b], i) for i in range(size)])
    assert abs(np.exp(ends - attention.score_texts(p, classes, [np.array([a, b])])[0]).sum() - 1) < 1e-3


def test_gradient_of_the_tail_is_the_slope():
    rng = np.random.default_rng(7)
    classes = small_classes(rng)
    p = {k: v.astype("f8") for k, v in attention.new_parameters().items()}
    inputs, target = (classes.class_of[rng.integers(0, 3000, (2, attention.CONTEXT))] for _ in range(2))
    _, g = attention._gradients(p, classes, inputs, target)
    for name in p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        losses = []
        for step in (1e-3, -1e-3):
            p[name][at] += step
            losses.append(attention._gradients(p, classes, inputs, target)[0])
            p[name][at] -= step
        slope = (losses[0] - losses[1]) / 2e-3
        assert abs(slope - g[name][at]) < 0.02 * abs(slope) + 1e-5, name


def test_rounds_cover_all_blocks_of_all_texts(spark):
    from tabloom.llm import lm_score

    texts = [("word%d " % i * 3000, i * 7919) for i in range(4)] + [(None, 5)]
    frame = spark.createDataFrame(texts, "text string, pick long")
    blocks = lm_score.batched(frame, lm_score._blocks(PATH, 50257, 50256), "pick long, ids binary").collect()
    assert sum(len(b.ids) // 4 - 1 for b in blocks) == sum(len(lm_score._ids_of(PATH, 50256)(lm_score.words_of(t))) for t, _ in texts)
    table = spark.createDataFrame([(b.pick,) for b in blocks], "pick long")
    large = [r.pick for part in range(lm_score.ROUNDS) for r in lm_score.of_round(table, part, lm_score.TRAIN_SHARE).collect()]
    assert sorted(large) == sorted(b.pick for b in blocks)
    assert all(lm_score.of_round(table, part, 1.0).count() == len(blocks) for part in (0, 3))


def test_blocks_of_two_bytes_an_id_train_the_same():
    from tabloom.llm import lm_score

    assert lm_score.id_type(50257) == "<u2" and lm_score.id_type(65535) == "<u2" and lm_score.id_type(65536) == "<u4"
    batch = lm_score.pa.RecordBatch.from_arrays([lm_score.pa.array(["some words to learn from " * 40, None, "xyzzy"]), lm_score.pa.array([5, 6, 7])], names=["text", "pick"])
    wide, narrow = (next(lm_score._blocks(PATH, 50257, 50256, kind)([batch])) for kind in ("<u4", "<u2"))
    assert wide.column(0) == narrow.column(0) and narrow.column(1).nbytes < wide.column(1).nbytes * 0.6
    for a, b in zip(wide.column(1).to_pylist(), narrow.column(1).to_pylist()):
        assert np.frombuffer(a, "<u4").tolist() == np.frombuffer(b, "<u2").tolist()
    rng = np.random.default_rng(1)
    classes, p = small_classes(rng, 50257), attention.new_parameters(side=attention.tail_side(50257))

    class Shared:
        value = lm_score._small(classes)

    made = [[b.column(1).to_pylist() for b in lm_score._trainer(Shared, p, 0, kind)([rows])] for kind, rows in (("<u4", wide), ("<u2", narrow))]
    assert made[0] == made[1]
