import hashlib
import random

import numpy as np
import pytest

from tabloom.llm.substring_dedup import remove_repeated, window_hashes


def brute(docs, words):
    """(words, removed, kept) of each row by comparing all windows; equal (id, text) rows are one document."""
    order = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    split = {d: [w.decode() for w in (d[1] or "").encode().split()] for d in order}
    seen, gone = set(), {d: set() for d in order}
    for d in order:
        ws = split[d]
        for a in range(len(ws) - words + 1):
            w = tuple(ws[a : a + words])
            if w in seen:
                gone[d].update(range(a, a + words))
            seen.add(w)
    return {d: (len(split[d]), len(gone[d]), " ".join(w for k, w in enumerate(split[d]) if k not in gone[d])) for d in order}


def corpus():
    rnd = random.Random(4)
    pool = ["".join(rnd.choice("abcdé") for _ in range(3)) for _ in range(300)]

    def prose(n):
        return [rnd.choice(pool) for _ in range(n)]

    passage = prose(70)
    docs = []
    for i in range(120):
        ws = prose(rnd.choice([0, 3, 19, 20, 21, 60, 150]))
        if i % 3 == 0:
            at, a = rnd.randint(0, len(ws)), rnd.randint(0, 30)
            ws[at:at] = passage[a : a + rnd.randint(10, 40)]
        docs.append((i, " ".join(ws)))
    docs += [(200 + i, docs[5][1] + " " + docs[6][1]) for i in range(40)]  # exact copies
    docs += [(300, " ".join(prose(7) * 12)), (301, "\t".join(passage) + "\n" + " ".join(passage)), (302, "ha " * 100)]
    docs += [(303, None), (304, ""), (305, " \n"), (306, "a\x1cb\x85c " * 30), (None, docs[9][1]), (306, "a\x1cb\x85c " * 30)]
    return docs + [(400, " ".join(prose(30000) + passage))]


@pytest.mark.parametrize("words", [20, 7])
def test_equals_brute_force(spark, words):
    docs = corpus()
    frame = spark.createDataFrame([(t, i, 1, "x") for i, t in docs], "text string, doc_id long, content int, own string").repartition(6)
    got = remove_repeated(frame, words=words, with_text=True).collect()
    want = brute(docs, words)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted((str(d[0]), *want[d]) for d in docs)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in got)
    assert sum(r.n_removed for r in got) > 1000


def test_many_partitions_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = [(1, text)] * 40 + [(2, text)] * 3 + [(3, "x " + text), (3, text + " y")]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {(r.doc_id, r.n_words, r.n_removed) for r in remove_repeated(spark.createDataFrame(docs, "doc_id long, text string").repartition(30)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {(1, 50, 0), (2, 50, 50), (3, 51, 50)}
    assert remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_window_hashes():
    h = np.arange(1, 60, dtype=np.uint64)
    for n in (1, 2, 3, 7, 10, 20, 33):
        w = window_hashes(np.tile(h, 2), n)
        assert len(w) == 2 * len(h) - n + 1
        assert (w[: len(h) - n + 1] == w[len(h) : 2 * len(h) - n + 1]).all() and len(np.unique(w)) == len(h)
    assert len(window_hashes(h, 100)) == 0
