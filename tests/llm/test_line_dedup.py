import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabloom.llm.line_dedup import drop_repeated_lines


def brute(docs, least):
    """Numbers of deleted lines of each document: all lines of later copies of runs that weigh enough."""
    order = sorted(docs, key=lambda d: d[0])
    lines = {i: t.split("\n") for i, t in order if t is not None}
    seen, gone = defaultdict(list), defaultdict(set)
    for i, ls in lines.items():
        for a in range(len(ls)):
            weight = 0
            for b in range(a, len(ls)):
                weight += max(1, len(ls[b].split()))
                if weight >= least:
                    seen["\n".join(ls[a : b + 1]), b - a].append((i, a, b))
    for places in seen.values():
        for i, a, b in places[1:]:
            gone[i].update(range(a, b + 1))
    return {i: sorted(gone[i]) for i, _ in order}, {i: None if t is None else "\n".join(x for n, x in enumerate(lines[i]) if n not in gone[i]) for i, t in order}


def corpus():
    rnd = random.Random(8)
    pool = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.choice([0, 1, 2, 3, 5, 12]))) for _ in range(14)]
    docs = []
    for i in range(60):
        ls = [rnd.choice(pool) if rnd.random() < 0.6 else f"own line {i} {k} of this text" for k in range(rnd.randint(1, 14))]
        docs.append((i, "\n".join(ls)))
    run = "\n".join(f"passage line {k} here" for k in range(20))
    docs += [(100, run), (101, "before\n" + run + "\nafter"), (102, run + "\n" + run), (103, "ha\n" * 30), (104, None), (105, ""), (106, "\n\n")]
    return docs + [(200 + i, "one very common line that stands in very many texts") for i in range(150)]


@pytest.mark.parametrize("least", [1, 4, 10])
def test_equals_brute_force(spark, least):
    docs = corpus()
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, h int, ld_h int").repartition(5)
    out = drop_repeated_lines(frame, min_words=least, removed="removed", n_lines="n_lines")
    assert out.columns == ["doc_id", "text", "h", "ld_h", "removed", "n_lines"]
    got = {r.doc_id: (r.removed, r.text) for r in out.collect()}
    removed, texts = brute(docs, least)
    assert got == {i: (removed[i], texts[i]) for i, _ in docs}
    assert sum(map(len, removed.values())) > 100


def test_null_ids_repeats_and_empty(spark):
    line = "a line of more than ten words that stands in all of these texts"
    docs = spark.createDataFrame([(None, line), (None, line), (1, line + "\nx"), (1, line), (2, line), (2, line)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in drop_repeated_lines(docs).collect())
    assert got == [(0, line), (0, line), (1, ""), (1, "x"), (2, ""), (2, "")]
    assert drop_repeated_lines(docs.limit(0)).count() == 0


def test_main_path_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string").withColumn("text", F.concat("text", F.lit("")))
    plan = drop_repeated_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
