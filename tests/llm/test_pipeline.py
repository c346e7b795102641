import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "secret_scan", "packing"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": ["ka", "mo", "tu", "ri", "sa", "le"], "bb": ["sch", "ung", "ver", "ü", "ber", "ein"]}


def table(spark):
    rng = np.random.default_rng(9)

    def prose(lang, n):
        return " ".join("".join(rng.choice(SYLLABLES[lang], int(rng.integers(2, 6)))) for _ in range(n))

    rows = [(i, "\n".join(prose("ab"[i % 2] * 2, 30) for _ in range(4)), "ab"[i % 2] * 2) for i in range(60)]
    passage = prose("aa", 60)
    words = rows[0][1].split()
    rows += [
        (100, None, "aa"), (101, "123 456", "aa"), (102, rows[3][1], "bb"), (103, rows[5][1] + "\n" + prose("bb", 20), "bb"),
        (104, prose("aa", 40) + "\n" + passage, "aa"), (105, prose("aa", 40) + "\n" + passage + "\n" + prose("aa", 35), "aa"),
        (106, prose("aa", 200) + ' password = "hunter2hunter2" ' + prose("aa", 30), "aa"),
        (107, " ".join(words), "aa"), (108, " ".join(words[:-1] + ["other"]), "aa"),
    ]
    return rows, spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)


def test_stages(spark):
    rows, docs = table(spark)
    by = {i: t for i, t, _ in rows}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, DATA)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(by) - {100, 101}
    two = stages["line_dedup"](spark, docs, DATA)
    got = {r.doc_id: (r.text, r.n_chars) for r in two.collect()}
    assert two.columns == docs.columns and set(got) == set(by) - {102}
    assert got[103][0] == by[103].split("\n")[-1] and got[103][1] == len(got[103][0])
    lines = by[105].split("\n")
    assert got[104][0] == by[104] and got[105][0] == "\n".join([lines[0], lines[2]])
    assert all(got[i][0] == by[i] for i in range(60))
    three = stages["simhash_near_dedup"](spark, docs.where("doc_id not in (101)"), DATA)
    kept = {r.doc_id for r in three.collect()}
    assert 102 not in kept and 0 in kept and 107 not in kept and set(range(60)) <= kept
    four = stages["secret_scan"](spark, docs, DATA)
    found = {r.doc_id: (r.text, r.n_chars) for r in four.collect()}
    assert set(found) == set(by) and "hunter2" not in found[106][0] and found[106][1] == len(found[106][0])
    assert all(found[i][0] == t for i, t in by.items() if i != 106)
    five = stages["packing"](spark, docs, DATA)
    assert five.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="tables not present")
def test_whole_run(spark):
    pieces = corpus_pipeline.run(spark, DATA).select("doc_id", "start", "length", "doc_tokens").collect()
    length = defaultdict(int)
    for r in pieces:
        length[r.doc_id, r.doc_tokens] += r.length
    assert length and all(n == tokens for (_, tokens), n in length.items())


def test_extra_columns_and_nulls(spark):
    rows = [(None, None, None, None, None), (1, "kamo tuka", None, None, None), (None, "mole rika sa", "aa", None, 3), (None, "mole rika sa", "aa", None, 3), (2, "schung ver token = abcdefgh", "bb", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("odd.name", "h", "fp", "spans", "score", "pos", "kept_id", "scan_key", "ld_h", "group", "component_id"):
        docs = docs.withColumn(name, F.lit(1))
    want = dict(zip([n for n, _ in corpus_pipeline.STAGES], [4, 5, 4, 5]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() == want[name], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= 5


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == 0
