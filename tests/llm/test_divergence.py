import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import divergence as dv


def brute(rows, min_docs, top):
    """rows: (text, lang, source)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = (text or "").translate({k: k + 32 for k in range(65, 91)})
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = {s: counts[lang, s] for la, s in groups if la == lang}
        whole = sum(own.values(), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in own if o != s]
            more = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", more)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda f: (-f[0], f[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


def corpus():
    rnd = random.Random(3)
    words = ["Der", "der", "der,", "(der)", "x-y", "été", "ÉTÉ", "naïve.", "a1b", "a", "b", "don't", "123", "—", "日本"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for i in range(160):
        lang = rnd.choice(["en", "de", None])
        source = "hot" if rnd.random() < 0.4 else rnd.choice(["s1", "s2", "s3", "s4", None, "", "ü"])
        rows.append((" ".join(rnd.choices(words, k=rnd.choice([0, 1, 5, 40]))), lang, source))
    rows += [(None, "en", "s1"), ("", "xx", "only empty"), ("... 12", "xx", "other"), ("rare", "yy", "one"), ("word word word", "yy", "two")]
    return rows + [("der " * 5000 + "z" * 3000, "de", "long")] * 3


@pytest.mark.parametrize("portion", [1, dv.PORTION])
def test_equals_brute_force(spark, portion, monkeypatch):
    monkeypatch.setattr("tabloom.llm.common.BATCH_ROWS", 7)
    rows = corpus()
    frame = spark.createDataFrame([(*r, 5, "x") for r in rows], "text string, lang string, source string, n long, term string").repartition(5)
    got = dv.divergence(frame, top=9, portion=portion)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    want = brute(rows, dv.MIN_DOCS, 9)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[0] == "yy" and r[2] == "pair" and r[4] == 0 for r in got)


def test_empty(spark):
    assert dv.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_stay_exact(spark):
    rnd = random.Random(1)
    cases = [(c, rnd.randint(c + 1, 9 * 10**15)) for c in (rnd.randint(0, 10 ** rnd.randint(1, 15)) for _ in range(300))]
    want = [1 + 10**9 * (c + 1) // d for c, d in cases]
    assert dv.shares(*np.array(cases).T).tolist() == want
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k long, c long, d long")
    assert [r[0] for r in frame.orderBy("k").select(dv.share(F.col("c"), F.col("d"))).collect()] == want
