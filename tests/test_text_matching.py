import random
import json
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabloom.operators import matching as M
from tabloom.operators import text as T
from tabloom.operators.graph import connected_components


def one(df):
    return df.first().asDict()


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame(
        [(1, "I love this great product"), (2, "Terrible and AWFUL"), (3, "good but bad"), (4, "Plain words"), (5, None)], "id int, text string"
    )


def test_sentiment_rules(reviews):
    got = {r["id"]: (r["sentiment"], round(r["confidence"], 2)) for r in T.sentiment(reviews, "text").collect()}
    assert got == {1: ("positive", 0.8), 2: ("negative", 0.8), 3: ("neutral", 0.5), 4: ("neutral", 0.5), 5: ("neutral", 0.5)}


def test_topics_without_hit_are_other(spark):
    df = spark.createDataFrame([("the company market",), ("zzz",), ("a movie about software",)], "text string")
    assert [(r["category"], round(r["confidence"], 1)) for r in T.classify_topics(df, "text").collect()] == [("business", 0.7), ("other", 0.5), ("technology", 0.6)]
    assert T.classify_custom(df, "text", "travel, movie").collect()[0]["category"] == "travel"


def test_entities_in_order_with_places(spark):
    text = "On 2020-01-05 Anna Bell paid $1,200.50 to Carl."
    got = [tuple(e) for e in one(T.extract_entities(spark.createDataFrame([(text,)], "text string"), "text"))["entities"]]
    assert got == [("On", "PERSON", 0, 2), ("Anna Bell", "PERSON", 14, 23), ("Carl", "PERSON", 42, 46), ("2020-01-05", "DATE", 3, 13), ("$1,200.50", "MONEY", 29, 38)]


def test_summaries(spark):
    df = spark.createDataFrame([("One sentence here. Second one is here. Third.",), ("Short",), ("",)], "text string")
    a = T.summarize(df, "text").collect()
    assert a[0]["summary"] == "One sentence here." and a[1]["summary"] == "Short" and a[2]["compression_ratio"] == 1.0
    assert T.summarize_extractive(df, "text").collect()[1]["summary"] == "Short."


def test_keywords_break_ties_by_first_position(spark):
    df = spark.createDataFrame([(1, "zebra apple zebra apple mango the the")], "id int, text string")
    got = [(r["kind"], r["rank"], r["term"], r["term_count"]) for r in T.keywords(df, "id", "text").orderBy("kind", "rank").collect()]
    assert got[:3] == [("keyword", 1, "zebra", 2), ("keyword", 2, "apple", 2), ("keyword", 3, "mango", 1)]
    assert got[3] == ("phrase", 1, "zebra apple", 2)


def test_language_votes(spark):
    df = spark.createDataFrame([("der hund und die katze",), ("the cat and the dog",), ("12 34",)], "text string")
    assert [(r["language_code"], r["confidence"]) for r in T.detect_language(df, "text").collect()] == [("de", 1.0), ("en", 1.0), ("en", 0.8)]


def test_batch_annotate_falls_back_per_batch(reviews):
    def fn(texts):
        if any("Terrible" in t for t in texts):
            raise RuntimeError
        return json.dumps([{"sentiment": "checked"}] * len(texts))

    got = T.batch_annotate(reviews.coalesce(1), "text", fn, "sentiment string", 1, T.sentiment_columns("text"))
    assert {r["id"]: r["sentiment"] for r in got.collect()} == {1: "checked", 2: "negative", 3: "checked", 4: "checked", 5: "checked"}


def components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("pairs", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(1, 2), (3, 4), (4, 5), (9, 2)], [(5, 5)]])
def test_components_of_chain_hub_and_parts(spark, pairs):
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "id_1 int, id_2 int")).collect()}
    assert got == components([p for p in pairs if p[0] != p[1]])


TEXTS = (
    ["alpha beta gamma delta"] * 6
    + ["alpha beta gamma delta epsilon", "alpha beta gamma zeta", "one two three four", "one two three five", "one two three four"]
    + ["", "", "solo words only", "x"]
)


def brute_pairs(threshold):
    docs = [Counter(re.findall(r"\w\w+", t)) for t in TEXTS]
    n, df = len(docs), Counter(w for d in docs for w in d)
    vecs = []
    for d in docs:
        v = {w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in d.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        vecs.append({w: x / size for w, x in v.items()})
    sims = {(i, j): sum(x * vecs[j].get(w, 0) for w, x in vecs[i].items()) for i in range(n) for j in range(i + 1, n)}
    return {p: s for p, s in sims.items() if s > threshold}


@pytest.mark.parametrize("threshold, block", [(0.5, 2), (0.8, 2), (0.8, 1000)])
def test_similarity_tools_equal_brute_force(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(M, "POSTING_BLOCK", block)
    want = brute_pairs(threshold)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    first = {}
    for i, t in enumerate(TEXTS):
        first.setdefault(t, i)
    pairs = M.similar_pairs(df, "id", "text", threshold).collect()
    reps = set(first.values())
    assert {(r["id_1"], r["id_2"]): round(r["similarity"], 9) for r in pairs} == {p: round(s, 9) for p, s in want.items() if set(p) <= reps and TEXTS[p[0]] != TEXTS[p[1]]}
    marked = {r["id"]: r for r in M.detect_duplicates(df, "id", ["text"], threshold, stop=(), max_features=None).collect()}
    groups = components(want)
    assert {i for i, r in marked.items() if r["is_duplicate"]} == {j for _, j in want}
    assert {i: r["duplicate_group"] for i, r in marked.items()} == {i: groups.get(i, -1) for i in range(len(TEXTS))}
    summary = one(M.duplicate_summary(df.sparkSession.createDataFrame(list(marked.values())), threshold))
    assert summary["duplicates_found"] == len({j for _, j in want}) and summary["total_records"] == len(TEXTS)


def test_links_of_near_copies_grow_with_the_texts(spark, monkeypatch):
    monkeypatch.setattr(M, "POSTING_BLOCK", 40)
    # two groups of near copies and a chain in which each text resembles only its neighbours
    base = [" ".join(f"common{g}x{i}" for i in range(120)) for g in range(2)]
    rows = [(f"k{i:05d}", f"{base[i % 2]} own{i}") for i in range(300)]
    rows += [(f"z{i:05d}", " ".join(f"step{j}" for j in range(i, i + 12))) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, text string").repartition(6)
    m = M._Matched(df, "id", F.col("text"), 0.8, (1, 1), (), None)
    assert m.links.count() < 4 * len(rows)
    got = {r["id"]: (r["is_duplicate"], r["duplicate_group"]) for r in M.detect_duplicates(df.withColumn("n", F.lit(1)), "id", ["text"], 0.8, stop=(), max_features=None).collect()}
    want = {k: (k not in ("k00000", "k00001", "z00000"), "k00000" if int(k[1:]) % 2 == 0 else "k00001") for k, _ in rows if k[0] == "k"}
    assert {k: v for k, v in got.items() if k[0] == "k"} == want
    assert {v for k, v in got.items() if k[0] == "z"} == {(False, "z00000"), (True, "z00000")}


def test_entities_have_mean_pair_similarity(spark):
    df = spark.createDataFrame([(1, "aa bb", 1.0), (2, "aa bb", 3.0), (3, "cc dd", 5.0)], "id int, name string, x double")
    rows, canon = M.resolve_entities(df, "id", ["name", "x"], 0.8)
    assert {r["id"]: (r["entity_id"], r["entity_group_size"]) for r in rows.collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 1)}
    c = one(canon)
    assert (c["group_size"], c["name"], c["x"], round(c["confidence"], 9)) == (2, "aa bb", 2.0, 1.0)


def test_patterns(spark):
    df = spark.createDataFrame([("a@b.org", 1.0), ("c@d.org", 1.0), ("none here", 2.0)], "t string, x double")
    got = {(r["column_name"], r["pattern_type"], r["matches"]) for r in M.discover_patterns(df, ["t", "x"]).collect()}
    assert ("t", "Email", 2) in got and ("t", "Fixed Length", 2) in got and ("x", "Common Value", 2) in got
    assert M.pattern_columns(df, ["t"]).where("t_email").count() == 2
    assert df.select(F.length("t")).count() == 3


def test_patterns_on_a_lattice(spark):
    rows = [(f"{100 + i}-555-{1000 + i}", n) for i, n in enumerate(["Anna Bell", "Bo Li", "Çelik Ö", None] * 5)] + [("none", "x")]
    df = spark.createDataFrame(rows, "phone string, name string").repartition(3)
    got = {(r["column_name"], r["level"], r["rank"]): r for r in M.value_patterns(df, ["phone", "name"]).collect()}
    assert (got["phone", "characters", 1]["pattern"], got["phone", "characters", 1]["matches"], got["phone", "characters", 1]["induced"]) == ("999-999-9999", 20, True)
    assert got["phone", "runs", 1]["pattern"] == "9+-9+-9+" and not got["phone", "runs", 1]["induced"]
    assert {got["name", "characters", r]["pattern"] for r in (1, 2, 3)} == {"Aaaa Aaaa", "Aa Aa", "Aaaaa A"}
    assert (got["name", "runs", 1]["pattern"], got["name", "runs", 1]["matches"]) == ("A+a+ A+a+", 10)
    assert (got["name", "words", 1]["pattern"], got["name", "words", 1]["induced"]) == ("w+ w+", True)
    assert round(got["name", "words", 1]["match_pct"], 6) == 93.75 and got["name", "kinds", 2]["pattern"] == "x+"


def test_dense_links_equal_all_pairs(spark, monkeypatch):
    from tabloom.operators import blocks as B

    monkeypatch.setattr(B, "ROWS", 7)
    monkeypatch.setattr(B, "COLUMNS", 16)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg"]) for _ in range(rng.randint(1, 9))) for _ in range(150)] + ["", None]
    df = spark.createDataFrame([(f"k{i:04d}", x) for i, x in enumerate(texts)], "id string, text string").repartition(5)
    vectors = {}
    for r in M.tfidf(df, "id", "text", max_features=6).collect():
        vectors.setdefault(r["id"], {})[r["term"]] = r["weight"]
    first = {}
    for i, x in enumerate(texts):
        first.setdefault(x or "", f"k{i:04d}")
    reps = {f"k{i:04d}": first[x or ""] for i, x in enumerate(texts)}
    cosine = lambda a, b: sum(w * vectors.get(b, {}).get(t, 0) for t, w in vectors.get(a, {}).items())
    classes = sorted(first.values())
    similar = {(a, b): s for a in classes for b in classes if a < b and (s := cosine(a, b)) > 0.8}
    counts = {r["id"]: (r["class_id"], r["n_links"], r["n_high"]) for r in M.link_counts(df, "id", "text", max_features=6).collect()}
    number = lambda x, least: sum(x in p and s > least for p, s in similar.items())
    assert similar and counts == {k: (r, number(r, 0.8), number(r, 0.9)) for k, r in reps.items()}
    # the copies of a text are similar to it unless it has no known term
    links = [*similar, *((r, k) for k, r in reps.items() if k != r and r in vectors)]
    want = components({p: 1 for p in links})
    m = M._Matched(df, "id", F.col("text"), 0.8, (1, 1), (), 6)
    assert {r["id"]: r["component"] for r in m.rows.collect() if r["matched"]} == want
    assert {r["id"] for r in m.rows.collect() if r["later"]} == {b for _, b in links}
    # what is written down grows with the texts and blocks
    assert B.joining_links(m.groups.numbered()[1], 0.8).count() < len(similar)
    sparse = {r["id"]: (r["class_id"], r["n_links"]) for r in M.link_counts(df, "id", "text").collect()}
    pairs = M.similar_pairs(df, "id", "text").collect()
    assert sparse == {k: (r, sum(r in (p["id_1"], p["id_2"]) for p in pairs)) for k, r in reps.items()}


def test_dense_texts_move_as_one_row_each(spark):
    texts = ["red fish blue", "red fish blue blue", "red", None, "blue fish", "red fish blue"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    groups = M.TextGroups(df, "id", F.col("text"), (1, 1), (), 3)
    nodes, rows = groups.numbered()
    assert rows.count() == nodes.count() == 4 and dict(rows.dtypes)["t"] == "array<smallint>"
    # the parts of a row give the weights of the vectors
    made = {}
    for r in rows.join(nodes, rows["rep"] == nodes["node"]).select(nodes["rep"], "t", "tf", "idf", "norm").collect():
        made[r["rep"]] = sorted(c * i / r["norm"] for c, i in zip(r["tf"], r["idf"]))
    want = {}
    for r in groups.vectors.collect():
        want.setdefault(r["rep"], []).append(r["weight"])
    assert made == {k: sorted(v) for k, v in want.items()}


def _plans(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_without_a_shuffle(spark):
    rows = [(1, "red fish blue fish"), (2, "red"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    terms = M.tokenize(df, "id", "text", (1, 2))
    assert "Exchange" not in _plans(terms)
    want = {(1, "red", 1), (1, "fish", 2), (1, "blue", 1), (1, "red fish", 1), (1, "fish blue", 1), (1, "blue fish", 1), (2, "red", 1)}
    assert {tuple(r) for r in terms.collect()} == want
    again = spark.createDataFrame([*rows, (2, "red red"), (None, "a1 a1"), (None, "a1")], "id int, text string")
    assert {tuple(r) for r in M.tokenize(again, "id", "text").collect()} >= {(2, "red", 3), (None, "a1", 3), (1, "fish", 2)}


def test_keywords_are_ranked_without_a_shuffle(spark):
    rows = [(1, "fish bird fish bird ant fish"), (2, None), (3, "bird fish")]
    df = spark.createDataFrame(rows, "id int, text string")
    found = T.keywords(df, "id", "text", 2, 1)
    assert "Exchange" not in _plans(found) and "Exchange" not in _plans(T.keyword_arrays(df, "id", "text"))
    words = {(r["id"], r["rank"], r["term"], r["term_count"]) for r in found.collect() if r["kind"] == "keyword"}
    assert words == {(1, 1, "fish", 3), (1, 2, "bird", 2), (3, 1, "bird", 1), (3, 2, "fish", 1)}
    assert {(r["id"], r["term"]) for r in found.collect() if r["kind"] == "phrase"} == {(1, "fish bird"), (3, "bird fish")}
    twice = spark.createDataFrame([*rows, (3, "fish ant")], "id int, text string")
    assert {(r["rank"], r["term"], r["term_count"]) for r in T.keywords(twice, "id", "text", 1, 0).collect() if r["id"] == 3} == {(1, "fish", 2)}
    assert [r["keywords"] for r in T.keyword_arrays(twice, "id", "text", 1).orderBy("id").collect()] == [["fish"], [], ["fish"], ["fish"]]


def test_metrics_read_the_results_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def note(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    results = spark.createDataFrame([("en", 0.5), ("de", 1.0), ("en", None), (None, 0.9)], "language string, confidence double").mapInPandas(note, "language string, confidence double")
    got = {r["metric"]: (r["number"], r["label"]) for r in T.nlp_metrics(results, "language_detection").collect()}
    assert got["total_texts"] == (4.0, None) and got["most_common_language"] == (None, "en") and got["unique_languages"] == (3.0, None)
    assert round(got["avg_confidence"][0], 9) == 0.8 and seen.value == 4


@pytest.mark.parametrize("name", ["similar_pairs", "similar_pairs_all_terms", "match_confidence"])
def test_similarity_queries_list_every_pair(spark, tmp_path, name):
    import duckdb

    import __spark_entry__ as entry

    rng = random.Random(3)
    words = [f"word{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 12))) for _ in range(60)]
    texts += [f"{texts[0]} extra{i}" for i in range(5)] + [texts[1], texts[1], "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    want = sorted(tuple(r) for r in res.fetchall())
    assert {"id_1", "id_2", "similarity", "copies_1", "copies_2"} <= set(names) == set(got.columns)
    assert want and sorted(tuple(r) for r in got.select(*names).collect()) == want


@pytest.mark.parametrize("folded", [False, True])
def test_tiles_of_blocks_find_all_links(monkeypatch, folded):
    import numpy as np

    from tabloom.operators import blocks as B

    monkeypatch.setattr(B, "ROWS", 16)
    monkeypatch.setattr(B, "COLUMNS", 24)
    rng = np.random.default_rng(7)
    # four kinds of texts over terms of their own, and some terms of all
    vectors = np.zeros((180, 60))
    for row in vectors:
        kind = rng.integers(4)
        row[rng.choice(np.r_[kind * 12 : kind * 12 + 12, 48:60], rng.integers(2, 8), False)] = rng.integers(1, 4)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    width = 25 if folded else 60
    column = np.arange(60) % width

    def block(at):
        sizes, terms, weights = [], [], []
        for k in at:
            own = np.flatnonzero(vectors[k]).tolist()
            sizes.append(len(own))
            terms += own
            weights += list(vectors[k][own])
        terms = np.array(terms)
        return B._Block(at, np.array(sizes), column[terms].astype("i2"), np.array(weights), width, groups, terms if folded else None)

    groups = np.zeros(width, int)
    every = block(np.arange(180))
    groups = B._Kinds(every.dense(np.arange(180)), width).groups
    dealt = rng.permutation(180)
    blocks = [block(dealt[:100]), block(dealt[100:])]
    cosine = vectors @ vectors.T
    want = {(i, j): cosine[i, j] for i in range(180) for j in range(i + 1, 180) if cosine[i, j] > 0.8}
    links, found, counted = {True: set(), False: set()}, {}, np.zeros(180, int)
    for left, right in ((0, 0), (0, 1), (1, 1)):
        a, b = blocks[left], blocks[right]
        for x, y, over in B._tiles(a, b, 0.8):
            i, j = np.nonzero(over)
            for p, q, s in zip(a.rep[x[i]], b.rep[y[j]], B._products(a, b, x[i], y[j])):
                assert (min(p, q), max(p, q)) not in found
                found[min(p, q), max(p, q)] = s
        for earlier, to in links.items():
            for batch in B._joining(earlier)(a, b, (0.8,)):
                to |= set(zip(*[c.to_pylist() for c in batch.columns]))
        for batch in B._counts(a, b, (0.8,)):
            np.add.at(counted, batch.column(0).to_numpy(), batch.column(1).to_numpy())
    assert want and set(found) == set(want) and all(abs(found[p] - s) < 1e-12 for p, s in want.items())
    assert counted.tolist() == [sum(k in p for p in want) for k in range(180)]
    for earlier, to in links.items():
        assert to <= set(want) and components(dict.fromkeys(to)) == components(want)
    assert {j for _, j in links[True]} == {j for _, j in want}
