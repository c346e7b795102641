from collections import defaultdict

from pyspark.sql import functions as F

from tabloom.llm.exact_dedup import exact_duplicates

TEXTS = ["Same", "same", "SAME", None, "", "É", "é", "x" * 300_000, "X" * 300_000, "alone", "samE "]


def frame(spark, parts=7):
    rows = [(i * 3 + r, t, "extra") for r in range(3) for i, t in enumerate(TEXTS)] + [(1000 + i, "hot", "h") for i in range(400)] + [(None, "null id", "n"), (None, "null id", "n"), (7, "Twice", "t"), (7, "twice", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(parts), rows


def norm(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def check(spark, keep, choose):
    df, rows = frame(spark)
    got = exact_duplicates(df, keep=keep, fan_in=2).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[norm(text)].append(doc_id)
    want = sorted(((i if i is not None else -1), choose([x for x in ids if x is not None]) if any(x is not None for x in ids) else -1, len(ids)) for ids in groups.values() for i in ids)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id if r.keep_id is not None else -1, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_largest_and_smallest_stay(spark):
    check(spark, "largest", max)
    check(spark, "smallest", min)


def test_digest_and_empty(spark):
    df = spark.createDataFrame([(1, "ABC é")], "doc_id long, text string")
    row = exact_duplicates(df).first()
    assert row.text_sha256 == df.select(F.sha2(F.lit("abc é"), 256)).first()[0] and row.kept
    assert exact_duplicates(df.limit(0)).count() == 0
