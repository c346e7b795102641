"""Repeated runs of lines, by a suffix array over line ids; DataFrame functions only.

The documents in order of their ids are one sequence of lines; a suffix ends with its document.  A run
of lines that occurs earlier, too, is a later copy, and if it weighs at least ``min_words`` its lines are
deleted.  A line weighs its words, at least 1, so a long run of short or blank lines counts as well.

Prefix doubling sorts the suffixes by their first 1, 2, 4, ... lines: a suffix's rank at one step and
the rank of the suffix that many lines on give the next rank.  Ranks come from ordering the distinct
pairs by range partitions, so they keep the order of the suffixes over all partitions, and equal ranks
are neighbours in the suffix array.  A suffix whose next lines occur nowhere else drops out, so the
sequence shrinks to its repeated parts after the first step.

Suffixes that share their first m lines are an interval of the suffix array whose longest common prefix
is at least m lines; all but its smallest position start a later copy.  For each suffix the interval of
the shortest m that reaches the weight is looked up (by the two ranks that cover m lines), and likewise
the interval of the shortest run that ends at each line.  A line of a maximal repeated run that weighs
enough lies in one of these shortest runs inside it: go back from the line until the weight is reached,
or to the run's start and then forward.  So the deleted lines are exactly those of all later copies of
all maximal repeated runs of that weight, and doubling may stop at ``min_words`` lines, however long the
runs are.

A line or run that stands in a third of all documents is one row after the first aggregation, and is
broadcast to its places, as are all runs of more than a thousandth of the places.

Edge cases: a null text stays null; an empty text is one blank line; rows that repeat a document id and
its text are one document to the sequence and get the same result; rows of equal ids and different texts
are ordered by a hash of the text; null ids come first; an empty table gives an empty result.  All input
columns are handed on, own columns get names that no input column has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import SPACES, all_columns, skewed_join, written

MIN_WORDS = 10


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, line_no, id1, id2, weight) of every line; two hashes name a line."""
    exploded = docs.select("doc_id", "h", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    words = F.regexp_count("line", F.lit(f"[^{SPACES}]+"))
    return exploded.select(
        "doc_id", "h", "line_no",
        F.xxhash64("line").alias("id1"), F.xxhash64(F.lit(1), "line").alias("id2"),
        F.greatest(F.lit(1), words).cast("long").alias("weight"),
    )


def _sequence(docs: DataFrame, min_words: int) -> DataFrame:
    """All lines in order: (pos, past, doc_id, h, line_no, id1, id2, ahead, back).

    ``pos`` grows by one from line to line of a document, ``past`` is the first position beyond it.
    ``ahead`` is the number of lines from here on that reach the weight, ``back`` the number up to here;
    null if the document is too short.  Documents are dealt out by ranges, none is cut, and all windows
    keep that partitioning.
    """
    dealt = _lines(docs).repartitionByRange("doc_id", "h").dropDuplicates(["doc_id", "h", "line_no"])
    doc = Window.partitionBy("doc_id", "h")
    run = dealt.withColumn("upto", F.sum("weight").over(doc.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("before", F.col("upto") - F.col("weight"))
    whole = doc.orderBy("upto").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = run.withColumns(
        {
            "n_lines": F.count("*").over(whole),
            "total": F.max("upto").over(whole),
            "back": F.count("*").over(doc.orderBy("upto").rangeBetween(1 - min_words, 0)),
        }
    ).withColumn("ahead", F.count("*").over(doc.orderBy("before").rangeBetween(0, min_words - 1)))
    ordered = run.sortWithinPartitions("doc_id", "h", "line_no").withColumn("pos", F.monotonically_increasing_id())
    return written(
        ordered.select(
            "pos", (F.col("pos") - F.col("line_no") + F.col("n_lines")).alias("past"), "doc_id", "h", "line_no", "id1", "id2",
            F.when(F.col("total") - F.col("before") >= min_words, F.col("ahead")).alias("ahead"),
            F.when(F.col("upto") >= min_words, F.col("back")).alias("back"),
        ),
        "lines",
    )


def _ranked(places: DataFrame, keys: list[str]) -> DataFrame:
    """(pos, past, rank) of the places whose keys occur more than once; ranks follow the order of the keys."""
    repeated = places.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    ranks = repeated.orderBy(*keys).select(*[F.col(k).alias(f"{k}_of") for k in keys], F.monotonically_increasing_id().alias("rank"), "n")
    ranks = written(ranks, "ranks")  # numbered once: all readers must see the same ranks
    return written(skewed_join(places, ranks, {k: f"{k}_of" for k in keys}, "n").select("pos", "past", "rank"), "ranked")


def suffix_ranks(lines: DataFrame, steps: int) -> list[DataFrame]:
    """Ranks of the suffixes by their first 1, 2, 4, ... lines, as far as these occur more than once."""
    ranks = [_ranked(lines.select("pos", "past", "id1", "id2"), ["id1", "id2"])]
    for step in range(steps):
        size = 1 << step
        here = ranks[-1].where(F.col("pos") + 2 * size <= F.col("past")).withColumnRenamed("rank", "rank1")
        on = ranks[-1].select((F.col("pos") - size).alias("at"), F.col("rank").alias("rank2"))
        pairs = written(here.join(on, F.col("pos") == F.col("at")).select("pos", "past", "rank1", "rank2"), "pairs")
        ranks.append(_ranked(pairs, ["rank1", "rank2"]))
    return ranks


def _later_copies(runs: DataFrame, ranks: DataFrame, size: int) -> DataFrame:
    """(pos, n) of the runs that start a later copy; ``runs`` have ``size`` to 2 * ``size`` - 1 lines."""
    first = ranks.select("pos", F.col("rank").alias("rank1"))
    second = ranks.select((F.col("pos")).alias("at"), F.col("rank").alias("rank2"))
    covered = runs.join(first, "pos").withColumn("tail", F.col("pos") + F.col("n") - size)
    covered = written(covered.join(second, F.col("tail") == F.col("at")).select("pos", "n", "rank1", "rank2"), "runs")
    interval = covered.groupBy("n", "rank1", "rank2").agg(F.min("pos").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    interval = interval.select(F.col("n").alias("n_of"), F.col("rank1").alias("rank1_of"), F.col("rank2").alias("rank2_of"), "first", "copies")
    joined = skewed_join(covered, written(interval, "intervals"), {"n": "n_of", "rank1": "rank1_of", "rank2": "rank2_of"}, "copies")
    return joined.where(F.col("pos") > F.col("first")).select("pos", "n")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, removed): the numbers of the lines to delete, for documents that have any.

    ``docs`` has ``doc_id``, ``h`` (hash of the text) and ``text``.
    """
    lines = _sequence(docs, min_words)
    ranks = suffix_ranks(lines, min_words.bit_length() - 1)
    ahead = lines.where("ahead is not null").select("pos", F.col("ahead").alias("n"))
    back = lines.where("back is not null").select((F.col("pos") - F.col("back") + 1).alias("pos"), F.col("back").alias("n"))
    runs = ahead.union(back)
    copies = []
    for step, rank in enumerate(ranks):
        size = 1 << step
        of_size = runs.where(F.col("n").between(size, 2 * size - 1)).distinct()
        copies.append(_later_copies(of_size, rank, size))
    deleted = reduce(DataFrame.union, copies).select(F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("gone")).distinct()
    places = lines.select("pos", F.col("doc_id"), F.col("h"), "line_no")
    return places.join(deleted, F.col("pos") == F.col("gone")).groupBy("doc_id", "h").agg(F.collect_list("line_no").alias("removed"))


def _free_prefix(docs: DataFrame) -> str:
    prefix = "ld"
    while any(c.lower().startswith(f"{prefix}_") for c in docs.columns):
        prefix += "x"
    return prefix


def drop_repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, removed: str | None = None, n_lines: str | None = None
) -> DataFrame:
    """All rows and columns of ``docs``; ``text`` loses its lines that are later copies.

    ``removed`` names a new column for the sorted numbers of the deleted lines, ``n_lines`` one for the
    number of lines before.  A text that loses all its lines becomes empty.
    """
    prefix = _free_prefix(docs)
    names = {n: f"{prefix}_{n}" for n in ("doc", "h", "gone", "lines", "kept")}
    keyed = docs.withColumn(names["h"], F.xxhash64(text))
    narrow = keyed.select(F.col(doc_id).alias("doc_id"), F.col(names["h"]).alias("h"), F.col(text).alias("text"))
    found = repeated_lines(narrow, min_words).select(F.col("doc_id").alias(names["doc"]), F.col("h").alias(f"{names['h']}_of"), F.col("removed").alias(names["gone"]))
    same = F.col(doc_id).eqNullSafe(F.col(names["doc"])) & (F.col(names["h"]) == F.col(f"{names['h']}_of"))
    joined = keyed.join(found, same, "left").withColumn(names["lines"], F.split(F.col(text), "\n", -1))
    lines, gone = F.col(names["lines"]), F.col(names["gone"])
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    clean = F.when(gone.isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    more = {}
    if removed:
        more[removed] = F.coalesce(F.array_sort(gone), F.array().cast("array<int>"))
    if n_lines:
        more[n_lines] = F.when(lines.isNull(), F.lit(0)).otherwise(F.size(lines))
    return joined.select(*[clean.alias(n) if n == text else c for n, c in zip(docs.columns, all_columns(docs))], *[v.alias(k) for k, v in more.items()])
