"""TF-IDF similarity, duplicate detection, record matching and entity resolution.

Equal texts are collapsed to one representative with a copy count before anything is compared, so a
text repeated in a third of the table costs one vector.  Pairs come from an exact prefix filter: with
unit vectors and terms in a fixed order (rarest first), two vectors above the threshold must share a
term in the part of each vector that precedes a tail of norm <= threshold.  Only those terms are
joined, long posting lists in salted blocks; pairs whose bound stays below the threshold are dropped
and every other candidate is scored exactly.

With few terms (``max_features``) a share of all pairs is similar at any size; then the pairs, the number of
links and the components come from products of dense blocks, see blocks.py.  The pairs themselves come from
there for any number of terms, unless a key repeats.

Duplicates, matches and entities need the components and whether an earlier text is similar, not the
pairs.  With many terms each text is first compared with the first holders of its rarest shared terms,
which ties a group of near copies together by one link a text.  Then blocks of posting lists are compared
inside tasks, and a pair leaves its task only if it can still join two groups or mark a text that no
earlier one has marked.  So the rows that are written grow with the texts, not with the square of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.columns import as_list, join_on, numeric_cols, text_cols
from tabloom.functions import patterns as P
from tabloom.functions import scalars as X
from tabloom.operators.blocks import DENSE_TERMS, folded_rows, joining_links, link_numbers, linked_pairs, text_rows
from tabloom.operators.graph import component_of, connected_components
from tabloom.operators.ordered import row_index
from tabloom.operators.profile import iqr_table, pct
from tabloom.session import cut_lineage, saved

TOKEN = r"[\p{L}\p{N}_]{2,}"
POSTING_BLOCK = 2_000
TAIL = 0.9
#: How many first holders of rare terms a text is compared with before the join.
LEADERS = 3


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def terms_column(text: Column, ngram=(1, 1), stop=()) -> Column:
    """Lower-case tokens of at least two word characters, without stop words, as n-grams."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    if stop:
        known = F.array(*[F.lit(w) for w in stop])
        words = F.filter(words, lambda w: ~F.array_contains(known, w))
    lists = [words if n == 1 else X.ngrams(words, n) for n in range(ngram[0], ngram[1] + 1)]
    return lists[0] if len(lists) == 1 else F.concat(*lists)


def counted_terms(rows: DataFrame, terms: Column, count: str) -> DataFrame:
    """(all columns, term, count): the distinct terms of each row's array, by the runs of the sorted array."""
    at = rows.withColumn("_s", F.sort_array(terms))
    runs = F.filter(F.transform("_s", lambda t, i: F.when((i == 0) | (t != F.get("_s", i - 1)), i)), lambda i: i.isNotNull())
    at = at.withColumn("_at", runs)

    def run(i, k):
        return F.struct(F.get("_s", i).alias("term"), (F.coalesce(F.get("_at", k + 1), F.size("_s")) - i).cast("long").alias(count))

    # the outer form has no condition on the array, which would be made a second time for it
    return at.select(*rows.columns, F.inline_outer(F.transform("_at", run))).where(F.col("term").isNotNull())


def _single_keys(df: DataFrame, key: str) -> bool:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").isEmpty()


def tokenize(df: DataFrame, key: str, text: str, ngram=(1, 1), stop=(), keep=(), single: bool | None = None) -> DataFrame:
    """(key, term, tf): how often each term occurs in each text, with the columns ``keep`` of the text.

    Terms are counted within their row, so no term is shuffled; only if a key repeats are its rows summed.
    ``single`` tells that no key does, if that is known.
    """
    keep = list(keep)
    counted = counted_terms(df.select(key, *keep, text), terms_column(F.col(text), ngram, stop), "tf").drop(text)
    if _single_keys(df, key) if single is None else single:
        return counted.select(key, "term", "tf", *keep)
    sums = counted.groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    return sums.join(df.select(key, *keep), key) if keep else sums


def _weighted(tf: DataFrame, key: str, n: int, max_features: int | None, numbered: bool = False) -> DataFrame:
    """(key, term, weight) with unit rows, and what the weight is made of, from (key, term, tf, copies).

    ``numbered``: a number stands for each term.
    """
    stats = tf.groupBy("term").agg(F.sum(F.col("tf") * F.col("copies")).alias("_total"), F.sum("copies").alias("df"))
    if max_features is not None:
        stats = stats.orderBy(F.desc("_total"), "term").limit(max_features)
    if max_features is not None and max_features <= DENSE_TERMS:
        # so the texts stay where they are and only the terms that are kept move on
        stats = F.broadcast(saved(stats))
    elif numbered:
        # from the most frequent on
        stats = saved(row_index(stats, [F.desc("df"), "term"], name="_no"))
        tf = tf.join(stats.select("term", "_no", "df"), "term").drop("term").withColumnRenamed("_no", "term")
        stats = None
    # ties and order of terms matter later, so the document frequency stays on the row
    known = tf if stats is None else tf.join(stats.drop("_total"), "term")
    scored = known.withColumn("idf", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).withColumn("_w", F.col("tf") * F.col("idf"))
    # a window over one text's own terms: bounded by the text
    scored = scored.withColumn("norm", F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key))))
    return scored.select(key, "term", "df", "tf", "idf", "norm", (F.col("_w") / F.col("norm")).alias("weight"))


def tfidf(df: DataFrame, key: str, text: str, ngram=(1, 1), stop=(), max_features: int | None = None) -> DataFrame:
    tf = tokenize(df, key, text, ngram, stop).withColumn("copies", F.lit(1))
    return _weighted(tf, key, df.count(), max_features).select(key, "term", "weight")


class TextGroups:
    """Representatives of equal texts and their unit vectors."""

    def __init__(self, df: DataFrame, key: str, text: Column, ngram, stop, max_features):
        hashed = df.select(F.col(key).alias("id"), text.alias("_text")).withColumn("_h", F.sha2(F.coalesce("_text", F.lit("")), 256))
        reps = hashed.groupBy("_h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        self.n = df.count()
        # row -> representative
        self.members = hashed.select("id", "_h").join(reps, "_h").select("id", "rep", "copies")
        texts = hashed.join(reps.select(F.col("rep").alias("id"), "copies"), "id").select(F.col("id").alias("rep"), "_text", "copies")
        single = _single_keys(texts, "rep")
        tf = tokenize(texts, "rep", "_text", ngram, stop, keep=["copies"], single=single)
        vectors = _weighted(tf, "rep", self.n, max_features, numbered=True)
        #: Few enough terms for products of dense blocks, and unit vectors: those of a key that repeats aren't.
        self.single = single
        self.dense = single and max_features is not None and max_features <= DENSE_TERMS
        self.vectors = saved(vectors if self.dense else vectors.select("rep", "term", "df", "tf", "norm", "weight"))

    def whole(self) -> DataFrame:
        """One row a text for the products of blocks: numbered in the order of the keys, with ``key`` and ``copies``."""
        nodes = self.members.where("id = rep").select("rep", "copies").orderBy("rep").withColumn("node", F.monotonically_increasing_id())
        vectors = (text_rows if self.dense else folded_rows)(self.vectors)
        return saved(vectors.join(saved(nodes), "rep").withColumnsRenamed({"rep": "key", "node": "rep"}))

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """For each document frequency, from the largest on, the first number of its terms and the second factor of their weights."""
        # a term's rows have the same frequency, and the frequencies are few beside the terms
        rows = self.vectors.groupBy("df").agg(F.min("term").alias("first")).orderBy("first").collect()
        return np.array([r["first"] for r in rows], np.int64), np.log((1 + self.n) / (1 + np.array([r["df"] for r in rows], float))) + 1

    def numbered(self) -> tuple[DataFrame, DataFrame]:
        """(rep, node): texts numbered in the order of their keys; the vectors with that number as ``rep``, if dense one row a text."""
        nodes = self.vectors.select("rep").distinct().orderBy("rep").withColumn("node", F.monotonically_increasing_id())
        nodes = saved(nodes)
        # whole texts lie together in the saved vectors, so only their lists move
        vectors = text_rows(self.vectors) if self.dense else self.vectors
        return nodes, saved(vectors.join(nodes, "rep").drop("rep").withColumnRenamed("node", "rep"))


def _prefix(vectors: DataFrame, threshold: float) -> DataFrame:
    """The terms that are joined: (rep, term, weight, before, after), and in ``_len`` how many texts join by the term.

    A vector's terms run from rare to frequent; terms whose tail norm is at most ``TAIL * threshold`` are
    left out.  ``before`` and ``after`` are the norms of the terms on either side.
    """
    w = F.col("weight")
    upto = Window.partitionBy("rep").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    prefix = (
        vectors.withColumn("_tail", F.sum(w * w).over(upto))
        .where(F.col("_tail") > (TAIL * threshold) ** 2 - 1e-9)
        .select(
            "rep", "term", "weight",
            F.sqrt(F.greatest(1 - F.col("_tail"), F.lit(0.0))).alias("before"),
            F.sqrt(F.greatest(F.col("_tail") - w * w, F.lit(0.0))).alias("after"),
        )
    )
    prefix = saved(prefix)
    lengths = prefix.groupBy("term").agg(F.count(F.lit(1)).alias("_len"), F.min("rep").alias("_first")).where(F.col("_len") > 1)
    return prefix.join(lengths, "term")


def _in_blocks(prefix: DataFrame) -> DataFrame:
    """A long posting list is cut into blocks; ``_own`` is a row's block, ``_b`` the number of blocks."""
    return prefix.withColumn("_b", F.ceil(F.col("_len") / POSTING_BLOCK).cast("int")).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_b")).cast("int"))


def _bounded(shared: DataFrame, threshold: float) -> DataFrame:
    """After the last joined term of a pair the rest of the product is at most the product of the two tail
    norms, so pairs whose partial product plus that bound stays below the threshold are dropped."""
    bounds = shared.groupBy("id_1", "id_2").agg(F.sum("part").alias("_part"), F.min("rest").alias("_rest"))
    return bounds.where(F.col("_part") + F.col("_rest") > threshold - 1e-9).select("id_1", "id_2")


def _candidates(vectors: DataFrame, threshold: float) -> DataFrame:
    """Pairs of representatives that may exceed the threshold; every pair that does is among them."""
    posted = _in_blocks(saved(_prefix(vectors, threshold)))
    # each pair of blocks is its own join key
    others = F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    left = posted.select(F.col("rep").alias("id_1"), "term", "_own", others.alias("_other"), F.col("weight").alias("w1"), F.col("after").alias("a1"))
    right = posted.select(F.col("rep").alias("id_2"), "term", F.col("_own").alias("_other"), others.alias("_own"), F.col("weight").alias("w2"), F.col("after").alias("a2"))
    shared = left.join(right, ["term", "_own", "_other"]).where(F.col("id_1") < F.col("id_2"))
    return _bounded(shared.select("id_1", "id_2", (F.col("w1") * F.col("w2")).alias("part"), (F.col("a1") * F.col("a2")).alias("rest")), threshold)


def _leader_links(prefix: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(id_1, id_2): links of texts with the first holder of one of their ``LEADERS`` rarest shared terms."""
    held = prefix.where(F.col("_first") != F.col("rep")).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("_len", "term", "_first"))).alias("l"))
    pairs = held.select(F.explode(F.array_distinct(F.slice("l._first", 1, LEADERS))).alias("id_1"), F.col("rep").alias("id_2"))
    return _scored(pairs, vectors).where(F.col("similarity") > threshold).select("id_1", "id_2")


_SHARED = pa.schema([("id_1", pa.int64()), ("id_2", pa.int64()), ("part", pa.float64()), ("rest", pa.float64())])


def _telling_pairs(threshold: float):
    """Rows in the order of (term, low, high): pairs of two blocks that can still tell something."""

    def compare(low: int, high: int, columns) -> pa.RecordBatch:
        own, rep, group, marked, weight, before, after = columns
        i, j = np.flatnonzero(own == low), np.flatnonzero(own == high)
        later = np.where(rep[i][:, None] < rep[j][None, :], marked[j][None, :], marked[i][:, None])
        telling = (group[i][:, None] != group[j][None, :]) | ~later
        bound = np.outer(before[i], before[j]) + np.outer(weight[i], weight[j]) + np.outer(after[i], after[j])
        telling &= bound > threshold - 1e-9
        a, b = np.nonzero(np.triu(telling, 1) if low == high else telling)
        a, b = i[a], j[b]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(rep[a], rep[b])), pa.array(np.maximum(rep[a], rep[b])), pa.array(weight[a] * weight[b]), pa.array(after[a] * after[b])], schema=_SHARED
        )

    def run(batches):
        at, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            terms = batch.column(0).to_pylist()
            low, high, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
            same = np.array([a == b for a, b in zip(terms[1:], terms)], bool)
            starts = np.flatnonzero(np.append(True, ~same | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
            for start, end in zip(starts, np.append(starts[1:], len(terms))):
                key = (terms[start], low[start], high[start])
                if key != at:
                    if held:
                        yield compare(at[1], at[2], [np.concatenate(c) for c in zip(*held)])
                    at, held = key, []
                held.append([c[start:end] for c in columns])
        if held:
            yield compare(at[1], at[2], [np.concatenate(c) for c in zip(*held)])

    return run


def group_links(vectors: DataFrame, threshold: float) -> DataFrame:
    """(id_1 < id_2): links between texts numbered by ``rep`` (long), enough to tell their components and
    which texts have a similar one before them."""
    prefix = saved(_prefix(vectors, threshold))
    led = saved(_leader_links(prefix, vectors, threshold))
    first = led.groupBy(F.col("id_2").alias("rep")).agg(F.min("id_1").alias("leader"))
    further = first.select(F.col("rep").alias("leader"), F.col("leader").alias("further"))
    known = first.join(further, "leader", "left").select("rep", F.coalesce("further", "leader").alias("group"))
    posted = _in_blocks(prefix).join(known, "rep", "left").withColumn("marked", F.col("group").isNotNull())
    other = F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    keys = ["term", "low", "high"]
    dealt = posted.withColumn("_other", other).select(
        "term", F.least("_own", "_other").alias("low"), F.greatest("_own", "_other").alias("high"),
        "_own", "rep", F.coalesce("group", "rep").alias("group"), "marked", "weight", "before", "after",
    )
    shared = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_telling_pairs(threshold), "id_1 long, id_2 long, part double, rest double")
    links = _scored(_bounded(shared, threshold), vectors).where(F.col("similarity") > threshold)
    return led.union(links.select("id_1", "id_2")).distinct()


def _scored(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Exact cosine of each pair from the terms both vectors hold."""
    a = vectors.select(F.col("rep").alias("id_1"), "term", F.col("weight").alias("w1"))
    b = vectors.select(F.col("rep").alias("id_2"), "term", F.col("weight").alias("w2"))
    both = pairs.join(a, "id_1").join(b, ["id_2", "term"])
    return both.groupBy("id_1", "id_2").agg(F.sum(F.col("w1") * F.col("w2")).alias("similarity"))


def group_pairs(groups: TextGroups, threshold: float) -> DataFrame:
    return _scored(_candidates(groups.vectors, threshold), groups.vectors).where(F.col("similarity") > threshold)


def similar_pairs(df: DataFrame, key: str, text, threshold: float = 0.8, ngram=(1, 1), stop=(), max_features: int | None = None) -> DataFrame:
    """Pairs of distinct texts with cosine above the threshold: (id_1 < id_2, similarity, copies_1, copies_2).

    Equal texts are one entry, named by their smallest key, with the number of copies.
    """
    groups = TextGroups(df, key, F.col(text) if isinstance(text, str) else text, ngram, stop, max_features)
    if groups.single:
        return linked_pairs(groups.whole(), threshold, "key", "copies", None if groups.dense else groups.steps())
    pairs = group_pairs(groups, threshold)
    sizes = groups.members.where("id = rep").select("rep", "copies")
    for side in ("1", "2"):
        pairs = pairs.join(sizes.select(F.col("rep").alias(f"id_{side}"), F.col("copies").alias(f"copies_{side}")), f"id_{side}")
    return pairs.select("id_1", "id_2", "similarity", "copies_1", "copies_2")


def link_counts(df: DataFrame, key: str, text, threshold: float = 0.8, ngram=(1, 1), stop=(), max_features: int | None = None, high: float = 0.9) -> DataFrame:
    """Every row with the class of its text and the class's links: (key, class_id, copies, n_links, n_high).

    Equal texts are one class, named by their smallest key.  ``n_links`` counts the other classes whose
    cosine is above ``threshold``, ``n_high`` those above ``high`` as well.
    """
    groups = TextGroups(df, key, F.col(text) if isinstance(text, str) else text, ngram, stop, max_features)
    rows = _class_links(groups, *groups.numbered(), [threshold, max(threshold, high)])
    return rows.select(F.col("id").alias(key), F.col("rep").alias("class_id"), "copies", F.col("n0").alias("n_links"), F.col("n1").alias("n_high"))


def _class_links(groups: TextGroups, nodes: DataFrame, vectors: DataFrame, levels) -> DataFrame:
    """The members of the groups, and in n0, n1, ... the links of their class above each level."""
    if groups.dense:
        counts = link_numbers(vectors, levels)
    else:
        pairs = _scored(_candidates(vectors, levels[0]), vectors).where(F.col("similarity") > levels[0])
        ends = pairs.select(F.explode(F.array("id_1", "id_2")).alias("rep"), "similarity")
        counts = ends.groupBy("rep").agg(*[F.count_if(F.col("similarity") > x).alias(f"n{k}") for k, x in enumerate(levels)])
    named = nodes.join(counts.withColumnRenamed("rep", "node"), "node").drop("node")
    return groups.members.join(named, "rep", "left").withColumns({f"n{k}": F.coalesce(f"n{k}", F.lit(0)).cast("long") for k in range(len(levels))})


class _Matched:
    """Shared result of the three tools below: rows with their representative and component.

    ``later`` tells whether an earlier row is similar; not without ``earlier``, which saves most of the comparisons inside a component.
    """

    def __init__(self, df, key, text, threshold, ngram, stop, max_features, earlier=True):
        self.groups = TextGroups(df, key, text, ngram, stop, max_features)
        self.nodes, self.vectors = nodes, vectors = self.groups.numbered()
        self.links = saved(joining_links(vectors, threshold, earlier) if self.groups.dense else group_links(vectors, threshold))
        parts = connected_components(self.links)
        after = self.links.select(F.col("id_2").alias("node")).distinct().withColumn("_after", F.lit(True))
        names = nodes.select(F.col("rep").alias("component"), F.col("node").alias("_c"))
        found = parts.withColumnRenamed("component", "_c").join(names, "_c").drop("_c")
        filled = nodes.join(after, "node", "left").join(found, "node", "left").drop("node").withColumn("_filled", F.lit(True))
        rows = self.groups.members.join(filled, "rep", "left")
        # copies of a text without any known term have similarity 0, as in the pairwise definition
        copied = (F.col("copies") > 1) & F.col("_filled")
        self.rows = saved(
            rows.select(
                "id", "rep",
                F.coalesce(F.col("_after") | (copied & (F.col("id") != F.col("rep"))), F.lit(False)).alias("later"),
                F.coalesce(F.col("component").isNotNull() | copied, F.lit(False)).alias("matched"),
                F.when(F.coalesce(F.col("component").isNotNull() | copied, F.lit(False)), F.coalesce("component", "rep")).alias("component"),
            )
            .withColumns({"later": F.coalesce("later", F.col("matched") & (F.col("id") != F.col("rep"))), "matched": F.col("matched")})
        )


def _joined_text(df: DataFrame, cols) -> Column:
    return X.concat_text(text_cols(df, cols))


def detect_duplicates(df: DataFrame, key: str, cols, threshold: float = 0.8, stop=None, max_features: int | None = 1000) -> DataFrame:
    """``is_duplicate`` (an earlier row is similar) and ``duplicate_group`` (smallest key of the component, -1 if none)."""
    return _marked_duplicates(df, key, _duplicates(df, key, cols, threshold, stop, max_features))


def duplicates_and_links(df: DataFrame, key: str, cols, threshold: float = 0.8, stop=None, max_features: int | None = 1000, high: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """``detect_duplicates``, and (key, class_id, n_high): the links above ``high`` of each row's class; both from the same vectors."""
    m = _duplicates(df, key, cols, threshold, stop, max_features)
    # the filter of the sparse join takes unit vectors for granted, which those of a key that repeats aren't
    levels = [high] if m.groups.dense else [threshold, high]
    links = _class_links(m.groups, m.nodes, m.vectors, levels)
    return _marked_duplicates(df, key, m), links.select(F.col("id").alias(key), F.col("rep").alias("class_id"), F.col(f"n{len(levels) - 1}").alias("n_high"))


def _duplicates(df, key, cols, threshold, stop, max_features) -> _Matched:
    return _Matched(df, key, _joined_text(df, as_list(cols)), threshold, (1, 1), english_stop_words() if stop is None else stop, max_features)


def _marked_duplicates(df: DataFrame, key: str, m: _Matched) -> DataFrame:
    marks = m.rows.select(F.col("id").alias(key), F.col("later").alias("is_duplicate"), F.coalesce(F.col("component"), F.lit(-1).cast(df.schema[key].dataType)).alias("duplicate_group"))
    return df.join(marks, key)


def similar_components(df: DataFrame, key: str, text: str, threshold: float = 0.8, ngram=(1, 1), stop=(), max_features: int | None = None) -> DataFrame:
    """(key, component): the smallest key that a row reaches by links of similar or equal texts, else its own."""
    if _single_keys(df, key):
        m = _Matched(df, key, F.col(text), threshold, ngram, stop, max_features, earlier=False)
        return m.rows.select(F.col("id").alias(key), F.coalesce("component", "id").alias("component"))
    # the pairs between distinct texts, and every copy tied to the first of its text
    pairs = similar_pairs(df, key, text, threshold, ngram, stop, max_features)
    hashed = df.select(F.sha2(text, 256).alias("h"), F.col(key).alias("id_2"))
    first = hashed.groupBy("h").agg(F.min("id_2").alias("id_1"))
    copies = hashed.join(first, "h").where("id_1 < id_2").select("id_1", "id_2")
    known = tfidf(df, key, text, ngram, stop, max_features).select(F.col(key).alias("id_2")).distinct()
    edges = pairs.select("id_1", "id_2").union(copies.join(known, "id_2", "left_semi").select("id_1", "id_2"))
    return component_of(df.select(key), edges, key)


def duplicate_summary(marked: DataFrame, threshold: float = 0.8) -> DataFrame:
    grouped = marked.groupBy("duplicate_group").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_duplicate").alias("d"))
    return grouped.agg(
        F.sum("n").alias("total_records"),
        F.sum("d").alias("duplicates_found"),
        F.count_if(F.col("duplicate_group") != -1).alias("duplicate_groups"),
        F.sum(F.col("n") - F.col("d")).alias("clean_records"),
        F.lit(threshold).alias("similarity_threshold"),
    )


def match_records(df: DataFrame, key: str, cols, threshold: float = 0.8, max_features: int | None = 500) -> DataFrame:
    """Cleaned text columns, ``match_group`` (smallest key of the component) and ``has_matches``."""
    texts = text_cols(df, as_list(cols))
    cleaned = df.withColumns({f"{c}_cleaned": X.normalize_text(F.coalesce(F.col(c), F.lit(""))) for c in texts})
    m = _Matched(cleaned, key, X.concat_text([f"{c}_cleaned" for c in texts]), threshold, (1, 2), (), max_features, earlier=False)
    marks = m.rows.select(F.col("id").alias(key), F.coalesce("component", "id").alias("match_group"), F.col("matched").alias("has_matches"))
    return cleaned.join(marks, key)


def match_confidence(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("match_confidence", F.when(F.col("similarity") > 0.9, "High").otherwise("Medium"))


def confidence_counts(counts: DataFrame) -> DataFrame:
    """The links of ``link_counts`` by confidence: high above the higher threshold, else medium."""
    return counts.withColumns({"high_links": F.col("n_high"), "medium_links": F.col("n_links") - F.col("n_high")}).drop("n_high")


def resolve_entities(df: DataFrame, key: str, cols, threshold: float = 0.8, max_features: int | None = 1000) -> tuple[DataFrame, DataFrame]:
    """Rows with ``entity_id`` and ``entity_group_size``; canonical rows of the groups with more than one row."""
    cols = as_list(cols)
    m = _Matched(df, key, _joined_text(df, cols), threshold, (1, 2), (), max_features, earlier=False)
    ids = m.rows.select(F.col("id").alias(key), "rep", F.coalesce("component", "id").alias("entity_id"))
    sizes = ids.groupBy("entity_id").agg(F.count(F.lit(1)).alias("entity_group_size"))
    tagged = ids.join(sizes, "entity_id")
    rows = df.join(tagged.drop("rep"), key)
    return rows, _canonical(df, key, cols, tagged.where(F.col("entity_group_size") > 1), m.groups.vectors)


def _canonical(df, key, cols, tagged, vectors) -> DataFrame:
    """Most frequent text, mean number, size and mean pair similarity of each group.

    The mean over all pairs of unit vectors needs only the group's summed vector:
    (|sum|^2 - members) / (members * (members - 1)).
    """
    numbers = numeric_cols(df, cols)
    copies = tagged.groupBy("entity_id", "rep").agg(F.count(F.lit(1)).alias("c"))
    weighted = copies.join(vectors, "rep")
    summed = weighted.groupBy("entity_id", "term").agg(F.sum(F.col("c") * F.col("weight")).alias("s"))
    squares = summed.groupBy("entity_id").agg(F.sum(F.col("s") * F.col("s")).alias("_sq"))
    n = F.col("group_size")
    base = df.join(tagged, key).groupBy("entity_id").agg(F.count(F.lit(1)).alias("group_size"), *[F.avg(c).alias(c) for c in numbers])
    out = base.join(squares, "entity_id", "left").withColumn("confidence", (F.col("_sq") - n) / (n * (n - 1))).drop("_sq")
    for c in text_cols(df, cols):
        counts = df.join(tagged, key).where(F.col(c).isNotNull()).groupBy("entity_id", c).agg(F.count(F.lit(1)).alias("_c"))
        top = counts.groupBy("entity_id").agg(F.max("_c").alias("_c"))
        best = counts.join(top, ["entity_id", "_c"]).groupBy("entity_id").agg(F.min(c).alias(c))
        out = out.join(best, "entity_id", "left")
    return out


def resolution_summary(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Records, groups with more than one row, and rows in them."""
    groups = rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.sum("n").alias("total_records"),
        F.count_if(F.col("n") > 1).alias("entity_groups_found"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("records_in_groups"),
        F.lit(threshold).alias("similarity_threshold"),
    )


def _text_pattern_counts(df: DataFrame, c: str) -> DataFrame:
    t = F.col(c)
    marks = (("Email", P.EMAIL), ("Phone", P.PHONE), ("Date", P.DATE))
    row = df.where(t.isNotNull()).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(t.rlike(p)).alias(k) for k, p in marks])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("pattern_type"), F.lit(k.lower()).alias("pattern"), F.col(k).alias("matches"), pct(F.col(k), F.col("n")).alias("match_pct")) for k, _ in marks]
    return row.select(F.inline(F.array(*rows))).where(F.col("matches") > 0)


def _common_values(df: DataFrame, c: str, value: Column, k: int, share: float, kind: str, fmt: str) -> DataFrame:
    """The k most frequent values whose share of the non-null rows is above ``share``."""
    present = df.where(F.col(c).isNotNull())
    n = present.count()
    counts = present.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("matches")).orderBy(F.desc("matches"), "v").limit(k)
    kept = counts.where(F.col("matches") > F.lit(n * share))
    return kept.select(F.lit(c).alias("column_name"), F.lit(kind).alias("pattern_type"), F.format_string(fmt, F.col("v").cast("string")).alias("pattern"), "matches", pct(F.col("matches"), F.lit(n)).alias("match_pct"))


def discover_patterns(df: DataFrame, cols) -> DataFrame:
    """E-mail / phone / date shares and fixed lengths of texts; quartile band and common values of numbers."""
    cols, parts = as_list(cols), []
    for c in text_cols(df, cols):
        parts.append(_text_pattern_counts(df, c))
        parts.append(_common_values(df, c, F.length(c), 5, 0.1, "Fixed Length", "Length: %s characters"))
    numbers = numeric_cols(df, cols)
    for c, b in iqr_table(df, numbers).items():
        if b["iqr"]:
            band = df.agg(F.count_if((F.col(c) >= b["q1"]) & (F.col(c) <= b["q3"])).alias("matches"))
            label = f"IQR: {b['q1']:.2f} - {b['q3']:.2f}"
            parts.append(band.select(F.lit(c).alias("column_name"), F.lit("Interquartile Range").alias("pattern_type"), F.lit(label).alias("pattern"), "matches", F.lit(50.0).alias("match_pct")))
        parts.append(_common_values(df, c, F.col(c), 3, 0.05, "Common Value", "Value: %s"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The lattice of value patterns, from the finest level to the coarsest.
PATTERN_LEVELS = ("characters", "runs", "words", "kinds")


def _masked(text: Column) -> Column:
    """Capitals as A, other letters as a, digits as 9; all else stands for itself."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Lu}", "A"), r"\p{Ll}|\p{Lt}|\p{Lm}|\p{Lo}", "a"), r"\p{N}", "9")


def _coarser(mask: Column) -> list[Column]:
    """The mask itself, then without the lengths of runs, then without the kind of letters, then of letters and digits."""

    def runs(c, *kinds):
        for kind, name in kinds:
            c = F.regexp_replace(c, kind, name)
        return F.regexp_replace(c, " +", " ")

    runs_of = runs(mask, ("A+", "A+"), ("a+", "a+"), ("9+", "9+"))
    words = runs(mask, ("[Aa]+", "w+"), ("9+", "9+"))
    return [mask, runs_of, words, runs(mask, ("[Aa9]+", "x+"))]


def value_patterns(df: DataFrame, cols, k: int = 3, cover: float = 0.8) -> DataFrame:
    """The ``k`` most frequent patterns of each text column on each level of a lattice, from exact characters to kinds.

    Values are counted by their mask of character classes, combined in the tasks; the coarser levels are
    counted from the masks.  ``induced`` marks the first pattern, on the finest level that has one, that
    covers ``cover`` of the column's non-null values.
    """
    texts = text_cols(df, as_list(cols))
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), _masked(F.col(f"`{c}`")).alias("mask")) for c in texts])
    masks = df.select(F.inline(F.filter(cells, lambda x: x["mask"].isNotNull()))).groupBy("column_name", "mask").agg(F.count(F.lit(1)).alias("n"))
    masks = cut_lineage(masks)
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(name).alias("level_name"), c.alias("pattern")) for i, (name, c) in enumerate(zip(PATTERN_LEVELS, _coarser(F.col("mask"))))])
    found = masks.select("column_name", "n", F.inline(levels)).groupBy("column_name", "level", "level_name", "pattern").agg(F.sum("n").alias("matches"))
    sizes = masks.groupBy("column_name").agg(F.sum("n").alias("_n"))
    order = Window.partitionBy("column_name", "level").orderBy(F.desc("matches"), "pattern")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(sizes, "column_name")
    best = best.withColumn("match_pct", pct(F.col("matches"), F.col("_n")))
    covers = (F.col("rank") == 1) & (F.col("matches") >= F.col("_n") * cover)
    finest = F.min(F.when(covers, F.col("level"))).over(Window.partitionBy("column_name"))
    marked = best.withColumn("induced", F.coalesce(covers & (F.col("level") == finest), F.lit(False)))
    return marked.select("column_name", F.col("level_name").alias("level"), "rank", "pattern", "matches", "match_pct", "induced")


def pattern_columns(df: DataFrame, cols) -> DataFrame:
    """Boolean marks of e-mail, phone and date texts."""
    marks = {"email": P.EMAIL, "phone": P.PHONE, "date": P.DATE}
    return df.withColumns({f"{c}_{k}": F.coalesce(F.col(c).rlike(p), F.lit(False)) for c in text_cols(df, as_list(cols)) for k, p in marks.items()})
