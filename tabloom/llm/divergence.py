"""How far the sources of each language differ in their words: an audit over all texts.

Terms are runs of letters (A-Z, a-z and everything beyond ASCII), A-Z lower-cased.  They are counted by
factors: a term never crosses white space, so documents are first taken apart into white-space chunks.

* A task counts the chunks of each of its documents and numbers the chunks that it meets.  For at most
  ``PORTION`` (document, chunk) pairs at a time it hands on, for each chunk and language, the occurrences
  in each source and the first ``min_docs`` distinct documents.
* The portions' chunks meet by a shuffle on the chunk (one row a portion and language, however frequent
  it is).  Each globally distinct chunk is cut into terms once, and its terms are joined to the counts.
* Terms are added up inside the task and then by a shuffle on language and term: occurrences add up, and
  documents in which several chunks hold the same term count once.  A union of sets that were cut off at
  ``min_docs`` documents tells exactly whether that many documents hold a term.

A term is kept in a language if at least ``min_docs`` of its documents hold it; V terms are.  A group is a
language's source, or the whole language.  A group with N occurrences of kept terms gives a term with count
c the share p = 1 + floor(10^9 (c + 1) / (N + V)), and one that measures against another's share q differs
by floor((p - q)^2 / q).  All shares are whole numbers, divided in steps of a thousand, so they are exact
as long as N + V is below 9 * 10^15.

The report: part ``pair`` has, for each source, the other sources of its language by the sum over all kept
terms; part ``term`` has the ``top`` terms that a source uses more than its language does.

Edge cases: null text, language or source count as empty; groups without terms take part in the pairs;
without kept terms all sums are 0; repeated rows are documents of their own; an empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import batched, skewed_join, written

MIN_DOCS, TOP = 3, 200
PORTION = 3_000_000
SOURCE_BLOCK = 256

_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")

#: ``at`` numbers the sources of a language; ``at`` and ``n`` belong together.
_COUNTS = [("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))]
_CHUNKS = pa.schema([("chunk", pa.binary()), ("lang", pa.int64()), *_COUNTS])
CHUNKS = "chunk binary, lang long, at array<int>, n array<long>, docs array<long>"
_TERMS = pa.schema([("term", pa.binary()), ("lang", pa.int64()), *_COUNTS])
TERMS = "term binary, lang long, at array<int>, n array<long>, docs array<long>"


def _lists(key: np.ndarray, keys: int, *values: np.ndarray) -> list[pa.Array]:
    """One list for each key from 0 on; ``key`` is sorted."""
    offsets = pa.array(np.searchsorted(key, np.arange(keys + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


def _added(keys: int, counts: tuple, docs: tuple, most: int) -> list[pa.Array]:
    """(at, n, docs) lists of each key: counts (key, at, n) added up, the first ``most`` distinct of (key, doc)."""
    key, at, n = counts
    width = int(at.max()) + 1 if len(at) else 1
    cell = key * width + at
    order = np.argsort(cell)
    cell = cell[order]
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    total = np.add.reduceat(n[order], first) if len(first) else n[:0]
    at, n = _lists(cell[first] // width, keys, (cell[first] % width).astype(np.int32), total)
    key, doc = docs
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[: len(key)]
    key, doc = key[new], doc[new]
    early = np.arange(len(key)) - np.searchsorted(key, key) < most
    return [at, n, *_lists(key[early], keys, doc[early])]


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class _Portion:
    """Chunk counts of some documents; chunks are numbered as they come."""

    def __init__(self, min_docs: int, first_doc: int):
        self.min_docs, self.next_doc = min_docs, first_doc
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, langs: np.ndarray, sources: np.ndarray, texts: list[str | None]) -> None:
        split = [(t or "").encode().split() for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        chunk = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        pairs, n = np.unique(chunk << 32 | np.repeat(np.arange(len(split)), lengths), return_counts=True)
        doc = pairs & 0xFFFFFFFF
        self.parts.append((pairs >> 32, langs[doc], sources[doc], n, doc + self.next_doc))
        self.next_doc += len(split)
        self.size += len(pairs)

    def rows(self) -> pa.RecordBatch:
        """A pair of chunk and document stands here once, so documents need no comparison."""
        chunk, lang, at, n, doc = (np.concatenate(c) for c in zip(*self.parts))
        langs, lang = np.unique(lang, return_inverse=True)
        count, width = max(len(langs), 1), int(at.max()) + 1 if len(at) else 1
        cell = (chunk * count + lang) * width + at
        order = np.argsort(cell, kind="stable")
        cell, doc = cell[order], doc[order]
        key = cell // width
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        pairs, place = key[start], np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
        total = np.add.reduceat(n[order], first) if len(first) else n
        early = np.arange(len(key)) - start[place] < self.min_docs
        counts = [*_lists(place[first], len(start), (cell[first] % width).astype(np.int32), total), *_lists(place[early], len(start), doc[early])]
        chunks = pa.array(list(self.numbers), pa.binary()).take(pa.array(pairs // count))
        self.clear()
        return pa.RecordBatch.from_arrays([chunks, pa.array(langs[pairs % count], pa.int64()), *counts], schema=_CHUNKS)


def _counter(min_docs: int, portion: int):
    def run(batches):
        held = _Portion(min_docs, TaskContext.get().partitionId() << 36)
        for batch in batches:
            held.add(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist())
            if held.size >= portion:
                yield held.rows()
        if held.parts:
            yield held.rows()

    return run


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths)."""
    return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())


def _picked(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the flat values of the lists of some rows, in order, and for each its number in ``rows``."""
    width = lengths[rows]
    begins = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(rows)), width)
    return np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width) + begins[rows][owner], owner


class _Terms:
    """Counts of terms, added up."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.counts: list[tuple] = []
        self.docs: list[tuple] = []
        self.size = 0

    def add(self, key: np.ndarray, rows: np.ndarray, at: pa.Array, n: pa.Array, docs: pa.Array) -> None:
        """The counts of row ``rows[i]`` belong to the term of number ``key[i]``."""
        (at, lengths), (n, _), (docs, held) = _flat(at), _flat(n), _flat(docs)
        places, owner = _picked(rows, lengths)
        self.counts.append((key[owner], at[places].astype(np.int64), n[places]))
        self.size += len(owner)
        places, owner = _picked(rows, held)
        self.docs.append((key[owner], docs[places]))

    def rows(self) -> pa.RecordBatch:
        counts, docs = (tuple(np.concatenate(c) for c in zip(*x)) for x in (self.counts, self.docs))
        lists = _added(len(self.numbers), counts, docs, self.min_docs)
        out = pa.RecordBatch.from_arrays([pa.array([t for _, t in self.numbers], pa.binary()), pa.array([la for la, _ in self.numbers], pa.int64()), *lists], schema=_TERMS)
        self.clear()
        return out


def _cutter(min_docs: int, portion: int):
    """Rows in the order of their chunks: each chunk is cut once."""

    def run(batches):
        held, last, terms = _Terms(min_docs), None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk, lang = batch.column(0), batch.column(1).to_numpy()
            same = pc.equal(chunk[1:], chunk[:-1]).to_numpy(zero_copy_only=False) & (lang[1:] == lang[:-1])
            start = np.flatnonzero(np.append(True, ~same))
            numbers, lengths, numbered = [], [], held.numbers
            for c, la in zip(chunk.take(pa.array(start)).to_pylist(), lang[start].tolist()):
                if c != last:
                    last, terms = c, _TERM.findall(c.lower())
                numbers += [numbered[la, t] for t in terms]
                lengths.append(len(terms))
            # every row has the terms of its run of equal chunks
            run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(lang))))
            places, rows = _picked(run, np.array(lengths, np.int64))
            if len(rows):
                held.add(np.array(numbers, np.int64)[places], rows, *batch.columns[2:])
            if held.size >= portion:
                yield held.rows()
        if held.numbers:
            yield held.rows()

    return run


def _keeper(min_docs: int):
    """Rows in the order of term and language, added up; terms of too few documents are dropped."""

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(np.diff(batch.column(4).offsets.to_numpy()) >= min_docs))

    def run(batches):
        held, last = _Terms(min_docs), None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()))
            # all but the last key are complete
            end = next((k for k in range(len(keys) - 1, -1, -1) if keys[k] != keys[-1]), -1) + 1
            if end:
                held.add(np.array([held.numbers[k] for k in keys[:end]]), np.arange(end), *batch.columns[2:])
                yield kept(held.rows())
            elif keys[-1] != last and held.numbers:
                yield kept(held.rows())
            held.add(np.array([held.numbers[k] for k in keys[end:]]), np.arange(end, len(keys)), *batch.columns[2:])
            last = keys[-1]
            if held.size >= PORTION:
                merged = held.rows()
                held.add(np.array([held.numbers[last]]), np.array([0]), *merged.columns[2:])
        if held.numbers:
            yield kept(held.rows())

    return run


def _groups(docs: DataFrame) -> DataFrame:
    """(lang, source, no, at, documents): languages are numbered, and the sources of each."""
    found = written(docs.groupBy("lang", "source").agg(F.count("*").alias("documents")), "groups")
    langs = written(found.select("lang").distinct().orderBy("lang").withColumn("no", F.monotonically_increasing_id()), "langs")
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return written(found.join(langs, "lang").withColumn("at", at), "numbered")


def _term_counts(docs: DataFrame, groups: DataFrame, min_docs: int, portion: int) -> DataFrame:
    """(term, lang, at, n): occurrences of the kept terms in the sources of each language, by their numbers."""
    named = groups.select(F.col("lang").alias("lang_of"), F.col("source").alias("source_of"), "no", "at", "documents")
    keyed = skewed_join(docs, named, {"lang": "lang_of", "source": "source_of"}, "documents")
    chunks = batched(keyed.select("no", "at", "text"), _counter(min_docs, portion), CHUNKS)
    terms = batched(chunks.repartition("chunk").sortWithinPartitions("chunk", "lang"), _cutter(min_docs, portion), TERMS)
    return batched(terms.repartition("term", "lang").sortWithinPartitions("term", "lang"), _keeper(min_docs), TERMS).drop("docs")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total), in steps of a thousand that stay within a long."""
    whole, rest = F.floor(F.lit(0)), count + 1
    for step in (1, 1000, 1000, 1000):
        rest = rest * step
        whole = whole * step + _div(rest, total)
        rest = rest % total
    return whole + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same for arrays."""
    whole, rest = 0, counts + 1
    for step in (1, 1000, 1000, 1000):
        rest = rest * step
        whole = whole * step + rest // totals
        rest = rest % totals
    return whole + 1


def _sums(batches):
    """From (lang, block, totals, at, n) of each term to the sums of one task by language and pair of sources."""
    schema = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])
    held: dict[tuple, np.ndarray] = {}
    for batch in batches:
        rows: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            rows.setdefault(key, []).append(k)
        (at, lengths), (n, _) = _flat(batch.column(3)), _flat(batch.column(4))
        for (lang, block), of in rows.items():
            totals = np.array(batch.column(2)[of[0]].as_py(), np.int64)
            places, owner = _picked(np.array(of), lengths)
            counts = np.zeros((len(of), len(totals)), np.int64)
            counts[owner, at[places]] = n[places]
            q = shares(counts, totals)
            p = q[:, block * SOURCE_BLOCK : (block + 1) * SOURCE_BLOCK]
            value = np.zeros((p.shape[1], len(totals)), np.int64)
            few = max(1, 1_000_000 // value.size)  # terms at a time
            for i in range(0, len(of), few):
                a, b = p[i : i + few, :, None], q[i : i + few, None, :]
                value += ((a - b) ** 2 // b).sum(axis=0)
            if (lang, block) in held:
                held[lang, block] += value
            else:
                held[lang, block] = value
    for (lang, block), value in held.items():
        a, b = np.indices(value.shape, dtype=np.int32)
        size = value.size
        yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array(a.ravel() + np.int32(block * SOURCE_BLOCK)), pa.array(b.ravel()), pa.array(value.ravel())], schema=schema)


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, portion: int = PORTION) -> DataFrame:
    """(lang, source, part, item, value, rank) as described above."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    placed = _groups(rows)
    found = _term_counts(rows, placed, min_docs, portion)
    found = found.select(F.col("lang").alias("no"), "term", F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"), F.arrays_zip("at", "n").alias("parts"))
    found = written(found, "terms")
    names = placed.groupBy("no").agg(F.first("lang").alias("lang")).join(found.groupBy("no").agg(F.count("*").alias("v")), "no")
    kept = skewed_join(found, names.withColumnRenamed("no", "no_of"), {"no": "no_of"}, "v").select("lang", "term", "n", "parts")

    each = kept.select("lang", F.explode("parts").alias("p")).groupBy("lang", F.col("p.at").alias("at")).agg(F.sum("p.n").alias("total"), F.count("*").alias("used"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total"))
    each = each.select(F.col("lang").alias("l"), F.col("at").alias("i"), F.col("total").alias("own"), "used")
    known = placed.join(each, (F.col("lang") == F.col("l")) & (F.col("at") == F.col("i")), "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("long")
    info = written(known.select("lang", "source", "at", F.coalesce("used", zero).alias("used"), F.coalesce("own", zero).alias("own"), F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v")), "totals")

    # all pairs of a language's sources, term by term
    totals = info.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", (F.col("own") + F.col("v")).alias("total")))).alias("t"), F.first("v").alias("v"))
    totals = totals.where("v > 0").select(F.col("lang").alias("lang_of"), F.col("t.total").alias("totals"), "v")
    dense = skewed_join(kept, totals, {"lang": "lang_of"}, "v").withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.size("totals") - 1) / SOURCE_BLOCK).cast("int"))))
    sums = batched(dense.select("lang", "block", "totals", F.col("parts.at"), F.col("parts.n")), _sums, "lang string, a int, b int, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = info.select("lang", "source", F.col("at").alias("a"))
    two = info.select("lang", F.col("source").alias("item"), F.col("at").alias("b"))
    pairs = one.join(two, "lang").where("a != b").join(sums, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))

    # what a source uses more than its language
    uses = kept.select("lang", "term", F.col("n").alias("all"), F.explode("parts").alias("p")).select("lang", "term", "all", "p.at", "p.n")
    of = info.where("used > 0").select(F.col("lang").alias("lang_of"), F.col("at").alias("at_of"), "source", "used", "own", "total", "v")
    uses = skewed_join(uses, of, {"lang": "lang_of", "at": "at_of"}, "used")
    p, q = share(F.col("n"), F.col("own") + F.col("v")), share(F.col("all"), F.col("total") + F.col("v"))
    more = uses.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    more = more.select("lang", "source", "part", "item", _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)
