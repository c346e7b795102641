"""Repeated passages of words, found level by level with windows of doubled length.

A window is a run of consecutive words of one document.  A word is removed if a window of ``words`` words
covers it whose words also start earlier (in a document of a smaller id, or before in the same one).

* The first level has windows of half the length.  Of the half windows inside each full window one stands
  for it, the one of the smallest hash, so equal full windows are stood for by equal half windows and few
  places are sent.  Those that occur at one place only drop out.
* Only what is left is extended to twice the length: the full windows whose half window has survived, named
  by 128 bits of hash.  Windows grow by the same doubling inside a task: the hash of 2m words is made of two
  hashes of m words, so any length takes a logarithmic number of array steps.
* Of equal full windows all but the earliest are later copies, and the words that they cover go.  A wider
  window has none but such windows inside, so no candidate is left to extend beyond the wanted length.

Documents of the same text are one before anything is compared: the row of the smallest id stands for
them, and a later copy of a whole text (if it has a window at all) loses all its words.

Each level is one shuffle on the window's hash in which sorted neighbours are compared.  A task first
merges what its own batch repeats: one row a batch and window is sent, the rest is known already and is
dealt out by place.  So a passage that stands in a third of all documents is no large key.

Edge cases: a null or blank text has no words; a null id comes before all others; rows that repeat an id
and its text are one document and get the same result; rows of one id and other texts are ordered by
hashes of the text; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import batched, skewed_join, written

WORDS = 20
CACHED_WORDS = 1_000_000

#: What a row of a level says: a place to compare; one that its batch has seen more than once; a known result.
_PLACE, _SEEN, _KNOWN = 0, 1, 2

_MIX = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _MIX[0] + ((b << np.uint64(31)) | (b >> np.uint64(33))) * _MIX[1]
    x ^= x >> np.uint64(32)
    x *= _MIX[2]
    return x ^ (x >> np.uint64(29))


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of the ``length`` words from each word on, by doubling; shorter by ``length`` - 1."""
    whole, size, done = None, 1, 0
    while True:
        if length & size:
            if whole is None:
                whole = hashes
            else:
                n = len(hashes) - done
                whole = _mix(whole[: max(n, 0)], hashes[done:]) if n > 0 else hashes[:0]
            done += size
        size *= 2
        if size > length:
            return whole[: max(len(whole), 0)]
        hashes = _mix(hashes[:-(size // 2)], hashes[size // 2 :])


class _Words:
    """Hashes of words, kept for the frequent ones."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(chain.from_iterable(texts)).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.uint64, sum(map(len, texts)))


def _windows(texts: list[list[bytes]], words: int, half: int, hashes: np.ndarray):
    """(first, chosen, halves): places of all full windows, of the half window that stands for each, and half hashes.

    Places count the words of all texts on; no window crosses the end of its text.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.repeat(np.cumsum(lengths), lengths)
    first = np.flatnonzero(np.arange(len(ends)) + words <= ends)
    halves = window_hashes(hashes, half)
    if not len(first):
        return first, first, halves
    inside = np.lib.stride_tricks.sliding_window_view(halves, words - half + 1)
    return first, first + inside.argmin(axis=1)[first], halves


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)


_HALVES = pa.schema([("hash", pa.int64()), ("content", pa.int64()), ("pos", pa.int32()), ("kind", pa.int8())])
_FULLS = pa.schema([("hash", pa.int64()), ("more", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("run", pa.int32())])


def _places(texts: list[list[bytes]], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and word number of places that count the words of all texts on."""
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text = np.searchsorted(starts, at, side="right") - 1
    return text, at - starts[text]


def _half_level(words: int, half: int):
    """From (content, text) to the half windows, each place of a content once a batch."""

    def run(batches):
        seen = _Words()
        for batch in batches:
            contents, texts = batch.column(0).to_numpy(), [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            _, once = np.unique(contents, return_index=True)
            once = [i for i in once if len(texts[i]) >= words]
            contents, texts = contents[once], [texts[i] for i in once]
            _, chosen, halves = _windows(texts, words, half, seen.of(texts))
            chosen = np.unique(chosen)
            text, pos = _places(texts, chosen)
            content, found = contents[text], halves[chosen]
            order = np.lexsort((pos, content, found))
            found, content, pos = found[order], content[order], pos[order]
            again = np.zeros(len(found), bool)
            again[1:] = found[1:] == found[:-1]
            kind = np.where(again, _KNOWN, np.where(np.append(again[1:], False), _SEEN, _PLACE))
            # a known place needs no comparison: it goes where its place says
            found = np.where(again, _mix(content.view(np.uint64), pos.astype(np.uint64)), found)
            yield _batch([_signed(found), content, pos.astype(np.int32), kind.astype(np.int8)], _HALVES)

    return run


def _repeated(batches):
    """Rows sorted by hash, content, place and kind (descending): (content, pos) of hashes at more than one place."""
    schema = pa.schema([("content", pa.int64()), ("pos", pa.int32())])
    last = None  # (hash, content, pos, told) of the last place so far
    for batch in batches:
        h, content, pos, kind = (c.to_numpy() for c in batch.columns)
        known = kind == _KNOWN
        out = [(content[known], pos[known])]
        h, content, pos, seen = h[~known], content[~known], pos[~known], kind[~known] == _SEEN
        told = np.zeros(len(h), bool)
        if last is not None:
            h, content, pos = (np.concatenate([[a], b]) for a, b in zip(last, (h, content, pos)))
            seen, told = np.append(False, seen), np.append(last[3], told)
        if len(h):
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (content[1:] != content[:-1]) | (pos[1:] != pos[:-1])
            # the first of equal places has the highest kind, but may have come with the batch before
            seen = np.maximum.reduceat(seen, np.flatnonzero(new))
            h, content, pos, told = h[new], content[new], pos[new], told[new]
            same = h[1:] == h[:-1]
            twice = seen | np.append(False, same) | np.append(same, False)
            out.append((content[twice & ~told], pos[twice & ~told]))
            last = (h[-1], content[-1], pos[-1], told[-1] | twice[-1])
        yield _batch([np.concatenate(c) for c in zip(*out)], schema)


def _runs(pos: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of places that follow each other, sorted by document and place."""
    starts = np.flatnonzero(np.append(True, (np.diff(pos) != 1) | (np.diff(doc) != 0))) if len(pos) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(pos)))


def _full_level(words: int, half: int):
    """From (doc, text, surviving half windows) to full windows; ``run`` is 0, or the length of a known run of later copies."""

    def run(batches):
        seen = _Words()
        for batch in batches:
            docs, once = np.unique(batch.column(0).to_numpy(), return_index=True)
            texts, alive = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts, alive = [texts[i].encode().split() for i in once], [alive[i] for i in once]
            hashes = seen.of(texts)
            first, chosen, _ = _windows(texts, words, half, hashes)
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
            marked = np.zeros(len(hashes) + 1, bool)
            for start, places in zip(starts, alive):
                marked[start + np.array(places, np.int64)] = True
            first = first[marked[chosen]]
            text, pos = _places(texts, first)
            doc = docs[text]
            a = window_hashes(hashes, words)[first]
            b = window_hashes(_mix(hashes, ~hashes), words)[first]
            order = np.lexsort((pos, doc, b, a))
            again = np.zeros(len(order), bool)
            again[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
            sent, later = order[~again], np.sort(order[again])
            yield _batch([_signed(a[sent]), _signed(b[sent]), doc[sent], pos[sent].astype(np.int32), np.zeros(len(sent), np.int32)], _FULLS)
            at, length = _runs(pos[later], doc[later])
            at = later[at]
            yield _batch([_signed(a[at]), _signed(_mix(a[at], pos[at].astype(np.uint64))), doc[at], pos[at].astype(np.int32), length.astype(np.int32)], _FULLS)

    return run


def _later(batches):
    """Rows sorted by hashes, document and place: (doc, pos, run) of all later copies."""
    schema = pa.schema([("doc", pa.int64()), ("pos", pa.int32()), ("run", pa.int32())])
    last = None  # (hash, more, doc, pos) of the first copy of the window at hand
    for batch in batches:
        a, b, doc, pos, run = (c.to_numpy() for c in batch.columns)
        known = run > 0
        out = [(doc[known], pos[known], run[known])]
        a, b, doc, pos = a[~known], b[~known], doc[~known], pos[~known]
        if last is not None:
            a, b, doc, pos = (np.concatenate([[x], y]) for x, y in zip(last, (a, b, doc, pos)))
        if len(a):
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            begins = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            copy = (doc != doc[begins][group]) | (pos != pos[begins][group])
            out.append((doc[copy], pos[copy], np.ones(copy.sum(), np.int32)))
            last = tuple(x[begins[-1]] for x in (a, b, doc, pos))
        yield _batch([np.concatenate(c) for c in zip(*out)], schema)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, content, more, own): two hashes of the text, one of the id and the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"),
        F.xxhash64(t).alias("content"), F.xxhash64(F.lit(1), t).alias("more"), F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), t).alias("own"),
    )


def _joined(rows: DataFrame, keyed: DataFrame, how: str) -> DataFrame:
    """On the row's key; identical rows that are more than a thousandth of all are not moved."""
    on = {"own": "own_of", "more": "more_of"}
    most = keyed.agg(F.max("copies"), F.sum("copies")).first()
    if (most[0] or 0) * 1000 > (most[1] or 0):
        return skewed_join(rows, keyed, on, "copies", how)
    return rows.join(keyed, (F.col("own") == F.col("own_of")) & (F.col("more") == F.col("more_of")), how)


def later_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(the standing rows: own_of, more_of, copies, doc), (doc, pos, run): the windows that start earlier, too.

    A standing row stands for all rows of its text; ``doc`` numbers them in the order of their ids.  ``run``
    windows from ``pos`` on are later copies.
    """
    if words < 2:
        raise ValueError("a window has at least 2 words")
    half = words // 2
    rows = _rows(docs, doc_id, text)
    same = rows.groupBy("content", "more", "own").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    first = same.groupBy("content", "more").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "own", "copies")).alias("r"))
    ordered = first.select("content", "more", "r.doc_id", "r.own", "r.copies").orderBy(F.col("doc_id").asc_nulls_first(), "content", "more")
    standing = written(ordered.select("content", F.col("more").alias("more_of"), F.col("own").alias("own_of"), "copies", F.monotonically_increasing_id().alias("doc")), "standing")

    level = batched(rows.select("content", "text"), _half_level(words, half), "hash long, content long, pos int, kind byte")
    sorted_ = level.repartition("hash").sortWithinPartitions("hash", "content", "pos", F.desc("kind"))
    alive = batched(sorted_, _repeated, "content long, pos int").distinct()
    alive = written(alive.groupBy("content").agg(F.collect_list("pos").alias("alive")), "alive")

    wanted = written(standing.join(alive, "content").drop("content"), "wanted")
    extended = _joined(rows.select("own", "more", "text"), wanted, "inner").select("doc", "text", "alive")
    level = batched(extended, _full_level(words, half), "hash long, more long, doc long, pos int, run int")
    sorted_ = level.repartition("hash", "more").sortWithinPartitions("hash", "more", "doc", "pos")
    return standing, written(batched(sorted_, _later, "doc long, pos int, run int"), "later")


def _remover(words: int, with_text: bool):
    def run(batches):
        for batch in batches:
            ids, texts, stands, found = (c.to_pylist() for c in batch.columns)
            totals, removed, digests, kept_texts = [], [], [], []
            for text, standing, runs in zip(texts, stands, found):
                ws = text.split() if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") else [w.decode() for w in text.encode().split()]
                totals.append(len(ws))
                if not standing and len(ws) >= words:
                    kept = []
                elif runs:
                    gone = np.zeros(len(ws) + 1, np.int64)
                    for r in runs:
                        gone[r["pos"]] += 1
                        gone[r["pos"] + r["run"] - 1 + words] -= 1
                    kept = [w for w, g in zip(ws, np.cumsum(gone).tolist()) if not g]
                else:
                    kept = ws
                removed.append(len(ws) - len(kept))
                left = " ".join(kept)
                digests.append(hashlib.sha256(left.encode()).hexdigest())
                if with_text:
                    kept_texts.append(left)
            columns = [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept_texts, pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, and ``kept``, the words that stay, if ``with_text``."""
    standing, later = later_windows(docs, doc_id, text, words)
    runs = later.distinct().groupBy("doc").agg(F.collect_list(F.struct("pos", "run")).alias("runs"))
    told = written(standing.join(runs, "doc", "left").select("own_of", "more_of", "copies", "runs"), "runs")
    joined = _joined(_rows(docs, doc_id, text), told, "left")
    narrow = joined.select("doc_id", "text", F.col("own_of").isNotNull().alias("standing"), "runs")
    return batched(narrow, _remover(words, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))
