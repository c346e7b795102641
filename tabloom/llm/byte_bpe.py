"""Byte-level BPE by merge ranks: encode whole texts, decode ids.

The bytes of many pre-tokens form one linked list, cut between them.  Every adjacent pair that has a
merge rank lies in the bucket of that rank; a hierarchical bitmap over the ranks, a word on top whose bits
stand for words below, tells the lowest bucket that holds anything by find-first-set.  Merging a pair
changes its neighbours' pairs: the new ones are added, the old entries stay and are skipped when they
come up.  A pre-token of n bytes so costs n steps of constant work, however long it is, and the pre-tokens
of many texts share the walk over the ranks.

Of equal ranks the leftmost merges first.  A merge that makes a lower rank is followed up before the rest
of its pre-token; other pre-tokens need not wait.  So the ids are those of repeatedly merging the leftmost
lowest pair.  A pre-token that is itself in the vocabulary is that one id.

Edge cases: a null text is an empty one and gives no ids; special tokens' strings are ordinary text;
unpaired surrogates can't occur in Spark strings; repeated rows and equal ids each give a row; an empty
table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import batched
from tabloom.llm.pieces import Kept, spaces_stand_alone

#: Texts are encoded together up to so many characters; pre-tokens and pieces kept per worker.
CHUNK_CHARS = 1 << 20
MAX_KEPT = 1_200_000


class RankQueue:
    """Buckets of positions by rank, with a bitmap of two levels over the ranks that hold any."""

    def __init__(self, ranks: int):
        self._shift = (ranks.bit_length() + 1) // 2
        self._bits = [1 << b for b in range(1 << self._shift)]
        self._low = [0] * ((ranks >> self._shift) + 1)
        self._top = 0
        self._buckets: dict[int, list[int]] = {}

    def fill(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Push many positions, in ascending order, into an empty queue."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order].tolist()
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
        for rank, a, b in zip(ranks[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(positions)]):
            self.push(rank, positions[a])
            self._buckets[rank] += positions[a + 1 : b]

    def push(self, rank: int, position: int) -> None:
        bucket = self._buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self._buckets[rank] = [position]
        high = rank >> self._shift
        self._low[high] |= self._bits[rank & len(self._bits) - 1]
        self._top |= 1 << high

    def take_first(self) -> tuple[int, list[int]] | None:
        """The lowest rank that holds positions, and those in order; they leave the queue."""
        if not self._top:
            return None
        high = (self._top & -self._top).bit_length() - 1
        word = self._low[high]
        first = word & -word
        self._low[high] = word ^ first
        if word == first:
            self._top ^= 1 << high
        rank = (high << self._shift) + first.bit_length() - 1
        bucket = self._buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class ByteBPE:
    """Encoder and decoder for one file of ranks; a worker keeps what it has encoded, up to a limit."""

    def __init__(self, path: str, pattern: str, limit: int = MAX_KEPT):
        with open(path, "rb") as lines:
            self._ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.tokens = {rank: token for token, rank in self._ranks.items()}
        self._matches = regex.compile(pattern).findall
        size = max(self.tokens) + 1
        self._shift = size.bit_length()
        self._mask = (1 << self._shift) - 1
        self._queue = RankQueue(size)
        self._bytes = np.array([self._ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        self._byte_pairs = np.array([self._ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], dtype=np.int64)
        self._pairs = Kept(self._pair_rank)
        self._limit = limit
        self._words: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}
        self._arrays: tuple | None = None

    def _pair_rank(self, pair: int) -> int:
        return self._ranks.get(self.tokens[pair >> self._shift] + self.tokens[pair & self._mask], -1)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token."""
        return [np.frombuffer(ids, dtype="<u4").tolist() for ids in self._merged(words)]

    def _merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers."""
        wholes = list(map(self._ranks.get, words))
        parted = iter(self._merged_bytes([w for w, whole in zip(words, wholes) if whole is None]))
        return [next(parted) if whole is None else whole.to_bytes(4, "little") for whole in wholes]

    def _merged_bytes(self, words: list[bytes]) -> list[bytes]:
        """The same, from single bytes on."""
        shift, pairs, queue = self._shift, self._pairs, self._queue
        push = queue.push
        found = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        bounds = np.cumsum([len(w) for w in words], dtype=np.int64)
        if not len(found):
            return [b""] * len(words)
        singles = self._bytes[found]
        if singles.min() < 0:
            raise ValueError("the vocabulary lacks a byte")
        starts = np.concatenate([[0], bounds[:-1]])
        links = np.arange(-1, len(found) + 1)
        before, after = links[:-2].copy(), links[2:].copy()
        before[starts[starts < len(found)]] = -1
        after[bounds[bounds > 0] - 1] = -1
        ranks = np.append(self._byte_pairs[found[:-1] << 8 | found[1:]], -1)
        ranks[after < 0] = -1
        at = np.flatnonzero(ranks >= 0)
        queue.fill(ranks[at], at)
        ids, before, after, ends = singles.tolist(), before.tolist(), after.tolist(), bounds.tolist()
        while (first := queue.take_first()) is not None:
            rank, bucket = first
            waits = -1  # places before this one belong to a pre-token with a lower rank to follow up
            for at in bucket:
                left, right = ids[at], after[at]
                if left < 0 or right < 0 or pairs[left << shift | ids[right]] != rank:
                    continue  # stale: one of the two has merged with another neighbour
                if at < waits:
                    push(rank, at)
                    continue
                follower, leader = after[right], before[at]
                ids[at], ids[right], after[at] = rank, -1, follower
                if follower >= 0:
                    before[follower] = at
                    if (made := pairs[rank << shift | ids[follower]]) >= 0:
                        push(made, at)
                        if made < rank:
                            waits = ends[bisect_right(ends, at)]
                if leader >= 0 and (made := pairs[ids[leader] << shift | rank]) >= 0:
                    push(made, leader)
                    if made < rank:
                        waits = ends[bisect_right(ends, at)]
        left = np.array(ids, dtype=np.int64)
        stays = left >= 0
        cuts = np.concatenate([[0], np.cumsum(stays)])[bounds] * 4
        flat = left[stays].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *cuts.tolist()], cuts.tolist())]

    def _spaced(self, piece: str) -> list[str]:
        """Pre-tokens of a space and a piece; letters are one match, a full stop or comma after them another."""
        if piece.isalpha():
            return [" " + piece]
        if piece[-1:] in (".", ",") and piece[:-1].isalpha():
            return [" " + piece[:-1], piece[-1]]
        return self._matches(" " + piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A space alone between two characters opens a match, so texts are cut there and a piece is matched
        and merged once.
        """
        words, pieces = self._words, self._pieces
        heads: list[list[str]] = []  # pre-tokens of each text's first piece, or of a text that can't be cut
        rests: list[tuple[list[str], list[bytes | None]]] = []
        strange: set[str] = set()
        for text in texts:
            head, *rest = text.split(" ") if spaces_stand_alone(text) else [text]
            heads.append(self._matches(head))
            ids = list(map(pieces.get, rest))
            if None in ids:
                strange.update([p for p, i in zip(rest, ids) if i is None])
            rests.append((rest, ids))
        matches = {p: self._spaced(p) for p in strange}
        wanted = {w for found in (*matches.values(), *heads) for w in found}
        # a space and a word is kept as the piece that the word is
        known = {w: pieces.get(w[1:]) if w[0] == " " and w[1:].isalpha() else words.get(w) for w in wanted}
        fresh = [w for w, ids in known.items() if ids is None]
        made = dict(zip(fresh, self._merged([w.encode() for w in fresh])))
        known.update(made)
        new = {p: known[found[0]] if len(found) == 1 else b"".join([known[w] for w in found]) for p, found in matches.items()}
        spaced = {w[1:]: ids for w, ids in made.items() if w[0] == " " and w[1:].isalpha()}
        others = {w: ids for w, ids in made.items() if not (w[0] == " " and w[1:].isalpha())}
        out = []
        for head, (rest, ids) in zip(heads, rests):
            if None in ids:
                ids = [new[p] if i is None else i for p, i in zip(rest, ids)]
            out.append(b"".join([known[w] for w in head] + ids))
        for kept, found in ((words, others), (pieces, spaced), (pieces, new)):
            if len(kept) < self._limit:
                kept.update(islice(found.items(), self._limit - len(kept)))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def decode_all(self, ids: list[bytes]) -> list[bytes]:
        """``decode`` of each."""
        return self._strung(ids, 0)

    def decimals(self, ids: list[bytes]) -> list[bytes]:
        """The ids of each as decimal numbers joined by a space."""
        return [d[:-1] for d in self._strung(ids, 1)]

    def _strung(self, ids: list[bytes], which: int) -> list[bytes]:
        """What the ids of each stand for, strung together: token bytes, or decimal numbers with a space after them."""
        if self._arrays is None:
            size = max(self.tokens) + 1
            self._arrays = tuple(pa.array(x, pa.large_binary()) for x in ([self.tokens.get(i) for i in range(size)], [b"%d " % i for i in range(size)]))
        out = []
        for part in _runs(ids, lambda i: len(i) // 4):
            flat = np.frombuffer(b"".join(part), dtype="<u4")
            taken = self._arrays[which].take(pa.array(flat))
            if taken.null_count:
                raise ValueError("an id is not in the vocabulary")
            _, offsets, data = taken.buffers()
            offsets = np.frombuffer(offsets, dtype=np.int64)[: len(flat) + 1]
            cuts = offsets[np.concatenate([[0], np.cumsum([len(i) // 4 for i in part])])].tolist()
            data = memoryview(data) if data is not None else memoryview(b"")
            out += [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:])]
        return out


def _runs(items: list, weight=len):
    """The items in runs of a weight of about CHUNK_CHARS."""
    held, size = [], 0
    for item in items:
        held.append(item)
        size += weight(item)
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


_CODERS: dict = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """One coder per file of ranks and worker process."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBPE(path, pattern)
    return _CODERS[path, pattern]


ENCODED = "doc_id long, n_tokens long, ids binary"


def _encoder(path: str, pattern: str):
    def run(batches):
        encode = coder(path, pattern).encode
        for batch in batches:
            ids = [i for chunk in _runs([t or "" for t in batch.column(1).to_pylist()]) for i in encode(chunk)]
            lengths = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), lengths, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _decoder(path: str, pattern: str):
    def run(batches):
        decode = coder(path, pattern).decode_all
        for batch in batches:
            decoded = pa.array(decode([ids or b"" for ids in batch.column(2).to_pylist()]), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def _digester(path: str, pattern: str):
    encode, decode = _encoder(path, pattern), _decoder(path, pattern)

    def run(batches):
        decimals = coder(path, pattern).decimals
        for batch in decode(encode(batches)):
            shas = [hashlib.sha256(d).hexdigest() for d in decimals(batch.column(2).to_pylist())]
            texts = [hashlib.sha256(t).hexdigest() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shas), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _narrow(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def encode_documents(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids as little-endian unsigned 32-bit integers); each match of ``pattern`` is merged by itself."""
    return batched(_narrow(docs, doc_id, text), _encoder(ranks, pattern), ENCODED)


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Add ``decoded``: the bytes that the ids of ``encode_documents`` stand for."""
    return batched(encoded.select("doc_id", "n_tokens", "ids"), _decoder(ranks, pattern), ENCODED + ", decoded binary")


def round_trip_digests(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, then decode the ids, in one pass; digests of the decimal ids and of the decoded bytes."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return batched(_narrow(docs, doc_id, text), _digester(ranks, pattern), schema)
