import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tabloom.llm.packing import assign, pack_documents, piece_cost, powers_of_two

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_powers():
    assert powers_of_two(0) == [] and powers_of_two(11) == [8, 2, 1]


def test_balanced_and_full():
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(1, 400, 300).tolist() + [900, 1000], reverse=True)
    total = sum(lengths)
    capacities = [1024] * (total // 1024) + powers_of_two(total % 1024)
    pieces = assign(lengths, capacities)
    used, cost = defaultdict(int), defaultdict(float)
    for _, _, length, at, offset in pieces:
        assert offset == used[at]
        used[at] += length
        cost[at] += piece_cost(length)
    assert [used[i] for i in range(len(capacities))] == capacities
    full = [c for i, c in cost.items() if capacities[i] == 1024]
    assert max(full) < 1.6 * min(full)


def test_every_id_in_one_piece(spark):
    texts = [None, "", "one", "word " * 3000, "a b c " * 700] + [f"text number {i} " * (i % 40) for i in range(200)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (3, "same id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    plain = Tokenizer.from_file(PATH)
    ids = defaultdict(list)
    for i, t, _ in rows:
        ids[i].append(plain.encode(t or "", add_special_tokens=False).ids + [2])
    got = pack_documents(docs, PATH, sequence_tokens=256, group_sequences=4, with_ids=True).collect()
    found, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        piece = np.frombuffer(r.ids, "<u4").tolist()
        assert len(piece) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        found[r.doc_id, r.doc_tokens].append((r.start, piece))
        sequences[r.sequence_id].append((r.offset, r.length))
    for (i, n), pieces in found.items():
        whole = sum((p for _, p in sorted(pieces)), [])
        assert whole in ids[i] and len(whole) == n
    assert len(found) == len(rows)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0 and at < 256
    assert pack_documents(docs.limit(0), PATH).count() == 0
