import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tabloom.llm.byte_bpe import ByteBPE, RankQueue, coder, decode_documents, encode_documents, round_trip_digests

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(3)
    parts = ["a", "b", "aa", "th", "e", "  ", " ", "\n", "\t", "é", "'s", "1", "ing", "日", "　", "!", "xyzzy", " "]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(400)]
    made += ["".join(rnd.choice("abtheing") for _ in range(4000)), "a" * 5000, "<|endoftext|>", "", "word " * 3000]
    return made


def test_ids_equal_the_library(library):
    for limit in (10, 100_000):
        own = ByteBPE(RANKS, PATTERN, limit)
        for _ in range(2):
            for text, ids in zip(texts(), own.encode(texts())):
                assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text[:80])
                assert own.decode(ids) == text.encode()


def test_words_merged_together_equal_words_alone(library):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("aabthine s") for _ in range(rnd.randrange(1, 40))).encode() for _ in range(500)]
    own = coder(RANKS, PATTERN)
    together = own.merge(words)
    assert together == [own.merge([w])[0] for w in words]


def test_many_decoded_at_once_equal_each_alone():
    own = ByteBPE(RANKS, PATTERN)
    ids = own.encode(texts())
    assert own.decode_all(ids) == [own.decode(i) for i in ids] == [t.encode() for t in texts()]
    assert own.decimals(ids) == [" ".join(map(str, np.frombuffer(i, "<u4").tolist())).encode() for i in ids]
    assert own.decode_all([]) == own.decimals([]) == [] and own.decode_all([b"", b""]) == [b"", b""]


def test_a_word_is_kept_once(library):
    own = ByteBPE(RANKS, PATTERN)
    for text in ("some zyxo, zyxo quib", "the quib. zyxo quibo,", "a quibo zyxo. quib"):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)
    assert {"zyxo", "quib", "quibo"} <= set(own._pieces) and not {" zyxo", " quib", " quibo"} & set(own._words)


def test_queue_filled_at_once_gives_lowest_rank_first():
    queue, rnd = RankQueue(50256), random.Random(2)
    pushed = [(rnd.randrange(500), at) for at in range(3000)]
    queue.fill(np.array([r for r, _ in pushed]), np.array([at for _, at in pushed]))
    out = []
    while (first := queue.take_first()) is not None:
        out += [(first[0], at) for at in first[1]]
    assert out == sorted(pushed)


def test_queue_gives_lowest_rank_first():
    queue, rnd = RankQueue(50256), random.Random(1)
    pushed = [(rnd.randrange(50256), rnd.randrange(1000)) for _ in range(3000)]
    for rank, at in pushed:
        queue.push(rank, at)
    out = []
    while (first := queue.take_first()) is not None:
        out += [(first[0], at) for at in first[1]]
    assert out == sorted(pushed)


def test_documents(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts()[-10:])] + [(None, None, "x"), (3, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    want = sorted((i if i is not None else -1, len(library.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, library.encode_ordinary(t or ""))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip_digests(docs, RANKS, PATTERN).collect())
    assert got == want
    decoded = decode_documents(encode_documents(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert sorted(bytes(r.decoded) for r in decoded.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert encode_documents(docs.limit(0), RANKS, PATTERN).count() == 0
