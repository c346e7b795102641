import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabloom.llm.common import shared_folder
from tabloom.llm.pieces import PieceEncoder
from tabloom.llm.token_files import pack, read_digests, read_tokens, unpack, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD_PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "  two  spaces ", "a\n\nb \n c", "It's we'll DON'T 'tis", "tabs\tand nbsp　wide", "été Été ﬁ Ωςσ ÀÉ", "日本語テキスト 😀 ok",
    "<|endoftext|> plain <|startoftext|>", "a <|endoftext|> b<|endoftext|>c.\n<|ENDOFTEXT|>\nword <|startoftext|>, <|endoftext|>.", "The cat, the dog. The end.\nNew line, again.\n", "word " * 5000, "x" * 5000, "1234 12,5 3.14 ... !!! -- ?!", "end.\nStart of, it.\n- item",
]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=600))
def test_packing_round_trip(ids):
    ids = np.array(ids, dtype=np.uint64)
    words, escapes = pack(ids)
    assert (unpack(words, len(ids), escapes) == ids).all()


def test_words_hold_as_many_ids_as_fit():
    assert [len(pack(np.array(ids, dtype=np.uint64))[0]) for ids in ([0] * 240, [1] * 60, [1] * 61, [32767] * 4, [32768] * 4, [1 << 60])] == [1, 1, 2, 1, 2, 2]


@pytest.mark.parametrize("path,space_led", [(PATH, True), (WORD_PATH, False)])
def test_pieces_equal_whole_texts(path, space_led):
    plain = Tokenizer.from_file(path)  # untouched: special strings become their tokens
    ordinary = Tokenizer.from_file(path)
    ordinary.encode_special_tokens = True
    for limit, special in ((3, True), (1000, True), (1000, False)):
        encoder = PieceEncoder(path, space_led, special, limit)
        plain = plain if special else ordinary
        for text in TEXTS[1:] + [" ".join(TEXTS[1:])]:
            assert encoder.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text[:60])


def test_files_hold_all_ids_in_order(spark):
    rows = [(100 - i, t, i) for i, t in enumerate(TEXTS)] + [(None, "null id", 0), (100, "same id", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(4)
    folder = shared_folder(spark, "test-tokens")
    write_tokens(docs, folder, PATH, block_ids=64)
    plain = Tokenizer.from_file(PATH)
    want = [(i, plain.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    got = sorted(read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == want
    assert [r.start for r in got] == np.cumsum([0] + [len(x) for _, x in want])[:-1].tolist()
    digests = sorted(read_digests(spark, folder).collect(), key=lambda r: r.start)
    assert [(r.n_tokens, r.ids_crc32) for r in digests] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for _, x in want]


def test_empty_table(spark):
    folder = shared_folder(spark, "test-tokens")
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder, PATH)
    assert read_digests(spark, folder).count() == 0


@pytest.mark.parametrize("path,space_led", [(PATH, True), (WORD_PATH, False)])
def test_letters_that_normalise_to_several_matches(path, space_led):
    plain, encoder = Tokenizer.from_file(path), PieceEncoder(path, space_led, special=True)
    for word in ("İstanbul", "क़म", "יִיִ", "xİ"):
        for text in (word, f"a {word} b", f"in {word}, {word}. {word}", f"a b\n{word}"):
            assert encoder.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, text
