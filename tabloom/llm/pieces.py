"""Encode whole texts with the tokenizers library, at most once per distinct piece and worker.

A text is cut only where both sides are encoded independently of each other, so the ids of its pieces
in a row are the ids of the whole text.  Pieces met first are kept in a table of bounded size; prose
repeats its words, so most pieces are looked up.  A new piece goes through the tokenizer itself.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

#: A worker keeps at most so many words and so many pieces (about 70 MB each).
MAX_KEPT = 400_000

#: White space other than the plain space and the line feed.
RARE_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def spaces_stand_alone(text: str) -> bool:
    """True if no other white space stands beside any space, as far as a quick look can tell."""
    return not ("  " in text or " \n" in text or "\n " in text or any(c in text for c in RARE_SPACE))


def _byte_chars() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself if it prints, else as the next free character from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_CHARS = _byte_chars()


class Kept(dict):
    """Values of ``make(key)``; stops keeping new ones at the limit."""

    def __init__(self, make, limit: int = MAX_KEPT):
        super().__init__()
        self._make, self._limit = make, limit

    def __missing__(self, key):
        value = self._make(key)
        if len(self) < self._limit:
            self[key] = value
        return value


class PieceEncoder:
    """``encode(text)`` gives the ids of a text as an unsigned 32-bit array.

    ``space_led``: a byte-level vocabulary, where a single space opens the match after it.  Otherwise
    white space is dropped by the vocabulary and any space or line feed is a safe cut.  With ``special`` the
    strings of special tokens in a text become these tokens, as in the library's own ``encode``; otherwise they
    are ordinary text.  They hold no white space, so they lie within a piece.
    """

    def __init__(self, path: str, space_led: bool, special: bool = False, limit: int = MAX_KEPT, pieces: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not special
        self._space_led = space_led
        self._lead = " " if space_led else ""
        self._merge, self._normalizer = self._tokenizer.model.tokenize, self._tokenizer.normalizer
        self._words, self._marks = Kept(self._word_ids, limit), Kept(self._all_ids, 3)
        self._pieces = Kept(self._piece, pieces or limit)

    def _all_ids(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bool:
        """True if the word is letters alone, normalised as well: a normaliser may turn a letter into a letter and a mark."""
        return word.isalpha() and (self._normalizer is None or word.isascii() or self._normalizer.normalize_str(word).isalpha())

    def _word_ids(self, word: str) -> bytes:
        """A word of letters, with the space before it or not, is one match: only normaliser and merges are needed."""
        if self._normalizer is not None:
            word = word.lower() if word.isascii() else self._normalizer.normalize_str(word)
        return array("I", [t.id for t in self._merge(word.encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Letters, one full stop or comma after them and one line feed after that are separate matches."""
        before, feed, after = piece.partition("\n")
        if feed:
            return self._piece(before) + self._marks[feed] + self._words[after] if self._letters(after) and before else self._all_ids(self._lead + piece)
        if self._letters(piece):
            word = self._lead + piece
            return self._words.get(word) or self._word_ids(word)  # kept as a piece
        if piece[-1:] in (".", ",") and self._letters(piece[:-1]):
            return self._words[self._lead + piece[:-1]] + self._marks[piece[-1]]
        return self._all_ids(self._lead + piece)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self._space_led:
            return b"".join(map(self._pieces.__getitem__, text.replace("\n", " ").split(" ")))
        if not spaces_stand_alone(text):
            return self._all_ids(text)
        head, *rest = text.split(" ")
        return self._all_ids(head) + b"".join(map(self._pieces.__getitem__, rest))

    def encode_word(self, word: str) -> bytes:
        """The ids of a space and a word."""
        return self._pieces[word]

    def encode_words(self, words: list[str]) -> bytes:
        """The ids of each word with a space before it, in a row."""
        return b"".join(map(self._pieces.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")


_ENCODERS: dict = {}


def encoder(path: str, space_led: bool, special: bool = False, pieces: int = MAX_KEPT) -> PieceEncoder:
    """One encoder per vocabulary and worker process."""
    key = path, special, pieces
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, space_led, special, pieces=pieces)
    return _ENCODERS[key]
