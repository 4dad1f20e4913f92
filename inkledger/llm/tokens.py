"""Encoding of whole notes with a tokenizer file, at the speed of a word cache.

A byte-level tokenizer splits before every space that a visible character follows, so a
note's ids are the ids of its space-led words in turn. Each Python worker keeps the ids of
the words it has met; only new words reach the tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import regex

# A worker remembers at most this many words; later new ones are encoded each time.
CACHED_WORDS = 350_000
# Longer words are not remembered.
CACHED_CHARS = 64

_BLANK_RUN = re.compile(r" \s")
_SAFE_CUT = re.compile(r" (?=\S)")
# Below this code point all libraries agree on what a letter is.
_SETTLED = "ɐ"
# Words by which a pattern is asked how it treats letters and stops.
_LETTERS = ("a", "s", "ll", "word", "Word", "WORD", "wORd", "élan", "dÉjà", "ªº")
_STOPS = ".,;:!?"


def _shown_bytes() -> dict[int, int]:
    """Byte -> the visible character that byte-level vocabularies write for it.

    Printable characters of Latin-1 stand for themselves, the rest for those from 256 on.
    """
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20,)]
    hidden = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(hidden)}


_SHOWN = _shown_bytes()


class _Pieces(dict):
    """Piece -> packed ids, by the tokenizer."""

    def __init__(self, encode_piece, encode):
        super().__init__()
        self.encode_piece, self.encode = encode_piece, encode

    def __missing__(self, piece: str) -> bytes:
        packed = self.encode_piece(piece)
        if len(self) < CACHED_WORDS and len(piece) <= CACHED_CHARS:
            self[piece] = packed
        return packed


class _Words(dict):
    """Word, without the ``lead`` before it -> packed ids."""

    def __init__(self, lead: str, pieces: _Pieces, find_pieces):
        super().__init__()
        self.lead, self.pieces, self.find_pieces = lead, pieces, find_pieces
        # Most patterns take letters whole and leave a stop behind them apart; this one is asked.
        self.whole = all(find_pieces(lead + w) == [lead + w] for w in _LETTERS) and all(
            find_pieces(lead + w + stop) == [lead + w, stop] for w in _LETTERS for stop in _STOPS)

    def __missing__(self, word: str) -> bytes:
        text = self.lead + word
        if self.whole and word.isalpha() and (word.isascii() or max(word) < _SETTLED):
            packed = self.pieces.encode_piece(text)
        elif self.whole and word[-1:] in _STOPS and word[:-1].isalpha() and max(word) < _SETTLED:
            packed = self[word[:-1]] + self.pieces[word[-1]]
        elif text and (text.isascii() or max(text) < _SETTLED):
            packed = b"".join(map(self.pieces.__getitem__, self.find_pieces(text)))
        else:
            packed = self.pieces.encode(text)
        if len(self) < CACHED_WORDS and len(word) <= CACHED_CHARS:
            self[word] = packed
        return packed


class NoteEncoder:
    """Whole notes to packed little-endian ids (``dtype``) of a byte-level tokenizer file."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # cores belong to Spark's tasks
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings are ordinary text in a note
        dtype = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

        def encode(text: str) -> bytes:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype).tobytes()

        merge, code, blank = tokenizer.model.tokenize, "H" if dtype.itemsize == 2 else "I", chr(_SHOWN[0x20])

        def encode_piece(piece: str) -> bytes:
            """A match of the pattern goes straight to the tokenizer's merges."""
            if piece.isascii() and piece.isprintable():
                shown = piece.replace(" ", blank)
            else:
                shown = piece.encode().decode("latin-1").translate(_SHOWN)
            return array(code, [t.id for t in merge(shown)]).tobytes()

        pieces, find = _Pieces(encode_piece, encode), regex.compile(pattern).findall
        self.dtype = dtype
        self._first, self._spaced = _Words("", pieces, find), _Words(" ", pieces, find)

    def packed(self, note: str) -> bytes:
        words = _SAFE_CUT.split(note) if _BLANK_RUN.search(note) else note.split(" ")
        first = self._first[words[0]]
        return first + b"".join(map(self._spaced.__getitem__, words[1:]))


_ENCODERS: dict[tuple[str, str], NoteEncoder] = {}


def encoder(path: str, pattern: str) -> NoteEncoder:
    """The worker's encoder for a tokenizer file."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = NoteEncoder(path, pattern)
    return _ENCODERS[path, pattern]
