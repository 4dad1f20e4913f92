"""Longest repeats of words, against comparing all pairs of places."""

from __future__ import annotations

import numpy as np
import pytest

from inkledger.llm.repetition import repeated_spans


def plain(words, doc, least):
    longest = np.zeros(len(words), int)
    for i in range(len(words)):
        for j in range(len(words)):
            k = 0
            while (i != j and max(i, j) + k < len(words) and doc[i + k] == doc[j + k] == doc[i] == doc[j]
                   and words[i + k] == words[j + k]):
                k += 1
            longest[i] = max(longest[i], k)
    return np.where(longest >= least, longest, 0)


@pytest.mark.parametrize("seed", range(12))
def test_repeats_that_part_at_different_words(seed):
    """Three to five repeats share 16 to 40 words and part within the next seven, in two notes."""
    draw = np.random.default_rng(seed)
    words, doc = [], []
    for note in range(2):
        shared = draw.integers(1000, 2000, 60)
        for copy in range(draw.integers(3, 6)):
            part = [*shared[:draw.integers(16, 41)], *draw.integers(0, 6, draw.integers(1, 8)), 5000 + copy]
            words += part
            doc += [note] * len(part)
    ids, doc = np.unique(words, return_inverse=True)[1], np.array(doc)
    assert (repeated_spans(ids, doc, 8) == plain(ids, doc, 8)).all()


def test_no_words_and_one_word_over_and_over():
    assert len(repeated_spans(np.zeros(0, int), np.zeros(0, int), 8)) == 0
    same = np.zeros(70, int)
    assert (repeated_spans(same, same, 8) == plain(same, same, 8)).all()
