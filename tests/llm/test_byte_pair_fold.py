"""The fold of op2 against the heap's merges, piece by piece."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from inkledger.llm import bytepair

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_fold_equals_the_heap_and_searches_no_place(spark):
    """Pieces of 1 to 256 bytes; a part's place stands in the state and is not searched."""
    draw, ids, pairs = np.random.default_rng(5), bytepair._byte_ids(RANKS), bytepair.pair_ranks(RANKS)
    words = [b" anderstntwh", b" einachauen", b"aaaaaaaaaaaaaaaa", b" the the", "ñíöß ü".encode()]
    words += [bytes(draw.integers(0, 256, n).tolist()) for n in range(1, 256, 15)]
    words += [bytes(draw.choice(list(b" etaoinsrh"), n).tolist()) for n in [*range(1, 40), 256]]
    codes = [[ids[b] for b in word] for word in words]
    table = spark.createDataFrame(list(enumerate(codes)), "k int, codes array<int>")
    folded = bytepair.fold_merges(F.col("codes"), RANKS)
    got = dict(table.select("k", folded).collect())
    assert got == {k: bytepair.merge_long(c, pairs) for k, c in enumerate(codes)}
    assert "array_position" not in str(folded)
