"""Tests of the third round's findings on the corpus operators."""

import numpy as np

from chronoloom.llm import partenum

U = np.uint64


def test_a_small_set_blinds_no_large_ones(spark):
    """large sets that share nothing are no candidates, even if a small set is in their block; alike ones are."""
    rng = np.random.default_rng(3)
    large = [np.unique(rng.integers(0, 1 << 63, 3000).astype(U)) for _ in range(20)]
    near = large[0].copy()
    near[:150] = np.unique(rng.integers(0, 1 << 63, 150).astype(U))
    sets = [np.arange(1, 30, dtype=U), *large, near]
    drawn = spark.createDataFrame([(i, len(v), bytearray(partenum.sketch(v))) for i, v in enumerate(sets)], "key bigint, n_shingles bigint, sketch binary")
    members = spark.createDataFrame([(7, i) for i in range(len(sets))], "a bigint, b bigint")
    labels = spark.createDataFrame([(i, i) for i in range(len(sets))], "b bigint, root bigint")
    assert [tuple(r) for r in partenum.across(members, labels, drawn, 80).collect()] == [(1, len(sets) - 1)]
