"""The depth at which texts are compared goes by all neighbours of the forest."""

import numpy as np

from meshwork.llm import jaccard_join
from meshwork.llm.scratch import Scratch


def test_depth_is_reckoned_from_all_neighbours(spark, monkeypatch):
    rng, pairs = np.random.default_rng(7), 5000
    one = rng.integers(0, 2**16, (pairs, 256)).astype(np.uint16)
    other = one.copy()
    other[:, 128:160] ^= 1  # 224 of 256 values agree, whole trees among them
    rows = [(i, bytearray(x.tobytes())) for i, x in enumerate(np.concatenate([one, other]))]
    seen = []

    def spy(similarity, *how):
        seen.append((dict(zip(similarity.tolist(), how[5].tolist(), strict=True)) if len(how) > 5 else len(similarity), shortened(similarity, *how)))
        return seen[-1][1]

    shortened = jaccard_join.shortened
    monkeypatch.setattr(jaccard_join, "shortened", spy)
    scratch = Scratch(spark, "depth")
    got = jaccard_join.candidates(spark.createDataFrame(rows, "k long, labels binary"), 0.8, 32, 8, 0.9999, scratch)
    assert got.groupBy("root").count().where("count = 2").count() == pairs
    assert seen == [({224 / 256: pairs}, seen[0][1])]
    # as many rows of the same kind, counted or listed, make the same depth
    some = rng.choice([0.8, 0.9, 0.97], 400)
    kinds, many = np.unique(some, return_counts=True)
    assert shortened(kinds, 0.8, 32, 8, 6, 0.9999, many) == shortened(some, 0.8, 32, 8, 6, 0.9999)
