"""Inverted lists against the search of all blocks: equal results, fewer pairs where vectors cluster."""

import numpy as np
import pytest

from tidemark.operators import similarity


@pytest.mark.parametrize("kind, n", [("clustered", 6000), ("spread", 1500), ("ties", 400), ("few", 3)])
def test_lists_give_what_blocks_give(spark, monkeypatch, kind, n):
    """Rows that repeat each other, fewer rows than neighbours, several blocks, vectors of any length."""
    monkeypatch.setattr(similarity, "ROWS", 700)
    r = np.random.default_rng(n)
    if kind == "clustered":
        x = r.normal(size=(40, 16))[r.integers(0, 40, n)] * 3 + 0.2 * r.normal(size=(n, 16))
    elif kind == "ties":
        x = r.integers(-1, 2, size=(n, 4)) + np.array([0.5, 0, 0, 0])
    else:
        x = r.normal(size=(n, 16))
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x * 7)], "vec_id long, embedding array<double>").cache()
    queries = df.where("vec_id % 20 = 0")
    want = sorted(map(tuple, similarity.cosine_top(df, queries).select("query_id", "vec_id", "cosine", "rank").collect()))
    result, first, pairs = similarity.cosine_top_listed(df, queries)
    assert sorted(map(tuple, result.select("query_id", "vec_id", "cosine", "rank").collect())) == want
    if kind == "clustered":
        share = pairs.agg({"pairs": "sum"}).first()[0] / (queries.count() * n)
        found = {(a, b) for a, b, *_ in want} & {(q.query_id, q.vec_id) for q in first.collect()}
        assert share < 0.2 and len(found) / len(want) >= 0.9


def test_keys_keep_the_best_pairs_only():
    """What a question holds is its best pairs by cosine, the lesser place of equals, whatever it was compared with."""
    r = np.random.default_rng(2)
    cosine = np.round(r.uniform(-1, 1, (30, 4000)), 2)
    cosine[:, 7] = np.nan
    place = r.permutation(4000)
    kept = np.full((30, 50), similarity.NONE)
    for j in range(0, 4000, 300):
        kept = similarity.largest(np.concatenate([kept, similarity.rank_keys(cosine[:, j : j + 300], place[j : j + 300])], axis=1), 50)
        assert kept.shape == (30, 50)
    got = [sorted(zip(-c, p)) for c, p in map(similarity.ranked, kept)]
    assert got == [sorted((-c, p) for c, p in zip(line, place) if c == c)[:50] for line in cosine]
    assert similarity.NONE > similarity.rank_keys(np.array([np.nan]), np.array([0]))[0] and similarity.NONE < similarity.rank_keys(np.array([-1.0]), np.array([2**31]))[0]
