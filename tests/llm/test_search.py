import numpy as np
import pytest

from parley.llm import search

INF = float("inf")


def brute(vectors, every, k):
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in good:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in sorted(queries.items()):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_random_vectors_match_brute_force(spark, monkeypatch):
    for name, value in (("QUERY_ROWS", 3), ("BLOCK_ROWS", 7), ("CELL_BLOCKS", 2), ("TOGETHER", 2)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(1)
    dense = [(int(i), [float(x) for x in rng.integers(-3, 4, 5) / 16]) for i in range(60)]
    sparse = [(100 + int(i), [float(x) * (rng.random() < 0.3) for x in rng.normal(size=rng.integers(0, 9))]) for i in range(40)]
    vectors = dense + sparse
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert rows(search.search(df, 5, 4)) == brute(vectors, 5, 4)


def test_nulls_repeats_and_ties(spark):
    vectors = [(0, [1.0, 0.5]), (0, [0.5, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [INF, 1.0]), (None, [9.0, 9.0]), (6, [0.0, 0.0]), (7, []), (9, [1.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "1 AS x", "1 AS block")
    assert rows(search.search(df, 5, 3)) == sorted(brute(vectors, 5, 3))


def test_empty_and_single(spark):
    df = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert search.search(df).count() == 0
    assert search.search(df.where("false")).count() == 0


def test_scores_beyond_64_bits_are_refused():
    big = (np.array([1]), np.array([0, 1]), np.array([0], np.int32), np.array([1 << 40]))
    other = (np.array([2]), *big[1:])
    with pytest.raises(ValueError):
        search.top_of_block(big, other, 1)
    # terms that cancel out: the bound leaves 64 bits, the score does not
    one = (np.array([1]), np.array([0, 2]), np.array([0, 1], np.int32), np.array([1 << 40, 1 << 40]))
    two = (np.array([2]), np.array([0, 2]), np.array([0, 1], np.int32), np.array([1 << 40, 7 - (1 << 40)]))
    assert [x.tolist() for x in search.top_of_block(one, two, 1)] == [[1], [2], [7 << 40]]


def test_large_components(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.integers(-30_000, 30_000, 64)]) for i in range(40)] + [(100, [1e5] * 64)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert rows(search.search(df, 10, 5)) == brute(vectors, 10, 5)
