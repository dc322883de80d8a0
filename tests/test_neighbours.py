"""Nearest neighbours over k-d cells against all distances, and how many cells a query visits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import neighbours as N


def frames(spark, points, queries):
    trained = spark.createDataFrame([([float(v) for v in p], i, i % 2) for i, p in enumerate(points)], "z array<double>, seq long, target int")
    trained = trained.groupBy("z").agg(F.min("seq").alias("seq"), F.min_by("target", "seq").alias("target"))
    asked = spark.createDataFrame([([float(v) for v in q],) for q in queries], "z array<double>").distinct()
    return trained, asked


def brute(points, queries):
    out = {}
    for q in queries:
        d2 = np.zeros(len(points))
        for j in range(points.shape[1]):
            d2 = d2 + (points[:, j] - q[j]) ** 2
        out[tuple(q)] = int(d2.argmin())
    return out


def found(best):
    return {tuple(r["z"]): r["seq"] for r in best.collect()}


@pytest.fixture(autouse=True)
def small_cells(monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 40)
    monkeypatch.setattr(N, "ASKED_ROWS", 25)
    monkeypatch.setattr(N, "PIECE", 500)


def test_clusters_ties_and_far_queries(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(600, 3)) * [1, 10, 0.1], np.rint(rng.normal(size=(600, 3)) * 2), np.repeat(rng.normal(size=(3, 3)), 60, axis=0)])
    queries = np.concatenate([rng.normal(size=(120, 3)) * 3, np.rint(rng.normal(size=(60, 3)) * 2), [[1e6, 0, 0], [-50, 50, 0]], points[:20]])
    best, beyond = N.searched(*frames(spark, points, queries), 3)
    assert found(best) == brute(points, queries)
    assert beyond.count() < 15 * len(queries)


@pytest.mark.parametrize("axis", [0, 1])
def test_a_coordinate_with_one_value_costs_nothing(spark, axis):
    rng = np.random.default_rng(2)
    points, queries = rng.normal(size=(4000, 2)), rng.normal(size=(300, 2))
    points[:, axis] = queries[:, axis] = 7.0
    best, beyond = N.searched(*frames(spark, points, queries), 2)
    assert found(best) == brute(points, queries)
    assert beyond.groupBy("z").count().agg(F.max("count")).first()[0] <= 4 and beyond.count() < len(queries)


def test_cells_are_bounded_even_where_one_value_is_frequent():
    rng = np.random.default_rng(3)
    sample = np.column_stack([np.where(rng.random(1600) < 0.9, 0.0, rng.normal(size=1600)), rng.normal(size=1600)])
    tree, cells = N.tree_of(sample, 100)
    sizes = np.bincount(tree.cells(sample), minlength=cells)
    assert 60 <= cells <= 100 and sizes.min() > 0 and sizes.max() <= 120


def test_one_vector_and_one_query(spark):
    best, beyond = N.searched(*frames(spark, np.zeros((5, 2)), np.ones((1, 2))), 2)
    assert found(best) == {(1.0, 1.0): 0} and beyond.count() == 0


def test_rows_come_back_with_the_target(spark):
    train = spark.createDataFrame([(i, float(i % 50), float(i % 7), i % 2) for i in range(500)], "i long, a double, b double, target int")
    df = spark.createDataFrame([(i, float(i % 60), 1.5) for i in range(90)], "i long, a double, b double")
    got = N.nearest(df, train, ["a", "b"], "i")
    assert got.count() == 90 and got.filter("near_target IS NULL").count() == 0
