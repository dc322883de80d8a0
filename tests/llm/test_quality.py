import zlib

import numpy as np
import pytest

from parley.llm import quality


def walked(forest, row):
    """One row down one tree after the other, node by node."""
    total = forest.start
    for root in forest.roots.tolist():
        node = root
        while forest.left[node] != node:
            node = forest.left[node] + int(row[forest.feature[node]] > forest.cut[node])
        total += forest.value[node]
    return total


def test_flat_arrays_give_what_a_plain_walk_gives():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 6))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] * x[:, 1] > 0)).astype(float)
    forest = quality.grow(x[:500], y[:500], np.ones(500), x[500:], y[500:], np.ones(200))
    got = forest.margins(x)
    assert np.allclose(got, [walked(forest, r) for r in x])
    assert ((got[500:] > 0) == (y[500:] == 1)).mean() > 0.9


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(7)
    x = np.rint(4 * rng.normal(size=(200, 3)))
    y = (x[:, 1] + rng.normal(size=200) > 1).astype(float)
    w = rng.uniform(0.5, 2, 200)
    forest = quality.grow(x, y, w, x, y, w)
    p = np.average(y, weights=w)
    g, h = w * (p - y), w * p * (1 - p)

    def gain(f, c):
        left = x[:, f] <= c
        if min(w[left].sum(), w[~left].sum()) < quality.LEAST_WEIGHT:
            return 0.0
        return sum(g[s].sum() ** 2 / (h[s].sum() + quality.PENALTY) for s in (left, ~left))

    every = {(f, c): gain(f, c) for f in range(3) for c in (np.unique(x[:, f])[:-1] + np.unique(x[:, f])[1:]) / 2}
    root = forest.roots[0]
    assert gain(forest.feature[root], forest.cut[root]) == pytest.approx(max(every.values()))


def test_features_of_any_text():
    for text in ["", " ", "\n\n", "a", "é", "\x00", "!!! ???", "x" * 100_000, "word " * 50_000, "一二三\n四五六", "A B C"]:
        row = quality.features(text)
        assert len(row) == len(quality.FEATURES) and np.isfinite(row).all()
    named = dict(zip(quality.FEATURES, quality.features("the the THE x,%% end.\nthe the THE x,%% end."), strict=True))
    assert named["distinct_lines"] == 0.5 and named["words"] == pytest.approx(np.log1p(10)) and named["odd_end"] == 0.2 and named["shouted"] == 0.2


@pytest.fixture(scope="module")
def large(spark):
    folder = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_held_out_accuracy(spark, large):
    documents, labels = large
    rows = quality.classify(documents, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(rows) > 700
    good = rows["quality"] == 1
    assert (rows["predicted"] == rows["quality"]).mean() > 0.97
    assert rows.loc[good, "predicted"].mean() > 0.97 and rows.loc[~good, "predicted"].mean() < 0.1
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in rows["doc_id"])


def test_labels_held_out_and_ids_are_no_input(spark, documents, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    base = {r.doc_id: r.score for r in quality.classify(documents, labels).collect()}
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    assert {r.doc_id: r.score for r in quality.classify(documents, flipped).collect()} == base
    other = documents.selectExpr("doc_id", "text", "'x' AS lang", "reverse(source) AS source", "0L AS n_chars")
    assert {r.doc_id: r.score for r in quality.classify(other.repartition(3), labels).collect()} == base


def test_odd_rows(spark, odd, empty, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.classify(odd, spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 0, 1), (6, 1, 0), (6, 0, 0), (7, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    same = [r.score for r in rows if r.doc_id in (1, 2)]
    assert len(set(same)) == 1
    assert quality.classify(empty, labels).count() == 0
    only = quality.classify(odd, labels.where("quality = 1"))
    assert {r.score for r in only.collect()} == {1.0}
    assert {r.score for r in quality.classify(odd, labels.where("false")).collect()} == {0.0}
