import numpy as np
import pytest

from parley.llm import negatives

INF = float("inf")


def brute(rows, every, n_pos, n_neg, least, most):
    good = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, label, v in good:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, other) for i, other, w in good if i != a)
        for place, (s, i, _) in enumerate([x for x in scored if x[2] == label][:n_pos]):
            fit = [(n, j) for n, j, other in scored if other != label and least * -s <= 100 * -n <= most * -s]
            out += [(a, i, r + 1, j, -s, -n, place + 1) for r, (n, j) in enumerate(fit[:n_neg])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def small(monkeypatch):
    for name, value in (("BLOCK_ROWS", 64), ("CHUNK_BLOCKS", 1), ("CELL_BLOCKS", 2), ("TOGETHER", 3), ("HELD", 20), ("CELLS", 1), ("REFERENCES", 4)):
        monkeypatch.setattr(negatives, name, value)


def test_clusters_match_brute_force(spark, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(3)), (centres[i % 6] + 0.4 * rng.normal(size=8)).tolist()) for i in range(500)]
    rows += [(500 + i, i % 3, centres[0].tolist()) for i in range(100)]  # many equal vectors: ties go by id
    rows += [(600 + i, i % 2, [float(x) for x in rng.integers(-2, 3, rng.integers(0, 6))]) for i in range(60)]
    assert found(negatives.mine(frame(spark, rows), 7)) == brute(rows, 7, 5, 10, 30, 90)


def test_nulls_repeats_and_odd_vectors(spark, monkeypatch):
    small(monkeypatch)
    rows = [(0, 1, [1.0, 0.5]), (0, 0, [0.5, 1.0]), (100, 1, [0.0, 0.0]), (200, 2, [-1.0, -1.0]), (300, 1, None), (400, None, [1.0, 1.0]), (500, 1, [None, 1.0]), (None, 1, [1.0, 1.0])]
    rows += [(1, 0, [1.0, 1.0])] * 3 + [(2, 1, [0.5, 0.5])] * 3 + [(3, 1, [float("nan"), 1.0]), (4, 1, [INF, 1.0]), (5, 2, []), (6, 2, [0.3]), (7, 1, [0.0, 0.0]), (8, 0, [0.0]), (600, 3, [1.0, 1.0])]
    df = frame(spark, rows).selectExpr("*", "1 AS score", "1 AS x", "1 AS `at`", "1 AS Vec_ID_2")
    assert found(negatives.mine(df)) == brute(rows, 100, 5, 10, 30, 90)


def test_empty_single_and_all_zero(spark):
    assert negatives.mine(frame(spark, []).where("false")).count() == 0
    assert negatives.mine(frame(spark, [(100, 1, [1.0])])).count() == 0
    rows = [(i, i % 2, [0.0, 0.0]) for i in range(0, 300, 20)]
    assert found(negatives.mine(frame(spark, rows))) == brute(rows, 100, 5, 10, 30, 90)


def test_large_components(spark):
    rows = [(0, 0, [3e4] * 64), (1, 0, [2.9e4] * 64), (2, 1, [2e4] * 64), (3, 1, [1e4 + 0.1] * 64), (100, 1, [1e6] * 3)]
    assert found(negatives.mine(frame(spark, rows))) == brute(rows, 100, 5, 10, 30, 90)
    big = np.array([[1 << 40]])
    with pytest.raises(ValueError):
        negatives.products(big, big)
    assert negatives.products(np.array([[1 << 40, 1]]), np.array([[1 << 20, 1]])).tolist() == [[(1 << 60) + 1]]


def test_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(5)
    centres = np.rint(200 * rng.normal(size=(12, 16)))
    x = np.rint(centres[np.repeat(np.arange(12), 50)] + 5 * rng.normal(size=(600, 16))).astype(np.int64)
    refs = centres[:8] / np.linalg.norm(centres[:8], axis=1, keepdims=True)
    norms, angles = negatives.measured(x, refs)
    low, high = negatives.bounds(angles[::7], norms[::7], angles, angles, norms, norms)
    score = x[::7] @ x.T
    assert (low <= score).all() and (score <= high).all()
    ids, labels = np.arange(600), np.arange(600) // 50

    def rows(sel, **more):
        out = object.__new__(negatives.Rows)
        out.ids, out.labels, out.x, out.norms, out.angles = ids[sel], labels[sel], x[sel], norms[sel], angles[sel]
        return out

    anchors, best, scored = rows(slice(0, 600, 7)), negatives.Best(86, 5), 0
    whole = np.iinfo(np.int64)
    open_low, open_high = np.full((86, 1), whole.max // 2), np.full((86, 1), whole.max)
    for i in range(12):
        scored += negatives.meet(anchors, rows(slice(50 * i, 50 * i + 50)), best, open_low, open_high, False)
    assert scored == 0  # no bound reaches such a window
