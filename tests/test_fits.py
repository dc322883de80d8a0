"""Iterative fits: they learn what is there to learn, and end where a plain computation ends."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import fits
from parley.operators import joins as J
from parley.operators import metrics as E
from parley.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for i in range(400):
        y = rng.randrange(2)
        data.append((i, y, y * 2 + rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(4)), "accept" if y else "decline", "red" if rng.random() < 0.5 + 0.3 * y else "blue", 3.0 * y + rng.gauss(0, 0.1)))
    df = spark.createDataFrame(data, "i long, target int, a double, b double, c double, label string, colour string, label_num double")
    return df.filter("i < 300"), df.filter("i >= 300")


def test_two_state_and_forward_select_beat_the_base_rate(rows):
    train, dev = rows
    base = E.score_binary(M.predict_base_rate(dev, train)).first()["log_loss"]
    assert E.score_binary(M.predict_two_state(dev, train, ["a", "b", "c"])).first()["log_loss"] < base
    chosen, scored = M.forward_select(train, dev, ["a", "b", "c"], max_terms=2, limit=4)
    assert "a" in chosen[0] and E.score_binary(scored).first()["log_loss"] < base


def test_glm_and_ridge(rows):
    train, dev = rows
    pred = M.predict_glm(dev, train, ["accept", "decline"], ["a", "b"], ["colour"])
    out = E.score_multiclass(pred, ["accept", "decline"]).first()
    assert out["accuracy"] > 0.75 and out["log_loss"] < 0.6
    assert E.score_regression(M.predict_ridge(dev, train, ["a", "b"], ["colour"])).first()["rmse"] < 1.2


def test_calibrators(rows):
    train, _ = rows
    pred = train.select("i", "target", F.round(1 / (1 + F.exp(-F.col("a"))), 2).alias("p"))
    before = E.score_binary(pred).first()["log_loss"]
    for fit in (M.platt, M.isotonic):
        out = fit(pred)
        assert E.score_binary(out.withColumn("p", F.col("calibrated"))).first()["log_loss"] < before
    steps = M.isotonic(pred).select("p", "calibrated").distinct().orderBy("p").toPandas()["calibrated"]
    assert steps.is_monotonic_increasing


def test_bootstrap_is_reproducible(spark):
    df = spark.range(500).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "accept").otherwise("decline").alias("label"), F.create_map(F.lit("accept"), F.lit(0.4)).alias("probabilities")
    )
    a = E.bootstrap_brier(df, "accept", "id").first()
    b = E.bootstrap_brier(df.repartition(5), "accept", "id").first()
    true = (167 * 0.36 + 333 * 0.16) / 500
    assert abs(a["mean_brier"] - true) < 0.005 and a["low"] < true < a["high"]
    assert abs(a["mean_brier"] - b["mean_brier"]) < 1e-12


def design_matrix(rows, numeric, categorical, scales, levels):
    """Intercept, standardised numbers and one column for each trained level, row by row."""
    out = []
    for r in rows:
        line = [1.0] + [((r[x] or 0.0) - m) / s for x, (m, s) in zip(numeric, scales)]
        line += [1.0 if (r[name] if r[name] is not None else "missing") == level else 0.0 for name, level in levels]
        out.append(line)
    return np.array(out)


@pytest.fixture(scope="module")
def mixed(spark):
    """Numbers with gaps, a hot level, a level that only development has, three labels."""
    rng = random.Random(11)
    data = []
    for i in range(600):
        colour = "red" if rng.random() < 0.4 else rng.choice(["blue", "green", None, f"c{i % 9}"])
        a = rng.gauss(0, 2) if rng.random() < 0.9 else None
        score = (a or 0) + (1 if colour == "red" else 0) + rng.gauss(0, 1)
        data.append((i, a, float(rng.randrange(5)), colour if i < 450 or i % 7 else "new", rng.choice("xy"), "accept" if score > 1 else "counter" if score > -1 else "decline", score, int(score > 0)))
    df = spark.createDataFrame(data, "i long, a double, b double, colour string, kind string, label string, label_num double, target int")
    return df.filter("i < 450").repartition(7), df.filter("i >= 450")


def test_ridge_solves_the_normal_equations(mixed):
    train, dev = mixed
    how, fit = M.fit_ridge(train, ["a", "b"], ["colour", "kind"], 0.05)
    levels = [(r["name"], r["level"]) for r in how.levels.orderBy("place").collect()]
    assert levels == sorted(levels) and len(levels) == how.width - 3
    x = design_matrix(train.collect(), ["a", "b"], ["colour", "kind"], how.scales, levels)
    y = np.array([r["label_num"] for r in train.collect()])
    want = np.linalg.solve(x.T @ x / len(y) + np.diag([0.0] + [0.05] * (how.width - 1)), x.T @ y / len(y))
    assert np.allclose(fit, want, atol=1e-9)
    got = {r["i"]: r["prediction"] for r in M.predict_ridge(dev, train, ["a", "b"], ["colour", "kind"]).collect()}
    rows = dev.collect()
    assert np.allclose([got[r["i"]] for r in rows], design_matrix(rows, ["a", "b"], ["colour", "kind"], how.scales, levels) @ want, atol=1e-9)
    named = {(r["name"], r["level"]): r["coefficient"][0] for r in how.frame(fit[:, None]).collect()}
    assert named["intercept", None] == pytest.approx(want[0]) and named[levels[0]] == pytest.approx(want[3])


def test_multinomial_gradient_vanishes(mixed):
    train, dev = mixed
    labels = ["accept", "counter", "decline"]
    how, fit = M.fit_glm(train, labels, ["a", "b"], ["colour", "kind"], 0.05)
    rows = train.collect()
    levels = [(r["name"], r["level"]) for r in how.levels.orderBy("place").collect()]
    x = design_matrix(rows, ["a", "b"], ["colour", "kind"], how.scales, levels)
    y = np.array([[r["label"] == k for k in labels] for r in rows], float)
    margin = x @ fit.T
    p = np.exp(margin - margin.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    weight = np.array([0.0] + [0.05] * (how.width - 1))
    assert np.abs((p - y).T @ x / len(y) + weight * fit).max() < 1e-6
    assert abs(fit[:, 0].sum()) < 1e-9
    scored = M.predict_glm(dev, train, labels, ["a", "b"], ["colour", "kind"]).collect()
    assert all(abs(sum(r["probabilities"].values()) - 1) < 1e-9 for r in scored) and len(scored) == dev.count()


def test_fits_of_nothing(spark, mixed):
    train, dev = mixed
    none = train.filter("false")
    assert M.predict_ridge(dev, none, ["a"], ["colour"]).agg(F.sum("prediction")).first()[0] == 0
    assert M.predict_glm(dev, none, ["accept", "decline"], ["a"], []).count() == dev.count()
    assert M.isotonic(none.withColumn("p", F.lit(0.5))).count() == 0
    wide = spark.range(fits.WIDEST + 5).selectExpr("CAST(id AS STRING) AS colour", "1.0D AS a", "1.0D AS label_num")
    with pytest.raises(ValueError):
        M.fit_ridge(wide, ["a"], ["colour"])


def test_platt_gradient_vanishes(mixed):
    train, _ = mixed
    pred = train.withColumn("p", 1 / (1 + F.exp(-F.coalesce("a", F.lit(0.0)) * 3)))
    rows = M.platt(pred).collect()
    q = np.clip([r["p"] for r in rows], 1e-6, 1 - 1e-6)
    margin = np.log(q / (1 - q))
    error = np.array([r["calibrated"] - r["target"] for r in rows])
    assert abs(error.mean()) < 1e-8 and abs((error * margin).mean()) < 1e-8


def test_isotonic_equals_the_max_min_formula(spark, many_segments):
    rng = random.Random(5)
    data = [(i, round(rng.random() ** 2, 2), int(rng.random() < 0.5)) for i in range(400)] + [(1000 + i, 0.25, i % 2) for i in range(300)]
    pred = spark.createDataFrame(data, "i long, p double, target int")
    got = {r["i"]: r["calibrated"] for r in M.isotonic(pred).collect()}
    places = sorted({p for _, p, _ in data})
    total = [sum(y for _, q, y in data if q == p) for p in places]
    weight = [sum(1 for _, q, _ in data if q == p) for p in places]
    n = len(places)
    mean = {(a, b): sum(total[a : b + 1]) / sum(weight[a : b + 1]) for a in range(n) for b in range(a, n)}
    fit = [max(min(mean[a, b] for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    assert all(got[i] == pytest.approx(fit[places.index(p)]) for i, p, _ in data)
    points = pred.groupBy("p").agg(F.sum("target").alias("s"), F.count("*").alias("w"))
    pools = fits.monotone(points, "p", "s", "w").orderBy("low").collect()
    means = [r["total"] / r["weight"] for r in pools]
    assert means == sorted(set(means)) and sum(r["weight"] for r in pools) == len(data)


def plain_search(train, dev, most, l2):
    """Forward selection as it is told: fit every open term, judge on development, keep the best that helps."""
    (x, y), (u, v) = train, dev
    mean, std = x.mean(axis=0), x.std(axis=0)
    std[std <= 1e-9] = 1
    x, u = (x - mean) / std, (u - mean) / std

    def fit(cols):
        z, b = np.column_stack([np.ones(len(y)), x[:, cols]]), np.zeros(len(cols) + 1)
        weight = np.array([0.0] + [l2] * len(cols))
        for _ in range(100):
            p = 1 / (1 + np.exp(-z @ b))
            b = b - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) / len(y) + np.diag(weight), z.T @ (p - y) / len(y) + weight * b)
        q = np.clip(1 / (1 + np.exp(-np.column_stack([np.ones(len(v)), u[:, cols]]) @ b)), 1e-6, 1 - 1e-6)
        return float(-(v * np.log(q) + (1 - v) * np.log(1 - q)).mean()), b

    chosen, best, kept = [], np.inf, None
    while len(chosen) < most:
        tried = [(fit([*chosen, t]), t) for t in range(x.shape[1]) if t not in chosen]
        won = None
        for (loss, b), t in tried:
            if loss < best - 1e-8:
                best, won, kept = loss, t, b
        if won is None:
            break
        chosen.append(won)
    return chosen, kept, best


def test_forward_selection_is_the_plain_search_on_the_given_tables(spark):
    from parley.plans import bindings as B
    from parley.plans.registry import Tables

    rows = B.case_reg(Tables(spark, "/root/testdata/sf0.001"))
    train, dev = rows.filter("region = 'train'"), rows.filter("region = 'development'")
    terms = M.candidate_terms(train, B.REG_NAMES)
    assert len(terms) > 8

    def dense(df):
        got = df.select(*[v.cast("double").alias(f"t{i}") for i, v in enumerate(terms.values())], F.col("target").cast("double").alias("y")).toPandas()
        return got.drop(columns="y").to_numpy(), got["y"].to_numpy()

    chosen, _, best = plain_search(dense(train), dense(dev), 5, 0.01)
    names, scored = M.forward_select(train, dev, B.REG_NAMES)
    assert names == [list(terms)[t] for t in chosen]
    assert E.score_binary(scored).first()["log_loss"] == pytest.approx(best, abs=1e-9)


def test_forward_selection_goes_on_past_a_strong_useless_term(spark):
    """The term that gains most in training may not help in development; another one still may."""
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 300).astype(float)
    x = np.column_stack([np.where(np.arange(300) < 150, y * 3 + rng.normal(size=300), rng.normal(size=300)), y + rng.normal(size=300), rng.normal(size=300)])
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(300)], "i long, x array<double>, y double")
    chosen, fit, _ = fits.forward(df.filter("i < 150"), df.filter("i >= 150"), 3, 3, 0.01)
    want, kept, _ = plain_search((x[:150], y[:150]), (x[150:], y[150:]), 3, 0.01)
    assert chosen == want and chosen[0] == 1 and np.allclose(fit, kept, atol=1e-7)


def test_lookup_gives_the_same_rows_either_way(spark):
    rng = random.Random(3)
    data = [(i, "hot" if i % 3 else rng.choice(["a", "b", None, f"k{i % 400}"]), i % 2) for i in range(3000)]
    fact = spark.createDataFrame(data, "i long, k string, s int")
    small = spark.createDataFrame([("hot", 0, 1.0), ("hot", 1, 2.0), ("a", 0, 3.0), ("k7", 1, 4.0), (None, 0, 9.0)], "k string, s int, v double")
    for how in ("left", "inner"):
        near, far = J.lookup(fact, small, ["k", "s"], how), J.lookup(fact, small, ["k", "s"], how, most=2)
        assert sorted(map(str, near.collect())) == sorted(map(str, far.collect()))
    assert J.lookup(fact, small, ["k", "s"]).filter("k IS NULL AND v IS NOT NULL").count() == 0
    assert "Exchange hashpartitioning" not in J.lookup(fact, small, ["k", "s"])._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_equals_a_plain_resampling(spark):
    df = spark.range(300).selectExpr("id", "IF(id % 3 = 0, 'accept', 'decline') AS label", "map('accept', 0.2 + (id % 5) / 10.0D) AS probabilities").repartition(6)
    got = E.bootstrap_brier(df, "accept", "id", samples=20).first()
    rows = df.collect()
    scores = []
    for rep in range(20):
        top = low = 0.0
        for r in rows:
            digest = hashlib.sha256(f"7:{rep // 16}:{r['id']}".encode()).digest()
            u = int.from_bytes(digest[2 * (rep % 16) : 2 * (rep % 16) + 2], "big")
            w = sum(u >= e for e in E.POISSON_EDGES)
            top += w * (r["probabilities"]["accept"] - (r["label"] == "accept")) ** 2
            low += w
        scores.append(top / low)
    assert got["samples"] == 20 and got["mean_brier"] == pytest.approx(np.mean(scores)) and got["high"] == pytest.approx(np.quantile(scores, 0.975))
