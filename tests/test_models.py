import math
import random

import numpy as np
from pyspark.sql import functions as F

from parley.operators import metrics as E
from parley.operators import models as M
from parley.operators.neighbours import predict_nearest

NAMES = ["accept", "counter", "decline", "expire"]


def pool(values, weights):
    blocks = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [v for v, _, n in blocks for _ in range(n)]


def test_pooled_equals_pooling_of_adjacent_violators(spark):
    rng = random.Random(5)
    data = [([rng.random() for _ in range(8)], [float(rng.randrange(1, 9)) for _ in range(8)]) for _ in range(25)]
    df = spark.createDataFrame(data, "v array<double>, w array<double>")
    for row in df.select("v", "w", M.pooled(F.col("v"), F.col("w"), 8).alias("fit")).collect():
        assert max(abs(a - b) for a, b in zip(row["fit"], pool(row["v"], row["w"]))) < 1e-9


def test_majority_and_unseen_category(spark):
    train = spark.createDataFrame([("a", "accept"), ("a", "accept"), ("a", "decline"), ("b", "counter")], "category string, label string")
    dev = spark.createDataFrame([("r1", "a", "accept"), ("r2", "z", "counter")], "row_id string, category string, label string")
    got = {r["row_id"]: r for r in M.predict_category_majority(dev, train, NAMES).collect()}
    assert got["r1"]["prediction"] == "accept" and abs(got["r1"]["probabilities"]["accept"] - 2 / 3) < 1e-12
    assert got["r2"]["probabilities"]["counter"] == 0.25


def test_log_loss_of_a_label_without_probability(spark):
    df = spark.createDataFrame([("accept", "accept", {"accept": 1.0}), ("gone", "accept", {"accept": 1.0})], "label string, prediction string, probabilities map<string,double>")
    out = E.score_multiclass(df, NAMES).first()
    assert abs(out["log_loss"] - (-math.log(1e-12) - math.log(1 - 1e-12)) / 2) < 1e-6
    assert out["accuracy"] == 0.5


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([(float(i),) for i in range(6)], "v double")
    # (6 - 1) * 0.5 = 2.5 -> 2, (6 - 1) * 0.3 = 1.5 -> 2
    assert tuple(E.nearest_rank(df, "v", {"a": 0.5, "b": 0.3}).first()) == (2.0, 2.0)
    assert E.median(df, "v").first()[0] == 2.5


def test_median_with_one_value_on_most_rows(many_segments):
    data = [(7.0,)] * 300 + [(float(i),) for i in range(100)]
    df = many_segments.createDataFrame(data, "v double")
    assert E.median(df, "v").first()[0] == float(np.median([x for (x,) in data]))


def test_nearest_neighbour_equals_brute_force(many_segments):
    spark = many_segments
    rng = random.Random(11)
    train = [(i, rng.randrange(2), rng.gauss(0, 1), rng.gauss(0, 3), float(rng.randrange(3))) for i in range(300)]
    # a hot group of copies, some of them asked for as well
    train += [(300 + i, 1, 0.5, 0.5, 1.0) for i in range(200)]
    dev = [(i, rng.gauss(0, 1), rng.gauss(0, 3), float(rng.randrange(3))) for i in range(120)] + [(120 + i, 0.5, 0.5, 1.0) for i in range(30)]
    names = ["a", "b", "c"]
    t = spark.createDataFrame(train, "seq long, target int, a double, b double, c double")
    d = spark.createDataFrame(dev, "id long, a double, b double, c double")
    got = {r["id"]: r["p"] for r in predict_nearest(d, t, names, "seq").collect()}
    x = np.array([r[2:] for r in train])
    mean, scale = x.mean(0), x.std(0)
    z = (x - mean) / scale
    assert len(got) == 150
    for row in dev:
        q = (np.array(row[1:]) - mean) / scale
        d2 = ((z - q) ** 2).sum(1)
        best = min(range(len(train)), key=lambda i: (round(d2[i], 10), i))
        assert got[row[0]] == (0.8 if train[best][1] else 0.2)


def test_counter_frontier_equals_brute_force(many_segments):
    spark = many_segments
    rng = random.Random(2)
    hist = [("hot" if rng.random() < 0.7 else "b", round(rng.random() * 1.4, 2), rng.choice(NAMES), i) for i in range(300)]
    ctx = [(f"c{i}", rng.choice(["hot", "b", "none"]), 100.0, [float(rng.randrange(5, 150)) for _ in range(3)]) for i in range(20)]
    h = spark.createDataFrame(hist, "category string, ratio double, label string, seq long")
    x = spark.createDataFrame(ctx, "context_id string, category string, listing_price double, counter_amounts array<double>")
    got = {(r["context_id"], r["counter_amount"]): r for r in M.counter_frontier(x, h, 5).collect()}
    for cid, cat, price, amounts in ctx:
        past = [(r, s, l) for k, r, l, s in hist if k == cat]
        ratios = [r for r, _, _ in past if r > 0]
        for amount in amounts:
            row, q = got[(cid, amount)], amount / price
            ok = bool(ratios) and min(ratios) <= q <= max(ratios)
            assert row["supported"] == ok
            if ok:
                best = sorted(past, key=lambda p: (abs(p[0] - q), p[1]))[:5]
                assert abs(row["p_accept"] - sum(l == "accept" for *_, l in best) / 5) < 1e-12
                assert abs(row["p_counter"] - sum(l == "counter" for *_, l in best) / 5) < 1e-12


def test_pareto_and_rotation(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("c", 0.4, 3), ("d", 0.6, 1), ("e", 0.3, 9)], "model_id string, log_loss double, complexity int")
    assert {r["model_id"] for r in E.pareto(df).collect()} == {"a", "b", "e"}
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "i int, label string")
    assert {r["i"]: r["label"] for r in E.rotate_labels(rows, ["i"], "label").collect()} == {1: "y", 2: "z", 3: "x"}


def test_tolerant_selection_equals_a_plain_loop(spark):
    rng = random.Random(9)
    rows = [
        (f"t{i % 3}", f"s{i % 2}", f"m{i}", round(rng.choice([0.5, 0.503, 0.506, 0.7, -0.2]), 3), rng.randrange(1, 4), rng.choice([0.1, 0.2]), rng.choice([1.0, 0.9]))
        for i in range(120)
    ]
    board = spark.createDataFrame(rows, "task string, split string, model_id string, log_loss double, complexity int, calibration_error double, coverage double")
    got = {(r.task, r.split): r.model_id for r in E.select_model(board, "log_loss").collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        mine = [r for r in rows if r[:2] == key]
        best = min(r[3] for r in mine)
        near = [r for r in mine if r[3] <= best + max(abs(best) * 0.01, 1e-12)]
        want[key] = min(near, key=lambda r: (r[4], r[5], -r[6], r[3], r[2]))[2]
    assert got == want and len(want) == 6


def test_threshold_rule_takes_the_best_of_all_cuts(many_segments):
    # the target turns between two neighbours of 301 values, half way between two of 25 evenly spaced cuts (125 and 137)
    turn = 131
    rows = [(f"r{i}", int(i > turn), float(i), float(i % 7)) for i in range(301)]
    train = many_segments.createDataFrame(rows, "row_id string, target int, a double, b double")

    def loss(at, cut):
        out = 0.0
        for side in ([r[1] for r in rows if r[at] <= cut], [r[1] for r in rows if r[at] > cut]):
            p = (sum(side) + 1.0) / (len(side) + 2.0)
            out -= sum(math.log(p if y else 1 - p) for y in side)
        return out / len(rows)

    cuts = []
    for place, (name, at) in enumerate((("b", 3), ("a", 2))):
        values = sorted({r[at] for r in rows})
        cuts += [(loss(at, (x + y) / 2), place, (x + y) / 2, name) for x, y in zip(values, values[1:])]
    best = min(cuts)
    rule = M.fit_threshold(train, ["b", "a"]).first()
    assert (rule["name"], rule["threshold"]) == (best[3], best[2]) == ("a", turn + 0.5)
    assert abs(rule["log_loss"] - best[0]) < 1e-12
    assert M.threshold_candidates(train, ["b", "a"]).count() == len(cuts) == 306
    got = {r["row_id"]: r["p"] for r in M.predict_threshold_rule(train, M.fit_threshold(train, ["b", "a"]), ["b", "a"]).collect()}
    assert all(abs(got[r[0]] - (rule["high_rate"] if r[1] else rule["low_rate"])) < 1e-12 for r in rows)
