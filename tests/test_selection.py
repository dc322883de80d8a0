"""Positions found by counting against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from parley.operators import metrics as E
from parley.operators import selection as L
from parley.operators import sequence
from parley.operators import splits as P


@pytest.fixture(params=["brackets", "all values", "hot"])
def setting(request, monkeypatch):
    if request.param != "all values":
        monkeypatch.setattr(L, "FEW", 50)
    if request.param == "hot":
        monkeypatch.setattr(sequence, "HOT_ROWS", 20)


def test_quantiles_of_skewed_groups(spark, setting):
    rng = random.Random(1)
    data = [("hot" if i % 3 else rng.choice(["a", "b", None]), rng.choice([5.0, rng.lognormvariate(0, 9), -rng.random(), None, float(rng.randrange(4))])) for i in range(6000)] + [("one", 7.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(7)
    got = {r["k"]: (r["a"], r["b"], r["mid"]) for r in E.quantiles_and_median(df, "v", {"a": 0.1, "b": 0.93}, ["k"]).collect()}
    for key in {k for k, _ in data}:
        values = sorted(v for k, v in data if k == key and v is not None)
        n = len(values)
        want = (values[round((n - 1) * 0.1)], values[round((n - 1) * 0.93)], (values[(n - 1) // 2] + values[n // 2]) / 2)
        assert got[key] == pytest.approx(want), key
    every = sorted(v for _, v in data if v is not None)
    assert E.median(df, "v").first()[0] == pytest.approx((every[(len(every) - 1) // 2] + every[len(every) // 2]) / 2)


def test_a_miss_of_the_sketch_is_seen(spark, monkeypatch):
    monkeypatch.setattr(L, "FEW", 0)
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS v")
    far = {"x": (0.2, lambda n: n - 1)}  # the bracket lies elsewhere
    assert L.values_at(df, "v", far).first()["x"] == 999.0


def test_split_by_time_with_ties_and_gaps(spark, setting):
    rng = random.Random(2)
    data = [(i, "x" if i % 3 else rng.choice(["y", None]), None if i % 50 == 0 else 3 if i % 2 else rng.randrange(9), f"r{i:05d}") for i in range(3000)] + [(9000, "single", 1, "r9")]
    df = spark.createDataFrame(data, "i long, task string, t int, row string").withColumn("ts", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, t)"))
    got = {r["i"]: r["region"] for r in P.chronological_split(df, "ts", "row", ["task"]).collect()}
    assert len(got) == len(data)
    alone = {r["i"]: r["region"] for r in P.chronological_split(df.filter("task = 'x'"), "ts", "row").collect()}
    assert alone == {i: got[i] for i in alone} and len(alone) == sum(x[1] == "x" for x in data)
    rows, _ = L.rows_at(df, ["task"], F.col("ts"), ["ts", "row"], P._ends(0.6, 0.2))
    by_cut = rows.select("i", F.struct("ts", "row") <= F.col("_cut_train")).collect()
    assert {i for i, is_train in by_cut if is_train} == {i for i, x in got.items() if x == "train"}
    for task in {x[1] for x in data}:
        rows = sorted([x for x in data if x[1] == task], key=lambda x: (x[2] is not None, x[2] or 0, x[3]))
        n = len(rows)
        train = max(1, int(n * 0.6))
        dev = max(train, int(n * 0.8 + 1e-9))
        dev = min(dev, n - 1) if n >= 3 else dev
        for place, (i, *_) in enumerate(rows, 1):
            assert got[i] == ("train" if place <= train else "development" if place <= dev else "hidden"), (task, place)


def test_groups_in_text_order(spark):
    names = [f"group-{i:04d}" for i in range(400)] + ["", "a", "é", "zz", "group-0399x"]
    df = spark.createDataFrame([(i, names[i % len(names)]) for i in range(2000)], "i long, g string")
    got = {r["g"]: r["region"] for r in P.group_split(df.filter("g <> ''"), "g", "i").collect()}
    ordered = sorted(x for x in names if x)
    n = len(ordered)
    assert [x for x in ordered if got[x] == "train"] == ordered[: int(n * 0.6)] and got[ordered[-1]] == "hidden"


def test_texts_are_ordered_too(spark, setting):
    df = spark.createDataFrame([(i, f"same start {i * 7919 % 1000:04d}" if i % 2 else "é"[: i % 4] + "z" * (i % 9)) for i in range(1000)], "i long, name string")
    got = {r["i"]: r["region"] for r in P.chronological_split(df, "name", "i").collect()}
    ordered = sorted(df.collect(), key=lambda r: (r["name"].encode(), r["i"]))
    assert [got[r["i"]] for r in ordered] == ["train"] * 600 + ["development"] * 200 + ["hidden"] * 200


def test_nothing_to_split(spark):
    df = spark.createDataFrame([], "i long, ts timestamp")
    assert P.chronological_split(df, "ts", "i").count() == 0 and E.median(df, "i").count() == 0
