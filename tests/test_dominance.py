"""Counts by date and value against a plain count, in one segment and in many."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import brackets as H
from parley.operators import dominance as D


def brute(points, questions):
    def less(v, w, incl):
        if np.isnan(w):
            return incl or not np.isnan(v)
        return not np.isnan(v) and (v <= w if incl else v < w)

    return {q: sum(1 for k, d, v in points if v is not None and k == key and d < at and less(v, w, incl)) for key, at, w, incl, q in questions}


@pytest.mark.parametrize("rows", [10_000, 150, 23])
def test_counts_match(spark, monkeypatch, rows):
    monkeypatch.setattr(D, "SEGMENT_ROWS", rows)
    rng = random.Random(rows)

    def value():
        return rng.choice([float("nan"), 3.0, float(rng.randrange(8)), rng.gauss(3, 2)])

    points = [("hot" if i % 3 else rng.choice(["a", "b", None]), rng.randrange(30), None if i % 17 == 0 else value()) for i in range(700)]
    questions = [("hot" if i % 2 else rng.choice(["a", "b", "none", None]), rng.randrange(32), value(), bool(rng.randrange(2)), f"q{i}") for i in range(300)]
    told = spark.createDataFrame(points, "k string, d int, v double")
    asked = spark.createDataFrame(questions, "k string, d int, v double, incl boolean, q string")
    got = {r["q"]: r["n"] for r in D.below(told, asked, ["k"], "d", "v", "q", "incl").collect()}
    want = brute(points, questions)
    assert {q: n for q, n in got.items()} == want


def test_one_value_fills_many_segments(spark, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT_ROWS", 50)
    told = spark.range(1000).selectExpr("'x' AS k", "CAST(id % 2 AS INT) AS d", "5.0D AS v")
    asked = spark.createDataFrame([("x", 1, 5.0, True, "a"), ("x", 2, 5.0, True, "b"), ("x", 2, 5.0, False, "c"), ("x", 0, 9.0, True, "d")], "k string, d int, v double, incl boolean, q string")
    got = {r["q"]: r["n"] for r in D.below(told, asked, ["k"], "d", "v", "q", "incl").collect()}
    assert got == {"a": 500, "b": 1000, "c": 0, "d": 0}


def test_brackets_of_every_kind(spark, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT_ROWS", 60)
    rng = random.Random(9)
    history = [(i % 3, f"2024-01-{1 + i % 28:02d}", None if i % 13 == 0 else float(rng.randrange(10)), None if i % 5 == 0 else 4.0) for i in range(200)]
    events = []
    for i in range(120):
        lo, hi = rng.choice([None, 2.0, 5.0]), rng.choice([None, 1.0, 5.0, 7.0])
        events.append((f"e{i}", i % 4, f"2024-01-{1 + i % 30:02d}", lo, hi, rng.choice([True, False, None]), rng.choice([True, False])))
    hist = spark.createDataFrame(history, "station int, d string, high double, forecast_mean double").withColumn("local_date", F.to_date("d"))
    evs = spark.createDataFrame(events, "event_id string, station int, d string, lo double, hi double, lo_incl boolean, hi_incl boolean").withColumn("local_date", F.to_date("d")).drop("d")
    got = {r["event_id"]: (r["history_days"], r["station_climatology"]) for r in H.climatology(evs, hist).collect()}

    def hit(v, lo, hi, li, ui):
        if v is None:
            return lo is None and hi is None
        return (lo is None or (v >= lo if li else v > lo)) and (hi is None or (v <= hi if ui else v < hi))

    for name, station, day, lo, hi, li, ui in events:
        past = [v for s, d, v, _ in history if s == station and d < day]
        want = (len(past), round(sum(hit(v, lo, hi, li, ui) for v in past) / len(past), 6) if past else None)
        assert got[name] == pytest.approx(want), (name, got[name], want)


def test_days_never_meet_brackets(spark):
    hist = spark.createDataFrame([(1, "2024-01-01", 3.0, 2.0)], "station int, d string, high double, forecast_mean double").withColumn("local_date", F.to_date("d"))
    evs = spark.createDataFrame([("e", 1, "2024-01-02", 2.0, 5.0, True, False)], "event_id string, station int, d string, lo double, hi double, lo_incl boolean, hi_incl boolean").withColumn("local_date", F.to_date("d"))
    plan = H.climatology(evs, hist)._jdf.queryExecution().analyzed().toString()
    joins = [line for line in plan.splitlines() if "Join " in line and "station" in line]
    assert not any("lo#" in line or "hi#" in line for line in joins)
