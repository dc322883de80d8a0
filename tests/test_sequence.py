import random

import pandas as pd
from pyspark.sql import functions as F

from parley.operators import sequence
from parley.operators.sequence import SEGMENT, Sequence, lag, lead, rank, running_max, running_min, running_sum, total
from parley.operators.walkforward import drawdown, framed


def rows(hot_share, n=600, seed=3):
    rng = random.Random(seed)
    return [(0 if rng.random() < hot_share else rng.randrange(1, 12), rng.randrange(50), i, rng.randrange(-5, 9)) for i in range(n)]


def expected(pdf, keys):
    pdf = pdf.sort_values([*keys, "t", "i"]).reset_index(drop=True)
    g = pdf.groupby(keys, sort=False) if keys else pdf.assign(_=0).groupby("_")
    v = g["v"]
    out = pdf.assign(
        r=g.cumcount() + 1, n=v.transform("size"), s=v.cumsum(), before=v.cumsum() - pdf["v"], top=v.cummax(), low=v.cummin(), nxt=g["i"].shift(-1), prv=g["i"].shift(1),
    )
    return out.set_index("i")


def computed(spark, data, keys):
    df = spark.createDataFrame(data, "k int, t int, i int, v int")
    v = F.col("v")
    seq = Sequence(df, keys, ["t", "i"])
    assert seq._df.select(SEGMENT).distinct().count() > 3
    return seq.add(
        r=rank(), n=total(), s=running_sum(v), before=running_sum(v, inclusive=False), top=running_max(v), low=running_min(v), nxt=lead(F.col("i")), prv=lag(F.col("i"))
    ).frame.toPandas().set_index("i")


def check(spark, data, keys):
    want, got = expected(pd.DataFrame(data, columns=["k", "t", "i", "v"]), keys), computed(spark, data, keys)
    assert len(got) == len(want)
    got = got.loc[want.index]
    for name in ("r", "n", "s", "top", "low"):
        assert (got[name] == want[name]).all(), name
    assert (got["before"].fillna(0) == want["before"]).all()
    assert (got["nxt"].fillna(-1) == want["nxt"].fillna(-1)).all()
    assert (got["prv"].fillna(-1) == want["prv"].fillna(-1)).all()


def test_one_key_holds_most_rows(many_segments):
    check(many_segments, rows(0.7), ["k"])


def test_even_keys(many_segments):
    check(many_segments, rows(0.1), ["k"])


def test_hot_and_cold_keys_side_by_side(many_segments, monkeypatch):
    monkeypatch.setattr(sequence, "HOT_ROWS", 100)
    data = rows(0.7)
    df = many_segments.createDataFrame(data, "k int, t int, i int, v int")
    seq = Sequence(df, ["k"], ["t", "i"])
    assert seq._df.select("k").distinct().count() == 1 and seq._cold.filter("k = 0").count() == 0
    check(many_segments, data, ["k"])
    nulls = [(None if k == 0 else k, t, i, v) for k, t, i, v in data]
    got = Sequence(many_segments.createDataFrame(nulls, "k int, t int, i int, v int"), ["k"], ["t", "i"]).add(r=rank(), n=total())
    assert got._df.count() == got.frame.filter("k IS NULL").count() == got.frame.filter("k IS NULL").agg(F.max("r")).first()[0]


def test_keys_below_the_bound_are_not_staged(many_segments, monkeypatch):
    monkeypatch.setattr(sequence, "HOT_ROWS", 10_000)
    data = rows(0.7)
    want, df = expected(pd.DataFrame(data, columns=["k", "t", "i", "v"]), ["k"]), many_segments.createDataFrame(data, "k int, t int, i int, v int")
    seq = Sequence(df, ["k"], ["t", "i"])
    assert seq._df is None
    got = seq.add(r=rank(), s=running_sum(F.col("v")), nxt=lead(F.col("i"))).map(t2=F.col("t") * 2).frame.toPandas().set_index("i").loc[want.index]
    assert (got["r"] == want["r"]).all() and (got["s"] == want["s"]).all() and (got["nxt"].fillna(-1) == want["nxt"].fillna(-1)).all()


def test_no_key_at_all(many_segments):
    check(many_segments, rows(0.3), [])


def test_hot_key_is_cut_over_segments(many_segments):
    df = many_segments.createDataFrame(rows(0.9), "k int, t int, i int, v int")
    parts = Sequence(df, ["k"], ["t", "i"])._df.groupBy("k", SEGMENT).count()
    biggest = parts.agg(F.max("count")).first()[0]
    assert parts.filter("k = 0").count() > 3
    assert biggest < 0.5 * 600


def test_framed_blocks_equal_plain_frames(spark):
    data = [(i, float((i * 37) % 11) / 100 - 0.04) for i in range(150)]
    df = spark.createDataFrame(data, "i long, r double")

    def outputs(w):
        return {
            "past": F.sum("r").over(w.rowsBetween(-6, 0)), "ahead": F.count("r").over(w.rowsBetween(1, 4)), "fall": drawdown(F.collect_list("r").over(w.rowsBetween(-6, 0))),
        }

    got = framed(df, "i", 6, 4, [], outputs, block=16).orderBy("i").toPandas()
    r = pd.Series([x for _, x in data])
    assert len(got) == 150
    assert (got["past"] - r.rolling(7, min_periods=1).sum()).abs().max() < 1e-12
    assert list(got["ahead"]) == [min(4, 149 - i) for i in range(150)]
    for i in (0, 5, 70, 149):
        value, peak, worst = 1.0, 1.0, 0.0
        for x in r[max(0, i - 6) : i + 1]:
            value *= 1 + x
            peak = max(peak, value)
            worst = min(worst, value / peak - 1)
        assert abs(got["fall"][i] - worst) < 1e-12
