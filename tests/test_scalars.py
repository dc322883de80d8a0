import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from parley.functions import scalars as S
from parley.functions import terms as T


def test_bin_edges(spark):
    ps = [0.0, 0.1, 0.3, 0.6, 0.7, 0.999, 1.0]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    assert [r[0] for r in df.select(S.bin_of(F.col("p"), 10)).collect()] == [min(9, int(p * 10)) for p in ps]


def test_canonical_hash_and_non_finite(spark):
    df = spark.createDataFrame([(2, "x", None)], "b int, a string, c string")
    want = hashlib.sha256(json.dumps({"a": "x", "b": 2, "c": None}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert df.select(S.canonical_hash("b", "a", "c")).first()[0] == want
    with pytest.raises(Exception, match="not finite"):
        spark.createDataFrame([(float("nan"),)], "a double").select(S.canonical_hash("a")).collect()


def test_bucket_is_the_full_modulus(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("k"))
    for r in df.select("k", S.hash_bucket(F.col("k"), 64).alias("b")).collect():
        assert r["b"] == int(hashlib.sha256(r["k"].encode()).hexdigest(), 16) % 64
    for n in (1, 48, 64, 1000, 2**31 - 1):
        got = [r[0] for r in df.select(S.hash_bucket(F.col("k"), n)).collect()]
        assert got == [int(hashlib.sha256(str(r["k"]).encode()).hexdigest(), 16) % n for r in df.collect()]
    with pytest.raises(ValueError):
        S.hash_bucket(F.col("k"), 0)


def test_dates(spark):
    df = spark.createDataFrame([("01may2012",), ("01may2012 11:00:00",), ("2012/05/01",), ("soon",), ("",)], "d string")
    may = datetime(2012, 5, 1)
    assert [r[0] for r in df.select(S.to_instant(F.col("d"))).collect()] == [may, datetime(2012, 5, 1, 11), may, None, None]


def test_conversion(spark):
    df = spark.createDataFrame([("7.0",), (" 8 ",), ("x",), ("",)], "v string")
    assert [r[0] for r in df.select(S.to_whole(F.col("v"))).collect()] == [7, 8, None, None]


def test_terms_are_safe(spark):
    df = spark.createDataFrame([(4.0, 0.0, None)], "x double, zero double, gone double")
    row = df.select(
        T.divide(T.var("x"), T.var("zero")), T.power(T.var("x"), F.lit(99.0)), T.var("gone"), T.log(T.var("zero")), T.exp(T.var("x") * 1000), T.sqrt(-T.var("x")), T.power(-T.var("x"), F.lit(0.5))
    ).first()
    assert row[0] == 0.0 and row[1] == 4.0**6 and row[2] == 0.0 and row[3] < -27 and row[4] < 1e22 and row[5] == 0.0 and row[6] is None


def test_reasons_are_compiled(spark):
    """Names in order, none where nothing holds or all is unknown, commas kept; no lambda in the plan."""
    from parley.functions.scalars import reasons

    df = spark.createDataFrame([(1, "x"), (5, None), (None, None)], "n int, s string")
    out = df.select(reasons(**{"small": df.n < 3, "a,b": df.s == "x", "big": df.n > 3}).alias("r"))
    assert [r.r for r in out.collect()] == [["small", "a,b"], ["big"], []]
    assert out.schema["r"].dataType.containsNull is False and "lambda" not in out._jdf.queryExecution().toString()
