import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators import ingest as I
from parley.sources import mapping as M
from parley.sources.delimited import HeaderMismatch, scan_delimited
from parley.sources.exports import format_of, scan_exports

SCHEMA = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])


def test_header_must_match(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n1,x\n")
    (tmp_path / "swapped.csv").write_text("b,a\nx,1\n")
    assert scan_delimited(spark, str(tmp_path / "good.csv"), SCHEMA).collect()[0]["a"] == 1
    with pytest.raises(HeaderMismatch, match="order_matches"):
        scan_delimited(spark, str(tmp_path / "swapped.csv"), SCHEMA)


def test_exports_of_several_formats(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,note\n1,hi\n")
    (tmp_path / "y.jsonl").write_text('{"id": 2, "price": 3.5}\n')
    rows = scan_exports(spark, [str(tmp_path / "x.csv"), str(tmp_path / "y.jsonl")]).orderBy("id").collect()
    assert [(r["id"], r["note"], r["price"]) for r in rows] == [("1", "hi", None), ("2", None, "3.5")]
    with pytest.raises(ValueError):
        format_of("table.xlsx")


def test_mapping_proposal_and_validation():
    m = M.propose_mapping(["Transaction ID", "ItemId", "Sold-Price", "Weather"], "orders")
    assert m == {"Transaction ID": "order_id", "ItemId": "listing_id", "Sold-Price": "sale_price_amount", "Weather": "ignore"}
    faults = M.validate_mapping(["a", "b"], "fees", {"a": "fee_id", "c": "order_id", "b": "fee_id"})
    assert faults["duplicate_targets"] == ["fee_id"] and faults["unknown_sources"] == ["c"] and "order_id" in faults["missing_required"]


def test_good_and_bad_rows_add_up(spark):
    base = {"fee_id": "1", "order_id": "2", "event_time": "2024-01-01T00:00:00Z", "available_at": "2024-01-01T00:00:00Z", "fee_amount": "1", "currency": "USD", "fee_type": "x", "listing_id": None}
    rows = [base, {**base, "currency": "usd"}, {**base, "fee_amount": "-1", "event_time": "2024-01-01T00:00:00"}, {**base, "available_at": "2023-12-31T23:59:59Z"}, {**base, "fee_type": " "}]
    schema = T.StructType([T.StructField(k, T.StringType()) for k in base])
    good, bad = I.canonicalize(spark.createDataFrame(rows, schema), "fees", {k: k for k in base})
    assert good.count() == 1
    assert sorted(tuple(r["reasons"]) for r in bad.collect()) == [
        ("available_before_event",), ("bad_currency",), ("bad_time_event_time", "bad_amount_fee_amount"), ("missing_fee_type",)
    ]


def test_duplicate_keys_keep_the_first_and_all_the_rest(spark):
    rows = [(1, 5, "c"), (1, 3, "a"), (1, 3, "a"), (2, 1, "z")]
    kept, rest = I.dedupe_by_key(spark.createDataFrame(rows, "k int, o int, v string"), ["k"], ["o"])
    assert sorted((r["k"], r["o"], r["v"]) for r in kept.collect()) == [(1, 3, "a"), (2, 1, "z")]
    assert sorted((r["o"], r["copies"]) for r in rest.collect()) == [(3, 1), (5, 1)]


def test_duplicate_keys_with_nulls_equal_a_plain_loop(spark):
    """Null keys, orders and values are values like others and come first; a third of all rows has one key."""
    rng = random.Random(2)
    pick = lambda *x: rng.choice([None, *x])
    rows = [(pick(1, 2) if i % 3 else 7, pick(3.0, -1.0, 2.5), pick("a", "b", "")) for i in range(300)]
    kept, rest = I.dedupe_by_key(spark.createDataFrame(rows, "k int, o double, v string").repartition(5), ["k"], ["o"])
    rank = lambda r: tuple((x is not None, x or (0 if isinstance(x, float) else "")) for x in r[1:])
    first = {k: min((r for r in rows if r[0] == k), key=rank) for k in {r[0] for r in rows}}
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, first.values()))
    left = Counter(rows) - Counter(first.values())
    assert {tuple(r)[:3]: r["copies"] for r in rest.collect()} == dict(left)
    for df in I.dedupe_by_key(spark.createDataFrame([], "k int, o double, v string"), ["k"], ["o"]):
        assert df.count() == 0


def test_secrets_in_maps_and_arrays(spark):
    df = spark.createDataFrame([({"api_key": "x", "n": "1"}, ["password=1", "ok"], "plain")], "m map<string,string>, a array<string>, s string")
    row = I.redact_secrets(df, ["m", "a", "s"]).first()
    assert row["m"] == {"api_key": "[REDACTED]", "n": "1"} and row["a"] == ["[REDACTED]", "ok"] and row["s"] == "plain" and row["secret_hit"]


def test_json_object_with_rows_and_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rows": [{"id": 1, "v": "x"}, {"id": 2, "v": null}], "note": "n"}')
    (tmp_path / "b.json").write_text('[{"id": 3, "v": "y"}]')
    (tmp_path / "c.csv").write_bytes(b"\xef\xbb\xbfid,v\n4,z\n")
    for schema in (None, T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.StringType())])):
        out = scan_exports(spark, [str(tmp_path / x) for x in ("a.json", "b.json", "c.csv")], schema)
        assert sorted((r.id, r.v) for r in out.collect() if r.v) == [("1", "x"), ("3", "y"), ("4", "z")] and out.count() == 4


def test_secret_spans(spark):
    texts = {
        "?api_key=abc&x=1": "?api_key=[REDACTED]&x=1",
        "token=abc": "token=[REDACTED]",
        "X-Api-Key: abc, next": "X-Api-Key: [REDACTED], next",
        "Authorization: Bearer abc.def": "Authorization: Bearer [REDACTED]",
        "sent bearer abcdef123": "sent bearer [REDACTED]",
        "the monkey: ran": "the monkey: ran",
        "a bearer of news": "a bearer of news",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(I.mask_secrets(F.col("t"))).collect()] == list(texts.values())
