from decimal import Decimal

from pyspark.sql import functions as F

from parley.operators import ledger as L
from parley.operators import profit as R


def test_unknown_cost_is_never_imputed(spark):
    df = spark.createDataFrame([(1, 100.0, 10.0, 5.0), (2, 100.0, None, 5.0)], "id int, gross double, fee double, ship double")
    got = {r["id"]: r for r in R.decision_accounting(df, "gross", ["fee", "ship"], ["fee", "ship"], F.lit(2.0)).collect()}
    assert got[1]["net_value"] == Decimal("85.00") and got[1]["conservative_net"] == Decimal("83.00")
    assert got[2]["total_costs"] is None and got[2]["conservative_net"] is None and got[2]["missing_costs"] == ["fee"]


def test_sum_by_keeps_absence(spark):
    df = spark.createDataFrame([("a", "1.10"), ("a", "2.20"), ("b", "x"), (None, "3")], "order_id string, amount string")
    assert [(r["order_id"], r["total"]) for r in R.sum_by(df, "order_id", "amount", "total").collect()] == [("a", Decimal("3.30"))]


def test_cancellation_that_matches_twice_counts_once(spark):
    offers = spark.createDataFrame([(1, 11, 100), (2, 12, 100), (3, None, 200)], "offer_id int, order_id int, listing_id int")
    canc = spark.createDataFrame(
        [(1, 1, None, 100, "2024-01-02"), (2, None, 12, None, "2024-01-01"), (3, 9, 12, 100, "2024-01-03"), (4, None, None, 300, "2024-01-01")],
        "cancellation_id int, offer_id int, order_id int, listing_id int, event_time string",
    )
    got = {r["offer_id"]: (r["cancellations"], r["cancelled_at"]) for r in R.match_cancellations(offers, canc).collect()}
    assert got == {1: (2, "2024-01-02"), 2: (3, "2024-01-01"), 3: (0, None)}


def test_only_order_of_a_listing_is_linked(spark):
    offers = spark.createDataFrame([(1, "l1"), (2, "l2"), (3, "l3")], "offer_id int, listing_id string")
    orders = spark.createDataFrame([(10, 1, "l9"), (20, None, "l2"), (30, None, "l3"), (31, None, "l3")], "order_id int, offer_id int, listing_id string")
    got = {r["offer_id"]: (r["order_id"], r["link"]) for r in R.link_orders(offers, orders).collect()}
    assert got == {1: (10, "offer_id"), 2: (20, "only_order"), 3: (None, "none")}


def test_drawdown_places(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, 3, -4, -2, 6, -7, 1])], "i int, v int")
    # the curve is 5 8 4 2 8 1 2
    row = L.max_drawdown(df, ["i"], F.col("v").cast("decimal(18,2)")).first()
    assert tuple(row) == (7.0, 1, 5)


def test_streak(spark):
    days = ["2024-01-01", "2024-01-02", "2024-01-02", "2024-01-04", "2024-01-05", "2024-01-06", "2024-02-01"]
    df = spark.createDataFrame([("k", d) for d in days], "k string, d string")
    assert tuple(L.longest_streak(df, ["k"], F.col("d")).first()) == ("k", 3, 6)
    assert tuple(L.longest_streak(df, ["k"], F.col("d"), "week").first()) == ("k", 1, 2)
