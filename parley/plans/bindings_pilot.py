"""Seller export and decision snapshots derived from orders, line items and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.profit import Pilot
from parley.plans.registry import Tables

c = F.col

AS_OF = "2001-06-01 00:00:00"

PILOT = """
p_listing AS (SELECT p_partkey AS listing_id, p_retailprice * 200 AS asking, p_type AS category, p_size * 4 AS age FROM part),
p_order AS (
  SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 25 = 0 THEN 1000000000 + o_orderkey ELSE o_custkey END AS listing_id,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS offer_id, o_totalprice AS sale,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'paid' ELSE 'open' END AS order_status,
         o_orderdate AS event_time, o_orderdate + INTERVAL 30 DAY AS window_at, o_orderstatus, o_orderpriority FROM orders),
p_offer AS (
  SELECT order_id AS offer_id, listing_id, event_time - INTERVAL 1 DAY AS event_time, event_time - INTERVAL 23 HOUR AS available_at,
         CASE WHEN order_id % 17 = 0 THEN NULL WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'accepted'
              WHEN o_orderpriority = '5-LOW' THEN 'countered' ELSE 'declined' END AS seller_response,
         CASE WHEN order_id % 13 <> 0 THEN event_time - INTERVAL 1 DAY + to_hours(order_id % 100) END AS seller_response_time,
         CASE WHEN order_id % 3 <> 0 THEN event_time - INTERVAL 22 HOUR END AS history_at, event_time + INTERVAL 1 DAY AS expires_at
  FROM p_order WHERE o_orderpriority <> '3-MEDIUM'),
p_fee AS (SELECT l_orderkey AS order_id, sum(CAST(floor(l_extendedprice * l_tax * 100) / 100 AS DECIMAL(18, 2))) AS fee FROM lineitem WHERE l_orderkey % 20 <> 0 GROUP BY 1),
p_ship AS (SELECT l_orderkey AS order_id, sum(CAST(l_quantity AS DECIMAL(18, 2))) AS shipping FROM lineitem WHERE l_orderkey % 30 <> 1 GROUP BY 1),
p_return AS (
  SELECT l_orderkey AS order_id, CAST(floor(l_extendedprice * l_discount * 100) / 100 AS DECIMAL(18, 2)) AS refund, l_shipdate + INTERVAL 20 DAY AS window_at
  FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1),
p_refund AS (SELECT order_id, sum(refund) AS refund, min(window_at) AS rw, count(*) AS return_rows FROM p_return GROUP BY 1),
p_cost AS (
  SELECT listing_id, CAST(cost AS DECIMAL(18, 2)) AS unit_cost FROM (
    SELECT l_partkey AS listing_id, floor(l_extendedprice / l_quantity) / 100 AS cost,
           row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS k
    FROM lineitem) WHERE k = 1),
p_cancel AS (
  SELECT order_id AS cancellation_id, CASE WHEN order_id % 3 = 0 THEN order_id END AS offer_id, CASE WHEN order_id % 3 = 1 THEN order_id END AS order_id,
         CASE WHEN order_id % 3 = 2 OR order_id % 7 = 0 THEN listing_id END AS listing_id, event_time + INTERVAL 2 DAY AS event_time
  FROM p_order WHERE o_orderstatus = 'O' AND o_orderpriority = '5-LOW'),
linked AS (
  SELECT f.*, coalesce(a.order_id, b.order_id) AS order_id,
         CASE WHEN a.order_id IS NOT NULL THEN 'offer_id' WHEN b.order_id IS NOT NULL THEN 'only_order' ELSE 'none' END AS link
  FROM p_offer f LEFT JOIN p_order a ON a.offer_id = f.offer_id
  LEFT JOIN (SELECT listing_id, min(order_id) AS order_id FROM p_order GROUP BY 1 HAVING count(*) = 1) b ON b.listing_id = f.listing_id),
state AS (
  SELECT o.*, order_status IN ('paid', 'completed') AS paid, order_status = 'completed' AS completed, least(o.window_at, rw) AS matured_at,
         coalesce(least(o.window_at, rw) <= TIMESTAMP '2001-06-01', false) AS matured, coalesce(return_rows, 0) AS return_rows, refund
  FROM p_order o LEFT JOIN p_refund USING (order_id)),
facts AS (
  SELECT s.*, fee, shipping, unit_cost, coalesce(category, 'unknown') AS category, asking, paid AND completed AND matured AS mature,
         CASE WHEN age < 30 THEN '0_to_29_days' WHEN age < 90 THEN '30_to_89_days' WHEN age < 180 THEN '90_to_179_days' WHEN age >= 180 THEN '180_plus_days'
              ELSE 'unknown' END AS age_band,
         CASE WHEN paid AND completed AND matured
              THEN CAST(sale AS DECIMAL(18, 2)) - fee - shipping - coalesce(refund, 0) - unit_cost END AS margin
  FROM state s LEFT JOIN p_fee USING (order_id) LEFT JOIN p_ship USING (order_id) LEFT JOIN p_cost USING (listing_id) LEFT JOIN p_listing USING (listing_id))
"""


def _days(n: int) -> Column:
    return F.expr(f"INTERVAL {n} DAYS")


def _hours(n: int) -> Column:
    return F.expr(f"INTERVAL {n} HOURS")


def pilot(t: Tables) -> Pilot:
    """Ten-table export: gaps (no fee, no cost, no response) are planted by key, nothing is left out."""
    k, day = c("o_orderkey"), c("o_orderdate")
    listing = F.when(k % 25 == 0, 1000000000 + k).otherwise(c("o_custkey"))
    orders = t.orders.select(
        k.alias("order_id"), listing.alias("listing_id"), F.when(k % 5 != 0, k).alias("offer_id"), c("o_totalprice").alias("sale_price_amount"),
        F.when(c("o_orderstatus") == "F", "completed").when(c("o_orderstatus") == "P", "paid").otherwise("open").alias("order_status"),
        day.alias("event_time"), F.lit(None).cast("timestamp_ntz").alias("paid_at"), F.lit(None).cast("timestamp_ntz").alias("completed_at"),
        (day + _days(30)).alias("return_window_matured_at"), F.lit(1).alias("quantity"),
    )
    asked = day - _days(1)
    priority = c("o_orderpriority")
    offers = t.orders.filter(priority != "3-MEDIUM").select(
        k.alias("offer_id"), listing.alias("listing_id"), asked.alias("event_time"), (day - _hours(23)).alias("available_at"),
        (c("o_totalprice") * 0.9).alias("offer_amount"), F.lit("open").alias("offer_state"),
        F.when(k % 17 == 0, F.lit(None).cast("string")).when(priority.isin("1-URGENT", "2-HIGH"), "accepted").when(priority == "5-LOW", "countered")
        .otherwise("declined").alias("seller_response"),
        F.when(k % 13 != 0, asked + F.make_dt_interval(hours=(k % 100).cast("int"))).alias("seller_response_time"),
        F.when(k % 3 != 0, day - _hours(22)).alias("decision_history_available_at"), (day + _days(1)).alias("expires_at"),
    )
    l, price = c("l_orderkey"), c("l_extendedprice")
    fees = t.lineitem.select(l.alias("order_id"), F.when(l % 20 != 0, F.floor(price * c("l_tax") * 100) / 100).alias("fee_amount"))
    shipping = t.lineitem.select(l.alias("order_id"), F.when(l % 30 != 1, c("l_quantity")).alias("shipping_cost_amount"))
    returns = t.lineitem.filter((c("l_returnflag") == "R") & (c("l_linenumber") == 1)).select(
        l.alias("order_id"), (F.floor(price * c("l_discount") * 100) / 100).alias("refund_amount"), (c("l_shipdate") + _days(20)).alias("return_window_matured_at")
    )
    costs = t.lineitem.select(
        c("l_partkey").alias("listing_id"), c("l_shipdate").alias("available_at"), (F.floor(price / c("l_quantity")) / 100).alias("unit_cost_amount"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("seq"),
    )
    cancellations = t.orders.filter((c("o_orderstatus") == "O") & (priority == "5-LOW")).select(
        k.alias("cancellation_id"), F.when(k % 3 == 0, k).alias("offer_id"), F.when(k % 3 == 1, k).alias("order_id"),
        F.when((k % 3 == 2) | (k % 7 == 0), listing).alias("listing_id"), (day + _days(2)).alias("event_time"),
    )
    listings = t.part.select(c("p_partkey").alias("listing_id"), (c("p_retailprice") * 200).alias("asking_price_amount"), c("p_type").alias("category"))
    inventory = t.part.select(c("p_partkey").alias("listing_id"), (c("p_size") * 4).alias("inventory_age_days"))
    return Pilot(listings, offers, orders, fees, shipping, costs, cancellations, returns, inventory)


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


SNAPSHOT = """
snap AS (
  SELECT o_orderkey AS k, o_orderdate AS decision_time, p_type AS category, p_retailprice AS asking, o_orderstatus,
         ['buyer_initiated_best_offer', 'seller_initiated_offer', 'seller_counteroffer', 'listing_price_reduction', 'passive_wait'][substr(o_orderpriority, 1, 1)::INT] AS channel,
         CASE WHEN o_orderkey % 29 <> 0 THEN p_retailprice * 0.5 END AS cost, p_retailprice * 0.55 AS floor_amount, o_orderkey % 120 AS days_active,
         o_orderkey % 200 AS views, ['declining', 'flat', 'increasing', 'unknown'][o_orderkey % 4 + 1] AS trend, o_orderkey % 80 AS age_hours,
         o_orderkey % 5 AS prior, o_orderkey % 8 AS interested, o_orderkey % 30 AS ship, o_orderkey % 10 AS promo, o_orderkey % 4 AS urgency,
         CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '3') THEN p_retailprice * (0.5 + (o_orderkey % 50) / 100.0::DOUBLE) END AS offered
  FROM orders JOIN part ON p_partkey = o_custkey),
shot AS (
  SELECT *, offered / asking AS ratio, ['wait', 'decline', 'counter_at_amount', CASE WHEN offered IS NULL THEN 'wait' ELSE 'accept' END][k % 4 + 1] AS taken,
         o_orderstatus <> 'O' AS has_outcome, o_orderstatus <> 'O' AND k % 7 <> 0 AS buyer_paid, o_orderstatus <> 'O' AND k % 7 <> 0 AND k % 11 <> 0 AS good_paid,
         CASE WHEN o_orderstatus = 'F' AND k % 7 <> 0 THEN floor(asking * (k % 11 - 3) * 10) / 100 END AS mature_raw,
         CASE WHEN k % 9 <> 0 THEN (k % 21)::DOUBLE END AS days_to_sale, k % 6 <> 0 AS fee_known, floor(asking * (k % 5) * 10) / 100 AS provisional
  FROM snap),
judged AS (SELECT *, CASE WHEN good_paid AND o_orderstatus = 'F' THEN mature_raw END AS margin FROM shot)
"""


def snapshots(t: Tables) -> DataFrame:
    """One decision per order; open orders are still pending and have no outcome."""
    k, ask, pri = c("o_orderkey"), c("p_retailprice"), F.substring("o_orderpriority", 1, 1).cast("int")
    channels = ["buyer_initiated_best_offer", "seller_initiated_offer", "seller_counteroffer", "listing_price_reduction", "passive_wait"]

    def pick(values: list[str], at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int"))

    offered = F.when(pri.isin(1, 3), ask * (F.lit(0.5) + (k % 50) / F.lit(100.0)))
    none = F.lit(None).cast("double")
    rows = t.orders.join(t.part, c("p_partkey") == c("o_custkey")).select(
        "*", offered.alias("offered"), (c("o_orderstatus") == "F").alias("final"), (c("o_orderstatus") != "O").alias("has_outcome")
    )
    context = F.struct(
        c("o_custkey").cast("string").alias("listing_id"), pick(channels, pri).alias("decision_channel"), c("p_type").alias("category"),
        c("p_brand").alias("condition"), ask.alias("asking_price"), F.when(k % 29 != 0, ask * 0.5).alias("seller_cost_basis"),
        (ask * 0.55).alias("minimum_net_proceeds"), (k % 120).alias("days_active"), (k % 900).alias("impressions_7d"), (k % 200).alias("views_7d"),
        pick(["declining", "flat", "increasing", "unknown"], k % 4 + 1).alias("traffic_trend"), (k % 80).cast("double").alias("traffic_data_age_hours"),
        (k % 5).alias("prior_offer_count"), c("offered").alias("buyer_offer_amount"), (c("offered") / ask).alias("offer_to_asking_ratio"),
        (k % 8).alias("eligible_interested_buyers"), (k % 30).cast("double").alias("shipping_cost"), (k % 10).cast("double").alias("promotion_cost"),
        F.struct((ask * 0.8).alias("low"), (ask * 0.9).alias("median"), ask.alias("high")).alias("comparable_price_band"),
        F.lit(1).alias("inventory_quantity"), (k % 4).alias("seller_urgency"),
    )

    def action(name: str, amount: Column) -> Column:
        return F.struct(F.lit(name).alias("action"), amount.cast("double").alias("amount"))

    basic = [action("wait", none), action("decline", none), action("counter_at_amount", ask * 0.9)]
    full = F.array(*basic, action("accept", c("offered")))
    actions = F.when(c("offered").isNull(), F.array(*basic)).otherwise(full)
    taken = F.coalesce(F.get(actions, (k % 4).cast("int")), basic[0])
    sold = k % 7 != 0
    outcome = F.struct(
        (k % 3 == 0).alias("seller_accepted"), sold.alias("buyer_paid"), (k % 11 == 0).alias("order_cancelled"), (~sold).alias("unpaid_order"),
        (k % 13 == 0).alias("returned"), c("final").alias("return_window_matured"), (k % 2 == 0).alias("sold_within_7_days"),
        F.when(sold, ask).alias("final_sale_price"), F.when(k % 9 != 0, (k % 21).cast("double")).alias("days_to_sale"),
        F.when(k % 6 != 0, ask * 0.1).alias("actual_fees"), (F.floor(ask * (k % 5) * 10) / 100).alias("provisional_margin"),
        F.when(c("final") & sold, F.floor(ask * (k % 11 - 3) * 10) / 100).alias("mature_margin"),
    )
    return rows.select(
        k.cast("string").alias("decision_id"), (c("o_custkey") % 50).cast("string").alias("seller_id"), c("o_custkey").cast("string").alias("listing_id"),
        c("o_orderdate").alias("decision_time"), c("o_orderdate").alias("observation_cutoff"), context.alias("context"), actions.alias("actions"),
        taken.alias("taken"), F.when(c("has_outcome"), outcome).alias("outcome"), k.alias("k"),
    )
