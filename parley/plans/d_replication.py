"""Replication moments, nearest neighbour, regression leaderboard, tie perturbation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import metrics as E
from parley.operators import models as M
from parley.operators import replication as R
from parley.operators import splits as P
from parley.operators.neighbours import predict_nearest
from parley.plans import bindings as B
from parley.plans.c_splits import region_sql
from parley.plans.d_models import REG_DATA, regions
from parley.plans.registry import ORACLES, Tables, ctes, query

c = F.col

RAW = """
rl AS (
  SELECT listing_id, seller_id, listing_price, CASE WHEN listing_id % 5 <> 0 THEN final_sale_price * 1.05::DOUBLE END AS final_sale_price,
         sold_by_best_offer AND listing_id % 5 <> 0 AS bargained, CASE WHEN listing_id % 10 <> 0 THEN age_days * 25 END AS condition_id, listing_id % 50 AS reference_count,
         listing_id % 4 = 0 AS revised, CASE WHEN listing_id % 5 <> 0 THEN listing_id % 97 END AS buyer, CASE WHEN seller_id % 13 <> 0 THEN 90.0::DOUBLE + seller_id % 10 END AS feedback
  FROM listing),
th AS (
  SELECT listing_id, thread_id, count(*) AS rounds, count(*) FILTER (offer_type <> 2) AS bo, count(*) FILTER (offer_type = 2) AS so, max(amount) AS top,
         arg_min(amount, turn_index) AS fa, arg_min(status_id, turn_index) AS fs, arg_min(offer_type, turn_index) AS ft, bool_or(status_id IN (1, 9)) AS agreed,
         bool_or(status_id = 7 AND NOT coalesce(next_action = 'counter' AND next_actor = CASE WHEN actor = 'buyer' THEN 'seller' ELSE 'buyer' END, false)) AS t3,
         bool_or(status_id IN (1, 9) AND next_actor IS NOT NULL) AS t4
  FROM numbered GROUP BY 1, 2),
lt AS (SELECT listing_id, max(top) AS top, bool_or(bo > 3) AS t2b, bool_or(so > 3) AS t2s, bool_or(t3) AS t3, bool_or(t4) AS t4 FROM th GROUP BY 1),
lf0 AS (
  SELECT rl.*, listing_price > 1000 AS l1, coalesce(final_sale_price > listing_price, false) AS l2, coalesce(top > listing_price, false) AS t1, coalesce(t2b, false) AS t2b,
         coalesce(t2s, false) AS t2s, coalesce(t3, false) AS t3, coalesce(t4, false) AS t4, top IS NOT NULL AS threaded FROM rl LEFT JOIN lt USING (listing_id)),
lf AS (SELECT *, NOT (l1 OR l2 OR t1 OR t2b OR t2s OR t3 OR t4) AS main FROM lf0),
lm AS (SELECT *, main AND reference_count >= 20 AND condition_id IS NOT NULL AS ref, final_sale_price / listing_price AS share FROM lf),
tm AS (SELECT th.*, fa / listing_price AS ratio, ref FROM th JOIN lm USING (listing_id) WHERE main),
ob AS (
  SELECT unnest(['raw_listings.count', 'main_sample_listings.count', 'l1_price_over_1000.count', 'l1_price_over_1000.fraction', 'l2_sale_above_listing.count', 'l2_sale_above_listing.fraction',
    't1_offer_above_listing.count', 't1_offer_above_listing.fraction', 't2_offer_limit.buyer_count', 't2_offer_limit.buyer_fraction', 't2_offer_limit.seller_count', 't2_offer_limit.seller_fraction',
    't3_t4_sequence.missing_counter_count', 't3_t4_sequence.missing_counter_fraction', 't3_t4_sequence.accepted_not_last_count', 't3_t4_sequence.accepted_not_last_fraction',
    'listing_price_mean.value', 'listing_used_rate.value', 'listing_used_rate.denominator', 'listing_revised_rate.value', 'listing_sold_rate.value', 'listing_sold_best_offer_rate.value',
    'listing_received_offer_rate.value', 'listing_sale_price_to_list.value', 'listing_bargained_price_to_list.value', 'sellers.seller_count', 'buyers.count', 'reference_listings.count',
    'reference_sold_rate.value', 'reference_received_offer_rate.value', 'reference_bargained_price_to_list.value']) AS k,
   unnest([count(*), count(*) FILTER (main), count(*) FILTER (l1), avg(l1::INT), count(*) FILTER (l2), avg(l2::INT), count(*) FILTER (t1), avg(t1::INT), count(*) FILTER (t2b), avg(t2b::INT),
    count(*) FILTER (t2s), avg(t2s::INT), count(*) FILTER (t3), avg(t3::INT), count(*) FILTER (t4), avg(t4::INT), avg(listing_price) FILTER (main),
    avg((condition_id >= 3000)::INT) FILTER (main AND condition_id IS NOT NULL), count(*) FILTER (main AND condition_id IS NOT NULL), avg(revised::INT) FILTER (main),
    avg((final_sale_price IS NOT NULL)::INT) FILTER (main), avg(bargained::INT) FILTER (main), avg(threaded::INT) FILTER (main), avg(share) FILTER (main), avg(share) FILTER (main AND bargained),
    count(DISTINCT seller_id) FILTER (main), count(DISTINCT buyer) FILTER (main), count(*) FILTER (ref), avg((final_sale_price IS NOT NULL)::INT) FILTER (ref), avg(threaded::INT) FILTER (ref),
    avg(share) FILTER (ref AND bargained)]::DOUBLE[]) AS v FROM lm
  UNION ALL SELECT unnest(['sellers.feedback_sellers', 'sellers.feedback_mean']), unnest([count(f), avg(f)]::DOUBLE[]) FROM (SELECT max(feedback) AS f FROM lm WHERE main GROUP BY seller_id)
  UNION ALL SELECT unnest(['threads.count', 'thread_offers_mean.value', 'thread_agreement_rate.value', 'thread_first_offer_to_list.value', 'reference_thread_agreement_rate.value', 'game_tree_root.count',
      'first_seller_response.accept_share', 'first_seller_response.counter_share', 'first_seller_response.decline_share']),
    unnest([count(*) FILTER (ratio <= 1), avg(rounds) FILTER (ratio <= 1), avg(agreed::INT) FILTER (ratio <= 1), avg(ratio) FILTER (ratio <= 1), avg(agreed::INT) FILTER (ratio <= 1 AND ref),
      count(*) FILTER (ft = 0), avg((fs IN (1, 9))::INT) FILTER (ft = 0), avg((fs = 7)::INT) FILTER (ft = 0), avg((fs NOT IN (1, 7, 9))::INT) FILTER (ft = 0)]::DOUBLE[]) FROM tm)
"""


def raw_listings(t: Tables) -> DataFrame:
    k = c("listing_id")
    rows = B.listings(t)
    return rows.withColumns(
        {
            "final_sale_price": F.when(k % 5 != 0, c("final_sale_price") * 1.05), "sold_by_best_offer": c("sold_by_best_offer") & (k % 5 != 0),
            "condition_id": F.when(k % 10 != 0, c("age_days") * 25), "reference_count": k % 50, "revised": k % 4 == 0,
            "buyer_id_if_sold": F.when(k % 5 != 0, k % 97), "feedback_positive": F.when(c("seller_id") % 13 != 0, 90.0 + c("seller_id") % 10),
        }
    )


@query("d33_observed_moments", ctes(B.TURN, RAW) + "SELECT split_part(k, '.', 1) AS moment, split_part(k, '.', 2) AS component, round(v, 6) AS observed FROM ob")
def d33(t: Tables) -> DataFrame:
    return R.observed_moments(raw_listings(t), B.numbered(t)).withColumn("observed", F.round("observed", 6))


TARGET_ROWS = ", ".join(f"('{m}', '{k}', {e}::DOUBLE, {tol!r}::DOUBLE, {str(f).lower()})" for m, k, e, tol, f in R.TARGETS)


@query(
    "d33_replication_check",
    ctes(B.TURN, RAW)
    + f"""
    SELECT moment, component, expected, fatal, CASE WHEN v IS NULL THEN 'not_evaluated' WHEN abs(v - expected) <= tolerance THEN 'passed' ELSE 'failed' END AS status
    FROM (VALUES {TARGET_ROWS}) t(moment, component, expected, tolerance, fatal) LEFT JOIN ob ON k = moment || '.' || component
    """,
)
def d33_check(t: Tables) -> DataFrame:
    out = R.replication_check(R.observed_moments(raw_listings(t), B.numbered(t)))
    return out.select("moment", "component", "expected", "fatal", "status")


SCALE = ", ".join(f"avg({x}) AS m_{x}, CASE WHEN stddev_pop({x}) > 1e-9 THEN stddev_pop({x}) ELSE 1 END AS s_{x}" for x in B.REG_NAMES)
DISTANCE = " + ".join(f"pow((d.{x} - m_{x}) / s_{x} - (t.{x} - m_{x}) / s_{x}, 2)" for x in B.REG_NAMES)


@query(
    "d14_nearest",
    ctes(B.CASE_REG)
    + f"""
    , sc AS (SELECT {SCALE} FROM train_reg),
    pairs AS (SELECT d.doc_id, t.target, row_number() OVER (PARTITION BY d.doc_id ORDER BY round({DISTANCE}, 9), t.doc_id) AS k FROM dev_reg d, train_reg t, sc)
    SELECT doc_id, CASE WHEN target = 1 THEN 0.8 ELSE 0.2 END::DOUBLE AS p FROM pairs WHERE k = 1
    """,
)
def d14_nearest(t: Tables) -> DataFrame:
    train, dev = regions(B.case_reg(t))
    return predict_nearest(dev, train, B.REG_NAMES, "doc_id").select("doc_id", "p")


@query(
    "d24_regression_leaderboard",
    ORACLES["d08_regression_baselines"].replace(
        "SELECT model_id, count(*) AS n, round(sqrt", "SELECT model_id, row_number() OVER (ORDER BY sqrt(avg((x - y) * (x - y))), model_id)::INTEGER AS place, round(sqrt"
    ).replace(
        "AS rmse, round(avg(abs(x - y)), 6) AS mae,\n           round(avg(greatest(0.5 * (y - x), -0.5 * (y - x))), 6) AS quantile_loss FROM long",
        "AS rmse, round(sqrt(avg((x - y) * (x - y))) / max(sqrt(avg((x - y) * (x - y)))) FILTER (model_id = 'median_regressor') OVER (), 6) AS error_ratio FROM long",
    ),
)
def d24_regression(t: Tables) -> DataFrame:
    train, dev = regions(B.split_cases(t, "final_price_ratio"))
    scores = E.score_regression(M.regression_baselines(dev, train), ["model_id"])
    scores = scores.withColumns({"task": F.lit("final_price_ratio"), "split": F.lit("chronological"), "complexity": F.lit(1)})
    rows = E.leaderboard(scores, "rmse", ["median_regressor"])
    return rows.select("model_id", "place", F.round("rmse", 6).alias("rmse"), F.round("error_ratio", 6).alias("error_ratio"))


@query(
    "d30_tie_perturbation",
    f"""
    WITH o AS (SELECT o_orderkey, o_orderdate, sha256(o_orderkey::VARCHAR) AS h FROM orders),
    p AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (ORDER BY o_orderdate, h) AS b, count(*) OVER () AS n FROM o)
    SELECT count(*) AS rows, count(CASE WHEN {region_sql('a', 'n')} <> {region_sql('b', 'n')} THEN 1 END) AS moved FROM p
    """,
)
def d30_ties(t: Tables) -> DataFrame:
    """Rows whose region hangs on how equal timestamps are ordered."""
    rows = t.orders.select("o_orderkey", "o_orderdate", F.sha2(c("o_orderkey").cast("string"), 256).alias("h"))
    a = P.chronological_split(rows, "o_orderdate", "o_orderkey").select("o_orderkey", c("region").alias("a"))
    b = P.chronological_split(rows, "o_orderdate", "h").select("o_orderkey", c("region").alias("b"))
    return a.join(b, "o_orderkey").agg(F.count("*").alias("rows"), F.count_if(c("a") != c("b")).alias("moved"))
