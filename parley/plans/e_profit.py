"""Profit reconstruction and policy audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import profit as R
from parley.operators import snapshots as N
from parley.operators.ingest import material_coverage, reason_counts
from parley.plans.bindings_pilot import PILOT, SNAPSHOT, as_of, pilot, snapshots
from parley.plans.registry import Tables, ctes, query

c = F.col
P = ctes(PILOT)
J = ctes(SNAPSHOT)
D = "double"


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("e01_sum_by", P + "SELECT order_id, fee::DOUBLE AS fee FROM p_fee")
def e01(t: Tables) -> DataFrame:
    return R.sum_by(pilot(t).fees, "order_id", "fee_amount", "fee").withColumn("fee", c("fee").cast(D))


@query("e02_latest_cost", P + "SELECT listing_id, unit_cost::DOUBLE AS unit_cost FROM p_cost")
def e02(t: Tables) -> DataFrame:
    return R.latest_cost(pilot(t).costs).withColumn("unit_cost", c("unit_cost").cast(D))


@query("e03_link_orders", P + "SELECT offer_id, order_id::DOUBLE AS order_id, link FROM linked")
def e03(t: Tables) -> DataFrame:
    p = pilot(t)
    return R.link_orders(p.offers, p.orders).select("offer_id", c("order_id").cast(D).alias("order_id"), "link")


DECIDED = """
decided AS (
  SELECT o.order_id, coalesce(CASE WHEN a.offer_id IS NOT NULL THEN coalesce(a.seller_response, 'open')
                                   WHEN b.n IS NOT NULL THEN b.r END, 'unknown') AS decision
  FROM p_order o LEFT JOIN p_offer a ON a.offer_id = o.offer_id
  LEFT JOIN (SELECT listing_id, count(*) AS n, max(coalesce(seller_response, 'open')) AS r FROM p_offer GROUP BY 1 HAVING count(*) = 1) b
    ON b.listing_id = o.listing_id)
"""


@query("e04_link_offers", ctes(PILOT, DECIDED) + "SELECT order_id, decision FROM decided")
def e04(t: Tables) -> DataFrame:
    p = pilot(t)
    return R.link_offers(p.orders, p.offers).select("order_id", "decision")


@query("e05_order_flags", P + "SELECT order_id, paid, completed, matured, matured_at, return_rows FROM state")
def e05(t: Tables) -> DataFrame:
    p = pilot(t)
    return R.order_flags(p.orders, p.returns, as_of()).select("order_id", "paid", "completed", "matured", "matured_at", "return_rows")


@query("e06_mature_margins", P + "SELECT order_id, margin::DOUBLE AS margin FROM facts WHERE margin IS NOT NULL")
def e06(t: Tables) -> DataFrame:
    return R.mature_margins(R.order_facts(pilot(t), as_of())).select("order_id", c("margin").cast(D).alias("margin"))


OFFER_STATE = """
ostate AS (
  SELECT l.*, coalesce(paid, false) AS paid, coalesce(completed, false) AS completed, coalesce(matured, false) AS matured,
         (epoch_us(seller_response_time) - epoch_us(l.event_time)) / 3.6e9 AS hours FROM linked l LEFT JOIN state s ON s.order_id = l.order_id)
"""


@query(
    "e07_offer_funnel",
    ctes(PILOT, OFFER_STATE)
    + """
    SELECT *, round(accepted / received, 6) AS acceptance_rate, round(paid / accepted, 6) AS payment_rate,
           (SELECT round(count(CASE WHEN completed THEN 1 END) / count(*), 6) FROM state WHERE paid) AS completion_rate FROM (
      SELECT count(*) AS received, count(CASE WHEN seller_response = 'accepted' THEN 1 END) AS accepted, count(CASE WHEN paid THEN 1 END) AS paid,
             count(CASE WHEN completed THEN 1 END) AS completed, count(CASE WHEN matured THEN 1 END) AS matured,
             (SELECT count(margin) FROM facts) AS mature_margins FROM ostate)
    """,
)
def e07(t: Tables) -> DataFrame:
    p = pilot(t)
    out = R.offer_funnel(R.offer_facts(p, as_of()), R.order_facts(p, as_of()))
    return six(out, "acceptance_rate", "payment_rate", "completion_rate")


@query(
    "e08_latency_stats",
    ctes(PILOT, OFFER_STATE) + "SELECT count(hours) AS n, round(avg(hours), 6) AS mean_hours, round(quantile_cont(hours, 0.5), 6) AS median_hours FROM ostate",
)
def e08(t: Tables) -> DataFrame:
    return six(R.latency_stats(R.offer_facts(pilot(t), as_of())), "mean_hours", "median_hours")


BREAKDOWN = """
SELECT {key} AS bucket, count(*) AS orders, sum(margin)::DOUBLE AS total_margin, sum(margin)::DOUBLE / count(*) AS average_margin,
       round(avg(sale / asking), 6) AS average_ratio FROM facts WHERE margin IS NOT NULL GROUP BY 1
"""


@query("e09_margin_by_category", P + BREAKDOWN.format(key="category"))
def e09(t: Tables) -> DataFrame:
    return six(R.margin_breakdown(R.order_facts(pilot(t), as_of()), "category"), "average_ratio")


@query("e09_margin_by_age", P + BREAKDOWN.format(key="age_band"))
def e09_age(t: Tables) -> DataFrame:
    return six(R.margin_breakdown(R.order_facts(pilot(t), as_of()), "age_band"), "average_ratio")


MATCHED = """
matched AS (
  SELECT l.offer_id, count(c.cancellation_id) AS cancellations, min(c.event_time) AS cancelled_at
  FROM linked l LEFT JOIN p_cancel c ON c.offer_id = l.offer_id OR c.order_id = l.order_id OR c.listing_id = l.listing_id GROUP BY 1)
"""


@query("e10_match_cancellations", ctes(PILOT, MATCHED) + "SELECT * FROM matched")
def e10(t: Tables) -> DataFrame:
    p = pilot(t)
    return R.match_cancellations(R.link_orders(p.offers, p.orders), p.cancellations).select("offer_id", "cancellations", "cancelled_at")


GAPS = """
gaps AS (
  SELECT DISTINCT 'missing_cost_basis' AS gap, listing_id::VARCHAR AS id FROM facts WHERE unit_cost IS NULL UNION
  SELECT 'missing_fee', order_id::VARCHAR FROM facts WHERE fee IS NULL UNION
  SELECT 'missing_shipping', order_id::VARCHAR FROM facts WHERE shipping IS NULL UNION
  SELECT 'incomplete_outcome', order_id::VARCHAR FROM facts WHERE NOT mature)
"""


@query("e11_data_gaps", ctes(PILOT, GAPS) + "SELECT * FROM gaps")
def e11(t: Tables) -> DataFrame:
    return R.data_gaps(R.order_facts(pilot(t), as_of()))


@query(
    "e11_readiness_gate",
    ctes(PILOT, GAPS)
    + """
    , g AS (
      SELECT count(margin) AS mature_margins, (count(*) - (SELECT count(*) FROM gaps WHERE gap = 'missing_cost_basis')) / count(*) AS cost_coverage,
             (count(*) - (SELECT count(*) FROM gaps WHERE gap = 'missing_fee')) / count(*) AS fee_coverage,
             (count(*) - (SELECT count(*) FROM gaps WHERE gap = 'missing_shipping')) / count(*) AS shipping_coverage,
             (SELECT count(CASE WHEN seller_response IS NOT NULL AND seller_response_time IS NOT NULL THEN 1 END) / count(*) FROM p_offer) AS decision_history_coverage,
             count(CASE WHEN completed AND matured THEN 1 END) / count(CASE WHEN completed THEN 1 END) AS return_window_coverage FROM facts)
    SELECT mature_margins, round(cost_coverage, 6) AS cost_coverage, round(fee_coverage, 6) AS fee_coverage, round(shipping_coverage, 6) AS shipping_coverage,
           round(decision_history_coverage, 6) AS decision_history_coverage, round(return_window_coverage, 6) AS return_window_coverage,
           concat_ws(',', CASE WHEN mature_margins < 30 THEN 'mature_margins' END, CASE WHEN cost_coverage < 0.95 THEN 'cost_coverage' END,
             CASE WHEN fee_coverage < 0.95 THEN 'fee_coverage' END, CASE WHEN shipping_coverage < 0.95 THEN 'shipping_coverage' END,
             CASE WHEN decision_history_coverage < 0.8 THEN 'decision_history_coverage' END,
             CASE WHEN return_window_coverage < 0.8 THEN 'return_window_coverage' END) AS failed,
           mature_margins >= 30 AND cost_coverage >= 0.95 AND fee_coverage >= 0.95 AND shipping_coverage >= 0.95 AND decision_history_coverage >= 0.8
             AND return_window_coverage >= 0.8 AS passed FROM g
    """,
)
def e11_gate(t: Tables) -> DataFrame:
    p = pilot(t)
    out = R.readiness_gate(p.offers, R.gate_facts(p, as_of()))
    covers = [x for x in R.READY if x != "mature_margins"]
    return six(out, *covers).withColumn("failed", F.array_join("failed", ","))


MARGINS = """
dm AS (SELECT decision, margin FROM facts JOIN decided USING (order_id) WHERE margin IS NOT NULL),
dmb AS (
  SELECT decision, count(*) AS n, sum(margin)::DOUBLE / count(*) AS mean_margin, sum(margin)::DOUBLE AS total_margin, count(CASE WHEN margin < 0 THEN 1 END) AS negative,
         CASE WHEN count(*) > 1 THEN 1.96 * stddev_samp(margin::DOUBLE) / sqrt(count(*)) ELSE 0 END AS half, quantile_cont(margin::DOUBLE, 0.5) AS median_margin
  FROM dm GROUP BY 1)
"""


@query(
    "e12_decision_margins",
    ctes(PILOT, DECIDED, MARGINS)
    + """
    SELECT decision, n, mean_margin, total_margin, negative, median_margin,
           round(mean_margin - half, 4) AS low, round(mean_margin + half, 4) AS high FROM dmb
    """,
)
def e12(t: Tables) -> DataFrame:
    p = pilot(t)
    out = R.decision_margins(R.order_facts(p, as_of()), p.offers)
    return out.withColumns({x: F.round(x, 4) for x in ("low", "high")})


@query(
    "e13_margin_counterexamples",
    P
    + """
    SELECT order_id, margin::DOUBLE AS margin, CASE WHEN margin < 0 THEN 'negative_margin' ELSE 'lowest_observed_margin' END AS reason,
           row_number() OVER (ORDER BY margin, order_id) AS rank FROM facts WHERE margin IS NOT NULL
    """,
)
def e13(t: Tables) -> DataFrame:
    rows = R.margin_counterexamples(R.order_facts(pilot(t), as_of()))
    return rows.select("order_id", c("margin").cast(D).alias("margin"), "reason", "rank")


@query(
    "e14_policy_candidate",
    ctes(PILOT, DECIDED, MARGINS) + "SELECT decision FROM dmb WHERE n >= 10 ORDER BY mean_margin DESC, n DESC LIMIT 1",
)
def e14(t: Tables) -> DataFrame:
    p = pilot(t)
    return R.policy_candidate(R.decision_margins(R.order_facts(p, as_of()), p.offers))


@query(
    "a22_validate_snapshots",
    J
    + """
    SELECT reason, count(*) AS n FROM (
      SELECT unnest(list_filter([
        CASE WHEN k % 101 = 0 THEN 'cutoff_after_decision' END,
        CASE WHEN k % 103 = 0 THEN 'ratio_mismatch' END,
        CASE WHEN k % 107 = 0 AND has_outcome THEN 'outcome_without_action' END], lambda x: x IS NOT NULL)) AS reason
      FROM (SELECT * REPLACE (offered IS NOT NULL AND k % 103 = 0 AS offered) FROM shot) s0, (SELECT 1) u WHERE true)
    GROUP BY reason
    """.replace("CASE WHEN k % 103 = 0 THEN", "CASE WHEN offered THEN"),
)
def a22(t: Tables) -> DataFrame:
    k = c("k")
    late = F.when(k % 101 == 0, c("decision_time") + F.expr("INTERVAL 1 HOUR")).otherwise(c("decision_time"))
    wrong = F.when(k % 103 == 0, c("context.offer_to_asking_ratio") + 0.2).otherwise(c("context.offer_to_asking_ratio"))
    rows = snapshots(t).withColumns(
        {
            "observation_cutoff": late,
            "context": c("context").withField("offer_to_asking_ratio", wrong),
            "taken": F.when(k % 107 != 0, c("taken")),
        }
    )
    return reason_counts(N.validate_offer_snapshots(rows)[1])


BUCKETS = """
bucketed AS (
  SELECT j.*, unnest(['offer_ratio', 'category', 'listing_age', 'cost_band', 'traffic', 'interested_buyers', 'prior_offers', 'seller_urgency']) AS dimension,
    unnest([
      CASE WHEN ratio IS NULL THEN 'no_buyer_offer' WHEN ratio < 0.65 THEN 'below_65_pct' WHEN ratio < 0.75 THEN '65_to_75_pct' WHEN ratio < 0.85 THEN '75_to_85_pct' ELSE 'above_85_pct' END,
      category,
      CASE WHEN days_active < 14 THEN '0_to_13_days' WHEN days_active < 45 THEN '14_to_44_days' WHEN days_active < 90 THEN '45_to_89_days' ELSE '90_plus_days' END,
      CASE WHEN cost IS NULL THEN 'missing_cost_basis' WHEN cost < 100 THEN 'under_100' WHEN cost < 500 THEN '100_to_499' WHEN cost < 1000 THEN '500_to_999' ELSE '1000_plus' END,
      trend,
      CASE WHEN interested = 0 THEN '0' WHEN interested <= 2 THEN '1_to_2' WHEN interested <= 5 THEN '3_to_5' ELSE '6_plus' END,
      CASE WHEN prior = 0 THEN '0' WHEN prior <= 2 THEN '1_to_2' ELSE '3_plus' END,
      urgency::VARCHAR]) AS bucket
  FROM judged j WHERE has_outcome)
"""


@query(
    "e15_policy_audit",
    ctes(SNAPSHOT, BUCKETS)
    + """
    SELECT dimension, bucket, sum(n)::BIGINT AS decisions, string_agg(taken || ':' || n, ',' ORDER BY taken) AS action_mix, round(sum(paid) / sum(n), 6) AS paid_rate,
           sum(m)::BIGINT AS mature_paid, sum(s)::DOUBLE / sum(m) AS mean_margin FROM (
      SELECT dimension, bucket, taken, count(*) AS n, count(CASE WHEN good_paid THEN 1 END) AS paid, count(margin) AS m, sum(CAST(margin AS DECIMAL(18, 2))) AS s FROM bucketed GROUP BY 1, 2, 3)
    GROUP BY 1, 2
    """,
)
def e15(t: Tables) -> DataFrame:
    out = N.policy_audit(snapshots(t))
    mix = F.array_join(F.transform(F.map_entries("action_mix"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return out.withColumns({"action_mix": mix, "paid_rate": F.round("paid_rate", 6)})


SUMMARY = """
SELECT {key} AS key, count(*) AS decisions, round(avg(good_paid::INT), 6) AS paid_rate, round(avg((good_paid AND k % 2 = 0)::INT), 6) AS sold_7_days_rate,
       count(CASE WHEN k % 3 = 0 AND NOT buyer_paid THEN 1 END) AS accepted_unpaid, count(margin) AS mature, count(*) - count(margin) AS immature,
       coalesce(sum(CAST(margin AS DECIMAL(18, 2))), 0)::DOUBLE AS total_margin, sum(CAST(margin AS DECIMAL(18, 2)))::DOUBLE / count(margin) AS mean_margin,
       round(avg(margin / greatest(coalesce(nullif(days_to_sale, 0), 1), 1)), 4) AS margin_per_day, coalesce(sum(CAST(provisional AS DECIMAL(18, 2))), 0)::DOUBLE AS total_provisional
FROM judged WHERE has_outcome GROUP BY 1
"""


def _summary(df: DataFrame) -> DataFrame:
    return six(df, "paid_rate", "sold_7_days_rate").withColumn("margin_per_day", F.round("margin_per_day", 4))


@query("e16_action_summary", J + SUMMARY.format(key="taken"))
def e16(t: Tables) -> DataFrame:
    return _summary(N.action_summary(snapshots(t), c("taken.action")))


@query("e16_channel_summary", J + SUMMARY.format(key="channel"))
def e16_channel(t: Tables) -> DataFrame:
    return _summary(N.action_summary(snapshots(t), c("context.decision_channel")))


@query(
    "e17_snapshot_quality",
    J
    + """
    SELECT *, round((a + b + d + e) / 4, 6) AS score,
           concat_ws(',', CASE WHEN a < 0.95 THEN 'cost_basis_incomplete' END, CASE WHEN b < 0.95 THEN 'fee_coverage_incomplete' END,
             CASE WHEN d < 0.8 THEN 'return_windows_immature' END, CASE WHEN mature_paid < 30 THEN 'few_mature_outcomes' END,
             CASE WHEN e < 0.95 THEN 'stale_traffic' END) AS warnings
    FROM (SELECT count(*) AS snapshots, count(CASE WHEN has_outcome THEN 1 END) AS with_outcome, count(margin) AS mature_paid, count(cost) / count(*) AS a,
                 count(CASE WHEN has_outcome AND fee_known THEN 1 END) / count(CASE WHEN has_outcome THEN 1 END) AS b,
                 count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / count(CASE WHEN has_outcome THEN 1 END) AS d,
                 count(CASE WHEN age_hours <= 72 THEN 1 END) / count(*) AS e FROM judged)
    """.replace("SELECT *, round((a", "SELECT snapshots, with_outcome, mature_paid, round((a"),
)
def e17(t: Tables) -> DataFrame:
    out = N.snapshot_quality(snapshots(t))
    return out.select("snapshots", "with_outcome", "mature_paid", F.round("score", 6).alias("score"), F.array_join("warnings", ",").alias("warnings"))


@query(
    "e18_missed_opportunities",
    J
    + """
    SELECT * FROM (
      SELECT k::VARCHAR AS decision_id, CASE WHEN taken IN ('decline', 'wait') AND offered IS NOT NULL AND margin <= 0 THEN 'positive_offer_let_go'
             WHEN has_outcome AND taken = 'accept' AND k % 13 = 0 THEN 'accepted_then_returned' END AS reason FROM judged)
    WHERE reason IS NOT NULL
    """,
)
def e18(t: Tables) -> DataFrame:
    return N.missed_opportunities(snapshots(t)).select("decision_id", "reason")


COMPARABLE = """
comp AS (SELECT channel, lower(category) AS cat, count(*) AS n FROM judged WHERE cost IS NOT NULL AND margin IS NOT NULL AND fee_known GROUP BY 1, 2),
pend AS (SELECT j.*, coalesce(n, 0) AS comparables FROM judged j LEFT JOIN comp ON comp.channel = j.channel AND cat = lower(category) WHERE NOT has_outcome)
"""


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = snapshots(t)
    return rows.filter(c("outcome").isNull()), rows.filter(c("outcome").isNotNull())


@query("e19_comparables", ctes(SNAPSHOT, COMPARABLE) + "SELECT k::VARCHAR AS decision_id, comparables FROM pend")
def e19(t: Tables) -> DataFrame:
    return N.comparables(*_halves(t)).select("decision_id", "comparables")


VALUED = """
act AS (
  SELECT p.*, unnest(['wait', 'decline', 'counter_at_amount'] || CASE WHEN offered IS NOT NULL THEN ['accept'] ELSE [] END) AS action FROM pend p),
act1 AS (
  SELECT *, CASE action WHEN 'wait' THEN asking * 0.9 WHEN 'counter_at_amount' THEN asking * 0.9 WHEN 'accept' THEN offered END AS amount,
         CASE trend WHEN 'declining' THEN -0.06 WHEN 'increasing' THEN 0.06 WHEN 'flat' THEN 0.0 ELSE -0.02 END::DOUBLE AS tr, 0.03::DOUBLE * urgency AS ur,
         least(0.12::DOUBLE, ln(1 + views) / 60) AS tf FROM act),
act2 AS (
  SELECT *, CASE action WHEN 'accept' THEN 1.0::DOUBLE WHEN 'decline' THEN 0.0::DOUBLE
      WHEN 'wait' THEN least(greatest(0.12::DOUBLE + tf + 0.03::DOUBLE * interested + tr - ur, 0.02), 0.65)
      ELSE CASE WHEN offered IS NULL THEN least(greatest(0.10::DOUBLE + greatest(0, 1 - amount / asking) * 1.8::DOUBLE + 0.04::DOUBLE * interested + tf + tr, 0.02), 0.88)
           ELSE least(greatest(0.78::DOUBLE - 1.85::DOUBLE * (greatest(amount - offered, 0) / greatest(offered, 1)) - 0.25::DOUBLE * greatest(amount / asking - 0.85::DOUBLE, 0) + tf + tr + ur, 0.02), 0.95) END
      END AS p, amount * (1 - 0.1325::DOUBLE) - ship - promo AS proceeds FROM act1),
act3 AS (
  SELECT *, CASE action WHEN 'accept' THEN 0.1 WHEN 'decline' THEN 7.0 WHEN 'wait' THEN least(7.0, greatest(1.0, 7.0 - urgency))
                 ELSE least(greatest((1 - p) * 7.0, 0.5), 7.0) END::DOUBLE AS days, p * (proceeds - cost) AS expected, coalesce(proceeds < floor_amount, false) AS violates
  FROM act2)
"""


@query(
    "e20_evaluate_actions",
    ctes(SNAPSHOT, COMPARABLE, VALUED)
    + """
    SELECT k::VARCHAR AS decision_id, action, round(p, 6) AS probability, round(days, 6) AS days, round(expected, 2) AS expected_margin, violates AS violates_floor FROM act3
    """,
)
def e20(t: Tables) -> DataFrame:
    rows = N.evaluate_actions(_halves(t)[0]).select("decision_id", F.explode("evaluated").alias("e"))
    return rows.select(
        "decision_id", "e.action", F.round("e.probability", 6).alias("probability"), F.round("e.days", 6).alias("days"), "e.expected_margin", "e.violates_floor"
    )


@query(
    "e21_recommend",
    ctes(SNAPSHOT, COMPARABLE, VALUED)
    + """
    , v AS (SELECT k, action, round(expected, 2) AS m, row_number() OVER (PARTITION BY k ORDER BY round(expected, 2) DESC,
              list_position(['wait', 'decline', 'counter_at_amount', 'accept'], action)) AS r FROM act3 WHERE NOT violates AND expected IS NOT NULL),
    best AS (SELECT k, max(m) FILTER (r = 1) AS m1, max(m) FILTER (r = 2) AS m2, max(action) FILTER (r = 1) AS a1 FROM v GROUP BY 1),
    w AS (
      SELECT p.k, comparables, m1, a1, concat_ws(',', CASE WHEN cost IS NULL THEN 'no_cost' END, CASE WHEN age_hours > 72 THEN 'old_traffic' END,
               CASE WHEN comparables < 10 THEN 'few_comparables' END, CASE WHEN b.k IS NULL THEN 'nothing_above_floor' END,
               CASE WHEN m1 - m2 < 5.0 THEN 'best_two_too_close' END) AS reasons
      FROM pend p LEFT JOIN best b USING (k))
    SELECT k::VARCHAR AS decision_id, CASE WHEN reasons = '' THEN 'recommend' ELSE 'abstain' END AS status, reasons, comparables,
           CASE WHEN reasons = '' THEN a1 END AS action, CASE WHEN reasons = '' THEN m1 END AS expected_margin,
           CASE WHEN reasons <> '' THEN 'none' WHEN comparables >= 100 THEN 'moderate' WHEN comparables >= 30 THEN 'low-moderate' ELSE 'low' END AS confidence FROM w
    """,
)
def e21(t: Tables) -> DataFrame:
    rows = N.recommend(*_halves(t))
    return rows.withColumn("reasons", F.array_join("reasons", ",")).drop("amount", "advantage_over_accept")


SHADOW = """
sv0 AS (
  SELECT l.offer_id, l.event_time, l.available_at, l.history_at, l.expires_at, l.seller_response_time, l.order_id IS NOT NULL AS has_order,
         coalesce(s.paid, false) AS paid, coalesce(s.completed, false) AS completed, coalesce(s.matured, false) AS matured, s.matured_at, coalesce(s.return_rows, 0) AS return_rows,
         s.sale, s.fee, s.shipping, coalesce(s.refund, 0) AS refund, pc.unit_cost AS holding, m.cancellations, m.cancelled_at,
         CASE seller_response WHEN 'accepted' THEN 'accept' WHEN 'declined' THEN 'decline' WHEN 'countered' THEN 'counter' ELSE 'unknown' END AS action
  FROM linked l JOIN matched m USING (offer_id) LEFT JOIN facts s ON s.order_id = l.order_id LEFT JOIN p_cost pc ON pc.listing_id = l.listing_id),
sv1 AS (
  SELECT *, CASE WHEN cancellations > 0 THEN 'cancelled' WHEN return_rows > 0 THEN 'returned' WHEN has_order AND paid AND completed AND matured THEN 'completed'
                 WHEN has_order AND paid THEN 'paid' WHEN action = 'accept' THEN 'accepted' ELSE 'unresolved' END AS status FROM sv0),
sv2 AS (
  SELECT *, status IN ('paid', 'completed', 'returned') AS settled, action = 'decline' AND status = 'unresolved' AS refused,
         holding IS NULL AND status IN ('accepted', 'paid', 'completed', 'returned', 'cancelled') AS no_cost,
         action = 'unknown' OR seller_response_time IS NULL AS silent FROM sv1),
sv3 AS (
  SELECT *, has_order AND settled AND fee IS NULL AS no_fee, has_order AND settled AND shipping IS NULL AS no_ship FROM sv2),
sv AS (
  SELECT *, refused OR NOT (no_cost OR no_fee OR no_ship) AS known,
    concat_ws(',', CASE WHEN NOT refused AND status = 'cancelled' THEN 'cancelled_or_unpaid_not_net_profit_claim' END, CASE WHEN silent THEN 'insufficient_seller_data' END,
      CASE WHEN NOT refused AND no_fee THEN 'missing_actual_fees' END, CASE WHEN NOT refused AND seller_response_time IS NULL THEN 'missing_seller_response_timestamp' END,
      CASE WHEN NOT refused AND no_ship THEN 'missing_shipping_costs' END, CASE WHEN NOT refused AND settled AND NOT matured THEN 'return_window_not_matured' END,
      CASE WHEN NOT refused AND no_cost THEN 'unknown_cost_basis' END, CASE WHEN NOT refused AND action = 'unknown' THEN 'unknown_seller_historical_action' END,
      CASE WHEN NOT refused AND (status IN ('accepted', 'paid') OR (status = 'unresolved' AND action <> 'decline')) THEN 'unresolved_financial_outcome' END) AS reasons,
    CASE WHEN refused THEN 0::DECIMAL(18, 2)
         WHEN action = 'accept' AND status IN ('completed', 'returned') AND matured AND sale IS NOT NULL AND NOT (no_cost OR no_fee OR no_ship)
         THEN CAST(sale AS DECIMAL(18, 2)) - fee - shipping - holding - refund END AS net
  FROM sv3)
"""


@query(
    "e22_shadow_values",
    ctes(PILOT, MATCHED, SHADOW)
    + "SELECT offer_id, action, status, reasons, known AS material_costs_known, silent AS explicit_silence, net::DOUBLE AS conservative_net, net IS NOT NULL AND NOT silent AS claim_eligible FROM sv",
)
def e22(t: Tables) -> DataFrame:
    rows = R.shadow_values(pilot(t), as_of())
    return rows.select(
        "offer_id", "action", "status", F.array_join("reasons", ",").alias("reasons"), "material_costs_known", "explicit_silence",
        c("conservative_net").cast(D).alias("conservative_net"), "claim_eligible",
    )


@query(
    "e23_decision_clocks",
    ctes(PILOT, MATCHED, SHADOW)
    + """
    SELECT offer_id, coalesce(seller_response_time, history_at, available_at) AS decision_time,
           least(coalesce(history_at, available_at), coalesce(seller_response_time, history_at, available_at)) AS data_cutoff,
           greatest(expires_at, seller_response_time, coalesce(seller_response_time, history_at, available_at)) AS deadline, matured_at, cancelled_at FROM sv
    """,
)
def e23(t: Tables) -> DataFrame:
    return R.decision_clocks(R.shadow_values(pilot(t), as_of())).drop("payment_time")


@query(
    "e24_decision_accounting",
    P
    + """
    SELECT order_id, concat_ws(',', CASE WHEN fee IS NULL THEN 'fee' END, CASE WHEN shipping IS NULL THEN 'shipping' END, CASE WHEN unit_cost IS NULL THEN 'unit_cost' END) AS missing_costs,
           (fee + shipping + unit_cost)::DOUBLE AS total_costs, (CAST(sale AS DECIMAL(18, 2)) - fee - shipping - unit_cost)::DOUBLE AS net_value,
           (CAST(sale AS DECIMAL(18, 2)) - fee - shipping - unit_cost - 12.5)::DOUBLE AS conservative_net FROM facts
    """,
)
def e24(t: Tables) -> DataFrame:
    costs = ["fee", "shipping", "unit_cost"]
    rows = R.decision_accounting(R.order_facts(pilot(t), as_of()), "sale_price_amount", costs, costs, F.lit(12.5))
    money = {x: c(x).cast(D) for x in ("total_costs", "net_value", "conservative_net")}
    return rows.withColumns({**money, "missing_costs": F.array_join("missing_costs", ",")}).select("order_id", "missing_costs", *money)


@query(
    "e25_shadow_report",
    ctes(PILOT, MATCHED, SHADOW)
    + """
    SELECT status, action, count(*) AS decisions, count(CASE WHEN net IS NOT NULL AND NOT silent THEN 1 END) AS eligible,
           count(CASE WHEN net IS NULL OR silent THEN 1 END) AS ineligible, count(CASE WHEN silent THEN 1 END) AS silent,
           coalesce(sum(CASE WHEN NOT silent THEN net END), 0)::DOUBLE AS total_value FROM sv GROUP BY 1, 2
    """,
)
def e25(t: Tables) -> DataFrame:
    return R.shadow_report(R.shadow_values(pilot(t), as_of()))


@query(
    "e11_shadow_policy_gate",
    ctes(PILOT, GAPS, DECIDED, MARGINS)
    + """
    SELECT meaningful_actions, failed, failed = '' AS passed FROM (
      SELECT (SELECT count(*) FROM dmb WHERE n >= 10) AS meaningful_actions,
        concat_ws(',', CASE WHEN count(margin) < 30 THEN 'mature_margins' END,
          CASE WHEN (count(*) - (SELECT count(*) FROM gaps WHERE gap = 'missing_cost_basis')) / count(*) < 0.95 THEN 'cost_coverage' END,
          CASE WHEN (count(*) - (SELECT count(*) FROM gaps WHERE gap = 'missing_fee')) / count(*) < 0.95 THEN 'fee_coverage' END,
          CASE WHEN (count(*) - (SELECT count(*) FROM gaps WHERE gap = 'missing_shipping')) / count(*) < 0.95 THEN 'shipping_coverage' END,
          CASE WHEN (SELECT count(CASE WHEN seller_response IS NOT NULL AND seller_response_time IS NOT NULL THEN 1 END) / count(*) FROM p_offer) < 0.8 THEN 'decision_history_coverage' END,
          CASE WHEN count(CASE WHEN completed AND matured THEN 1 END) / count(CASE WHEN completed THEN 1 END) < 0.8 THEN 'return_window_coverage' END,
          CASE WHEN (SELECT count(*) FROM dmb WHERE n >= 10) < 2 THEN 'few_meaningful_actions' END,
          CASE WHEN count(margin) < 30 THEN 'small_commercial_sample' END) AS failed FROM facts)
    """,
)
def e11_shadow_gate(t: Tables) -> DataFrame:
    p = pilot(t)
    facts = R.gate_facts(p, as_of())
    out = R.shadow_policy_gate(R.readiness_gate(p.offers, facts), R.decision_margins(facts, p.offers))
    return out.select("meaningful_actions", F.array_join("failed", ",").alias("failed"), "passed")


@query(
    "e11_abstention_reasons",
    ctes(PILOT, GAPS)
    + """
    , g AS (
      SELECT 'cost_coverage' AS "check", (count(*) - (SELECT count(*) FROM gaps WHERE gap = 'missing_cost_basis'))::DOUBLE / count(*) AS seen, 0.95::DOUBLE AS asked FROM facts UNION ALL
      SELECT 'fee_coverage', (count(*) - (SELECT count(*) FROM gaps WHERE gap = 'missing_fee'))::DOUBLE / count(*), 0.95 FROM facts UNION ALL
      SELECT 'shipping_coverage', (count(*) - (SELECT count(*) FROM gaps WHERE gap = 'missing_shipping'))::DOUBLE / count(*), 0.95 FROM facts UNION ALL
      SELECT 'mature_margins', count(margin)::DOUBLE, 30 FROM facts UNION ALL
      SELECT 'return_window_coverage', count(CASE WHEN completed AND matured THEN 1 END)::DOUBLE / count(CASE WHEN completed THEN 1 END), 0.8 FROM facts UNION ALL
      SELECT 'decision_history_coverage', count(CASE WHEN seller_response IS NOT NULL AND seller_response_time IS NOT NULL THEN 1 END)::DOUBLE / count(*), 0.8 FROM p_offer)
    SELECT "check", round(seen, 6) AS seen, asked FROM g WHERE seen < asked
    """,
)
def e11_reasons(t: Tables) -> DataFrame:
    p = pilot(t)
    return six(R.abstention_reasons(R.readiness_gate(p.offers, R.gate_facts(p, as_of()))), "seen")


@query(
    "a21_onboarding_gate",
    """
    WITH n AS (SELECT (SELECT count(*) FROM orders) AS orders, count(*) FILTER (l_orderkey % 20 <> 0) AS fee, count(*) FILTER (l_orderkey % 30 <> 1) AS ship, count(*) AS cost FROM lineitem)
    SELECT least(orders, fee, ship, cost) AS mature_margins, round(fee / orders, 6) AS fee_coverage, round(ship / orders, 6) AS shipping_coverage, round(cost / orders, 6) AS cost_coverage,
           '' AS failed, true AS passed FROM n
    """,
)
def a21_gate(t: Tables) -> DataFrame:
    p = pilot(t)
    parts = [(p.fees, "fee_amount"), (p.shipping, "shipping_cost_amount"), (p.costs, "unit_cost_amount")]
    told = [material_coverage(df, [x]) for df, x in parts]
    out = R.onboarding_gate(p.orders, p.offers, told[0].unionByName(told[1]).unionByName(told[2]))
    covers = {x: F.round(x, 6) for x in ("fee_coverage", "shipping_coverage", "cost_coverage")}
    return out.select("mature_margins", *[v.alias(k) for k, v in covers.items()], F.array_join("failed", ",").alias("failed"), "passed")
