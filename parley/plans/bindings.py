"""Domain inputs derived from the given tables, each with the SQL text that says the same.

Every binding reads whole tables. Planted defects (unknown codes, copies, gaps) are
mappings of rows; no rows are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.cases import build_cases, turn_features
from parley.operators.splits import chronological_purged_split, chronological_split
from parley.operators.models import LABELS, with_prediction
from parley.plans.registry import Tables
from parley.session import stage

c = F.col

LISTING = """
listing AS (
  SELECT p_partkey AS listing_id, p_partkey // 20 AS seller_id, p_type AS category, p_brand AS condition,
         p_retailprice AS listing_price, p_retailprice * (0.6 + (p_partkey % 40) / 100.0) AS final_sale_price,
         p_partkey % 3 <> 0 AS sold_by_best_offer, p_size * 4 AS age_days
  FROM part)
"""

TURN = LISTING + """,
turn0 AS (
  SELECT event_id, user_id AS buyer_id, ts AS event_time,
         CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS thread_id,
         user_id * 13 + CASE WHEN user_id % 10 = 0 THEN 0 ELSE 1 + (day(ts) - 1) // 3 END AS listing_id,
         CASE WHEN event_type IN ('view', 'signup') THEN 0 WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 2 END AS offer_type,
         [0, 1, 2, 6, 7, 8, 9][event_id % 7 + 1] AS status_id,
         CASE WHEN event_id % 11 <> 0 THEN ts + to_seconds(event_id % 5000) END AS response_time
  FROM events),
turn AS (
  SELECT t.*, l.listing_price * (0.40 + ((event_id * 7) % 65) / 100.0) AS amount,
         CASE WHEN offer_type = 2 THEN 'seller' ELSE 'buyer' END AS actor,
         CASE WHEN offer_type = 0 THEN 'offer' ELSE 'counter' END AS action,
         l.seller_id, l.category, l.condition, l.listing_price, l.final_sale_price, l.sold_by_best_offer
  FROM turn0 t JOIN listing l USING (listing_id)),
turn_placed AS (
  SELECT *, row_number() OVER w AS turn_index,
         lead(actor) OVER w AS next_actor, lead(action) OVER w AS next_action, lead(event_time) OVER w AS next_time,
         row_number() OVER w - 1 AS prior_turns,
         coalesce(sum(CASE WHEN action = 'counter' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior_counters,
         amount / listing_price AS offer_ratio
  FROM turn
  WINDOW w AS (PARTITION BY thread_id ORDER BY event_time, offer_type, amount, event_id)),
turn_marked AS (
  SELECT *, sha256(turn_index || '|' || coalesce(actor, '') || '|' || coalesce(action, '') || '|' || coalesce(floor(amount * 1000)::BIGINT::VARCHAR, 'none')) AS mark
  FROM turn_placed),
numbered AS (
  SELECT * EXCLUDE (mark), sum(('0x' || substr(mark, 1, 15))::BIGINT::HUGEINT) OVER u || '-' || sum(('0x' || substr(mark, 16, 15))::BIGINT::HUGEINT) OVER u AS history_digest
  FROM turn_marked
  WINDOW u AS (PARTITION BY thread_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""

CASES = TURN + """,
outcome AS (
  SELECT thread_id, bool_or(status_id = 8) AS any8,
         CASE WHEN bool_or(status_id IN (1, 9)) THEN '1' WHEN bool_or(status_id = 8) THEN NULL
              WHEN arg_max(status_id, turn_index) IN (0, 2, 6) THEN '0' END AS agreement
  FROM numbered GROUP BY thread_id),
labelled AS (
  SELECT n.*, o.agreement, o.any8,
         CASE WHEN status_id IN (1, 9) THEN 'accept' WHEN status_id IN (2, 6) THEN 'decline' WHEN status_id = 0 THEN 'expire'
              WHEN status_id = 7 AND next_action = 'counter' AND next_actor = CASE WHEN actor = 'buyer' THEN 'seller' ELSE 'buyer' END
              THEN 'counter' END AS turn_label,
         CASE WHEN status_id <> 8 AND response_time >= event_time
              THEN (epoch_us(response_time) - epoch_us(event_time)) / 1e6 END AS latency
  FROM numbered n JOIN outcome o USING (thread_id)),
raw_case AS (
  SELECT *, 'seller_next_action' AS task, thread_id || ':' || turn_index || ':seller_next_action' AS row_id,
         turn_label AS label_str, NULL::DOUBLE AS label_num, status_id = 8 AS cens FROM labelled WHERE actor = 'buyer'
  UNION ALL
  SELECT *, 'buyer_response_to_counter', thread_id || ':' || turn_index || ':buyer_response', turn_label, NULL, status_id = 8
  FROM labelled WHERE actor = 'seller'
  UNION ALL
  SELECT *, 'response_latency', thread_id || ':' || turn_index || ':response_latency', NULL, latency, status_id = 8 FROM labelled
  UNION ALL
  SELECT *, 'agreement', thread_id || ':agreement', agreement, NULL, any8 FROM labelled WHERE turn_index = 1
  UNION ALL
  SELECT *, 'final_price_ratio', thread_id || ':final_price_ratio', NULL,
         CASE WHEN sold_by_best_offer AND agreement = '1' THEN round(final_sale_price / listing_price, 6) END, any8
  FROM labelled WHERE turn_index = 1),
cases AS (
  SELECT row_id, task, label_str, label_num,
         CASE WHEN label_str IS NOT NULL OR label_num IS NOT NULL THEN 'supervised' WHEN cens THEN 'censored' ELSE 'unknown' END AS outcome_state,
         thread_id, listing_id, seller_id, buyer_id, event_time AS timestamp, category, condition, listing_price,
         actor AS current_actor, action AS current_action, amount AS current_amount, offer_ratio AS offer_to_asking_ratio,
         turn_index AS round_number, prior_turns AS prior_turn_count, prior_counters AS prior_counter_count,
         hour(event_time) + minute(event_time) / 60.0 AS event_hour, history_digest
  FROM raw_case)
"""

ORDER = ["event_time", "offer_type", "amount", "event_id"]


def listings(t: Tables) -> DataFrame:
    key = c("p_partkey")
    return t.part.select(
        key.alias("listing_id"),
        F.floor(key / 20).cast("long").alias("seller_id"),
        c("p_type").alias("category"),
        c("p_brand").alias("condition"),
        c("p_retailprice").alias("listing_price"),
        (c("p_retailprice") * (F.lit(0.6) + (key % 40) / F.lit(100.0))).alias("final_sale_price"),
        (key % 3 != 0).alias("sold_by_best_offer"),
        (c("p_size") * 4).alias("age_days"),
    )


def bare_turns(t: Tables) -> DataFrame:
    """Turns with their codes, before they meet their listing."""
    e = c("event_id")
    statuses = F.array(*[F.lit(s) for s in (0, 1, 2, 6, 7, 8, 9)])
    kind = c("event_type")
    return t.events.select(
        e,
        c("user_id").alias("buyer_id"),
        c("ts").alias("event_time"),
        F.concat(c("user_id").cast("string"), F.lit("-"), c("ts").cast("date").cast("string")).alias("thread_id"),
        (c("user_id") * 13 + F.when(c("user_id") % 10 == 0, 0).otherwise(1 + F.floor((F.dayofmonth("ts") - 1) / 3))).alias("listing_id"),
        F.when(kind.isin("view", "signup"), 0).when(kind.isin("click", "purchase"), 1).otherwise(2).alias("offer_type"),
        F.element_at(statuses, (e % 7 + 1).cast("int")).alias("status_id"),
        F.when(e % 11 != 0, c("ts") + F.make_dt_interval(secs=(e % 5000).cast("decimal(18,6)"))).alias("response_time"),
    )


def turns(t: Tables) -> DataFrame:
    side = listings(t).drop("age_days")
    return bare_turns(t).join(side, "listing_id").withColumns(
        {
            "amount": c("listing_price") * (F.lit(0.40) + ((c("event_id") * 7) % 65) / F.lit(100.0)),
            "actor": F.when(c("offer_type") == 2, "seller").otherwise("buyer"),
            "action": F.when(c("offer_type") == 0, "offer").otherwise("counter"),
        }
    )


def numbered(t: Tables) -> DataFrame:
    """Turns with position, look-ahead and prior counts."""
    return turn_features(turns(t), ORDER)


def cases(t: Tables) -> DataFrame:
    """All tasks over staged turn features: both branches of the case union read them."""
    return build_cases(stage(numbered(t)))


def split_cases(t: Tables, task: str) -> DataFrame:
    """Supervised cases of one task with their region, staged because fits and scores both read them."""
    rows = build_cases(numbered(t), [task])
    kept, _ = chronological_purged_split(rows, "timestamp", "listing_id", "row_id")
    return stage(kept.filter(c("outcome_state") == "supervised").withColumnRenamed("label_str", "label"))


PRED = """
pred AS (
  SELECT *, CASE label WHEN 'accept' THEN p_accept WHEN 'counter' THEN p_counter WHEN 'decline' THEN p_decline ELSE p_expire END AS p_label,
         CASE WHEN p_accept >= p_counter AND p_accept >= p_decline AND p_accept >= p_expire THEN 'accept'
              WHEN p_counter >= p_decline AND p_counter >= p_expire THEN 'counter'
              WHEN p_decline >= p_expire THEN 'decline' ELSE 'expire' END AS prediction FROM (
    SELECT *, 1.0::DOUBLE - p_accept - p_counter - p_decline AS p_expire FROM (
      SELECT *, 0.7::DOUBLE * (1.0::DOUBLE - p_accept - p_counter) AS p_decline FROM (
        SELECT *, CASE WHEN prior_counter_count > 0 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END * (1.0::DOUBLE - p_accept) AS p_counter FROM (
          SELECT *, label_str AS label, least(0.9, greatest(0.05, offer_to_asking_ratio * offer_to_asking_ratio)) AS p_accept,
                 least(0.9, greatest(0.05, offer_to_asking_ratio)) AS p_other, (label_str = 'accept')::INT AS target
          FROM cases WHERE task = 'seller_next_action' AND label_str IS NOT NULL)))))
"""


def predictions(t: Tables) -> DataFrame:
    """Seller answers with a closed-form probability for every label, as a stand-in for any model."""
    rows = build_cases(numbered(t), ["seller_next_action"]).filter(c("outcome_state") == "supervised")
    r = c("offer_to_asking_ratio")
    one = F.lit(1.0)
    rows = rows.withColumnRenamed("label_str", "label").withColumns(
        {"p_accept": F.least(F.lit(0.9), F.greatest(F.lit(0.05), r * r)), "p_other": F.least(F.lit(0.9), F.greatest(F.lit(0.05), r))}
    )
    rows = rows.withColumn("p_counter", F.when(c("prior_counter_count") > 0, 0.5).otherwise(0.3) * (one - c("p_accept")))
    rows = rows.withColumn("p_decline", F.lit(0.7) * (one - c("p_accept") - c("p_counter")))
    rows = rows.withColumn("p_expire", one - c("p_accept") - c("p_counter") - c("p_decline"))
    rows = with_prediction(rows, {x: c(f"p_{x}") for x in LABELS["seller_next_action"]})
    return rows.withColumn("target", (c("label") == "accept").cast("int"))


CASE_REG = """
case_reg AS (
  SELECT doc_id, quality AS target, n_chars::DOUBLE AS chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS spaces,
         (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE AS capitals, lang
  FROM labels JOIN documents USING (doc_id)),
placed_reg AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) AS pos, count(*) OVER () AS n FROM case_reg),
train_reg AS (SELECT * FROM placed_reg WHERE pos <= floor(n * 0.6)),
dev_reg AS (SELECT * FROM placed_reg WHERE pos > floor(n * 0.6) AND pos <= floor(n * 0.8))
"""

REG_NAMES = ["chars", "spaces", "lines", "capitals"]


def case_reg(t: Tables) -> DataFrame:
    """Quality labels of documents with numbers read off their whole texts, and the region by document order."""
    size = F.length("text")
    rows = t.labels.join(t.documents, "doc_id").select(
        "doc_id", c("quality").alias("target"), c("n_chars").cast("double").alias("chars"),
        (size - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("double").alias("spaces"),
        (size - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("double").alias("lines"),
        F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("double").alias("capitals"), "lang",
    )
    return stage(chronological_split(rows, "doc_id", "doc_id"))


EPISODE = """
episode AS (
  SELECT event_id AS episode_id, ts AS decision_time, event_type, value, (props->>'$.k')::DOUBLE AS k, user_id FROM events)
"""


def episodes(t: Tables) -> DataFrame:
    """Events as decision episodes; errors have no known outcome, views lack one context value."""
    k = F.get_json_object("props", "$.k").cast("double")
    context = F.create_map(F.lit("value"), c("value"), F.lit("hour"), F.hour("ts").cast("double"))
    with_k = F.map_concat(context, F.create_map(F.lit("k"), k))
    return t.events.select(
        c("event_id").alias("episode_id"),
        c("ts").alias("decision_time"),
        c("ts").alias("observation_cutoff"),
        F.when(c("event_type") == "view", context).otherwise(with_k).alias("context"),
        F.when(c("event_type") == "error", F.create_map().cast("map<string,boolean>"))
        .otherwise(F.create_map(F.lit("purchased"), c("event_type") == "purchase")).alias("outcomes"),
    )
