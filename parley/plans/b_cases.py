"""Negotiation case construction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import cases as K
from parley.plans import bindings as B
from parley.plans.registry import Tables, ctes, query
from parley.session import stage

c = F.col


@query(
    "b01_turn_features",
    ctes(B.TURN) + "SELECT event_id, turn_index, prior_turns, prior_counters, round(offer_ratio, 6) AS offer_ratio, category, history_digest FROM numbered",
)
def b01(t: Tables) -> DataFrame:
    cols = ["event_id", "turn_index", "prior_turns", "prior_counters", F.round("offer_ratio", 6).alias("offer_ratio"), "category", "history_digest"]
    return B.numbered(t).select(*cols)


@query(
    "b02_history_chunks",
    ctes(B.TURN)
    + """
    SELECT thread_id, (turn_index - 1) // 4 AS chunk,
           string_agg(turn_index || ':' || actor || ':' || action || ':' || floor(amount * 1000)::BIGINT, '|' ORDER BY turn_index) AS turns
    FROM numbered GROUP BY 1, 2
    """,
)
def b02(t: Tables) -> DataFrame:
    def shown(x):
        return F.concat_ws(":", x["turn_index"], x["actor"], x["action"], F.floor(x["amount"] * 1000))

    return K.history_chunks(B.numbered(t), 4).withColumn("turns", F.array_join(F.transform("turns", shown), "|"))


LABEL = """
CASE WHEN status_id IN (1, 9) THEN 'accept' WHEN status_id IN (2, 6) THEN 'decline' WHEN status_id = 0 THEN 'expire'
     WHEN status_id = 7 AND next_actor = '{actor}' AND next_action = 'counter' THEN 'counter' END
"""


@query(
    "b03_seller_next_action",
    ctes(B.TURN)
    + f"""
    SELECT thread_id || ':' || turn_index || ':seller_next_action' AS row_id, {LABEL.format(actor='seller')} AS label_str, prior_counters
    FROM numbered WHERE actor = 'buyer' AND action IN ('offer', 'counter') AND ({LABEL.format(actor='seller')}) IS NOT NULL
    """,
)
def b03(t: Tables) -> DataFrame:
    return K.seller_next_action(B.numbered(t)).select("row_id", "label_str", "prior_counters")


ACTED = B.TURN + """,
acted0 AS (
  SELECT * REPLACE (CASE WHEN status_id = 1 THEN 'accept' WHEN status_id = 2 THEN 'decline' WHEN status_id = 0 THEN 'expire' ELSE action END AS action)
  FROM turn),
acted AS (
  SELECT *, row_number() OVER w AS turn_index, lead(actor) OVER w AS next_actor, lead(action) OVER w AS next_action,
         lead(event_time) OVER w AS next_time FROM acted0
  WINDOW w AS (PARTITION BY thread_id ORDER BY event_time, offer_type, amount, event_id))
"""


def acted(t: Tables) -> DataFrame:
    """Turns of a source without status codes: endings are actions of their own."""
    s = c("status_id")
    action = F.when(s == 1, "accept").when(s == 2, "decline").when(s == 0, "expire").otherwise(c("action"))
    rows = B.turns(t).withColumn("action", action).withColumn("status_id", F.lit(None).cast("int"))
    return K.turn_features(rows, B.ORDER)


@query(
    "b04_seller_next_row",
    ctes(ACTED)
    + """
    SELECT thread_id || ':' || turn_index || ':seller_next_action' AS row_id,
           CASE WHEN next_action IN ('accept', 'counter', 'decline') THEN next_action ELSE 'expire' END AS label_str
    FROM acted WHERE actor = 'buyer' AND next_actor = 'seller'
    """,
)
def b04(t: Tables) -> DataFrame:
    return K.seller_next_action(acted(t), "next_row").select("row_id", "label_str")


@query(
    "b05_buyer_response",
    ctes(B.TURN)
    + f"""
    SELECT thread_id || ':' || turn_index || ':buyer_response' AS row_id, {LABEL.format(actor='buyer')} AS label_str
    FROM numbered WHERE actor = 'seller' AND action = 'counter' AND ({LABEL.format(actor='buyer')}) IS NOT NULL
    """,
)
def b05(t: Tables) -> DataFrame:
    return K.buyer_response(B.numbered(t)).select("row_id", "label_str")


@query(
    "b05_buyer_next_row",
    ctes(ACTED)
    + """
    SELECT thread_id || ':' || turn_index || ':buyer_response' AS row_id,
           CASE WHEN next_action IN ('accept', 'counter', 'expire') THEN next_action ELSE 'leave' END AS label_str
    FROM acted WHERE actor = 'seller' AND action = 'counter' AND next_actor = 'buyer'
    """,
)
def b05_next(t: Tables) -> DataFrame:
    return K.buyer_response(acted(t), "next_row").select("row_id", "label_str")


@query("b06_agreement", ctes(B.CASES) + "SELECT o.thread_id, agreement, count(*) AS turns FROM outcome o JOIN turn USING (thread_id) GROUP BY 1, 2")
def b06(t: Tables) -> DataFrame:
    return K.agreement(B.numbered(t)).select("thread_id", "agreement", "turns")


@query(
    "b06_agreement_by_action",
    ctes(ACTED)
    + """
    SELECT thread_id, CASE WHEN bool_or(action = 'accept') THEN '1' WHEN arg_max(action, turn_index) IN ('decline', 'expire') THEN '0' END AS agreement
    FROM acted GROUP BY thread_id
    """,
)
def b06_action(t: Tables) -> DataFrame:
    return K.agreement(acted(t)).select("thread_id", "agreement")


@query(
    "b07_final_price_ratio",
    ctes(B.CASES) + "SELECT row_id, label_num FROM cases WHERE task = 'final_price_ratio' AND label_num IS NOT NULL",
)
def b07(t: Tables) -> DataFrame:
    return K.final_price_ratio(B.numbered(t)).select("row_id", "label_num")


@query(
    "b07_accepted_price_ratio",
    ctes(B.TURN)
    + """
    SELECT thread_id || ':final_price_ratio' AS row_id, round(a / p, 6) AS label_num FROM (
      SELECT thread_id, arg_min(amount, turn_index) FILTER (status_id IN (1, 9)) AS a, any_value(listing_price) AS p
      FROM numbered GROUP BY thread_id) WHERE a IS NOT NULL
    """,
)
def b07_accepted(t: Tables) -> DataFrame:
    return K.final_price_ratio(B.numbered(t), "accepted").select("row_id", "label_num")


@query(
    "b08_response_latency",
    ctes(B.CASES) + "SELECT row_id, label_num FROM cases WHERE task = 'response_latency' AND label_num IS NOT NULL",
)
def b08(t: Tables) -> DataFrame:
    return K.response_latency(B.numbered(t)).select("row_id", "label_num")


@query(
    "b08_next_turn_latency",
    ctes(B.TURN)
    + """
    SELECT thread_id || ':' || turn_index || ':response_latency' AS row_id, (epoch_us(next_time) - epoch_us(event_time)) / 1e6 AS label_num
    FROM numbered WHERE next_time IS NOT NULL
    """,
)
def b08_next(t: Tables) -> DataFrame:
    return K.response_latency(B.numbered(t), "next_turn").select("row_id", "label_num")


ORPHAN = """
  (SELECT count(DISTINCT thread_id) FROM turn0 WHERE listing_id + 40 NOT IN (SELECT listing_id FROM listing))
"""


@query(
    "b09_task_manifest",
    ctes(B.CASES)
    + f"""
    SELECT task, count(*) AS eligible, count(CASE WHEN outcome_state = 'supervised' THEN 1 END) AS supervised,
           count(CASE WHEN outcome_state = 'unknown' THEN 1 END) AS unknown,
           count(CASE WHEN outcome_state = 'censored' THEN 1 END) AS censored, {ORPHAN} AS excluded
    FROM cases GROUP BY task
    """,
)
def b09(t: Tables) -> DataFrame:
    # listing ids shifted by 40: the last ones miss their listing
    shifted = B.bare_turns(t).withColumn("listing_id", c("listing_id") + 40)
    return K.task_manifest(B.cases(t), shifted, B.listings(t))


CASE_COLUMNS = """
row_id, task, label_str, label_num, outcome_state, thread_id, listing_id, seller_id, buyer_id, category, condition,
current_actor, current_action, round(current_amount, 4) AS current_amount, round(offer_to_asking_ratio, 6) AS offer_to_asking_ratio,
round_number, prior_turn_count, prior_counter_count, round(event_hour, 6) AS event_hour, history_digest
"""


@query("b10_build_cases", ctes(B.CASES) + f"SELECT {CASE_COLUMNS} FROM cases")
def b10(t: Tables) -> DataFrame:
    rounded = {"current_amount": 4, "offer_to_asking_ratio": 6, "event_hour": 6}
    rows = B.cases(t).drop("timestamp", "listing_price")
    return rows.withColumns({k: F.round(k, n) for k, n in rounded.items()})


@query(
    "b11_publish_cases",
    ctes(B.CASES)
    + """
    SELECT task, outcome_state, count(*) AS public_rows, count(CASE WHEN outcome_state = 'supervised' THEN 1 END) AS label_rows
    FROM cases GROUP BY 1, 2
    """,
)
def b11(t: Tables) -> DataFrame:
    public, labels = K.publish_cases(stage(B.cases(t)))
    joined = public.join(labels.withColumn("has_label", F.lit(1)), ["task", "row_id"], "left")
    return joined.groupBy("task", "outcome_state").agg(F.count("*").alias("public_rows"), F.count("has_label").alias("label_rows"))


@query(
    "b12_leakage_audit",
    ctes(B.CASES)
    + """
    SELECT task, count(*) AS rows, count(CASE WHEN listing_id % 9 = 0 THEN 1 END) AS forbidden,
           count(CASE WHEN listing_id % 9 = 0 OR listing_id % 8 = 0 THEN 1 END) AS undeclared,
           count(CASE WHEN round_number = 3 AND listing_id % 7 = 0 THEN 1 END) AS history_leaks,
           bool_and(listing_id % 9 <> 0 AND listing_id % 8 <> 0 AND NOT (round_number = 3 AND listing_id % 7 = 0)) AS passed
    FROM cases GROUP BY task
    """,
)
def b12(t: Tables) -> DataFrame:
    l = c("listing_id")
    name = F.when(l % 9 == 0, "final_price").when(l % 8 == 0, "buyer_mood").otherwise("round_number")
    state = F.when((c("round_number") == 3) & (l % 7 == 0), "Accepted").otherwise("open")
    rows = B.cases(t).withColumns(
        {
            "features": F.create_map(name, c("round_number").cast("string"), F.lit("category"), c("category")),
            "history": F.array(F.create_map(F.when(state == "Accepted", "status").otherwise("action"), state)),
        }
    )
    return K.leakage_audit(rows, "features", "history")


TOKEN_SQL = """
tokens AS (
  SELECT row_id,
    concat_ws(chr(1), task, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f'), category, condition, floor(listing_price * 1000)::BIGINT,
              current_actor, current_action, floor(current_amount * 1000)::BIGINT, round_number, prior_counter_count, history_digest) AS content,
    concat_ws(chr(1), task, row_id, thread_id, listing_id) AS source
  FROM cases)
"""


@query(
    "b13_case_tokens",
    ctes(B.CASES, TOKEN_SQL)
    + "SELECT row_id, sha256(source || chr(1) || content) AS case_token, sha256(content) AS content_token, sha256(source) AS source_token FROM tokens",
)
def b13(t: Tables) -> DataFrame:
    return K.case_tokens(B.cases(t)).select("row_id", "case_token", "content_token", "source_token")


@query(
    "b14_sequence_violations",
    ctes(B.TURN)
    + """
    SELECT listing_id,
      bool_or(status_id = 7 AND NOT coalesce(next_action = 'counter' AND next_actor = CASE WHEN actor = 'buyer' THEN 'seller' ELSE 'buyer' END, false)) AS missing_counter,
      bool_or(status_id IN (1, 9) AND next_actor IS NOT NULL) AS accepted_not_last
    FROM numbered GROUP BY listing_id
    """,
)
def b14(t: Tables) -> DataFrame:
    return K.sequence_violations(B.numbered(t))


@query(
    "b15_supervised_rows",
    ctes(B.EPISODE)
    + """
    SELECT episode_id AS case_id, decision_time, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS target,
           CASE WHEN event_type = 'view' THEN 3 ELSE 4 END AS features, false AS leaks
    FROM episode WHERE event_type <> 'error' AND decision_time <= TIMESTAMP '2024-01-21 12:00:00'
    """,
)
def b15(t: Tables) -> DataFrame:
    through = F.lit("2024-01-21 12:00:00").cast("timestamp_ntz")
    rows = K.supervised_rows(B.episodes(t), "purchased", through)
    return rows.select("case_id", "decision_time", "target", F.size("features").alias("features"), "leaks")


@query(
    "b16_trial_rows",
    """
    SELECT event_id AS case_id, CASE WHEN event_id % 4 <> 3 THEN ts ELSE ts + INTERVAL 1 HOUR END AS decision_time,
           CASE WHEN event_id % 4 <> 3 THEN ts + INTERVAL 1 MINUTE ELSE ts + INTERVAL 2 HOUR END AS eligibility_recorded_at,
           CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS target
    FROM events WHERE event_type <> 'error'
    """,
)
def b16(t: Tables) -> DataFrame:
    # the trials whose id leaves 3 over never had an assignment written
    e = c("event_id")
    episodes = B.episodes(t)
    trials = episodes.select(
        c("episode_id").alias("trial_id"), c("episode_id").alias("assignment_id"), "context", "outcomes",
        (c("decision_time") + F.expr("INTERVAL 1 HOUR")).alias("recorded_at"), (c("decision_time") + F.expr("INTERVAL 2 HOUR")).alias("written_at"),
    )
    assignments = t.events.select(
        F.when(e % 4 == 3, -e - 1).otherwise(e).alias("assignment_id"), c("ts").alias("assigned_at"),
        (c("ts") + F.expr("INTERVAL 1 MINUTE")).alias("written_at"),
    )
    return K.trial_rows(trials, assignments, "purchased").select("case_id", "decision_time", "eligibility_recorded_at", "target")


@query(
    "b17_feature_catalog",
    ctes(B.EPISODE)
    + """
    SELECT 'value' AS name, count(value) AS rows FROM episode WHERE event_type <> 'error' UNION ALL
    SELECT 'hour', count(*) FROM episode WHERE event_type <> 'error' UNION ALL
    SELECT 'k', count(k) FROM episode WHERE event_type NOT IN ('error', 'view')
    """,
)
def b17(t: Tables) -> DataFrame:
    return K.feature_catalog(K.supervised_rows(B.episodes(t), "purchased"))


# Phrases said on top of the given texts, with the price and act a reader would note.
PHRASES = [
    ("How about $120 if I can pick up", 120.0, "counter"),
    ("deal", None, "accept"),
    ("too low", None, "reject"),
    ("could do 95.50", 95.5, "counter"),
    ("USD 80 cash, final offer", 80.0, "propose"),
    ("I paid 200, not interested", 200.0, "quit"),
    ("my best i can is 75 or 70", 70.0, "propose"),
    ("is shipping free?", None, "other"),
]

SAID = """
said AS (
  SELECT conv_id, turn, text || ' ' || [{texts}][(conv_id + turn) % 8 + 1] AS said,
         [{prices}][(conv_id + turn) % 8 + 1] AS want_price, [{acts}][(conv_id + turn) % 8 + 1] AS want_act FROM conversations),
found AS (SELECT *, regexp_extract_all(said, '(?i)(?:\\$|usd\\s*)?(\\d+(?:\\.\\d{{1,2}})?)', 1) AS prices, lower(said) AS low FROM said),
priced AS (SELECT *, prices[-1]::DOUBLE AS price, len(prices)::INTEGER AS numbers FROM found),
facts AS (
  SELECT *, regexp_matches(low, 'lower|come down|meet you|split|best i can|final offer') AS concession,
    CASE WHEN regexp_matches(low, 'accept|deal|sounds good|you got it') THEN 'accept'
         WHEN regexp_matches(low, 'no thanks|reject|can''t do|too low') THEN 'reject'
         WHEN regexp_matches(low, 'bye|nevermind|walk away|not interested') THEN 'quit'
         WHEN price IS NOT NULL AND regexp_matches(low, 'counter|meet|instead|how about|could do') THEN 'counter'
         WHEN price IS NOT NULL THEN 'propose' ELSE 'other' END AS act,
    concat_ws(',', CASE WHEN regexp_matches(low, 'deliver|ship') THEN 'delivery_or_shipping' END,
              CASE WHEN regexp_matches(low, 'pickup|pick up|meet') THEN 'pickup_or_meetup' END,
              CASE WHEN regexp_matches(low, 'cash|paypal|venmo') THEN 'payment_method' END) AS conditions
  FROM priced)
""".format(
    texts=", ".join(f"'{p[0]}'" for p in PHRASES),
    prices=", ".join("NULL" if p[1] is None else str(p[1]) for p in PHRASES),
    acts=", ".join(f"'{p[2]}'" for p in PHRASES),
)


def facts(t: Tables) -> DataFrame:
    at = ((c("conv_id") + c("turn")) % 8 + 1).cast("int")

    def pick(i: int):
        return F.element_at(F.array(*[F.lit(p[i]) for p in PHRASES]), at)

    said = t.conversations.select(
        "conv_id", "turn", F.concat_ws(" ", "text", pick(0)).alias("said"), pick(1).cast("double").alias("want_price"), pick(2).alias("want_act")
    )
    return K.utterance_facts(said, "said")


@query("b18_utterance_facts", ctes(SAID) + "SELECT conv_id, turn, numbers, price, act, conditions, concession FROM facts")
def b18(t: Tables) -> DataFrame:
    return facts(t).select("conv_id", "turn", "numbers", "price", "act", F.array_join("conditions", ",").alias("conditions"), "concession")


@query(
    "b19_price_sequence",
    ctes(SAID) + "SELECT conv_id, turn, price, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM facts WHERE price IS NOT NULL",
)
def b19(t: Tables) -> DataFrame:
    return K.price_sequence(facts(t), "conv_id", "turn")


@query(
    "b20_extraction_accuracy",
    ctes(SAID)
    + """
    SELECT count(*) AS rows, round(avg((price IS NOT DISTINCT FROM want_price)::INT), 6) AS offer_accuracy,
           round(avg((act = want_act)::INT), 6) AS act_accuracy, count(CASE WHEN numbers > 1 THEN 1 END) AS ambiguous FROM facts
    """,
)
def b20(t: Tables) -> DataFrame:
    rows = K.extraction_accuracy(facts(t), "want_price", "want_act")
    return rows.withColumns({x: F.round(x, 6) for x in ("offer_accuracy", "act_accuracy")})
