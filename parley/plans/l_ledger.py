"""Decision ledgers, source registries, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import terms as T
from parley.operators import ledger as L
from parley.operators import metrics as E
from parley.operators.sequence import Sequence, lag, rank
from parley.plans import bindings as B
from parley.plans.d_models import DATA, TASK, regions
from parley.plans.registry import Tables, ctes, query
from parley.session import stage

c = F.col

ENTRY = """
entry0 AS (
  SELECT event_id, user_id || '-' || ts::DATE AS decision_id, ts AS decision_timestamp0, event_type, user_id % 3 AS strategy_id, user_id % 5 AS source_id,
         floor((value - 40) * 100) / 100 AS value, sha256(event_id::VARCHAR) AS record_hash FROM events),
entry AS (
  SELECT *, lag(record_hash) OVER w AS prev_hash, row_number() OVER w AS n, first_value(decision_timestamp0) OVER w AS decision_timestamp
  FROM entry0 WINDOW w AS (PARTITION BY decision_id ORDER BY event_id)),
entries AS (
  SELECT *, CASE WHEN event_id % 37 = 0 THEN 'forged' ELSE prev_hash END AS supersedes, CASE WHEN event_id % 101 = 0 THEN 'real' ELSE 'paper' END AS designation,
         CASE WHEN event_id % 4 = 0 THEN 'resolved_paper' ELSE 'paper_decision' END AS evidence_state, CASE WHEN event_id % 3 = 0 THEN 'fixed' END AS correction_reason,
         CASE WHEN event_id % 4 = 0 THEN value END AS realized_net,
         CASE WHEN event_id % 6 = 0 THEN 'abstain' ELSE 'trade' END AS selected_action, CASE WHEN user_id_event THEN 'ev-' || (event_id // 20) END AS economic_event_key
  FROM (SELECT *, event_id % 2 = 0 AS user_id_event FROM entry))
"""


def entries(t: Tables) -> DataFrame:
    """Events as ledger entries of one decision per user and day; forged links and mixed designations are planted."""
    e = c("event_id")
    base = t.events.select(
        e, F.concat_ws("-", "user_id", F.to_date("ts")).alias("decision_id"), c("ts").alias("written_at"), "event_type", (c("user_id") % 3).alias("strategy_id"),
        (c("user_id") % 5).alias("source_id"), (F.floor((c("value") - 40) * 100) / 100).alias("value"), F.sha2(e.cast("string"), 256).alias("record_hash"),
    )
    first = base.groupBy("decision_id").agg(F.min_by("written_at", "event_id").alias("decision_timestamp"))
    chained = Sequence(base, ["decision_id"], ["event_id"]).add(prev_hash=lag(c("record_hash"))).frame.join(first, "decision_id")
    return chained.select(
        "*",
        F.when(e % 37 == 0, "forged").otherwise(c("prev_hash")).alias("supersedes"),
        F.when(e % 101 == 0, "real").otherwise("paper").alias("designation"), F.lit("c1").alias("contract_hash"),
        F.when(e % 4 == 0, "resolved_paper").otherwise("paper_decision").alias("evidence_state"), F.when(e % 3 == 0, "fixed").alias("correction_reason"),
        F.when(e % 4 == 0, c("value")).alias("realized_net"), c("value").alias("conservative_net"), F.lit("abstain").alias("no_action"),
        F.when(e % 6 == 0, "abstain").otherwise("trade").alias("selected_action"), F.when(e % 2 == 0, F.concat(F.lit("ev-"), F.floor(e / 20))).alias("economic_event_key"),
        F.abs("value").alias("capital_required"), F.abs("value").alias("maximum_possible_loss"),
    )


@query(
    "l01_latest_entries",
    ctes(ENTRY) + "SELECT decision_id, event_id, evidence_state FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY event_id DESC) AS k FROM entries) WHERE k = 1",
)
def l01(t: Tables) -> DataFrame:
    return L.latest_entries(entries(t), "decision_id", "event_id").select("decision_id", "event_id", "evidence_state")


@query(
    "l01_supersession_check",
    ctes(ENTRY)
    + """
    , p AS (SELECT *, lag(designation) OVER w AS pd, lag(evidence_state) OVER w AS ps, lag(selected_action) OVER w AS pa, lag(value) OVER w AS pv
            FROM entries WINDOW w AS (PARTITION BY decision_id ORDER BY event_id))
    SELECT fault, count(*) AS n FROM (
      SELECT unnest(list_filter([
        CASE WHEN n = 1 AND supersedes IS NOT NULL THEN 'first_entry_supersedes' END,
        CASE WHEN n > 1 AND supersedes <> prev_hash THEN 'wrong_predecessor' END,
        CASE WHEN n > 1 AND designation <> pd THEN 'designation_mixed' END,
        CASE WHEN n > 1 AND (selected_action <> pa OR value <> pv) THEN 'immutable_field_rewritten' END,
        CASE WHEN n > 1 AND evidence_state = ps AND correction_reason IS NULL THEN 'same_state_without_correction' END,
        CASE WHEN n > 1 AND ps = 'resolved_paper' AND correction_reason IS NULL THEN 'changed_after_resolution' END], lambda x: x IS NOT NULL)) AS fault FROM p) GROUP BY 1
    """,
)
def l01_check(t: Tables) -> DataFrame:
    rows = L.supersession_check(entries(t), "decision_id", "event_id")
    return rows.select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


@query(
    "l02_resolution_check",
    """
    SELECT fault, count(*) AS n FROM (
      SELECT unnest(list_filter([
        CASE WHEN event_id % 23 = 0 THEN 'cost_field_missing' END, CASE WHEN event_id % 29 = 0 THEN 'cost_unknown' END, CASE WHEN event_id % 31 = 0 AND event_id % 29 <> 0 THEN 'cost_negative' END,
        CASE WHEN event_id % 41 = 0 THEN 'net_does_not_add_up' END], lambda x: x IS NOT NULL)) AS fault FROM events) GROUP BY 1
    """,
)
def l02(t: Tables) -> DataFrame:
    e = c("event_id")
    fee = F.when(e % 29 == 0, F.lit(None).cast("double")).when(e % 31 == 0, -1.25).otherwise(1.25)
    names = [x for x in L.MATERIAL_COSTS if x not in ("fees", "slippage")]
    rest = [y for x in names for y in (F.lit(x), F.lit(0.5))]
    full = F.create_map(F.lit("fees"), fee, F.lit("slippage"), F.lit(0.25), *rest)
    short = F.create_map(F.lit("fees"), fee, F.lit("other"), F.lit(0.25), *rest)
    net = c("value") - F.coalesce(fee, F.lit(0.0)) - 0.25 - 0.5 * len(names)
    rows = t.events.select(
        F.when(e % 23 == 0, short).otherwise(full).alias("realized_costs"), c("value").alias("realized_gross"), F.when(e % 41 == 0, net + 1).otherwise(net).alias("realized_net")
    )
    return L.resolution_check(rows).select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


UNIQUE = """
, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY event_id DESC) AS k FROM entries) WHERE k = 1),
ue AS (SELECT *, count(*) OVER (PARTITION BY ek) AS decisions, row_number() OVER (PARTITION BY ek ORDER BY decision_timestamp DESC, decision_id DESC) AS j
       FROM (SELECT *, coalesce(economic_event_key, decision_id) AS ek FROM last)),
un AS (SELECT *, CAST(coalesce(realized_net, value) AS DECIMAL(18, 2)) AS v FROM ue WHERE j = 1)
"""


@query(
    "l03_money_summary",
    ctes(ENTRY)
    + UNIQUE
    + """
    SELECT count(*) AS opportunities, sum(decisions)::BIGINT AS decisions, sum(decisions - 1)::BIGINT AS duplicates, count(CASE WHEN selected_action = 'abstain' THEN 1 END) AS no_action,
           sum(CAST(abs(value) AS DECIMAL(18, 2)))::DOUBLE AS capital_at_risk, sum(CAST(abs(value) AS DECIMAL(18, 2)))::DOUBLE AS maximum_loss,
           max(CAST(abs(value) AS DECIMAL(18, 2)))::DOUBLE AS largest_loss, sum(v)::DOUBLE AS total_value, min(designation) <> max(designation) AS mixed_designations FROM un
    """,
)
def l03(t: Tables) -> DataFrame:
    return L.money_summary(L.unique_events(entries(t), "event_id"))


@query(
    "l03_value_by",
    ctes(ENTRY)
    + UNIQUE
    + """
    SELECT 'event_type' AS dimension, event_type AS key, count(*) AS n, sum(v)::DOUBLE AS value FROM un GROUP BY 2 UNION ALL
    SELECT 'strategy_id', strategy_id::VARCHAR, count(*), sum(v)::DOUBLE FROM un GROUP BY 2 UNION ALL
    SELECT 'source_id', source_id::VARCHAR, count(*), sum(v)::DOUBLE FROM un GROUP BY 2 UNION ALL
    SELECT 'selected_action', selected_action, count(*), sum(v)::DOUBLE FROM un GROUP BY 2
    """,
)
def l03_by(t: Tables) -> DataFrame:
    return L.value_by(L.unique_events(entries(t), "event_id"), ["event_type", "strategy_id", "source_id", "selected_action"], L.entry_value())


DRAWDOWN = """
SELECT {keys} max(peak - cum)::DOUBLE AS maximum_drawdown,
       coalesce(arg_min(peak_at, i) FILTER (peak - cum = worst AND worst > 0), 0) AS peak_index, coalesce(min(i) FILTER (peak - cum = worst AND worst > 0), 0) AS trough_index
FROM (SELECT *, max(peak - cum) OVER ({part}) AS worst, arg_min(i, -cum) OVER ({part} ORDER BY i ROWS UNBOUNDED PRECEDING) AS peak_at FROM (
  SELECT *, max(cum) OVER ({part} ORDER BY i ROWS UNBOUNDED PRECEDING) AS peak FROM (
    SELECT *, row_number() OVER ({part} ORDER BY ts, event_id) - 1 AS i, sum(v) OVER ({part} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cum
    FROM (SELECT ts, event_id, event_type, CAST(floor((value - 50) * 100) / 100 AS DECIMAL(18, 2)) AS v FROM events)))) {group}
"""


def _value():
    return (F.floor((c("value") - 50) * 100) / 100).cast("decimal(18,2)")


@query("l04_max_drawdown", DRAWDOWN.format(keys="", part="", group=""))
def l04(t: Tables) -> DataFrame:
    return L.max_drawdown(t.events, ["ts", "event_id"], _value())


@query("l04_drawdown_by_type", DRAWDOWN.format(keys="event_type,", part="PARTITION BY event_type", group="GROUP BY event_type"))
def l04_by(t: Tables) -> DataFrame:
    return L.max_drawdown(t.events, ["ts", "event_id"], _value(), ["event_type"])


def chained(t: Tables) -> DataFrame:
    """Hash chains of at most 32 records cut from each user's events, with payloads and links tampered afterwards."""
    placed = Sequence(t.events.select("event_id", "user_id", "props"), ["user_id"], ["event_id"]).add(pos=rank()).frame
    piece = F.floor((c("pos") - 1) / 32)
    rows = placed.withColumns({"chain": F.concat_ws("-", "user_id", piece), "seq": c("pos") - piece * 32})
    lists = rows.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("seq", "event_id", "props"))).alias("r"))
    start = F.struct(F.lit("genesis").alias("h"), F.array().cast("array<struct<seq:bigint,event_id:bigint,props:string,previous_hash:string,record_hash:string>>").alias("out"))

    def step(acc, x):
        h = F.sha2(F.concat_ws("|", x["seq"], x["event_id"], x["props"], acc["h"]), 256)
        one = F.struct(x["seq"].alias("seq"), x["event_id"].alias("event_id"), x["props"].alias("props"), acc["h"].alias("previous_hash"), h.alias("record_hash"))
        return F.struct(h.alias("h"), F.concat(acc["out"], F.array(one)).alias("out"))

    long = lists.select("chain", F.explode(F.aggregate("r", start, step, lambda acc: acc["out"])).alias("x")).select("chain", "x.*")
    e = c("event_id")
    return long.withColumns(
        {
            "props": F.when(e % 211 == 0, F.concat("props", F.lit(" "))).otherwise(c("props")),
            "previous_hash": F.when(e % 223 == 0, "forged").otherwise(c("previous_hash")),
        }
    )


@query(
    "l05_verify_chain",
    """
    SELECT 'hash_mismatch' AS fault, count(*) AS n FROM events WHERE event_id % 211 = 0 OR event_id % 223 = 0 UNION ALL
    SELECT 'broken_link', count(*) FROM events WHERE event_id % 223 = 0
    """,
)
def l05(t: Tables) -> DataFrame:
    bad = L.verify_chain(stage(chained(t)), "chain", "seq", F.concat_ws("|", "seq", "event_id", "props", "previous_hash"), "genesis")
    return bad.select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


REPORT = """
rep AS (
  SELECT event_id, CASE event_type WHEN 'purchase' THEN 'resolved' WHEN 'error' THEN 'failed' ELSE 'decision' END AS kind, 'c' || (user_id % 4) AS contract,
         's' || (user_id % 3) AS strategy, CASE WHEN user_id % 10 = 3 THEN '[REDACTED]' ELSE 'src' || (user_id % 10) END AS source,
         CAST(floor(value * 100) / 100 AS DECIMAL(18, 2)) AS v, event_id % 6 = 0 AS idle FROM events),
longrep AS (
  SELECT 'contract' AS dimension, contract AS key, * FROM rep UNION ALL SELECT 'strategy', strategy, * FROM rep UNION ALL
  SELECT 'source', source, * FROM rep UNION ALL SELECT 'all', 'all', * FROM rep)
"""


@query(
    "l06_period_report",
    ctes(REPORT)
    + """
    SELECT dimension, key, coalesce(sum(v) FILTER (kind = 'resolved'), 0)::DOUBLE AS realized_value, coalesce(sum(v) FILTER (kind = 'decision'), 0)::DOUBLE AS prospective_value,
           coalesce(sum(v) FILTER (kind = 'decision'), 0)::DOUBLE AS capital, count(*) FILTER (kind = 'decision') AS decisions,
           round(count(*) FILTER (kind = 'decision' AND idle) / count(*) FILTER (kind = 'decision'), 6) AS no_action_rate, count(*) FILTER (kind = 'failed') AS incidents
    FROM longrep GROUP BY 1, 2
    """,
)
def l06(t: Tables) -> DataFrame:
    u = c("user_id")
    value = F.floor(c("value") * 100) / 100
    rows = t.events.select(
        F.when(c("event_type") == "purchase", "resolved").when(c("event_type") == "error", "failed").otherwise("decision").alias("kind"),
        F.concat(F.lit("c"), u % 4).alias("contract_id"), F.concat(F.lit("s"), u % 3).alias("strategy_id"),
        F.when(u % 10 == 3, "feed?token=abc").otherwise(F.concat(F.lit("src"), u % 10)).alias("source_id"), value.alias("realized_net"), value.alias("conservative_net"),
        value.alias("capital_required"), F.when(c("event_id") % 6 == 0, "abstain").otherwise("trade").alias("selected_action"),
    )
    return L.period_report(rows)


STREAK = """
SELECT user_id, max(n) AS longest, sum(n)::BIGINT AS periods FROM (
  SELECT user_id, g, count(*) AS n FROM (
    SELECT user_id, d, d - to_days((row_number() OVER (PARTITION BY user_id ORDER BY d) * {step})::INT) AS g FROM (SELECT DISTINCT user_id, {day} AS d FROM events)) GROUP BY 1, 2)
GROUP BY 1
"""


@query("l07_longest_streak_days", STREAK.format(step=1, day="ts::DATE"))
def l07(t: Tables) -> DataFrame:
    return L.longest_streak(t.events, ["user_id"], c("ts"))


@query("l07_longest_streak_weeks", STREAK.format(step=7, day="date_trunc('week', ts)::DATE"))
def l07_weeks(t: Tables) -> DataFrame:
    return L.longest_streak(t.events, ["user_id"], c("ts"), "week")


@query(
    "l07_duration_gate",
    f"""
    SELECT user_id, longest, periods, elapsed_days, elapsed_days >= 28 AND longest >= 10 AS passed, round(least(1.0::DOUBLE, elapsed_days / 28, longest / 10), 6) AS progress
    FROM ({STREAK.format(step=1, day="ts::DATE")}) JOIN (SELECT user_id, (datediff('day', DATE '2024-01-01', max(ts)::DATE) + 1)::INTEGER AS elapsed_days FROM events GROUP BY 1) USING (user_id)
    """,
)
def l07_gate(t: Tables) -> DataFrame:
    return L.duration_gate(t.events, ["user_id"], c("ts"), F.lit("2024-01-01"), 28, 10)


@query(
    "l08_usage_vs_budget",
    """
    SELECT event_type AS kind, count(*) FILTER (ts BETWEEN TIMESTAMP '2024-01-13 12:00:00' AND TIMESTAMP '2024-01-20 12:00:00') AS week,
           count(*) FILTER (ts::DATE = DATE '2024-01-20') AS day,
           greatest(0, 500 - count(*) FILTER (ts BETWEEN TIMESTAMP '2024-01-13 12:00:00' AND TIMESTAMP '2024-01-20 12:00:00')) AS week_left,
           greatest(0, 70 - count(*) FILTER (ts::DATE = DATE '2024-01-20')) AS day_left FROM events GROUP BY 1
    """,
)
def l08(t: Tables) -> DataFrame:
    rows = t.events.select(c("event_type").alias("kind"), c("ts").alias("event_time"))
    limits = rows.select("kind").distinct().withColumns({"weekly_limit": F.lit(500), "daily_limit": F.lit(70)})
    out = L.usage_vs_budget(rows, limits, F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))
    return out.select("kind", "week", "day", "week_left", "day_left")


@query(
    "l09_unrepeated_failures",
    "SELECT l_partkey, l_suppkey, l_returnflag FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) = 1",
)
def l09(t: Tables) -> DataFrame:
    return L.unrepeated_failures(t.lineitem, ["l_partkey", "l_suppkey", "l_returnflag"])


@query(
    "l10_classify_sources",
    """
    SELECT CASE WHEN r < 0.5 OR i >= 3 THEN 'broken' WHEN d >= 0.9 AND e <= 0 THEN 'redundant' WHEN u <= 0 AND p <= 0 AND e <= 0 THEN 'low_value'
                WHEN u >= 3 AND r >= 0.95 AND e > 0 THEN 'core' WHEN r >= 0.8 AND (p > 0 OR e > 0) THEN 'useful' ELSE 'experimental' END AS class, count(*) AS n
    FROM (SELECT (p_partkey % 21) / 20.0::DOUBLE AS r, p_partkey % 4 AS i, (p_partkey % 11) / 10.0::DOUBLE AS d, p_size % 5 AS u, p_size % 3 - 1 AS p, p_size % 7 - 3 AS e FROM part) GROUP BY 1
    """,
)
def l10(t: Tables) -> DataFrame:
    k, s = c("p_partkey"), c("p_size")
    rows = t.part.select(
        (k % 21 / F.lit(20.0)).alias("reliability"), (k % 4).alias("incidents"), (k % 11 / F.lit(10.0)).alias("redundancy"), (s % 5).alias("usage"),
        (s % 3 - 1).alias("predictive_lift"), (s % 7 - 3).alias("economic_lift"),
    )
    return rows.groupBy(L.classify_sources().alias("class")).agg(F.count("*").alias("n"))


@query(
    "l11_lineage_permissions",
    """
    WITH why AS (
      SELECT l_orderkey AS artifact_id, CASE WHEN s.s_suppkey IS NULL THEN 'unknown_source' WHEN s_suppkey % 7 = 0 THEN 'use_not_allowed' WHEN s_suppkey % 11 = 0 THEN 'license_not_confirmed'
             WHEN s_suppkey % 2 = 0 AND l_linenumber <= 1 THEN 'evidence_missing' END AS why
      FROM lineitem LEFT JOIN supplier s ON s_suppkey = l_suppkey + 2)
    SELECT artifact_id, bool_and(why IS NULL) AS allowed, count(*) AS sources, coalesce(string_agg(DISTINCT why, ',' ORDER BY why), '') AS refusals FROM why GROUP BY 1
    """,
)
def l11(t: Tables) -> DataFrame:
    s = c("s_suppkey")
    registry = t.supplier.select(
        s.alias("source_id"), F.create_map(F.lit("production_export"), s % 7 != 0).alias("allowed_uses"),
        F.when(s % 11 == 0, "unclear").otherwise("confirmed").alias("license_status"), (s % 2 == 0).alias("requires_evidence"),
    )
    lineage = t.lineitem.select(c("l_orderkey").alias("artifact_id"), (c("l_suppkey") + 2).alias("source_id"), (c("l_linenumber") > 1).alias("has_evidence"))
    return L.lineage_permissions(lineage, registry, "production_export").withColumn("refusals", F.array_join("refusals", ","))


@query(
    "l12_capture_status",
    """
    SELECT CASE event_type WHEN 'view' THEN 'active' WHEN 'purchase' THEN 'completed' ELSE 'incomplete' END AS episode_status, count(*) AS captures,
           sum((event_id % 2 = 0)::INT + 1)::BIGINT AS pending,
           sum(CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN (ts + INTERVAL 1 DAY < TIMESTAMP '2024-01-20')::INT ELSE 0 END + (ts + INTERVAL 3 DAY < TIMESTAMP '2024-01-20')::INT ELSE 0 END)::BIGINT AS overdue,
           count(CASE WHEN event_id % 9 = 0 THEN 1 END) AS missed FROM events GROUP BY 1
    """,
)
def l12(t: Tables) -> DataFrame:
    e = c("event_id")

    def followup(status, days):
        return F.struct(status.alias("status"), (c("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("due_at"))

    status = F.when(c("event_type") == "view", "active").when(c("event_type") == "purchase", "completed").otherwise("incomplete")
    rows = t.events.select(
        status.alias("episode_status"), F.array(followup(F.when(e % 2 == 0, "pending").otherwise("done"), 1), followup(F.lit("pending"), 3)).alias("followups"), (e % 9 == 0).alias("missed")
    )
    return L.capture_status(rows, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query(
    "l13_ranking_value",
    ctes(ENTRY)
    + """
    SELECT event_type, (sum(CAST(coalesce(realized_net, value) AS DECIMAL(18, 2))))::DOUBLE AS ranking_value, coalesce(sum(CAST(realized_net AS DECIMAL(18, 2))), 0)::DOUBLE AS realized_value,
           coalesce(sum(CASE WHEN realized_net IS NULL THEN CAST(value AS DECIMAL(18, 2)) END), 0)::DOUBLE AS expected_value FROM entries GROUP BY 1
    """,
)
def l13(t: Tables) -> DataFrame:
    return L.ranking_value(entries(t), ["event_type"])


@query(
    "l14_formula_scores",
    DATA.rstrip()
    + """,
    s AS (SELECT *, r + CASE WHEN prior_counter_count > 0 THEN 1.0::DOUBLE ELSE 0 END + r * round_number AS sc FROM sup),
    f AS (SELECT (avg(sc) FILTER (label = 'accept') + avg(sc) FILTER (label <> 'accept')) / 2 AS cut, (count(*) FILTER (label = 'accept') + 0.5) / (count(*) + 1.0) AS base FROM s WHERE region = 'train'),
    p AS (SELECT (label = 'accept')::INT AS y, least(greatest(base + 0.25 * tanh(sc - cut), 1e-6), 1 - 1e-6) AS p FROM s, f WHERE region = 'development')
    SELECT count(*) AS n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM p
    """,
)
def l14(t: Tables) -> DataFrame:
    train, dev = regions(B.split_cases(t, TASK))
    r, n, k = T.var("offer_to_asking_ratio"), T.var("prior_counter_count"), T.var("round_number")
    scored = L.formula_scores(train, dev, [r, T.threshold(n, F.lit(0.0)), T.interaction(r, k)], "accept")
    out = E.score_binary(scored.withColumn("target", (c("label") == "accept").cast("int")))
    return out.select("n", F.round("log_loss", 6).alias("log_loss"))


@query(
    "l15_diagnose_failures",
    """
    SELECT CASE WHEN lower(text) LIKE '%schema%' OR lower(text) LIKE '%field%' THEN 'schema_drift' WHEN lower(text) LIKE '%404%' OR lower(text) LIKE '%gone%' THEN 'dead_source'
                WHEN lower(text) LIKE '%rate%' OR lower(text) LIKE '%429%' THEN 'rate_limited' ELSE 'source_degraded' END AS cause, count(*) AS n FROM documents GROUP BY 1
    """,
)
def l15(t: Tables) -> DataFrame:
    return t.documents.groupBy(L.diagnose(c("text")).alias("cause")).agg(F.count("*").alias("n"))


@query(
    "l16_source_gaps",
    """
    WITH need AS (SELECT unnest([p_name, p_brand]) AS family FROM part)
    SELECT family, count(*) AS needed FROM need WHERE family NOT IN (
      SELECT CASE WHEN l_linenumber % 2 = 0 THEN p_brand ELSE p_name END FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A' AND l_quantity > 49) GROUP BY 1
    """,
)
def l16(t: Tables) -> DataFrame:
    proposals = t.part.select(F.array("p_name", "p_brand").alias("families"))
    family = F.when(c("l_linenumber") % 2 == 0, c("p_brand")).otherwise(c("p_name"))
    status = F.when((c("l_returnflag") == "A") & (c("l_quantity") > 49), "available").otherwise("broken")
    catalog = t.lineitem.join(t.part, c("p_partkey") == c("l_partkey")).select(family.alias("family"), c("l_suppkey").alias("source_id"), status.alias("status"))
    return L.source_gaps(proposals, catalog)


@query(
    "l16_catalog_families",
    """
    SELECT p_type AS family, (list(p_partkey ORDER BY p_partkey DESC))[1] AS source_id FROM part WHERE p_size % 3 <> 0 GROUP BY 1
    """,
)
def l16_catalog(t: Tables) -> DataFrame:
    catalog = t.part.select(c("p_type").alias("family"), c("p_partkey").alias("source_id"), F.when(c("p_size") % 3 == 0, "rejected").otherwise("available").alias("status"))
    return L.catalog_families(catalog, "source_id")


@query(
    "l17_overdue_cycles",
    """
    SELECT c_custkey AS lab, max(o_orderdate) AS last_observed, coalesce(datediff('day', max(o_orderdate), TIMESTAMP '2001-08-01') >= max(30 + c_custkey % 100), true) AS due
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
    """,
)
def l17(t: Tables) -> DataFrame:
    cadence = t.customer.select(c("c_custkey").alias("lab"), (30 + c("c_custkey") % 100).alias("cadence_days"))
    snapshots = t.orders.select(c("o_custkey").alias("lab"), c("o_orderdate").alias("observed_at"))
    return L.overdue_cycles(snapshots, cadence, F.lit("2001-08-01")).drop("cadence_days")


@query(
    "l18_latest_fits",
    """
    SELECT user_id % 7 AS campaign_id, event_type AS model_id, arg_max(event_id, (ts, event_id)) AS fit_id, count(*) AS fits FROM events GROUP BY 1, 2
    """,
)
def l18(t: Tables) -> DataFrame:
    rows = t.events.select((c("user_id") % 7).alias("campaign_id"), c("event_type").alias("model_id"), c("event_id").alias("fit_id"), F.struct("ts", "event_id").alias("seq"))
    return L.latest_fits(rows, "seq")


@query(
    "l18_lineage_edges",
    "SELECT unnest(CASE WHEN p_partkey % 3 = 0 THEN [p_partkey // 2, p_partkey // 3] ELSE [p_partkey // 2] END) AS parent, p_partkey AS child FROM part WHERE p_partkey > 0",
)
def l18_edges(t: Tables) -> DataFrame:
    k = c("p_partkey")
    half, third = F.floor(k / 2), F.floor(k / 3)
    parents = F.when(k == 0, F.array().cast("array<bigint>")).when(k % 3 == 0, F.array(half, third)).otherwise(F.array(half))
    return L.lineage_edges(t.part.select(k.alias("hypothesis_id"), parents.alias("parent_ids")))


@query(
    "l19_budget_usage",
    """
    SELECT user_id AS campaign_id, CASE WHEN event_id % 2 = 0 THEN 'hidden' ELSE 'development' END AS split,
           CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN count(*) FILTER (event_type = 'signup') ELSE count(*) FILTER (event_type = 'purchase') END AS used,
           CASE WHEN event_id % 2 = 0 THEN 1 ELSE 20 END AS allowed,
           greatest(0, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 20 END - CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN count(*) FILTER (event_type = 'signup') ELSE count(*) FILTER (event_type = 'purchase') END) AS remaining,
           CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN count(*) FILTER (event_type = 'signup') ELSE count(*) FILTER (event_type = 'purchase') END >= CASE WHEN event_id % 2 = 0 THEN 1 ELSE 20 END AS exhausted
    FROM events GROUP BY user_id, event_id % 2
    """,
)
def l19(t: Tables) -> DataFrame:
    rows = t.events.select(c("user_id").alias("campaign_id"), F.when(c("event_id") % 2 == 0, "hidden").otherwise("development").alias("split"), "event_type")
    limits = rows.select("split").distinct().withColumn("allowed", F.when(c("split") == "hidden", 1).otherwise(20))
    return L.budget_usage(rows, limits, "signup", "purchase")
