"""Randomised comparison and off-policy estimation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import causal as A
from parley.plans.registry import Tables, ctes, query

c = F.col


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({x: F.round(x, 6) for x in names})


def trials(t: Tables, varying: bool) -> DataFrame:
    u = c("user_id")
    p = F.when(u % 4 < 2, 0.3).otherwise(0.7) if varying else F.lit(0.5)
    return t.events.select(
        F.date_format("ts", "E").alias("block"), F.when(u % 2 == 1, "treatment").otherwise("comparator").alias("arm"),
        p.alias("probability"), (c("event_type") == "purchase").cast("int").alias("outcome"), (c("event_id") % 50 != 0).alias("adherent"),
    )


def compare_sql(p: str) -> str:
    return f"""
    WITH tr AS (
      SELECT strftime(ts, '%a') AS block, user_id % 2 = 1 AS t, {p}::DOUBLE AS p, (event_type = 'purchase')::INT AS y, event_id % 50 = 0 AS off FROM events),
    w AS (SELECT *, CASE WHEN t THEN 1 / p ELSE 1 / (1 - p) END AS w FROM tr),
    s AS (SELECT 'block' AS scope, * FROM w UNION ALL SELECT 'overall', * REPLACE ('all' AS block) FROM w),
    g AS (
      SELECT scope, block, count(*) FILTER (t) AS tn, count(*) FILTER (NOT t) AS cn, sum(y) FILTER (t) AS ty, sum(y) FILTER (NOT t) AS cy,
             max(p) - min(p) > 1e-12 AS varies, sum(w * y) FILTER (t) / sum(w) FILTER (t) AS tw, sum(w * y) FILTER (NOT t) / sum(w) FILTER (NOT t) AS cw,
             count(CASE WHEN off THEN 1 END) AS nonadherent FROM s GROUP BY 1, 2),
    m AS (SELECT *, CASE WHEN varies THEN tw ELSE ty / tn END AS tm, CASE WHEN varies THEN cw ELSE cy / cn END AS cm,
                 (ty + 1.0::DOUBLE) / (tn + 2) AS ta, (cy + 1.0::DOUBLE) / (cn + 2) AS ca FROM g),
    v AS (
      SELECT s.scope, s.block, sqrt(sum(w * w * (y - tw) * (y - tw)) FILTER (t) / pow(sum(w) FILTER (t), 2)
             + sum(w * w * (y - cw) * (y - cw)) FILTER (NOT t) / pow(sum(w) FILTER (NOT t), 2)) AS sw
      FROM s JOIN g ON g.scope = s.scope AND g.block = s.block GROUP BY 1, 2)
    SELECT scope, block, tn AS treatment_n, cn AS comparator_n, round(tm, 6) AS treatment_mean, round(cm, 6) AS comparator_mean, round(tm - cm, 6) AS effect,
           round(se, 6) AS standard_error, round(greatest(-1, mid - 1.96 * se), 6) AS low, round(least(1, mid + 1.96 * se), 6) AS high, nonadherent,
           CASE WHEN varies THEN 'hajek_weighted' ELSE 'difference_in_means' END AS estimator,
           concat_ws(',', CASE WHEN tn < 10 OR cn < 10 THEN 'small_sample' END, CASE WHEN nonadherent > 0 THEN 'nonadherent_trials' END,
                     CASE WHEN varies THEN 'varying_probability' END) AS warnings
    FROM (SELECT m.*, CASE WHEN varies THEN sw ELSE sqrt(ta * (1 - ta) / (tn + 2) + ca * (1 - ca) / (cn + 2)) END AS se,
                 CASE WHEN varies THEN tm - cm ELSE ta - ca END AS mid FROM m JOIN v ON v.scope = m.scope AND v.block = m.block)
    """


def _compared(df: DataFrame) -> DataFrame:
    out = A.treatment_compare(df, "treatment", "comparator").withColumn("warnings", F.array_join("warnings", ","))
    return rounded(out, "treatment_mean", "comparator_mean", "effect", "standard_error", "low", "high")


@query("f01_treatment_compare", compare_sql("0.5"))
def f01(t: Tables) -> DataFrame:
    return _compared(trials(t, False))


@query("f02_weighted_compare", compare_sql("CASE WHEN user_id % 4 < 2 THEN 0.3 ELSE 0.7 END"))
def f02(t: Tables) -> DataFrame:
    return _compared(trials(t, True))


def randomized(t: Tables) -> DataFrame:
    return t.events.select((c("user_id") % 2).cast("int").alias("treatment"), (c("event_type") == "purchase").cast("int").alias("outcome"))


UPLIFT = "u AS (SELECT (user_id % 2)::INT AS t, (event_type = 'purchase')::INT AS y FROM events)"


@query(
    "f03_uplift",
    ctes(UPLIFT)
    + """
    SELECT rows, treated, controls, round(tr, 6) AS treatment_rate, round(cr, 6) AS control_rate, round(tr - cr, 6) AS ate, round(se, 6) AS standard_error,
           round(tr - cr - 1.96 * se, 6) AS low, round(tr - cr + 1.96 * se, 6) AS high
    FROM (SELECT count(*) AS rows, count(*) FILTER (t = 1) AS treated, count(*) FILTER (t = 0) AS controls, avg(y) FILTER (t = 1) AS tr, avg(y) FILTER (t = 0) AS cr,
                 sqrt(var_samp(y) FILTER (t = 1) / count(*) FILTER (t = 1) + var_samp(y) FILTER (t = 0) / count(*) FILTER (t = 0)) AS se FROM u)
    """,
)
def f03(t: Tables) -> DataFrame:
    return rounded(A.uplift(randomized(t)), "treatment_rate", "control_rate", "ate", "standard_error", "low", "high")


@query(
    "f04_permutation_test",
    ctes(UPLIFT)
    + """
    , s AS (SELECT count(*) AS n, sum(y) AS k, sum(t) AS m, sum(y * t) AS x FROM u),
    p AS (
      SELECT i, i / m - (k - i) / (n - m) AS ate, x / m - (k - x) / (n - m) AS seen,
             exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + lgamma(n - k + 1) - lgamma(m - i + 1) - lgamma(n - k - m + i + 1)
                 - lgamma(n + 1) + lgamma(m + 1) + lgamma(n - m + 1)) AS w
      FROM s, range(0, 10000000) r(i) WHERE i BETWEEN greatest(0, k + m - n) AND least(k, m))
    SELECT round(max(seen), 6) AS ate, round(sum(w) FILTER (abs(ate) >= abs(seen) - 1e-12) / sum(w), 6) AS p_value, round(sum(w * ate) / sum(w), 6) + 0.0 AS null_mean FROM p
    """,
)
def f04(t: Tables) -> DataFrame:
    out = A.permutation_test(randomized(t))
    return out.select(F.round("ate", 6).alias("ate"), F.round("p_value", 6).alias("p_value"), (F.round("null_mean", 6) + 0.0).alias("null_mean"))


def _wrapped(product: str) -> str:
    return f"(({product}) % 18446744073709551616::UHUGEINT)::UBIGINT"


# the mixed bits of a row and draw, in wrapping 64-bit arithmetic
DRAWN = f"""
u AS (SELECT (user_id % 2)::INT AS t, value AS y, ('0x' || right(sha256(event_id::VARCHAR), 15))::UBIGINT AS x FROM events),
z0 AS (SELECT d, y, {_wrapped("x::UHUGEINT + (d + 1)::UHUGEINT * 11400714819323198485::UHUGEINT")} AS z FROM u, range(200) r(d)),
z1 AS (SELECT d, y, {_wrapped("xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT")} AS z FROM z0),
z2 AS (SELECT d, y, {_wrapped("xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT")} AS z FROM z1),
placed AS (SELECT d, y, row_number() OVER (PARTITION BY d ORDER BY xor(z, z >> 31)) AS place FROM z2)
"""


@query(
    "f04_permutation_draws",
    ctes(DRAWN)
    + """
    , s AS (SELECT count(*) AS n, sum(t) AS m, sum(y) AS total, avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS ate FROM u),
    e AS (SELECT d, max(ate) AS seen, sum(y) FILTER (place <= m) / max(m) - (max(total) - sum(y) FILTER (place <= m)) / (max(n) - max(m)) AS ate
          FROM placed, s GROUP BY d)
    SELECT round(max(seen), 6) AS ate, round(avg((abs(ate) >= abs(seen) - 1e-12 * greatest(1, abs(seen)))::INT), 6) AS p_value, round(avg(ate), 6) AS null_mean,
           count(*) AS draws, 'sampled' AS method FROM e
    """,
)
def f04_draws(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", (c("user_id") % 2).cast("int").alias("treatment"), c("value").alias("outcome"))
    return rounded(A.permutation_draws(rows, "event_id", draws=200), "ate", "p_value", "null_mean")


# Probabilities of a policy by context (rows) and action (columns); "gift" is never logged.
POLICY_ACTIONS = ["click", "error", "purchase", "signup", "gift"]
POLICY = [[0.4, 0.1, 0.3, 0.1, 0.1], [0.2, 0.2, 0.2, 0.4, 0.0], [0.5, 0.0, 0.5, 0.0, 0.0], [0.25, 0.25, 0.25, 0.25, 0.0]]

POLICY_SQL = "policy AS (SELECT * FROM (VALUES {}) v(context, action, prob)),".format(
    ", ".join(f"({i}, '{a}', {p}::DOUBLE)" for i, row in enumerate(POLICY) for a, p in zip(POLICY_ACTIONS, row))
)
LOGS = """
base AS (SELECT user_id % 4 AS context, event_type AS action, (value > 50)::INT::DOUBLE AS reward, event_id FROM events),
logs AS (
  SELECT context, action, reward, CASE WHEN event_id % 97 = 0 THEN 0 ELSE count(*) OVER (PARTITION BY context, action) / count(*) OVER (PARTITION BY context) END::DOUBLE AS propensity
  FROM base),
"""


def bandit(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Logged actions with their empirical share by context as propensity; one row in 97 lost it."""
    base = t.events.select(
        (c("user_id") % 4).alias("context"), c("event_type").alias("action"), (c("value") > 50).cast("double").alias("reward"), "event_id"
    )
    pair = base.groupBy("context", "action").agg(F.count("*").alias("n"))
    whole = base.groupBy("context").agg(F.count("*").alias("m"))
    share = pair.join(whole, "context").select("context", "action", (c("n") / c("m")).alias("share"))
    logs = base.join(share, ["context", "action"]).withColumn("propensity", F.when(c("event_id") % 97 == 0, 0.0).otherwise(c("share")))
    table = F.array(*[F.map_from_arrays(F.array(*[F.lit(a) for a in POLICY_ACTIONS]), F.array(*[F.lit(p) for p in row])) for row in POLICY])
    contexts = base.select("context").distinct()
    policy = contexts.select("context", F.explode(F.get(table, c("context").cast("int"))).alias("action", "prob"))
    return logs.select("context", "action", "reward", "propensity"), policy


@query(
    "f05_off_policy",
    "WITH " + POLICY_SQL + LOGS
    + """
    mean AS (SELECT action, avg(reward) AS m FROM logs GROUP BY 1),
    dm AS (SELECT context, sum(prob * coalesce(m, 0)) AS q FROM policy LEFT JOIN mean USING (action) GROUP BY 1),
    r AS (
      SELECT reward, q, coalesce(prob, 0) AS p, propensity, m, CASE WHEN coalesce(prob, 0) > 0 AND propensity > 0 THEN prob / propensity ELSE 0 END AS w
      FROM logs LEFT JOIN policy USING (context, action) LEFT JOIN dm USING (context) LEFT JOIN mean USING (action)),
    x AS (SELECT *, least(w, 10) AS wc, CASE WHEN p <= 0 THEN q WHEN propensity > 0 THEN q + w * (reward - m) END AS dr FROM r),
    a AS (SELECT avg(reward) AS onp, avg(w) AS mw, count(*) AS n, count(CASE WHEN p > 0 AND propensity <= 0 THEN 1 END) AS void,
                 (SELECT count(DISTINCT action) FROM policy WHERE prob > 0 AND action NOT IN (SELECT action FROM logs)) AS lost FROM x),
    e AS (
      SELECT 'direct_method' AS estimator, avg(q) AS v, sqrt(var_samp(q) / count(*)) AS se, NULL::DOUBLE AS ess, max(lost) AS bad FROM x, a UNION ALL
      SELECT 'ips', avg(w * reward), sqrt(var_samp(w * reward) / count(*)), pow(sum(w), 2) / sum(w * w), max(lost + void) FROM x, a UNION ALL
      SELECT 'self_normalized_ips', avg(w * reward) / max(mw), sqrt(var_samp(w * reward) / count(*)) / max(mw), pow(sum(w), 2) / sum(w * w), max(lost + void) FROM x, a UNION ALL
      SELECT 'doubly_robust', avg(dr), sqrt(var_samp(dr) / count(dr)), pow(sum(w), 2) / sum(w * w), max(lost + void) FROM x, a WHERE dr IS NOT NULL UNION ALL
      SELECT 'switch_ips', avg(wc * reward), sqrt(var_samp(wc * reward) / count(*)), pow(sum(wc), 2) / sum(wc * wc), max(lost + void) FROM x, a)
    SELECT estimator, round(v, 6) AS value, round(ess, 4) AS effective_sample_size, bad AS support_violations, round(v - 1.96 * se, 6) AS low,
           round(v + 1.96 * se, 6) AS high, round(abs(v - onp) / onp, 6) AS relative_error FROM e, a
    """,
)
def f05(t: Tables) -> DataFrame:
    out = A.ope(*bandit(t), ["context"]).drop("on_policy")
    return rounded(out, "value", "low", "high", "relative_error").withColumn("effective_sample_size", F.round("effective_sample_size", 4))


@query(
    "f06_unsupported_actions",
    "WITH " + POLICY_SQL + LOGS.rstrip().rstrip(",") + " SELECT DISTINCT action FROM policy WHERE prob > 0 AND action NOT IN (SELECT action FROM logs)",
)
def f06(t: Tables) -> DataFrame:
    return A.unsupported_actions(*bandit(t), ["context"])


DRAW = "('0x' || substr(sha256('7:pilot:' || c_custkey::VARCHAR), 1, 15))::BIGINT::DOUBLE / 1152921504606846976.0::DOUBLE"


@query(
    "f07_assign",
    f"""
    SELECT c_custkey, CASE WHEN d < 0.3 THEN 'treatment' ELSE 'comparator' END AS arm, CASE WHEN d < 0.3 THEN 0.3 ELSE 0.7 END::DOUBLE AS assigned_probability
    FROM (SELECT c_custkey, {DRAW} AS d FROM customer)
    """,
)
def f07(t: Tables) -> DataFrame:
    return A.assign(t.customer, "c_custkey", 0.3, 7, "pilot").select("c_custkey", "arm", "assigned_probability")


@query(
    "f07_blocks",
    """
    SELECT 'fatigue_band=' || CASE WHEN f > 0.66 THEN 'high' WHEN f > 0.33 THEN 'medium' ELSE 'low' END || '|task_size=' || CASE WHEN v > 50 THEN 'large' ELSE 'small_or_medium' END
           || '|time_of_day=' || CASE WHEN hour(ts) < 12 THEN 'morning' ELSE 'not_morning' END AS block, count(*) AS n
    FROM (SELECT ts, value AS v, (event_id % 100) / 100.0::DOUBLE AS f FROM events) GROUP BY 1
    """,
)
def f07_blocks(t: Tables) -> DataFrame:
    context = F.create_map(
        F.lit("fatigue"), (c("event_id") % 100) / F.lit(100.0), F.lit("task_size_large"), (c("value") > 50).cast("double"),
        F.lit("time_of_day_morning"), (F.hour("ts") < 12).cast("double"),
    )
    return t.events.withColumn("context", context).groupBy(A.context_block().alias("block")).agg(F.count("*").alias("n"))


@query(
    "f08_trial_integrity",
    """
    SELECT fault, count(*) AS n FROM (
      SELECT unnest(list_filter([CASE WHEN event_type = 'error' THEN 'no_assignment' END, CASE WHEN event_type <> 'error' AND event_id % 17 = 0 THEN 'arm_mismatch' END,
        CASE WHEN event_type <> 'error' AND event_id % 19 = 0 AND NOT again THEN 'before_assignment' END, CASE WHEN again THEN 'duplicate' END], lambda x: x IS NOT NULL)) AS fault
      FROM (SELECT *, false AS again FROM events UNION ALL SELECT *, true FROM events WHERE event_type = 'view')) GROUP BY 1
    """,
)
def f08(t: Tables) -> DataFrame:
    e = c("event_id")
    arm = F.when(e % 2 == 0, "a").otherwise("b")
    assignments = t.events.filter(c("event_type") != "error").select(e.alias("assignment_id"), arm.alias("arm"), c("ts").alias("assigned_at"))
    copies = F.explode(F.when(c("event_type") == "view", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    late = F.when((e % 19 == 0) & (c("_again") == 0), c("ts") - F.expr("INTERVAL 1 HOUR")).otherwise(c("ts") + F.expr("INTERVAL 1 HOUR") * (c("_again") + 1))
    outcomes = t.events.withColumn("_again", copies).select(
        (e * 2 + c("_again")).alias("trial_id"), e.alias("assignment_id"), F.when(e % 17 == 0, "c").otherwise(arm).alias("arm"), late.alias("recorded_at")
    )
    found = A.trial_integrity(outcomes, assignments)
    return found.select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


@query(
    "f08_over_plan",
    "SELECT user_id AS preregistration_id, count(*) AS assigned, 60 + user_id % 20 AS planned FROM events GROUP BY 1 HAVING count(*) > 60 + user_id % 20",
)
def f08_plan(t: Tables) -> DataFrame:
    assignments = t.events.select(c("user_id").alias("preregistration_id"))
    plans = assignments.distinct().withColumn("planned", 60 + c("preregistration_id") % 20)
    return A.over_plan(assignments, plans)


PROPOSE = """
ctx AS (SELECT c_custkey AS id, (c_custkey % 7 = 0) AS large, (c_custkey % 10) / 10.0::DOUBLE AS fatigue FROM customer),
pred AS (
  SELECT o_custkey AS id, o_orderpriority AS model, avg(o_totalprice) FILTER (o_orderstatus <> 'O') / 390001 AS t, avg(o_totalprice) FILTER (o_orderstatus = 'O') / 390001 AS k
  FROM orders GROUP BY 1, 2),
gain AS (SELECT id, greatest(max(t) - min(t), max(k) - min(k), max(t - k) - min(t - k)) AS s, avg(t - k) AS g FROM pred GROUP BY 1),
util AS (SELECT id, s, g, CASE WHEN large THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END * 0.1 + 0.05 * 0.1 + (0.15 + 0.1 * fatigue) * 0.1 AS price FROM gain JOIN ctx USING (id))
"""


def proposals(t: Tables, mode: str) -> DataFrame:
    """Each order priority stands for a model, its finished and open orders for the two arms."""
    arm = F.when(c("o_orderstatus") != "O", "treatment").otherwise("comparator")
    predictions = t.orders.groupBy(c("o_custkey").alias("context_id"), c("o_orderpriority").alias("model"), arm.alias("arm")).agg(
        (F.avg("o_totalprice") / 390001).alias("p")
    )
    k = c("c_custkey")
    contexts = t.customer.select(k.alias("context_id"), F.when(k % 7 == 0, 1.0).otherwise(0.0).alias("task_size_large"), ((k % 10) / F.lit(10.0)).alias("fatigue"))
    return A.propose_experiment(predictions, contexts, mode)


@query("f09_propose_science", ctes(PROPOSE) + "SELECT id AS context_id, round(s, 6) AS separation, round(s - price, 6) AS utility FROM util")
def f09(t: Tables) -> DataFrame:
    return rounded(proposals(t, "science"), "separation", "utility").select("context_id", "separation", "utility")


@query(
    "f09_best_context",
    ctes(PROPOSE) + "SELECT id AS context_id, round(g - price, 6) AS utility FROM util ORDER BY g - price DESC NULLS LAST, id LIMIT 1",
)
def f09_best(t: Tables) -> DataFrame:
    return rounded(A.best_context(proposals(t, "optimization")), "utility").select("context_id", "utility")
