"""Walk-forward allocation over seven assets priced from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import walkforward as W
from parley.plans.registry import Tables, query
from parley.session import stage

c = F.col


def mix(weights: dict[str, float]) -> str:
    return " + ".join(f"{w}::DOUBLE * ({r} / lag({r}) OVER o - 1)" for r, w in weights.items())


BASE = f"""
WITH px AS (SELECT l_suppkey % 7 AS a, l_shipdate::DATE AS d, 100 + 150 * round(avg(l_discount), 6) AS p FROM lineitem GROUP BY 1, 2),
tab AS (
  SELECT d, {", ".join(f"max(p) FILTER (a = {i}) AS {r}" for i, r in enumerate(W.ROLES))} FROM px GROUP BY 1 HAVING count(*) = 7),
ret AS (
  SELECT d, row_number() OVER o - 1 AS i, {", ".join(f"{mix(w)} AS {n}" for n, w in W.PORTFOLIOS.items())} FROM tab WINDOW o AS (ORDER BY d)),
nums AS (SELECT *, count(*) OVER () AS n FROM ret),
lvl AS (SELECT *, {", ".join(f"product(1 + coalesce({n}, 0)) OVER (ORDER BY i) AS c_{n}" for n in W.PORTFOLIOS)} FROM nums),
pair AS (
  SELECT e.i AS e, j.i AS j, j.i > e.i AS ahead, {", ".join(f"j.c_{n} AS c_{n}, j.{n}" for n in W.PORTFOLIOS)},
         {", ".join(f"CASE WHEN j.i > e.i THEN j.c_{n} / e.c_{n} ELSE j.c_{n} / (SELECT s.c_{n} FROM lvl s WHERE s.i = e.i - 20) END AS v_{n}" for n in W.PORTFOLIOS)}
  FROM lvl e JOIN lvl j ON j.i BETWEEN e.i - 19 AND e.i + 20 AND j.i >= 1 WHERE e.i >= 20),
falls AS (
  SELECT e, ahead, j, {", ".join(f"v_{n}, {n}, v_{n} / greatest(1, max(v_{n}) OVER (PARTITION BY e, ahead ORDER BY j)) - 1 AS f_{n}" for n in W.PORTFOLIOS)} FROM pair),
win AS (
  SELECT e AS i, count(*) FILTER (ahead) AS n_ahead, count(*) FILTER (NOT ahead) AS n_past,
         {", ".join(f"arg_max(v_{n}, j) FILTER (NOT ahead) - 1 AS past_{n}, arg_max(v_{n}, j) FILTER (ahead) - 1 AS ahead_{n}, least(0, min(f_{n}) FILTER (ahead)) AS fall_{n}, round(stddev_samp({n}) FILTER (ahead) * sqrt(252), 6) AS vol_{n}" for n in W.PORTFOLIOS)},
         least(0, min(f_normal_exposure) FILTER (NOT ahead)) AS fall_past, round(stddev_samp(normal_exposure) FILTER (NOT ahead) * sqrt(252), 6) AS volatility
  FROM falls GROUP BY 1),
fc AS (
  SELECT *, count(*) OVER w AS samples, round(avg((fall_past <= -0.05)::INT) OVER w, 6) AS p_fall, round(avg((past_equity < past_cash)::INT) OVER w, 6) AS p_under,
         round(avg(past_normal_exposure) OVER w, 6) + 0.0 AS expected, round(past_equity - past_cash, 6) + 0.0 AS spread
  FROM win WINDOW w AS (ORDER BY i ROWS BETWEEN 79 PRECEDING AND CURRENT ROW)),
due AS (SELECT f.*, d FROM fc f JOIN ret USING (i) WHERE i >= 45 AND n_ahead >= 20 AND (i - 45) % 5 = 0)
"""


def choose(m: float = 1.0) -> str:
    cfg = W.RiskConfig()
    vl, vc, dl, dc, uc = (repr(x * m) for x in (cfg.volatility_low, cfg.volatility_cash, cfg.drawdown_low, cfg.drawdown_cash, cfg.underperform_cash))
    return f"""CASE strategy_id WHEN 'buy_and_hold' THEN 'normal_exposure' WHEN 'fixed_allocation' THEN 'low_exposure' WHEN 'cash' THEN 'cash'
      WHEN 'simple_momentum' THEN CASE WHEN spread <= 0 THEN 'cash' WHEN volatility > {vl} THEN 'low_exposure' ELSE 'normal_exposure' END
      WHEN 'volatility_scaling' THEN CASE WHEN volatility >= {vc} THEN 'cash' WHEN volatility >= {vl} THEN 'low_exposure' ELSE 'normal_exposure' END
      ELSE CASE WHEN volatility >= {vc} OR p_fall >= {dc} OR p_under >= {uc} THEN 'cash' WHEN volatility >= {vl} OR p_fall >= {dl} THEN 'low_exposure' ELSE 'normal_exposure' END END"""


TURN = " ".join(f"WHEN '{a}>{b}' THEN {W._turnover_between(a, b)}" for a in W.ACTIONS for b in W.ACTIONS)
DECIDE = f"""
, st AS (SELECT *, unnest([{", ".join(f"'{s}'" for s in W.STRATEGIES)}]) AS strategy_id FROM due),
act AS (SELECT *, {choose()} AS action FROM st),
trn AS (
  SELECT *, row_number() OVER o - 1 AS k, (CASE coalesce(lag(action) OVER o, 'cash') || '>' || action {TURN} END)::DOUBLE AS turnover
  FROM act WINDOW o AS (PARTITION BY strategy_id ORDER BY i)),
cst AS (SELECT *, round(100000 * turnover * 5 / 10000, 2) AS cost FROM trn),
rea AS (
  SELECT *, round(g, 6) + 0.0 AS gross, round(g - cost / 100000, 6) + 0.0 AS net, round(ahead_cash, 6) + 0.0 AS cash, v AS rvol, f <= -0.05 AS fell, ahead_equity < ahead_cash AS under FROM (
    SELECT *, CASE action {" ".join(f"WHEN '{a}' THEN ahead_{a}" for a in W.ACTIONS)} END AS g, CASE action {" ".join(f"WHEN '{a}' THEN vol_{a}" for a in W.ACTIONS)} END AS v,
           CASE action {" ".join(f"WHEN '{a}' THEN fall_{a}" for a in W.ACTIONS)} END AS f FROM cst))
"""


def table(t: Tables) -> DataFrame:
    """Complete dates with one price column per role."""
    role = c("l_suppkey") % 7
    px = t.lineitem.groupBy(role.alias("a"), F.to_date("l_shipdate").alias("market_date")).agg((100 + 150 * F.round(F.avg("l_discount"), 6)).alias("p"))
    wide = px.groupBy("market_date").agg(*[F.max(F.when(c("a") == i, c("p"))).alias(r) for i, r in enumerate(W.ROLES)])
    return wide.dropna()


def decisions(t: Tables) -> DataFrame:
    return W.walk_forward(table(t))


NAMES = list(W.PORTFOLIOS)


@query("i01_portfolio_returns", BASE + "SELECT d AS market_date, i AS session_index, {} FROM ret".format(", ".join(f"round({n}, 6) + 0.0 AS r_{n}" for n in NAMES)))
def i01(t: Tables) -> DataFrame:
    return W.portfolio_returns(table(t)).withColumns({f"r_{n}": F.round(f"r_{n}", 6) for n in NAMES})


def windows(t: Tables) -> DataFrame:
    return W.window_returns(W.portfolio_returns(table(t))).filter(c("n_past") >= 20)


@query("i02_compound_return", BASE + "SELECT i AS session_index, round(past_normal_exposure, 8) AS past, round(past_equity, 8) AS equity FROM win")
def i02(t: Tables) -> DataFrame:
    return windows(t).select("session_index", F.round("past_normal_exposure", 8).alias("past"), F.round("past_equity", 8).alias("equity"))


@query("i03_window_drawdown", BASE + "SELECT i AS session_index, round(fall_past, 6) + 0.0 AS drawdown FROM win")
def i03(t: Tables) -> DataFrame:
    return windows(t).select("session_index", F.round("fall_past", 6).alias("drawdown"))


@query("i04_annualised", BASE + "SELECT i AS session_index, volatility FROM win")
def i04(t: Tables) -> DataFrame:
    return windows(t).select("session_index", "volatility")


@query("i05_rolling_forecast", BASE + "SELECT i AS session_index, samples AS sample_count, p_fall, p_under, expected, spread FROM fc")
def i05(t: Tables) -> DataFrame:
    rows = W.rolling_forecast(W.window_returns(W.portfolio_returns(table(t)))).filter(c("n_past") >= 20)
    return rows.select(
        "session_index", "sample_count", c("probability_5pct_drawdown").alias("p_fall"), c("probability_equities_underperform_cash").alias("p_under"),
        c("expected_return").alias("expected"), c("trailing_spread").alias("spread"),
    )


@query("i06_strategy_actions", BASE + DECIDE + "SELECT strategy_id, i AS session_index, action FROM act")
def i06(t: Tables) -> DataFrame:
    return decisions(t).select("strategy_id", "session_index", "action")


@query("i07_turnover", BASE + DECIDE + "SELECT strategy_id, i AS session_index, k AS decision_index, turnover, cost AS transaction_cost FROM cst")
def i07(t: Tables) -> DataFrame:
    return decisions(t).select("strategy_id", "session_index", "decision_index", "turnover", "transaction_cost")


@query(
    "i08_realised",
    BASE + DECIDE + "SELECT strategy_id, i AS session_index, gross AS gross_return, net AS net_return, cash AS no_action_return, rvol AS realized_volatility, fell AS drawdown_event, under AS underperform_event FROM rea",
)
def i08(t: Tables) -> DataFrame:
    names = ["gross_return", "net_return", "no_action_return", "realized_volatility", "drawdown_event", "underperform_event"]
    return decisions(t).select("strategy_id", "session_index", *names)


@query(
    "i09_walk_forward",
    BASE
    + DECIDE
    + """
    , crv AS (SELECT strategy_id, k, net, product(1 + net) OVER (PARTITION BY strategy_id ORDER BY k) AS v FROM rea),
    pk AS (SELECT *, max(v) OVER (PARTITION BY strategy_id ORDER BY k) AS p FROM crv),
    dd AS (SELECT strategy_id, least(0, min(round(v / p - 1, 6))) AS maximum_drawdown FROM pk GROUP BY 1)
    SELECT *, CASE WHEN annualized_volatility <> 0 THEN round(annualized_return / annualized_volatility, 6) ELSE 0 END AS risk_adjusted_return FROM (
      SELECT strategy_id, count(*) AS decisions, round(sum(turnover), 2) AS total_turnover, round(sum(cost), 2) AS total_cost, round(product(1 + net) - 1, 6) AS cumulative_return,
             round(avg(net) * 52, 6) AS annualized_return, round(stddev_samp(net) * sqrt(252), 6) AS annualized_volatility, round(avg(net - cash), 6) AS mean_over_cash,
             round(avg((net > cash)::INT), 6) AS beat_cash_rate, round(avg(abs(volatility - rvol)), 6) AS volatility_mae FROM rea GROUP BY 1)
    JOIN dd USING (strategy_id)
    """,
)
def i09(t: Tables) -> DataFrame:
    return W.evaluate_walk_forward(stage(decisions(t))).drop("peak_index", "trough_index")


@query(
    "i09_forecast_calibration",
    BASE
    + DECIDE
    + """
    , l AS (SELECT strategy_id, 'drawdown' AS target, p_fall AS p, fell AS y FROM rea UNION ALL SELECT strategy_id, 'underperform', p_under, under FROM rea),
    b AS (SELECT strategy_id, target, least(floor(p * 5), 4) AS bin, count(*) AS n, avg(p) AS p, avg(y::INT) AS y FROM l GROUP BY 1, 2, 3)
    SELECT strategy_id, target, round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM b GROUP BY 1, 2
    """,
)
def i09_calibration(t: Tables) -> DataFrame:
    return W.forecast_calibration(decisions(t))


@query(
    "i09_regime_concentration",
    BASE
    + DECIDE
    + """
    , l AS (SELECT strategy_id, 'period' AS kind, strftime(d, '%Y') AS value FROM rea UNION ALL
            SELECT strategy_id, 'regime', CASE WHEN rvol < 0.12 THEN 'low_volatility' WHEN rvol < 0.24 THEN 'normal_volatility' ELSE 'high_volatility' END FROM rea),
    n AS (SELECT strategy_id, kind, value, count(*) AS n FROM l GROUP BY 1, 2, 3)
    SELECT strategy_id, kind, round(max(n) / sum(n), 6) AS largest_share, (list(value ORDER BY n DESC, value))[1] AS largest FROM n GROUP BY 1, 2
    """,
)
def i09_regime(t: Tables) -> DataFrame:
    return W.regime_concentration(decisions(t))


@query(
    "i10_sensitivity",
    BASE
    + DECIDE
    + " UNION ALL ".join(
        f"""SELECT {m}::DOUBLE AS multiplier, round(avg((other <> action)::INT), 6) AS action_change_rate,
                   round(avg(round(CASE other {" ".join(f"WHEN '{a}' THEN ahead_{a}" for a in W.ACTIONS)} END, 6)), 6) AS mean_return
            FROM (SELECT *, {choose(m)} AS other FROM rea WHERE strategy_id = '{W.PRIMARY}')"""
        for m in (0.9, 1.0, 1.1)
    ),
)
def i10(t: Tables) -> DataFrame:
    return W.sensitivity(decisions(t))


@query(
    "i11_paper_span",
    """
    SELECT datediff('day', min(d), max(d))::INTEGER AS span_days, count(*) AS decision_days, datediff('day', min(d), max(d)) >= 183 AS long_enough
    FROM (SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')
    """,
)
def i11(t: Tables) -> DataFrame:
    entries = t.orders.select(
        F.when(c("o_orderstatus") == "P", "paper").otherwise("real").alias("designation"), F.when(c("o_orderpriority") == "1-URGENT", "paper_cycle").otherwise("backfill").alias("mode"),
        F.lit("paper_decision").alias("evidence_state"), c("o_orderdate").alias("decision_timestamp"),
    )
    return W.paper_span(entries)
