"""Walk-forward allocation over price history.

Windows over sessions have bounded frames, so they run in blocks of sessions with a halo: a row is copied
into the few blocks whose frames reach it and no task holds the whole history.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.scalars import bin_of
from parley.operators.sequence import Sequence, lag, rank, running_max, running_sum, total

c = F.col

# Roles of a universe and the weights of each action.
ROLES = ["us_equity", "international_equity", "treasury_bond", "investment_grade_credit", "gold", "broad_commodities", "cash_equivalent"]
WEIGHTS = {
    "cash": {"cash_equivalent": 1.0},
    "low_exposure": {
        "us_equity": 0.20, "international_equity": 0.10, "treasury_bond": 0.30, "investment_grade_credit": 0.15,
        "gold": 0.05, "broad_commodities": 0.05, "cash_equivalent": 0.15,
    },
    "normal_exposure": {
        "us_equity": 0.45, "international_equity": 0.20, "treasury_bond": 0.15, "investment_grade_credit": 0.07,
        "gold": 0.05, "broad_commodities": 0.05, "cash_equivalent": 0.03,
    },
}
EQUITY = {"us_equity": 0.70, "international_equity": 0.30}
PORTFOLIOS = {**WEIGHTS, "equity": EQUITY}
ACTIONS = list(WEIGHTS)
STRATEGIES = ["buy_and_hold", "fixed_allocation", "cash", "simple_momentum", "volatility_scaling", "target_only_autoregression"]
PRIMARY = "target_only_autoregression"


@dataclass(frozen=True)
class RiskConfig:
    horizon: int = 20
    history: int = 45
    lookback: int = 80
    notional: float = 100_000.0
    cost_bps: float = 5.0
    uncertainty: float = 0.02
    volatility_low: float = 0.18
    volatility_cash: float = 0.28
    drawdown_low: float = 0.25
    drawdown_cash: float = 0.40
    underperform_cash: float = 0.45


def six(x: Column) -> Column:
    return F.round(x, 6)


def decision_sessions(calendar: DataFrame, day: str, history: int, horizon: int, every: int = 5) -> DataFrame:
    """Every n-th session that has enough history before it and enough sessions after it."""
    placed = Sequence(calendar.select(day).distinct(), [], [day]).add(_pos=rank(), _n=total()).frame
    i = c("_pos") - 1
    keep = (i >= history) & (i + horizon < c("_n")) & ((i - history) % every == 0)
    return placed.filter(keep).select(day, i.alias("session_index"))


def portfolio_returns(table: DataFrame, day: str = "market_date", roles: list[str] = ROLES) -> DataFrame:
    """Session index and the daily return of every portfolio; table has one price column per role."""
    seq = Sequence(table, [], [day]).add(_pos=rank(), **{f"_p_{r}": lag(c(r)) for r in roles}).frame
    own = {r: c(r) / c(f"_p_{r}") - 1 for r in roles}
    mixes = {f"r_{name}": reduce(lambda a, b: a + b, [F.lit(w) * own[r] for r, w in weights.items()]) for name, weights in PORTFOLIOS.items()}
    return seq.withColumn("session_index", c("_pos") - 1).withColumns(mixes).select(day, "session_index", *mixes)


def framed(df: DataFrame, index: str, before: int, after: int, keys: list[str], outputs, block: int = 512) -> DataFrame:
    """Columns over frames of at most ``before`` rows back and ``after`` rows ahead, computed block by block.

    ``outputs`` maps a window to columns; ``index`` counts rows from 0 without gaps inside the keys.
    """
    i = c(index)
    first = F.greatest(F.lit(0), F.floor((i - after) / block))
    copies = df.withColumn("_block", F.explode(F.sequence(first.cast("long"), F.floor((i + before) / block).cast("long"))))
    window = Window.partitionBy(*keys, "_block").orderBy(index)
    return copies.withColumns(outputs(window)).filter(c("_block") == F.floor(i / block)).drop("_block")


def compounded(returns: Column) -> Column:
    """Return of an array of daily returns."""
    return F.aggregate(returns, F.lit(1.0), lambda acc, r: acc * (1 + r)) - 1


def drawdown(returns: Column) -> Column:
    """Worst fall below the peak inside an array of daily returns; the peak starts at 1."""
    start = F.struct(F.lit(1.0).alias("v"), F.lit(1.0).alias("p"), F.lit(0.0).alias("w"))

    def step(acc: Column, r: Column) -> Column:
        v = acc["v"] * (1 + r)
        p = F.greatest(acc["p"], v)
        return F.struct(v.alias("v"), p.alias("p"), F.least(acc["w"], v / p - 1).alias("w"))

    return F.aggregate(returns, start, step, lambda acc: acc["w"])


def annual_volatility(x: str, window) -> Column:
    return six(F.coalesce(F.stddev_samp(x).over(window), F.lit(0.0)) * F.sqrt(F.lit(252.0)))


def window_returns(returns: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Compounded returns and drawdown of the last h returns, and of the next h, at every session."""
    h = cfg.horizon

    def outputs(w):
        past, ahead = w.rowsBetween(-(h - 1), 0), w.rowsBetween(1, h)
        out = {"n_past": F.count("r_normal_exposure").over(past), "n_ahead": F.count("r_normal_exposure").over(ahead)}
        for p in PORTFOLIOS:
            out[f"past_{p}"] = compounded(F.collect_list(f"r_{p}").over(past))
            out[f"ahead_{p}"] = compounded(F.collect_list(f"r_{p}").over(ahead))
            out[f"vol_ahead_{p}"] = annual_volatility(f"r_{p}", ahead)
            out[f"fall_ahead_{p}"] = drawdown(F.collect_list(f"r_{p}").over(ahead))
        out["fall_past"] = drawdown(F.collect_list("r_normal_exposure").over(past))
        out["volatility"] = annual_volatility("r_normal_exposure", past)
        return out

    return framed(returns, "session_index", h, h, [], outputs)


def rolling_forecast(windows: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Forecast targets at every session from the previous windows: shares of bad windows and the mean return."""
    k = cfg.lookback
    full = c("n_past") >= cfg.horizon

    def outputs(w):
        last = w.rowsBetween(-(k - 1), 0)

        def share(event: Column) -> Column:
            return F.coalesce(six(F.avg(F.when(full, event.cast("double"))).over(last)), F.lit(0.5))

        mean = F.avg(F.when(full, c("past_normal_exposure"))).over(last)
        return {
            "sample_count": F.count(F.when(full, 1)).over(last),
            "probability_5pct_drawdown": share(c("fall_past") <= -0.05),
            "probability_equities_underperform_cash": share(c("past_equity") < c("past_cash")),
            "expected_return": six(F.coalesce(mean, c("past_normal_exposure"))),
        }

    out = framed(windows, "session_index", k, 0, [], outputs)
    return out.withColumn("trailing_spread", six(c("past_equity") - c("past_cash")))


def select_action(strategy: Column, cfg: RiskConfig = RiskConfig()) -> Column:
    """Action of each strategy under a forecast."""
    vol, fall, under = c("volatility"), c("probability_5pct_drawdown"), c("probability_equities_underperform_cash")
    momentum = F.when(c("trailing_spread") <= 0, "cash").when(vol > cfg.volatility_low, "low_exposure").otherwise("normal_exposure")
    scaling = F.when(vol >= cfg.volatility_cash, "cash").when(vol >= cfg.volatility_low, "low_exposure").otherwise("normal_exposure")
    target = (
        F.when((vol >= cfg.volatility_cash) | (fall >= cfg.drawdown_cash) | (under >= cfg.underperform_cash), "cash")
        .when((vol >= cfg.volatility_low) | (fall >= cfg.drawdown_low), "low_exposure")
        .otherwise("normal_exposure")
    )
    return (
        F.when(strategy == "buy_and_hold", "normal_exposure").when(strategy == "fixed_allocation", "low_exposure").when(strategy == "cash", "cash")
        .when(strategy == "simple_momentum", momentum).when(strategy == "volatility_scaling", scaling).when(strategy == PRIMARY, target)
    )


def strategy_actions(forecasts: DataFrame, cfg: RiskConfig = RiskConfig(), strategies: list[str] = STRATEGIES) -> DataFrame:
    """One row per decision and strategy: an explode over the fixed list of strategies."""
    rows = forecasts.withColumn("strategy_id", F.explode(F.array(*[F.lit(s) for s in strategies])))
    return rows.withColumn("action", select_action(c("strategy_id"), cfg))


def _turnover_between(old: str, new: str) -> float:
    return round(sum(abs(WEIGHTS[new].get(r, 0.0) - WEIGHTS[old].get(r, 0.0)) for r in ROLES) / 2, 6)


def turnover(actions: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Turnover and cost of each decision against the strategy's previous weights; the first comes from cash."""
    seq = Sequence(actions, ["strategy_id"], ["session_index"]).add(_before=lag(c("action")), _pos=rank()).frame
    pairs = F.create_map(*[F.lit(x) for a in ACTIONS for b in ACTIONS for x in (f"{a}>{b}", _turnover_between(a, b))])
    moved = F.try_element_at(pairs, F.concat_ws(">", F.coalesce("_before", F.lit("cash")), "action"))
    rows = seq.withColumns({"decision_index": c("_pos") - 1, "turnover": moved}).drop("_before", "_pos")
    cost = F.round(F.lit(cfg.notional) * c("turnover") * cfg.cost_bps / 10000.0, 2)
    gross = F.round(c("expected_return") * cfg.notional, 2)
    doubt = F.round(F.abs("volatility") * cfg.notional * cfg.uncertainty, 2)
    return rows.withColumns({"transaction_cost": cost, "expected_gross": gross, "uncertainty": doubt}).withColumn(
        "conservative_net", F.round(c("expected_gross") - c("transaction_cost") - c("uncertainty"), 2)
    )


def by_action(prefix: str) -> Column:
    out = c(f"{prefix}_cash")
    for a in ACTIONS[1:]:
        out = F.when(c("action") == a, c(f"{prefix}_{a}")).otherwise(out)
    return out


def realised(decisions: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """What the next h sessions brought under the chosen action, net of cost, and under cash."""
    cost = c("transaction_cost") / cfg.notional
    return decisions.withColumns(
        {
            "gross_return": six(by_action("ahead")), "net_return": six(by_action("ahead") - cost), "no_action_return": six(c("ahead_cash")),
            "realized_volatility": by_action("vol_ahead"), "drawdown_event": by_action("fall_ahead") <= -0.05,
            "underperform_event": c("ahead_equity") < c("ahead_cash"),
        }
    )


def walk_forward(table: DataFrame, cfg: RiskConfig = RiskConfig(), strategies: list[str] = STRATEGIES) -> DataFrame:
    """Decisions of all strategies at every fifth session with their realised outcome."""
    windows = window_returns(portfolio_returns(table), cfg)
    forecasts = rolling_forecast(windows, cfg)
    i = c("session_index")
    due = forecasts.filter((i >= cfg.history) & (c("n_ahead") >= cfg.horizon) & ((i - cfg.history) % 5 == 0))
    return realised(turnover(strategy_actions(due, cfg, strategies), cfg), cfg)


def drawdown_of_curve(df: DataFrame, keys: list[str], index: str, value: Column) -> DataFrame:
    """Largest relative fall of a curve with the places of its peak and trough; the earliest of equals."""
    rows = df.withColumn("_v", value)
    seq = Sequence(rows, keys, [index]).add(_peak=running_max(F.struct(c("_v").alias("v"), (-c(index)).alias("i")))).frame
    fall = c("_v") / c("_peak.v") - 1
    worst = F.min(F.struct(fall.alias("f"), c(index).alias("t"), (-c("_peak.i")).alias("p")))
    return seq.groupBy(*keys).agg(worst.alias("w")).select(
        *keys, F.least(c("w.f"), F.lit(0.0)).alias("maximum_drawdown"),
        F.when(c("w.f") < 0, c("w.p")).otherwise(0).alias("peak_index"), F.when(c("w.f") < 0, c("w.t")).otherwise(0).alias("trough_index"),
    )


def evaluate_walk_forward(rows: DataFrame) -> DataFrame:
    """One row per strategy: turnover, cost, returns, risk, drawdown, against cash, volatility error."""
    curve = Sequence(rows.select("strategy_id", "decision_index", "net_return"), ["strategy_id"], ["decision_index"]).add(
        _log=running_sum(F.log1p("net_return"))
    ).frame
    falls = drawdown_of_curve(curve, ["strategy_id"], "decision_index", F.exp("_log"))
    net, cash = c("net_return"), c("no_action_return")
    out = rows.groupBy("strategy_id").agg(
        F.count("*").alias("decisions"), F.round(F.sum("turnover"), 2).alias("total_turnover"), F.round(F.sum("transaction_cost"), 2).alias("total_cost"),
        six(F.exp(F.sum(F.log1p(net))) - 1).alias("cumulative_return"), six(F.avg(net) * 52).alias("annualized_return"),
        six(F.coalesce(F.stddev_samp(net), F.lit(0.0)) * F.sqrt(F.lit(252.0))).alias("annualized_volatility"),
        six(F.avg(net - cash)).alias("mean_over_cash"), six(F.avg((net > cash).cast("double"))).alias("beat_cash_rate"),
        six(F.avg(F.abs(c("volatility") - c("realized_volatility")))).alias("volatility_mae"),
    )
    ratio = F.when(c("annualized_volatility") != 0, six(c("annualized_return") / c("annualized_volatility"))).otherwise(0.0)
    return out.withColumn("risk_adjusted_return", ratio).join(falls.withColumn("maximum_drawdown", six(c("maximum_drawdown"))), "strategy_id")


def forecast_calibration(rows: DataFrame) -> DataFrame:
    """Calibration of the two event forecasts in five bins, per strategy."""
    pairs = F.array(
        F.struct(F.lit("drawdown").alias("target"), c("probability_5pct_drawdown").alias("p"), c("drawdown_event").alias("y")),
        F.struct(F.lit("underperform").alias("target"), c("probability_equities_underperform_cash").alias("p"), c("underperform_event").alias("y")),
    )
    long = rows.select("strategy_id", F.explode(pairs).alias("s")).select("strategy_id", "s.*")
    cells = long.groupBy("strategy_id", "target", bin_of(c("p"), 5).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p").alias("p"), F.avg(c("y").cast("double")).alias("y")
    )
    return cells.groupBy("strategy_id", "target").agg(six(F.sum(c("n") * F.abs(c("p") - c("y"))) / F.sum("n")).alias("ece"))


def regime_concentration(rows: DataFrame, day: str = "market_date") -> DataFrame:
    """Largest share of one year and of one volatility regime, per strategy."""
    vol = c("realized_volatility")
    regime = F.when(vol < 0.12, "low_volatility").when(vol < 0.24, "normal_volatility").otherwise("high_volatility")
    kinds = F.array(
        F.struct(F.lit("period").alias("kind"), F.date_format(day, "yyyy").alias("value")), F.struct(F.lit("regime").alias("kind"), regime.alias("value"))
    )
    counts = rows.select("strategy_id", F.explode(kinds).alias("k")).groupBy("strategy_id", "k.kind", "k.value").agg(F.count("*").alias("n"))
    return counts.groupBy("strategy_id", "kind").agg(
        six(F.max("n") / F.sum("n")).alias("largest_share"), F.min_by("value", F.struct(-c("n"), c("value"))).alias("largest")
    )


def sensitivity(rows: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """The primary strategy with its thresholds at 0.9, 1 and 1.1 times: how often actions change, what they return."""
    names = ["volatility_low", "volatility_cash", "drawdown_low", "drawdown_cash", "underperform_cash"]
    cases = []
    for m in (0.9, 1.0, 1.1):
        shifted = replace(cfg, **{n: getattr(cfg, n) * m for n in names})
        cases.append(F.struct(F.lit(m).alias("multiplier"), select_action(c("strategy_id"), shifted).alias("other")))
    long = rows.filter(c("strategy_id") == PRIMARY).withColumn("_s", F.explode(F.array(*cases)))
    long = long.withColumn("was", c("action")).withColumn("action", c("_s.other"))
    return long.groupBy(c("_s.multiplier").alias("multiplier")).agg(
        six(F.avg((c("action") != c("was")).cast("double"))).alias("action_change_rate"), six(F.avg(six(by_action("ahead")))).alias("mean_return")
    )


def paper_span(entries: DataFrame, required_days: int = 183) -> DataFrame:
    """Days between the first and the last paper decision and how many distinct days had one."""
    ok = (c("designation") == "paper") & (c("mode") == "paper_cycle") & (c("evidence_state") == "paper_decision")
    days = entries.filter(ok).select(F.to_date("decision_timestamp").alias("d")).distinct()
    return days.agg(F.coalesce(F.datediff(F.max("d"), F.min("d")), F.lit(0)).alias("span_days"), F.count("*").alias("decision_days")).withColumn(
        "long_enough", c("span_days") >= required_days
    )
