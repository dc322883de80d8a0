"""Valuation of events that pay if a value falls into a bracket.

An event has event_id, city, station, local_date and a bracket (lo, hi, lo_incl, hi_incl; NULL ends are open).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.scalars import reasons
from parley.operators.dominance import below
from parley.operators.sequence import Sequence, running_sum

c = F.col

BRACKET = ["lo", "hi", "lo_incl", "hi_incl"]
SOURCES = ["strategy", "market_implied", "station_climatology", "official_forecast", "station_bias_corrected"]


@dataclass(frozen=True)
class CostPolicy:
    fee: float = 0.01
    slippage: float = 0.01
    liquidity_fraction: float = 0.5
    max_contracts: int = 5
    min_edge: float = 0.03
    buffer: float = 0.05
    pessimistic_multiplier: float = 2.0


def best_ask(levels: Column) -> Column:
    """Lowest price; of equal prices the largest size."""
    least = F.array_min(F.transform(levels, lambda x: F.struct(x["price"].alias("price"), (-x["quantity"]).alias("q"))))
    return F.when(least.isNotNull(), F.struct(least["price"].alias("price"), (-least["q"]).alias("quantity")))


def best_bid(levels: Column) -> Column:
    """Highest price; of equal prices the largest size."""
    return F.array_max(F.transform(levels, lambda x: F.struct(x["price"].alias("price"), x["quantity"].alias("quantity"))))


def in_bracket(value: Column, lo: Column | None = None, hi: Column | None = None, lo_incl: Column | None = None, hi_incl: Column | None = None) -> Column:
    lo, hi = (c("lo") if lo is None else lo), (c("hi") if hi is None else hi)
    lo_incl, hi_incl = (c("lo_incl") if lo_incl is None else lo_incl), (c("hi_incl") if hi_incl is None else hi_incl)
    above = lo.isNull() | F.when(lo_incl, value >= lo).otherwise(value > lo)
    below = hi.isNull() | F.when(hi_incl, value <= hi).otherwise(value < hi)
    return above & below


def climatology(events: DataFrame, history: DataFrame) -> DataFrame:
    """Events with the share of earlier days at their station that fell into their bracket, and the station's forecast bias.

    history: station, local_date, high, forecast_mean. What lies below either end of a bracket is counted by date and value
    at once, so days meet neither events nor brackets; bias and number of days come from running sums in date order. Events
    read all of these at their own date, strictly before it.
    """
    day = F.coalesce(F.unix_date("local_date"), F.lit(-(2**31))).alias("_day")
    both = history.select("station", "local_date", F.lit(1).alias("_k"), F.lit("").alias("_row"), (c("high") - c("forecast_mean")).alias("_delta")).unionByName(
        events.select("station", "local_date", F.lit(0).alias("_k"), c("event_id").cast("string").alias("_row"), F.lit(None).cast("double").alias("_delta"))
    )
    seq = Sequence(both, ["station"], ["local_date", "_k", "_row"]).add(
        _n=running_sum(c("_k")), _d=running_sum(F.coalesce("_delta", F.lit(0.0))), _m=running_sum(F.when(c("_delta").isNotNull(), 1).otherwise(0))
    ).frame
    days = seq.filter(c("_k") == 0).select(c("_row").alias("event_id"), "_n", "_d", "_m")

    # an open upper end has everything below it, an open lower end nothing
    upper = F.struct(F.lit("u").alias("side"), F.coalesce("hi", F.lit(float("nan"))).cast("double").alias("v"), F.coalesce(c("hi").isNull() | c("hi_incl"), F.lit(False)).alias("incl"))
    lower = F.struct(F.lit("l").alias("side"), c("lo").cast("double").alias("v"), (~F.coalesce("lo_incl", F.lit(False))).alias("incl"))
    ends = events.select("station", day, "event_id", F.explode(F.array(upper, lower)).alias("e")).filter("e.v IS NOT NULL")
    ends = ends.select("station", "_day", F.concat("e.side", c("event_id").cast("string")).alias("_end"), c("e.v").alias("_v"), c("e.incl").alias("_incl"))
    points = history.select("station", day, c("high").cast("double").alias("_v"))
    counts = below(points, ends, ["station"], "_day", "_v", "_end", "_incl")
    sides = counts.groupBy(F.expr("substr(_end, 2)").alias("event_id")).agg(
        F.sum(F.when(c("_end").startswith("u"), c("n")).otherwise(-c("n"))).alias("_hits")
    )
    hits = F.when(c("lo").isNull() & c("hi").isNull(), c("_n")).otherwise(F.greatest(F.coalesce("_hits", F.lit(0)), F.lit(0)))
    out = events.join(days, "event_id").join(sides, "event_id", "left").withColumns(
        {
            "history_days": c("_n"), "station_climatology": F.when(c("_n") > 0, F.round(hits / c("_n"), 6)),
            "station_bias": F.when(c("_m") > 0, F.round(c("_d") / c("_m"), 6)).otherwise(0.0),
        }
    )
    return out.drop("_n", "_d", "_m", "_hits")


def forecast_mass(distribution: Column, shift: Column | None = None) -> Column:
    """Share of a forecast's mass inside the bracket, values shifted if asked."""
    moved = F.lit(0.0) if shift is None else shift
    mass = F.aggregate(distribution, F.lit(0.0), lambda acc, x: acc + x["probability"])
    inside = F.aggregate(distribution, F.lit(0.0), lambda acc, x: acc + F.when(in_bracket(x["value"] + moved), x["probability"]).otherwise(0.0))
    return F.when(mass > 0, F.round(inside / mass, 6))


def bracket_probabilities(events: DataFrame, history: DataFrame) -> DataFrame:
    """All probability sources of every event; events carry yes_asks (array) and forecast (array of value and probability)."""
    rows = climatology(events, history)
    return rows.withColumns(
        {
            "best_ask": best_ask(c("yes_asks")),
            "official_forecast": forecast_mass(c("forecast")),
            "station_bias_corrected": forecast_mass(c("forecast"), c("station_bias")),
        }
    ).withColumn("market_implied", F.round("best_ask.price", 6))


def bracket_decisions(rows: DataFrame, policy: CostPolicy = CostPolicy()) -> DataFrame:
    """Buy or pass, with sizes, costs and every reason to pass."""
    price = c("best_ask.price")
    quantity = F.least(F.lit(policy.max_contracts), F.floor(F.coalesce(c("best_ask.quantity"), F.lit(0)) * F.lit(policy.liquidity_fraction)).cast("int"))
    edge = F.when(price.isNotNull(), c("station_bias_corrected") - price).otherwise(0.0)
    rows = rows.withColumns({"quantity": F.greatest(F.lit(0), quantity), "edge": edge})
    q = c("quantity")
    cents = {
        "expected_gross": q * c("edge"), "fees": q * F.lit(policy.fee), "slippage": q * F.lit(policy.slippage), "uncertainty": q * F.lit(policy.buffer),
    }
    rows = rows.withColumns({k: F.round(v, 2) for k, v in cents.items()})
    rows = rows.withColumn("conservative", F.round(c("expected_gross") - c("fees") - c("slippage") - c("uncertainty"), 2))
    has = price.isNotNull()
    why = reasons(
        conservative_net_value_not_positive=c("conservative") <= 0,
        edge_below_minimum_probability=has & (c("edge") < policy.min_edge),
        edge_not_positive_after_uncertainty_buffer=has & (c("edge") - policy.buffer <= 0),
        insufficient_order_book_quantity_after_liquidity_limit=q <= 0,
        no_executable_yes_ask=~has,
    )
    rows = rows.withColumn("no_trade_reasons", why).withColumn("trade", F.size("no_trade_reasons") == 0)
    return rows.withColumn("capital_required", F.when(c("trade"), F.round(price * q + c("fees") + c("slippage"), 2)).otherwise(0.0))


def pick_per_group(decisions: DataFrame, group: list[str]) -> DataFrame:
    """One decision per group: trades first, then the highest conservative value, then the smallest id."""
    columns = [x for x in decisions.columns if x not in group]
    # a struct minimum is a plain aggregate: the group is never gathered
    order = F.struct((~c("trade")).alias("_t"), (-c("conservative")).alias("_v"), c("event_id").alias("_e"))
    best = decisions.groupBy(*group).agg(F.min_by(F.struct(*columns), order).alias("_b"))
    return best.select(*group, "_b.*")


def settle(decisions: DataFrame, settlements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Realised values of settled decisions, and the decisions whose settlement names another station or series.

    settlements: event_id, observed, settled_station, settled_series.
    """
    rows = decisions.join(settlements, "event_id")
    wrong = (c("settled_station") != c("station")) | (c("settled_series") != c("series"))
    good = rows.filter(~wrong).withColumn("outcome_yes", in_bracket(c("observed")))
    gross = F.when(c("trade"), F.round(F.when(c("outcome_yes"), c("quantity")).otherwise(0) - c("quantity") * c("best_ask.price"), 2)).otherwise(0.0)
    good = good.withColumns({"realized_gross": gross, "realized_costs": F.when(c("trade"), c("fees") + c("slippage")).otherwise(0.0)})
    return good.withColumn("realized_net", F.round(c("realized_gross") - c("realized_costs"), 2)), rows.filter(wrong)


def bracket_scorecard(resolved: DataFrame) -> DataFrame:
    """Brier score of every probability source that gave one."""
    y = c("outcome_yes").cast("double")
    known = {"strategy": c("station_bias_corrected"), **{s: c(s) for s in SOURCES[1:]}}
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), known[s].alias("p")) for s in SOURCES]))
    long = resolved.select(y.alias("y"), cells.alias("s")).select("y", "s.source", "s.p")
    return long.groupBy("source").agg(F.count("p").alias("n"), F.round(F.avg((c("p") - c("y")) ** 2), 6).alias("brier"))


def cost_sensitivity(resolved: DataFrame, policy: CostPolicy = CostPolicy()) -> DataFrame:
    """Total net value if fees and slippage were several times higher."""
    return resolved.agg(
        F.count_if("trade").alias("trades"),
        F.round(F.sum(c("realized_gross") - c("realized_costs") * policy.pessimistic_multiplier), 2).alias("pessimistic_net"),
    ).withColumn("passes", (c("trades") > 0) & (c("pessimistic_net") > 0))


# Largest share that one value of a dimension may have.
SHARES = {"city": 0.5, "month": 0.4, "regime": 0.6}


def concentration(df: DataFrame, dimensions: dict[str, Column], limits: dict[str, float] = SHARES, strict_from: int = 30) -> DataFrame:
    """Largest share by dimension from one scan, and whether it stays within its limit once there are enough rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), x.cast("string").alias("value")) for n, x in dimensions.items()]))
    counts = df.select(cells.alias("s")).groupBy("s.dimension", "s.value").agg(F.count("*").alias("n"))
    out = counts.groupBy("dimension").agg(
        F.sum("n").alias("rows"), F.round(F.max("n") / F.sum("n"), 6).alias("max_share"), F.min_by("value", F.struct(-c("n"), c("value"))).alias("max_key")
    )
    allowed = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    return out.withColumn("passes", (c("rows") < strict_from) | (c("max_share") <= F.coalesce(F.try_element_at(allowed, c("dimension")), F.lit(1.0))))


def evidence_gate(resolved: DataFrame, available: Column, scorecard: DataFrame, sensitivity: DataFrame, shares: DataFrame, prospective: DataFrame) -> DataFrame:
    """One row with each condition of a later review; prospective: local_date, strategy_version."""
    score = scorecard.groupBy().agg(
        F.max(F.when(c("source") == "strategy", c("brier"))).alias("s"), F.max(F.when(c("source") == "market_implied", c("brier"))).alias("m")
    )
    days = prospective.select("local_date").distinct().agg(F.count("*")).scalar()
    versions = prospective.select("strategy_version").distinct().agg(F.count("*")).scalar()
    beats = score.select(F.coalesce(c("s") <= c("m"), F.lit(False))).scalar()
    out = resolved.agg(F.count("*").alias("resolved")).withColumns(
        {
            "enough_resolved": (available < 150) | (c("resolved") >= 150),
            "beats_market": beats,
            "survives_costs": sensitivity.select("passes").scalar(),
            "not_concentrated": shares.agg(F.bool_and("passes")).scalar(),
            "prospective_days": days,
            "strategy_locked": versions <= 1,
        }
    )
    every = c("enough_resolved") & c("beats_market") & c("survives_costs") & c("not_concentrated") & (c("prospective_days") >= 30) & c("strategy_locked")
    return out.withColumn("review_allowed", every)
