"""Bracket-event valuation: monthly order values by nation as the measured quantity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import brackets as H
from parley.plans.registry import Tables, ctes, query
from parley.session import stage

c = F.col

BASE = """
days AS (
  SELECT c_nationkey AS station, date_trunc('month', o_orderdate)::DATE AS local_date, round(avg(o_totalprice) / 5000, 3) AS high
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
hist AS (SELECT *, (year(local_date) * 12 + month(local_date))::BIGINT AS m, high + ((year(local_date) * 12 + month(local_date)) * 7 + station) % 11 - 5 AS mean FROM days),
ev AS (
  SELECT h.*, b, station || '-' || local_date || '-' || b AS event_id, [NULL, 35, 40, 45][b + 1]::DOUBLE AS lo, [35, 40, 45, NULL][b + 1]::DOUBLE AS hi,
         b <> 3 AS lo_incl, b = 2 AS hi_incl, (station + m + b) % 9 <> 0 AS has_ask, ((station * 13 + m * 7 + b * 5) % 60 + 5) / 100.0::DOUBLE AS price,
         (station + m + b) % 30 AS qty FROM hist h, range(4) r(b)),
"""

IN = "(lo IS NULL OR CASE WHEN lo_incl THEN {x} >= lo ELSE {x} > lo END) AND (hi IS NULL OR CASE WHEN hi_incl THEN {x} <= hi ELSE {x} < hi END)"


def inside(x: str) -> str:
    return IN.format(x=x)


def mass_sql(shift: str) -> str:
    points = [(-4, 0.1), (-2, 0.2), (0, 0.4), (2, 0.2), (4, 0.1)]
    return "round((" + " + ".join(f"CASE WHEN {inside(f'(mean + {d} + {shift})')} THEN {w}::DOUBLE ELSE 0 END" for d, w in points) + ") / 1.0, 6)"


PROB = f"""
clim AS (
  SELECT e.event_id, count(h.high) AS n, round(avg(({inside('h.high')})::INT), 6) AS climate, coalesce(round(avg(h.high - h.mean), 6), 0) + 0.0 AS bias
  FROM ev e LEFT JOIN hist h ON h.station = e.station AND h.local_date < e.local_date GROUP BY 1),
prob AS (SELECT e.*, n, climate, bias, CASE WHEN has_ask THEN round(price, 6) END AS market, {mass_sql('0')} AS official, {mass_sql('bias')} AS corrected
         FROM ev e JOIN clim USING (event_id)),
"""

DECIDE = """
d0 AS (SELECT *, greatest(0, least(5, floor(CASE WHEN has_ask THEN qty ELSE 0 END * 0.5)))::INT AS q, CASE WHEN has_ask THEN corrected - price ELSE 0 END AS edge FROM prob),
d1 AS (SELECT *, round(q * edge, 2) AS gross, round(q * 0.01::DOUBLE, 2) AS fees, round(q * 0.01::DOUBLE, 2) AS slip, round(q * 0.05::DOUBLE, 2) AS unc FROM d0),
d2 AS (SELECT *, round(gross - fees - slip - unc, 2) + 0.0 AS cons FROM d1),
dec AS (
  SELECT *, why = '' AS trade FROM (
    SELECT *, concat_ws(',', CASE WHEN cons <= 0 THEN 'conservative_net_value_not_positive' END, CASE WHEN has_ask AND edge < 0.03 THEN 'edge_below_minimum_probability' END,
      CASE WHEN has_ask AND edge - 0.05 <= 0 THEN 'edge_not_positive_after_uncertainty_buffer' END, CASE WHEN q <= 0 THEN 'insufficient_order_book_quantity_after_liquidity_limit' END,
      CASE WHEN NOT has_ask THEN 'no_executable_yes_ask' END) AS why FROM d2)),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station, local_date ORDER BY trade DESC, cons DESC, event_id) AS k FROM dec) WHERE k = 1),
res AS (
  SELECT *, CASE WHEN trade THEN round(CASE WHEN yes THEN q ELSE 0 END - q * price, 2) ELSE 0 END AS rgross, CASE WHEN trade THEN fees + slip ELSE 0 END AS rcost
  FROM (SELECT *, {inside} AS yes FROM pick WHERE (m + station) % 50 <> 0))
""".replace("{inside}", inside("high"))


def sql(tail: str, prob: bool = True, decide: bool = False) -> str:
    parts = BASE + (PROB if prob else "") + (DECIDE if decide else "")
    return "WITH " + parts.rstrip().rstrip(",") + tail


def measured(t: Tables) -> DataFrame:
    day = F.date_trunc("month", c("o_orderdate")).cast("date")
    high = t.orders.join(t.customer, c("c_custkey") == c("o_custkey")).groupBy(c("c_nationkey").alias("station"), day.alias("local_date")).agg(
        F.round(F.avg("o_totalprice") / 5000, 3).alias("high")
    )
    m = (F.year("local_date") * 12 + F.month("local_date")).cast("long")
    return high.withColumn("m", m).withColumn("forecast_mean", c("high") + F.pmod(c("m") * 7 + c("station"), F.lit(11)) - 5)


def events(days: DataFrame) -> DataFrame:
    """Four brackets per station and month, two ask levels unless the book is empty."""
    b, s, m = c("b"), c("station"), c("m")
    rows = days.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(3))))
    price = ((s * 13 + m * 7 + b * 5) % 60 + 5) / F.lit(100.0)
    quantity = ((s + m + b) % 30).cast("int")
    level = F.struct(price.alias("price"), quantity.alias("quantity"))
    worse = F.struct((price + 0.03).alias("price"), F.lit(10).alias("quantity"))
    points = F.array(*[F.struct((c("forecast_mean") + d).alias("value"), F.lit(w).alias("probability")) for d, w in ((-4, 0.1), (-2, 0.2), (0, 0.4), (2, 0.2), (4, 0.1))])
    return rows.select(
        F.concat_ws("-", s, "local_date", b).alias("event_id"), s.cast("string").alias("city"), s.alias("station"), "local_date", F.lit("monthly").alias("series"),
        F.when(b == 1, 35.0).when(b == 2, 40.0).when(b == 3, 45.0).alias("lo"), F.when(b == 0, 35.0).when(b == 1, 40.0).when(b == 2, 45.0).alias("hi"),
        (b != 3).alias("lo_incl"), (b == 2).alias("hi_incl"),
        F.when((s + m + b) % 9 != 0, F.array(worse, level)).otherwise(F.array().cast("array<struct<price:double,quantity:int>>")).alias("yes_asks"), points.alias("forecast"), m.alias("m"),
    )


def probabilities(t: Tables) -> DataFrame:
    days = stage(measured(t))
    return H.bracket_probabilities(events(days), days.select("station", "local_date", "high", "forecast_mean"))


def picks(t: Tables) -> DataFrame:
    return H.pick_per_group(H.bracket_decisions(probabilities(t)), ["station", "local_date"])


def settled(t: Tables) -> DataFrame:
    days = measured(t).select("station", "local_date", "high", "m")
    b = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("b")
    settlements = days.select("*", b).select(
        F.concat_ws("-", "station", "local_date", "b").alias("event_id"), c("high").alias("observed"),
        F.when((c("m") + c("station")) % 50 == 0, -1).otherwise(c("station")).alias("settled_station"), F.lit("monthly").alias("settled_series"),
    )
    return H.settle(picks(t), settlements)[0]


@query(
    "h01_best_levels",
    sql(" SELECT event_id, CASE WHEN has_ask THEN price END AS ask, CASE WHEN has_ask THEN qty::DOUBLE END AS ask_quantity, CASE WHEN has_ask THEN price + 0.03 END AS bid FROM ev", prob=False),
)
def h01(t: Tables) -> DataFrame:
    rows = events(measured(t)).withColumns({"a": H.best_ask(c("yes_asks")), "b": H.best_bid(c("yes_asks"))})
    return rows.select("event_id", c("a.price").alias("ask"), c("a.quantity").cast("double").alias("ask_quantity"), c("b.price").alias("bid"))


@query("h02_in_bracket", sql(f" SELECT event_id, {inside('high')} AS hit FROM ev", prob=False))
def h02(t: Tables) -> DataFrame:
    days = measured(t)
    rows = events(days).join(days.select("station", "local_date", "high"), ["station", "local_date"])
    return rows.select("event_id", H.in_bracket(c("high")).alias("hit"))


@query(
    "h03_bracket_probabilities",
    sql(" SELECT event_id, n AS history_days, climate AS station_climatology, bias AS station_bias, market AS market_implied, official AS official_forecast, corrected AS station_bias_corrected FROM prob"),
)
def h03(t: Tables) -> DataFrame:
    names = ["history_days", "station_climatology", "station_bias", "market_implied", "official_forecast", "station_bias_corrected"]
    return probabilities(t).select("event_id", *names)


@query(
    "h04_bracket_decisions",
    sql(" SELECT event_id, q AS quantity, round(edge, 6) + 0.0 AS edge, cons AS conservative, why AS no_trade_reasons, trade FROM dec", decide=True),
)
def h04(t: Tables) -> DataFrame:
    rows = H.bracket_decisions(probabilities(t))
    return rows.select("event_id", "quantity", F.round("edge", 6).alias("edge"), "conservative", F.array_join("no_trade_reasons", ",").alias("no_trade_reasons"), "trade")


@query("h05_pick_per_group", sql(" SELECT station, local_date, event_id, trade FROM pick", decide=True))
def h05(t: Tables) -> DataFrame:
    return picks(t).select("station", "local_date", "event_id", "trade")


@query(
    "h06_settle",
    sql(" SELECT event_id, yes AS outcome_yes, rgross::DOUBLE AS realized_gross, round(rgross - rcost, 2)::DOUBLE AS realized_net FROM res", decide=True),
)
def h06(t: Tables) -> DataFrame:
    return settled(t).select("event_id", "outcome_yes", "realized_gross", "realized_net")


@query(
    "h07_scorecard",
    sql(
        " "
        + " UNION ALL ".join(
            f"SELECT '{name}' AS source, count({col}) AS n, round(avg(({col} - yes::INT) * ({col} - yes::INT)), 6) AS brier FROM res"
            for name, col in (
                ("strategy", "corrected"), ("market_implied", "market"), ("station_climatology", "climate"), ("official_forecast", "official"), ("station_bias_corrected", "corrected"),
            )
        ),
        decide=True,
    ),
)
def h07(t: Tables) -> DataFrame:
    return H.bracket_scorecard(settled(t))


@query(
    "h08_cost_sensitivity",
    sql(
        " SELECT count(CASE WHEN trade THEN 1 END) AS trades, round(sum(rgross - rcost * 2), 2) AS pessimistic_net, count(CASE WHEN trade THEN 1 END) > 0 AND sum(rgross - rcost * 2) > 0 AS passes FROM res",
        decide=True,
    ),
)
def h08(t: Tables) -> DataFrame:
    return H.cost_sensitivity(settled(t))


def shares(rows: DataFrame) -> DataFrame:
    regime = F.when(c("observed") < 38, "low").otherwise("high")
    return H.concentration(rows, {"city": c("city"), "month": F.substring(c("local_date").cast("string"), 1, 7), "regime": regime})


SHARES = """
, cnt AS (
  SELECT 'city' AS dimension, station::VARCHAR AS value, count(*) AS n FROM res GROUP BY 2 UNION ALL
  SELECT 'month', substr(local_date::VARCHAR, 1, 7), count(*) FROM res GROUP BY 2 UNION ALL
  SELECT 'regime', CASE WHEN high < 38 THEN 'low' ELSE 'high' END, count(*) FROM res GROUP BY 2),
shr AS (
  SELECT dimension, sum(n)::BIGINT AS rows, round(max(n) / sum(n), 6) AS max_share, (list(value ORDER BY n DESC, value))[1] AS max_key,
         round(max(n) / sum(n), 6) <= CASE dimension WHEN 'city' THEN 0.5 WHEN 'month' THEN 0.4 ELSE 0.6 END AS passes FROM cnt GROUP BY 1)
"""


@query("h09_concentration", sql(SHARES + " SELECT * FROM shr", decide=True))
def h09(t: Tables) -> DataFrame:
    return shares(settled(t))


@query(
    "h10_evidence_gate",
    sql(
        SHARES
        + """
    SELECT *, enough_resolved AND beats_market AND survives_costs AND not_concentrated AND prospective_days >= 30 AND strategy_locked AS review_allowed FROM (
      SELECT count(*) AS resolved, count(*) >= 150 OR (SELECT count(*) FROM hist) < 150 AS enough_resolved,
             round(avg((corrected - yes::INT) * (corrected - yes::INT)), 6) <= round(avg((market - yes::INT) * (market - yes::INT)), 6) AS beats_market,
             sum(rgross - rcost * 2) > 0 AS survives_costs, (SELECT bool_and(passes) FROM shr) AS not_concentrated,
             count(DISTINCT local_date) FILTER (local_date >= DATE '1999-01-01') AS prospective_days, true AS strategy_locked FROM res)
    """,
        decide=True,
    ),
)
def h10(t: Tables) -> DataFrame:
    rows = stage(settled(t))
    days = measured(t).agg(F.count("*")).scalar()
    later = rows.filter(c("local_date") >= "1999-01-01").select("local_date", F.lit("v1").alias("strategy_version"))
    return H.evidence_gate(rows, days, H.bracket_scorecard(rows), H.cost_sensitivity(rows), shares(rows), later)
