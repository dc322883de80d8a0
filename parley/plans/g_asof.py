"""Point-in-time queries over revised observations."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators import asof as G
from parley.operators import walkforward as W
from parley.plans.registry import Tables, ctes, query

c = F.col

OBS = """
obs AS (
  SELECT l_partkey AS instrument, l_suppkey % 3 AS source, date_trunc('year', l_shipdate)::TIMESTAMP AS event_time, available_at, ingested_at, knowledge,
         l_orderkey * 10 + l_linenumber AS revision_id, value, greatest(available_at, knowledge) AS eff, greatest(available_at, knowledge, ingested_at) AS vis FROM (
    SELECT *, l_shipdate + to_days((l_orderkey % 5)::INT) AS available_at, l_shipdate + to_days((l_orderkey % 5 + l_suppkey % 3)::INT) AS ingested_at,
           CASE WHEN l_orderkey % 11 = 0 THEN l_shipdate + INTERVAL 30 DAY END AS knowledge, l_extendedprice / l_quantity AS value FROM lineitem)),
q AS (
  SELECT o_orderkey AS query_id, o_custkey AS instrument, date_trunc('year', o_orderdate)::TIMESTAMP AS event_time, o_orderdate + INTERVAL 60 DAY AS as_of,
         CASE WHEN o_orderkey % 4 = 0 THEN 1 END AS want FROM orders)
"""


def observations(t: Tables) -> DataFrame:
    """Unit prices as yearly figures, revised by every line item; some wait for a corporate action to be known."""
    k, s = c("l_orderkey"), c("l_suppkey")
    available = c("l_shipdate") + F.make_dt_interval(days=(k % 5).cast("int"))
    return t.lineitem.select(
        F.lit("trade").alias("kind"), c("l_partkey").alias("instrument"), (s % 3).alias("source"),
        F.date_trunc("year", c("l_shipdate")).cast("timestamp_ntz").alias("event_time"), available.alias("available_at"),
        (available + F.make_dt_interval(days=(s % 3).cast("int"))).alias("ingested_at"),
        F.when(k % 11 == 0, c("l_shipdate") + F.expr("INTERVAL 30 DAYS")).alias("corporate_action_knowledge_at"),
        (k * 10 + c("l_linenumber")).alias("revision_id"), (c("l_extendedprice") / c("l_quantity")).alias("value"),
        F.lit(None).cast("string").alias("revision_group_id"), F.lit(None).cast("string").alias("source_observation_id"), F.lit(None).cast("date").alias("session_date"),
    )


def questions(t: Tables) -> DataFrame:
    return t.orders.select(
        c("o_orderkey").alias("query_id"), F.lit("trade").alias("kind"), c("o_custkey").alias("instrument"), c("o_custkey").alias("calendar_id"),
        F.date_trunc("year", c("o_orderdate")).cast("timestamp_ntz").alias("event_time"), (c("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("as_of"),
        F.when(c("o_orderkey") % 4 == 0, 1).cast("long").alias("source"),
    )




def typed(t: Tables) -> DataFrame:
    """One observation per line item, kinds in turn, with faults planted by key."""
    k = c("l_orderkey") * 7 + c("l_linenumber")
    kinds = F.array(*[F.lit(x) for x in G.KINDS])
    none_d, none_s, none_t = (F.lit(None).cast(x) for x in ("double", "string", "timestamp_ntz"))
    price = c("l_extendedprice") / c("l_quantity")
    bad = {n: k % m == 0 for n, m in (("a", 29), ("b", 31), ("c", 37))}

    def of(kind: str, value: Column, other: Column) -> Column:
        return F.when(c("base") == kind, value).otherwise(other)

    level = F.struct(price.alias("price"), c("l_quantity").alias("size"))
    worse = F.struct((price * 0.9).alias("price"), c("l_quantity").alias("size"))
    terms = F.create_map(F.lit("ratio"), F.lit(2.0))
    empty_terms = F.create_map().cast("map<string,double>")
    fields = F.array(F.lit("close"))
    rows = t.lineitem.withColumn("k", k).withColumn("base", F.element_at(kinds, (F.pmod(c("k"), F.lit(len(G.KINDS))) + 1).cast("int")))
    bar = c("base").isin("daily_bar", "adjusted_total_return_bar")
    open_state = F.when(bad["a"], "closed").otherwise("open")
    return rows.select(
        "k",
        F.when(k % 53 == 0, "rumour").otherwise(c("base")).alias("kind"),
        c("l_partkey").cast("string").alias("instrument"), c("l_suppkey").cast("string").alias("source"),
        c("l_shipdate").alias("available_at"),
        F.when(k % 61 == 0, c("l_shipdate") - F.expr("INTERVAL 1 HOUR")).otherwise(c("l_shipdate")).alias("ingested_at"),
        F.lit("UTC").alias("timezone"), F.when(k % 59 == 0, " ").otherwise("USD").alias("currency"), F.lit("share").alias("unit"),
        F.when((c("base") == "adjusted_total_return_bar") & ~bad["c"], "total_return_adjusted").otherwise("unadjusted").alias("adjustment_basis"),
        c("k").cast("string").alias("revision_id"), F.lit("h").alias("source_artifact_hash"),
        of("quote", F.when(bad["a"], price * 1.2).otherwise(price), none_d).alias("bid_price"),
        of("quote", F.when(bad["b"], none_d).otherwise(price * 1.1), none_d).alias("ask_price"), none_d.alias("indicative_price"),
        F.lit(True).alias("bid_is_executable"), (c("base") == "quote").alias("ask_is_executable"),
        F.when(c("base") == "trade", F.when(bad["a"], 0.0).otherwise(price)).when(c("base") == "distribution", F.when(bad["a"], -1.0).otherwise(price))
        .when(c("base") == "settlement_event", F.when(bad["a"], none_d).otherwise(price)).when(c("base") == "adjusted_total_return_bar", F.when(bad["a"], 0.0).otherwise(1.0))
        .when(c("base") == "economic_release", F.when(bad["a"], float("nan")).otherwise(price)).alias("value"),
        of("trade", c("l_quantity"), of("daily_bar", F.when(bad["b"], -1.0).otherwise(5.0), none_d)).alias("quantity"),
        F.when(bar, price).alias("open_price"), F.when(bar, F.when(k % 41 == 0, price * 0.5).otherwise(price * 1.1)).alias("high_price"),
        F.when(bar, price * 0.9).alias("low_price"), F.when(bar, F.when(k % 43 == 0, 0.0).otherwise(price)).alias("close_price"),
        of("market_calendar", open_state, F.lit("open")).alias("market_status"),
        of("order_book_snapshot", F.when(bad["a"], F.array(worse, level)).when(bad["b"], F.array().cast("array<struct<price:double,size:double>>")).otherwise(F.array(level, worse)),
           F.lit(None).cast("array<struct<price:double,size:double>>")).alias("bids"),
        F.lit(None).cast("array<struct<price:double,size:double>>").alias("asks"),
        of("market_calendar", F.when(bad["b"], none_t).otherwise(c("l_shipdate")), none_t).alias("open_time"),
        of("market_calendar", c("l_shipdate"), none_t).alias("close_time"),
        F.when(bad["a"] & c("base").isin("corporate_action", "vintage_snapshot"), empty_terms).otherwise(terms).alias("terms"),
        F.to_date("l_shipdate").alias("period_start"),
        F.when(bad["b"], F.date_sub("l_shipdate", 1)).otherwise(F.to_date("l_shipdate")).alias("period_end"),
        F.lit("g").alias("revision_group_id"), F.when(bad["c"], "").otherwise("v1").alias("vintage_id"),
        F.when(bad["a"], F.array().cast("array<string>")).otherwise(fields).alias("changed_fields"),
        F.when(bad["a"], "").otherwise("1d").alias("tenor"),
    )


KIND_SQL = "['" + "', '".join(G.KINDS) + "']"


@query(
    "g01_validate_observations",
    f"""
    WITH r AS (SELECT *, l_orderkey * 7 + l_linenumber AS k FROM lineitem),
    b AS (SELECT k, CASE WHEN k % 53 = 0 THEN 'rumour' ELSE {KIND_SQL}[k % 13 + 1] END AS kind, k % 29 = 0 AS a, k % 31 = 0 AS b, k % 37 = 0 AS c FROM r)
    SELECT kind, reason, count(*) AS n FROM (
      SELECT kind, unnest(list_filter([
        CASE WHEN kind = 'rumour' THEN 'unknown_kind' END,
        CASE WHEN k % 59 = 0 THEN 'missing_metadata' END,
        CASE WHEN k % 61 = 0 THEN 'ingested_before_available' END,
        CASE WHEN kind = 'quote' AND a AND NOT b THEN 'quote_crossed' END,
        CASE WHEN kind = 'quote' AND b THEN 'executable_without_price' END,
        CASE WHEN kind = 'trade' AND a THEN 'trade_not_positive' END,
        CASE WHEN kind IN ('daily_bar', 'adjusted_total_return_bar') AND k % 43 = 0 THEN 'bar_price_not_positive' END,
        CASE WHEN kind IN ('daily_bar', 'adjusted_total_return_bar') AND k % 41 = 0 THEN 'bar_high_below_low' END,
        CASE WHEN kind = 'daily_bar' AND b THEN 'bar_negative_volume' END,
        CASE WHEN kind = 'adjusted_total_return_bar' AND c THEN 'bar_wrong_basis' END,
        CASE WHEN kind = 'adjusted_total_return_bar' AND a THEN 'bar_factor_not_positive' END,
        CASE WHEN kind = 'order_book_snapshot' AND b AND NOT a THEN 'book_empty' END,
        CASE WHEN kind = 'order_book_snapshot' AND a THEN 'book_not_sorted' END,
        CASE WHEN kind = 'market_calendar' AND a THEN 'calendar_closed_with_hours' END,
        CASE WHEN kind = 'market_calendar' AND NOT a AND b THEN 'calendar_open_without_hours' END,
        CASE WHEN kind = 'corporate_action' AND a THEN 'action_without_terms' END,
        CASE WHEN kind = 'distribution' AND a THEN 'distribution_negative' END,
        CASE WHEN kind = 'settlement_event' AND a THEN 'settlement_missing' END,
        CASE WHEN kind = 'economic_release' AND b THEN 'release_period_reversed' END,
        CASE WHEN kind IN ('economic_release', 'vintage_snapshot') AND c THEN 'release_without_vintage' END,
        CASE WHEN kind = 'revision_record' AND a THEN 'revision_without_fields' END,
        CASE WHEN kind = 'vintage_snapshot' AND a THEN 'vintage_empty' END,
        CASE WHEN kind = 'cash_risk_free_benchmark' AND a THEN 'benchmark_without_tenor' END,
        CASE WHEN (kind = 'economic_release' OR (kind = 'rumour' AND k % 13 = 9)) AND a THEN 'value_not_finite' END], lambda x: x IS NOT NULL)) AS reason
      FROM b) GROUP BY 1, 2
    """,
)
def g01(t: Tables) -> DataFrame:
    bad = G.validate_observations(typed(t))[1]
    return bad.select("kind", F.explode("reasons").alias("reason")).groupBy("kind", "reason").agg(F.count("*").alias("n"))


@query("g02_effective_available_at", ctes(OBS) + "SELECT instrument, source, min(eff) AS first_seen, max(eff) AS last_seen FROM obs GROUP BY 1, 2")
def g02(t: Tables) -> DataFrame:
    rows = observations(t).withColumn("e", G.effective_available_at())
    return rows.groupBy("instrument", "source").agg(F.min("e").alias("first_seen"), F.max("e").alias("last_seen"))


@query(
    "g03_asof",
    ctes(OBS)
    + """
    SELECT query_id, source, revision_id, value FROM (
      SELECT query_id, o.source, o.revision_id, o.value, row_number() OVER (PARTITION BY query_id, o.source ORDER BY eff DESC, ingested_at DESC, revision_id DESC, value DESC) AS k
      FROM q JOIN obs o ON o.instrument = q.instrument AND o.event_time = q.event_time AND vis <= as_of AND (want IS NULL OR want = o.source)) WHERE k = 1
    """,
)
def g03(t: Tables) -> DataFrame:
    return G.asof(questions(t), observations(t)).select("query_id", "source", "revision_id", "value")


@query(
    "g03_asof_latest",
    ctes(OBS)
    + """
    SELECT q.query_id, o.event_time, o.revision_id::DOUBLE AS revision_id, o.value FROM q LEFT JOIN (
      SELECT query_id, o.*, row_number() OVER (PARTITION BY query_id ORDER BY o.event_time DESC, eff DESC, ingested_at DESC, revision_id DESC, value DESC) AS k
      FROM q JOIN obs o ON o.instrument = q.instrument AND vis <= as_of) o ON o.query_id = q.query_id AND o.k = 1
    """,
)
def g03_latest(t: Tables) -> DataFrame:
    rows = G.asof_latest(questions(t), observations(t), ["instrument"])
    return rows.select("query_id", "event_time", c("revision_id").cast("double").alias("revision_id"), "value")


@query(
    "g04_latest_revision",
    ctes(OBS)
    + """
    SELECT instrument, source, event_time::VARCHAR AS bucket, revision_id, value, vintages FROM (
      SELECT *, row_number() OVER (PARTITION BY instrument, source, event_time ORDER BY eff DESC, ingested_at DESC, revision_id DESC, value DESC) AS k,
             count(*) OVER (PARTITION BY instrument, source, event_time) AS vintages FROM obs) WHERE k = 1
    """,
)
def g04(t: Tables) -> DataFrame:
    rows = G.latest_revision(observations(t))
    return rows.select("instrument", "source", "bucket", "revision_id", "value", "vintages")


@query(
    "g04_all_vintages",
    ctes(OBS)
    + """
    SELECT query_id, count(*) AS vintages, min(value) AS lowest, max(value) AS highest FROM q JOIN obs o
    ON o.instrument = q.instrument AND o.event_time = q.event_time AND vis <= as_of AND (want IS NULL OR want = o.source) GROUP BY 1
    """,
)
def g04_all(t: Tables) -> DataFrame:
    return G.vintages_at(questions(t), observations(t))


CALENDAR = """
cal AS (
  SELECT o_custkey AS calendar_id, date_trunc('year', o_orderdate)::DATE AS session_date, CASE WHEN o_orderstatus = 'O' THEN 'closed' ELSE 'open' END AS status,
         o_orderdate AS available_at, o_orderdate + INTERVAL 1 DAY AS ingested_at, o_orderkey AS revision_id FROM orders)
"""


def calendar(t: Tables) -> DataFrame:
    return t.orders.select(
        c("o_custkey").alias("calendar_id"), F.date_trunc("year", c("o_orderdate")).cast("date").alias("session_date"),
        F.when(c("o_orderstatus") == "O", "closed").otherwise("open").alias("status"), c("o_orderdate").alias("available_at"),
        F.lit(None).cast("timestamp_ntz").alias("corporate_action_knowledge_at"), (c("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("ingested_at"),
        c("o_orderkey").alias("revision_id"),
    )


@query(
    "g05_missing_reason",
    ctes(OBS, CALENDAR)
    + """
    , hit AS (SELECT query_id, count(DISTINCT o.source) AS found FROM q JOIN obs o ON o.instrument = q.instrument AND o.event_time = q.event_time AND vis <= as_of
              AND (want IS NULL OR want = o.source) GROUP BY 1),
    st AS (SELECT query_id, status FROM (
      SELECT query_id, status, row_number() OVER (PARTITION BY query_id ORDER BY available_at DESC, ingested_at DESC, revision_id DESC) AS k
      FROM q JOIN cal ON calendar_id = instrument AND session_date = event_time::DATE AND ingested_at <= as_of) WHERE k = 1)
    SELECT query_id, coalesce(found, 0) AS found, CASE WHEN found IS NOT NULL THEN NULL WHEN status = 'closed' THEN 'market_closed_no_forward_fill'
           ELSE 'no_observation_at_event_time_no_forward_fill' END AS missing_reason FROM q LEFT JOIN hit USING (query_id) LEFT JOIN st USING (query_id)
    """,
)
def g05(t: Tables) -> DataFrame:
    return G.asof_with_reason(questions(t), observations(t), calendar(t))


@query(
    "g06_revision_intervals",
    ctes(OBS)
    + """
    , best AS (SELECT instrument, event_time, vis, max((eff, ingested_at, revision_id, value)) OVER (PARTITION BY instrument, event_time ORDER BY vis) AS w FROM obs),
    step AS (SELECT DISTINCT instrument, event_time, vis, w FROM best),
    turn AS (SELECT *, lag(w) OVER (PARTITION BY instrument, event_time ORDER BY vis) AS old FROM step),
    chg AS (SELECT * FROM turn WHERE old IS NULL OR old <> w)
    SELECT instrument, event_time, vis AS visible_from, lead(vis) OVER (PARTITION BY instrument, event_time ORDER BY vis) AS visible_to, w[3] AS revision_id FROM chg
    """,
)
def g06_intervals(t: Tables) -> DataFrame:
    return G.revision_intervals(observations(t), ["instrument", "event_time"]).select("instrument", "event_time", "visible_from", "visible_to", "revision_id")


PRICE = """
price AS (
  SELECT 'a' || (l_suppkey % 7) AS asset_id, l_shipdate::DATE AS market_date, l_extendedprice / l_quantity AS v, l_shipdate + to_days((l_orderkey % 4)::INT) AS availability_time,
         l_orderkey * 10 + l_linenumber AS revision_id FROM lineitem),
hist AS (
  SELECT asset_id, market_date, v AS adjusted_close FROM (
    SELECT *, row_number() OVER (PARTITION BY asset_id, market_date ORDER BY availability_time DESC, revision_id DESC, v DESC) AS k FROM price
    WHERE availability_time <= TIMESTAMP '2000-01-01') WHERE k = 1)
"""


def prices(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.concat(F.lit("a"), c("l_suppkey") % 7).alias("asset_id"), F.to_date("l_shipdate").alias("market_date"), (c("l_extendedprice") / c("l_quantity")).alias("adjusted_close"),
        (c("l_shipdate") + F.make_dt_interval(days=(c("l_orderkey") % 4).cast("int"))).alias("availability_time"),
        F.struct((c("l_orderkey") * 10 + c("l_linenumber")).alias("r"), (c("l_extendedprice") / c("l_quantity")).alias("v")).alias("revision_id"),
    )


def cutoff() -> Column:
    return F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")


@query("g06_price_history", ctes(PRICE) + "SELECT asset_id, market_date, adjusted_close FROM hist")
def g06(t: Tables) -> DataFrame:
    return G.price_history(prices(t), cutoff())


ASSETS = [f"a{i}" for i in range(7)]


@query(
    "g07_complete_dates",
    ctes(PRICE)
    + "SELECT market_date, {} FROM hist GROUP BY 1 HAVING count(DISTINCT asset_id) = 7".format(
        ", ".join(f"max(adjusted_close) FILTER (asset_id = '{a}') AS {a}" for a in ASSETS)
    ),
)
def g07(t: Tables) -> DataFrame:
    return G.complete_dates(G.price_history(prices(t), cutoff()), ASSETS)


@query(
    "g08_value_kinds",
    """
    SELECT concat_ws(',', CASE WHEN l_linenumber > 3 THEN 'indicative' END, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'executable_bid' END,
                     CASE WHEN l_returnflag = 'R' THEN 'executable_ask' END) AS kinds, count(*) AS n FROM lineitem GROUP BY 1
    """,
)
def g08(t: Tables) -> DataFrame:
    flag = c("l_returnflag")
    rows = t.lineitem.select(
        F.when(c("l_linenumber") > 3, c("l_extendedprice")).alias("indicative_price"), F.when(flag == "A", c("l_extendedprice")).alias("bid_price"),
        F.when(flag == "R", c("l_extendedprice")).alias("ask_price"), (c("l_linestatus") == "O").alias("bid_is_executable"), F.lit(True).alias("ask_is_executable"),
    )
    return rows.groupBy(F.array_join(G.value_kinds(), ",").alias("kinds")).agg(F.count("*").alias("n"))


@query(
    "g09_decision_sessions",
    """
    WITH d AS (SELECT DISTINCT l_shipdate::DATE AS session_date FROM lineitem),
    i AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS i, count(*) OVER () AS n FROM d)
    SELECT session_date, i AS session_index FROM i WHERE i >= 60 AND i + 20 < n AND (i - 60) % 5 = 0
    """,
)
def g09(t: Tables) -> DataFrame:
    days = t.lineitem.select(F.to_date("l_shipdate").alias("session_date")).distinct()
    return W.decision_sessions(days, "session_date", history=60, horizon=20, every=5)


@query(
    "g10_forecast_guard",
    """
    SELECT CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 7 = 0 THEN 'late' ELSE 'usable' END AS state, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2
    """,
)
def g10(t: Tables) -> DataFrame:
    k, at = c("o_orderkey"), c("o_orderdate")
    later = at + F.expr("INTERVAL 1 HOUR")
    decisions = t.orders.select(k.alias("decision_id"), k.alias("event_id"), at.alias("decision_time"))
    snapshots = t.orders.select(
        k.alias("event_id"), F.when(k % 9 == 0, later).otherwise(at).alias("issue_time"), F.when(k % 7 == 0, later).otherwise(at).alias("as_of"), "o_orderstatus"
    )
    good, late = G.asof_forecast(decisions, snapshots)
    both = good.select(F.lit("usable").alias("state"), "o_orderstatus").unionByName(late.select(F.lit("late").alias("state"), "o_orderstatus"))
    return both.groupBy("state", "o_orderstatus").agg(F.count("*").alias("n"))
