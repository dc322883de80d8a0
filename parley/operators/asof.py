"""Point-in-time answers over revised observations.

An observation is visible at T when both its availability and its ingestion are at or before T. Among the
visible ones of a group the winner has the largest (availability, ingestion, revision). So with rows ordered
by the later of the two clocks, the winner at T is a running maximum: queries are merged into that order
instead of being joined with the observations, and no group is ever paired.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.scalars import clean, reasons
from parley.operators.sequence import Sequence, lead, running_max, running_min, running_sum

c = F.col

# Kinds, market states, adjustment bases.
KINDS = (
    "quote trade daily_bar adjusted_total_return_bar order_book_snapshot market_calendar corporate_action distribution "
    "settlement_event economic_release revision_record vintage_snapshot cash_risk_free_benchmark"
).split()


def effective_available_at() -> Column:
    """Availability, but not before the corporate action behind an adjusted value was known."""
    return F.greatest("available_at", "corporate_action_knowledge_at")


def visible_from(require_ingested: bool = True) -> Column:
    return F.greatest(effective_available_at(), c("ingested_at")) if require_ingested else effective_available_at()


GROUP = ["kind", "instrument", "source", "bucket", "revision_group"]


def with_group(df: DataFrame) -> DataFrame:
    """Revision group of every observation: declared group, else the source's own id, else the event time."""
    stamp = c("event_time").cast("string")
    declared = c("revision_group_id")
    group = F.coalesce(declared, "source_observation_id", stamp)
    day = c("session_date").cast("string")
    bucket = F.coalesce(day, declared, stamp)
    return df.withColumns({"bucket": bucket, "revision_group": F.when(day.isNotNull(), F.concat_ws(":", group, day)).otherwise(group)})


def _winner() -> Column:
    return F.struct(effective_available_at().alias("a"), c("ingested_at").alias("i"), c("revision_id").alias("r"), c("value").alias("v"))


def latest_revision(df: DataFrame, as_of: Column | None = None, require_ingested: bool = True) -> DataFrame:
    """Winner of every revision group, of all rows or of those visible at one time."""
    rows = with_group(df)
    if as_of is not None:
        rows = rows.filter(visible_from(require_ingested) <= as_of)
    return rows.groupBy(*GROUP).agg(F.max(_winner()).alias("w"), F.count("*").alias("vintages")).select(
        *GROUP, c("w.r").alias("revision_id"), c("w.v").alias("value"), "vintages"
    )


def revision_intervals(df: DataFrame, keys: list[str], require_ingested: bool = True) -> DataFrame:
    """When each revision was the one to be seen: [visible_from, visible_to). One row per change of winner.

    The history at any cut-off is a plain filter on these rows.
    """
    rows = df.withColumns({"visible_from": visible_from(require_ingested), "_w": _winner()})
    seq = Sequence(rows, keys, ["visible_from", "_w"]).add(_best=running_max(c("_w"))).frame
    # a row takes over when it is the new maximum; of rows that appear together the last one counts
    changes = seq.filter(c("_best") == c("_w")).groupBy(*keys, "visible_from").agg(F.max("_w").alias("_w"))
    out = Sequence(changes, keys, ["visible_from"]).add(visible_to=lead(c("visible_from"))).frame
    return out.select(*keys, "visible_from", "visible_to", c("_w.r").alias("revision_id"), c("_w.v").alias("value"))


def _merge(queries: DataFrame, observations: DataFrame, keys: list[str], winner: Column, require_ingested: bool) -> DataFrame:
    """Running winner at every query: queries sort after the observations of the same instant."""
    seen = observations.select(*keys, visible_from(require_ingested).alias("_at"), F.lit(0).alias("_q"), winner.alias("_w"), F.lit(None).cast("long").alias("query_id"))
    asked = queries.select(*keys, c("as_of").alias("_at"), F.lit(1).alias("_q"), F.lit(None).cast(seen.schema["_w"].dataType).alias("_w"), "query_id")
    both = seen.unionByName(asked)
    seq = Sequence(both, keys, ["_at", "_q", "query_id", "_w"]).add(_best=running_max(c("_w"))).frame
    return seq.filter(c("_q") == 1).select("query_id", *keys, c("_best"))


def asof(queries: DataFrame, observations: DataFrame, require_ingested: bool = True) -> DataFrame:
    """Winners at each query's time for its exact event time, one row per visible revision group.

    queries: query_id, kind, instrument, event_time, as_of, source (nullable). A query is repeated once per
    revision group of its event, never per observation.
    """
    rows = with_group(observations)
    groups = rows.select(*GROUP, "event_time").distinct()
    q = queries.withColumnRenamed("source", "_source").join(groups, ["kind", "instrument", "event_time"])
    q = q.filter(c("_source").isNull() | (c("_source") == c("source")))
    # the event time itself is part of the key: a group may hold several event times
    keys = [*GROUP, "event_time"]
    found = _merge(q.select("query_id", "as_of", *keys), rows, keys, _winner(), require_ingested)
    return found.filter(c("_best").isNotNull()).select("query_id", *GROUP, c("_best.r").alias("revision_id"), c("_best.v").alias("value"))


def vintages_at(queries: DataFrame, observations: DataFrame, require_ingested: bool = True) -> DataFrame:
    """How many vintages of its event each query sees, with their lowest and highest value; queries as for ``asof``.

    Running counts in the order of visibility: all vintages are counted without listing them per query.
    """
    rows = observations.withColumn("_at", visible_from(require_ingested))
    keys = ["kind", "instrument", "event_time", "source"]
    sources = rows.select(*keys).distinct()
    q = queries.withColumnRenamed("source", "_source").join(sources, keys[:3]).filter(c("_source").isNull() | (c("_source") == c("source")))
    seen = rows.select(*keys, "_at", F.lit(0).alias("_q"), "value", F.lit(None).cast("long").alias("query_id"), "revision_id")
    asked = q.select(
        *keys, c("as_of").alias("_at"), F.lit(1).alias("_q"), F.lit(None).cast("double").alias("value"), "query_id",
        F.lit(None).cast(seen.schema["revision_id"].dataType).alias("revision_id"),
    )
    seq = Sequence(seen.unionByName(asked), keys, ["_at", "_q", "query_id", "revision_id", "value"]).add(
        _n=running_sum(1 - c("_q")), _lo=running_min(c("value")), _hi=running_max(c("value"))
    ).frame
    out = seq.filter((c("_q") == 1) & (c("_n") > 0)).groupBy("query_id")
    return out.agg(F.sum("_n").alias("vintages"), F.min("_lo").alias("lowest"), F.max("_hi").alias("highest"))


def asof_latest(queries: DataFrame, observations: DataFrame, by: list[str], require_ingested: bool = True) -> DataFrame:
    """The newest event visible at each query's time: an as-of join over many queries in one pass."""
    winner = F.struct(
        c("event_time").alias("e"), effective_available_at().alias("a"), c("ingested_at").alias("i"), c("revision_id").alias("r"), c("value").alias("v")
    )
    found = _merge(queries.select("query_id", "as_of", *by), observations, by, winner, require_ingested)
    return found.select("query_id", *by, c("_best.e").alias("event_time"), c("_best.r").alias("revision_id"), c("_best.v").alias("value"))


def asof_with_reason(queries: DataFrame, observations: DataFrame, calendar: DataFrame, require_ingested: bool = True) -> DataFrame:
    """How many groups each query sees, and why it sees none. A gap is never filled from an earlier event.

    calendar: calendar_id, session_date, status, available_at, corporate_action_knowledge_at, ingested_at, revision_id.
    queries carry calendar_id as well.
    """
    found = asof(queries, observations, require_ingested).groupBy("query_id").agg(F.count("*").alias("found"))
    dated = queries.withColumn("session_date", c("event_time").cast("date"))
    state = F.struct(effective_available_at().alias("a"), c("ingested_at").alias("i"), c("revision_id").alias("r"), c("status").alias("s"))
    days = _merge(dated.select("query_id", "as_of", "calendar_id", "session_date"), calendar, ["calendar_id", "session_date"], state, require_ingested)
    status = days.select("query_id", c("_best.s").alias("_status"))
    out = queries.join(found, "query_id", "left").join(status, "query_id", "left")
    reason = (
        F.when(c("found").isNotNull(), F.lit(None).cast("string"))
        .when(c("event_time").isNull(), "no_observation_available_as_of")
        .when(c("_status") != "open", F.concat(F.lit("market_"), c("_status"), F.lit("_no_forward_fill")))
        .otherwise("no_observation_at_event_time_no_forward_fill")
    )
    return out.select("query_id", F.coalesce("found", F.lit(0)).alias("found"), reason.alias("missing_reason"))


def value_kinds() -> Column:
    """What a quote can be used as."""
    return F.array_compact(
        F.array(
            F.when(c("indicative_price").isNotNull(), "indicative"),
            F.when(c("bid_price").isNotNull() & c("bid_is_executable"), "executable_bid"),
            F.when(c("ask_price").isNotNull() & c("ask_is_executable"), "executable_ask"),
        )
    )


def _sorted_book(levels: str, descending: bool) -> Column:
    prices = F.transform(levels, lambda x: x["price"])
    return prices == F.sort_array(prices, asc=not descending)


def validate_observations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good observations and quarantined ones with their reasons; a column that a kind does not use is NULL."""

    def kind(*names: str) -> Column:
        return c("kind").isin(*names)

    def given(*names: str) -> Column:
        return reduce(lambda a, b: a | b, [clean(c(x)).isNull() for x in names])

    def not_positive(x: str) -> Column:
        return F.coalesce(c(x) <= 0, F.lit(False)) | F.coalesce(F.isnan(x), F.lit(False))

    prices = ["open_price", "high_price", "low_price", "close_price"]
    none_of = reduce(lambda a, b: a & b, [c(x).isNull() for x in prices])
    no_price = c("bid_price").isNull() & c("ask_price").isNull() & c("indicative_price").isNull()
    size = {x: F.coalesce(F.size(x), F.lit(0)) for x in ("bids", "asks")}
    bar = kind("daily_bar", "adjusted_total_return_bar")
    adjusted = F.coalesce(c("adjustment_basis") == "total_return_adjusted", F.lit(False))
    finite = F.coalesce(F.isnan("value") | (F.abs("value") == float("inf")), F.lit(False))
    checks = {
        "unknown_kind": ~F.coalesce(c("kind").isin(KINDS), F.lit(False)),
        "missing_metadata": given("instrument", "source", "timezone", "currency", "unit", "revision_id", "source_artifact_hash"),
        "ingested_before_available": c("ingested_at") < c("available_at"),
        "quote_without_price": kind("quote") & no_price,
        "quote_price_not_positive": kind("quote") & (not_positive("bid_price") | not_positive("ask_price") | not_positive("indicative_price")),
        "quote_crossed": kind("quote") & (c("bid_price") > c("ask_price")),
        "executable_without_price": kind("quote") & ((c("bid_is_executable") & c("bid_price").isNull()) | (c("ask_is_executable") & c("ask_price").isNull())),
        "trade_not_positive": kind("trade") & ~F.coalesce((c("value") > 0) & (c("quantity") > 0), F.lit(False)),
        "bar_price_not_positive": bar & reduce(lambda a, b: a | b, [not_positive(x) for x in prices]),
        "bar_without_price": ((kind("daily_bar") & (c("market_status") == "open")) | kind("adjusted_total_return_bar")) & none_of,
        "bar_high_below_low": bar & (c("high_price") < c("low_price")),
        "bar_negative_volume": kind("daily_bar") & (c("quantity") < 0),
        "bar_wrong_basis": (kind("daily_bar") & adjusted) | (kind("adjusted_total_return_bar") & ~adjusted),
        "bar_factor_not_positive": kind("adjusted_total_return_bar") & ~F.coalesce(c("value") > 0, F.lit(False)),
        "book_empty": kind("order_book_snapshot") & (size["bids"] == 0) & (size["asks"] == 0),
        "book_not_sorted": kind("order_book_snapshot") & ~F.coalesce(_sorted_book("bids", True) & _sorted_book("asks", False), F.lit(True)),
        "calendar_closed_with_hours": kind("market_calendar") & (c("market_status") == "closed") & (c("open_time").isNotNull() | c("close_time").isNotNull()),
        "calendar_open_without_hours": kind("market_calendar") & c("market_status").isin("open", "partial") & (c("open_time").isNull() | c("close_time").isNull()),
        "action_without_terms": kind("corporate_action") & (F.coalesce(F.size("terms"), F.lit(0)) <= 0),
        "distribution_negative": kind("distribution") & ~F.coalesce(c("value") >= 0, F.lit(False)),
        "settlement_missing": kind("settlement_event") & c("value").isNull(),
        "release_period_reversed": kind("economic_release") & (c("period_end") < c("period_start")),
        "release_without_vintage": kind("economic_release", "vintage_snapshot") & given("revision_group_id", "vintage_id"),
        "revision_without_fields": kind("revision_record") & (F.coalesce(F.size("changed_fields"), F.lit(0)) <= 0),
        "vintage_empty": kind("vintage_snapshot") & (F.coalesce(F.size("terms"), F.lit(0)) <= 0),
        "benchmark_without_tenor": kind("cash_risk_free_benchmark") & given("tenor"),
        "value_not_finite": finite,
    }
    rows = df.withColumn("reasons", reasons(**checks))
    return rows.filter(F.size("reasons") == 0).drop("reasons"), rows.filter(F.size("reasons") > 0)


def price_history(prices: DataFrame, cutoff: Column) -> DataFrame:
    """Latest revision per asset and date of the prices available at a cut-off.

    prices: asset_id, market_date, adjusted_close, availability_time, revision_id.
    """
    best = F.max_by("adjusted_close", F.struct("availability_time", "revision_id"))
    return prices.filter(c("availability_time") <= cutoff).groupBy("asset_id", "market_date").agg(best.alias("adjusted_close"))


def complete_dates(history: DataFrame, assets: list[str]) -> DataFrame:
    """Wide table of the dates on which every asset has a price."""
    wide = history.filter(c("asset_id").isin(assets)).groupBy("market_date").agg(
        *[F.max(F.when(c("asset_id") == a, c("adjusted_close"))).alias(a) for a in assets]
    )
    return wide.dropna(subset=assets)


def asof_forecast(decisions: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each decision with its forecast, and the decisions whose forecast was issued or seen too late.

    decisions: decision_id, event_id, decision_time. snapshots: event_id, issue_time, as_of and payload.
    """
    rows = decisions.join(snapshots, "event_id")
    late = (c("issue_time") > c("decision_time")) | (c("as_of") > c("decision_time"))
    return rows.filter(~late), rows.filter(late)
