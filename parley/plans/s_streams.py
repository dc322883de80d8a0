"""Streaming queries, run over what the folder holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.ingest import reason_counts
from parley.plans import bindings as B
from parley.plans.a_ingest import DIRTY_TURN, dirty_turns
from parley.plans.c_splits import ARRIVAL_SQL, FREEZE, arrivals, freezes
from parley.plans.registry import Tables, ctes, query
from parley.streaming import streams as Z

c = F.col


class Live(Tables):
    """The same tables, with events as a stream."""

    def __init__(self, t: Tables):
        super().__init__(t.spark, t._folder)
        self.events = Z.file_stream(t.spark, t._folder, "events.parquet", t.events.schema)


@query(
    "s01_stream_turns",
    ctes(DIRTY_TURN)
    + """
    SELECT outcome, count(*) AS n FROM (
      SELECT CASE WHEN buyer_id IS NULL THEN 'missing_identifier' WHEN status_id = 5 THEN 'unknown_status' WHEN offer_type = 4 THEN 'unknown_offer_type'
                  ELSE 'accepted' END AS outcome FROM (SELECT DISTINCT * FROM raw)) GROUP BY 1
    """,
)
def s01(t: Tables) -> DataFrame:
    raw = dirty_turns(Live(t)).withColumn("event_time", c("event_time").cast("timestamp"))
    good, bad = Z.stream_turns(raw)
    return good.agg(F.lit("accepted").alias("outcome"), F.count("*").alias("n")).unionByName(reason_counts(bad).withColumnRenamed("reason", "outcome"))


@query(
    "s02_stream_prospective",
    ctes(FREEZE) + ARRIVAL_SQL,
)
def s02(t: Tables) -> DataFrame:
    assigned = arrivals(t).filter(c("event_type") == "purchase")
    return Z.run_to_folder(Z.stream_prospective(arrivals(Live(t)), freezes(t), assigned).select("case_id", "split", "policy", "freeze_id"))


@query(
    "s03_stream_action_mix",
    ctes(B.TURN)
    + """
    SELECT strftime(time_bucket(INTERVAL 1 HOUR, event_time), '%Y-%m-%d %H:%M:%S') AS start, action, count(*) AS turns,
           round(avg((epoch_us(response_time) - epoch_us(event_time)) / 1e6), 4) AS mean_latency
    FROM (SELECT *, CASE WHEN offer_type = 0 THEN 'offer' ELSE 'counter' END AS action FROM turn0)
    WHERE time_bucket(INTERVAL 1 HOUR, event_time) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY 1, 2
    """,
)
def s03(t: Tables) -> DataFrame:
    rows = B.bare_turns(Live(t)).withColumn("action", F.when(c("offer_type") == 0, "offer").otherwise("counter"))
    out = Z.run_to_folder(Z.stream_action_mix(rows))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "action", "turns", F.round("mean_latency", 4).alias("mean_latency"))


@query(
    "s03_stream_sessions",
    """
    SELECT user_id AS buyer_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS turns FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
    GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)
    """,
)
def s03_sessions(t: Tables) -> DataFrame:
    out = Z.run_to_folder(Z.stream_sessions(B.bare_turns(Live(t)), "buyer_id"))
    return out.select("buyer_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "turns")


# An offer is told when its deadline is before the watermark of both sides: the earlier one of their last times.
@query(
    "s04_stream_overdue",
    ctes(B.TURN)
    + """
    , o AS (SELECT *, least((SELECT max(event_time) FROM turn0), (SELECT max(response_time) FROM turn0)) - INTERVAL 1 HOUR AS mark FROM turn0)
    SELECT event_id AS offer_id, event_time FROM o
    WHERE (response_time IS NULL OR response_time > event_time + INTERVAL 30 MINUTE) AND event_time + INTERVAL 30 MINUTE < mark
    """,
)
def s04(t: Tables) -> DataFrame:
    offers = B.bare_turns(Live(t)).select(c("event_id").alias("offer_id"), "event_time")
    answered = B.bare_turns(Live(t)).filter(c("response_time").isNotNull()).select(c("event_id").alias("offer_id"), "response_time")
    late = Z.run_to_folder(Z.stream_overdue(offers, answered, "30 minutes"))
    return late.select("offer_id", c("event_time").cast("timestamp_ntz").alias("event_time"))


# The watermark is in milliseconds and runs over offers and answers together.
@query(
    "s04_stream_reminders",
    ctes(B.TURN)
    + """
    , o AS (SELECT *, (SELECT max(epoch_ms(greatest(event_time, response_time))) FROM turn0) - 3600000 AS mark FROM turn0),
    d AS (SELECT event_id AS offer_id, step, event_time + to_seconds(wait) AS deadline, response_time, mark FROM o, (VALUES (1, 1800), (2, 3600), (3, 14400)) s(step, wait))
    SELECT offer_id, step, strftime(deadline, '%Y-%m-%d %H:%M:%S') AS deadline FROM d WHERE (response_time IS NULL OR response_time > deadline) AND epoch_ms(deadline) <= mark
    """,
)
def s04_reminders(t: Tables) -> DataFrame:
    offers = B.bare_turns(Live(t)).select(c("event_id").alias("offer_id"), "event_time")
    answers = B.bare_turns(Live(t)).select(c("event_id").alias("offer_id"), "response_time")
    with Z.rocks_state(t.spark):
        told = Z.run_to_folder(Z.stream_reminders(offers, answers, [1800, 3600, 14400]))
    return told.select("offer_id", "step", F.date_format("deadline", "yyyy-MM-dd HH:mm:ss").alias("deadline"))
