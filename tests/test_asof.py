from datetime import datetime

import pytest
from pyspark.sql import functions as F

from parley.operators import asof as G


def at(day, hour=0):
    return datetime(2024, 1, day, hour)


@pytest.fixture(scope="module")
def releases(spark):
    rows = [
        ("economic_release", "jobs", "src", at(1), at(2), at(2, 1), None, "r1", 150.0, "g", None, None), ("economic_release", "jobs", "src", at(1), at(10), at(10, 1), None, "r2", 50.0, "g", None, None),
        ("adjusted_total_return_bar", "etf", "src", at(3), at(3), at(3, 1), at(8), "b1", 9.0, None, None, None),
    ]
    schema = (
        "kind string, instrument string, source string, event_time timestamp, available_at timestamp, ingested_at timestamp, corporate_action_knowledge_at timestamp, "
        "revision_id string, value double, revision_group_id string, source_observation_id string, session_date date"
    )
    return spark.createDataFrame(rows, schema)


def ask(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "query_id long, kind string, instrument string, event_time timestamp, as_of timestamp, source string, calendar_id string")


def test_no_look_ahead_and_latest_vintage(spark, releases):
    q = ask(
        spark, ("economic_release", "jobs", at(1), at(5), None, "c"), ("economic_release", "jobs", at(1), at(20), None, "c"), ("economic_release", "jobs", at(1), at(2), None, "c"),
        ("adjusted_total_return_bar", "etf", at(3), at(5), None, "c"), ("adjusted_total_return_bar", "etf", at(3), at(9), "src", "c"),
    )
    got = {r["query_id"]: r["value"] for r in G.asof(q, releases).collect()}
    # available but not ingested yet, and adjusted before the corporate action was known: both unseen
    assert got == {0: 150.0, 1: 50.0, 4: 9.0}
    assert {r["query_id"] for r in G.asof(q, releases, require_ingested=False).collect()} == {0, 1, 2, 4}


def test_revision_intervals(spark, releases):
    rows = G.revision_intervals(releases.filter("kind = 'economic_release'"), ["instrument"]).orderBy("visible_from").collect()
    assert [(r["value"], r["visible_from"], r["visible_to"]) for r in rows] == [(150.0, at(2, 1), at(10, 1)), (50.0, at(10, 1), None)]


def test_gap_is_never_filled(spark, releases):
    cal = spark.createDataFrame(
        [("c", datetime(2024, 1, 4).date(), "closed", at(1), None, at(1), "x")],
        "calendar_id string, session_date date, status string, available_at timestamp, corporate_action_knowledge_at timestamp, ingested_at timestamp, revision_id string",
    )
    q = ask(spark, ("economic_release", "jobs", at(4), at(20), None, "c"), ("economic_release", "jobs", at(5), at(20), None, "c"), ("economic_release", "jobs", at(1), at(20), None, "c"))
    got = {r["query_id"]: (r["found"], r["missing_reason"]) for r in G.asof_with_reason(q, releases, cal).collect()}
    assert got == {0: (0, "market_closed_no_forward_fill"), 1: (0, "no_observation_at_event_time_no_forward_fill"), 2: (1, None)}


def test_asof_latest_with_a_hot_instrument(many_segments):
    spark = many_segments
    obs = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, F.lit("x")).otherwise(F.lit("hot")).alias("instrument"), F.timestamp_seconds(F.col("id") * 60).alias("event_time"),
        F.timestamp_seconds(F.col("id") * 60 + (F.col("id") * 7919) % 3000).alias("available_at"), F.timestamp_seconds(F.col("id") * 60).alias("ingested_at"),
        F.lit(None).cast("timestamp").alias("corporate_action_knowledge_at"), F.col("id").alias("revision_id"), F.col("id").cast("double").alias("value"),
    )
    q = spark.range(100).select(F.col("id").alias("query_id"), F.lit("hot").alias("instrument"), F.timestamp_seconds(F.col("id") * 301).alias("as_of"))
    got = {r["query_id"]: r["revision_id"] for r in G.asof_latest(q, obs, ["instrument"]).collect()}
    for k in range(100):
        seen = [i for i in range(500) if i % 3 and max(i * 60 + (i * 7919) % 3000, i * 60) <= k * 301]
        assert got[k] == (max(seen) if seen else None)
