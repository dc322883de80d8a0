"""The registered queries against their SQL twins on the smallest tables, and the contract of the registry."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from check import TABLES, agree, canonical

FOLDER = "/root/testdata/sf0.001"
# one query per family and technique; check.py runs all of them
SAMPLE = """
a04_canonicalize a05_decode_turns a08_dedupe_by_key a11_profile a12_bucketed_sink a20_backfill_gaps a25_mask_secret_spans b01_turn_features b10_build_cases b14_sequence_violations
c02_purged_split c05_standard_splits c07_validate_split c08_fresh_hidden d02_category_majority d05_stumps d07_glm_balance d07_ridge d12_two_state d19_isotonic_rows d19_platt d23_bootstrap_brier d08_regression_baselines d11_threshold_candidates d20_nearest_rank d24_leaderboard
e06_mature_margins e10_match_cancellations e15_policy_audit e21_recommend e22_shadow_values f01_treatment_compare f04_permutation_draws f05_off_policy h03_bracket_probabilities d14_nearest g01_validate_observations g03_asof g05_missing_reason
h05_pick_per_group l01_supersession_check l04_max_drawdown l05_verify_chain l07_longest_streak_weeks s01_stream_turns s04_stream_overdue s04_stream_reminders fn_dates flagship_next_action
""".split()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    rel = db.sql(entry.oracle_sql()[name])
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    want = pd.DataFrame(rel.fetchall(), columns=rel.columns, dtype=object)
    assert sorted(df.columns) == sorted(want.columns)
    assert all(agree(t, types[x]) for x, t in df.dtypes)
    assert canonical(df.toPandas().astype(object)) == canonical(want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1
