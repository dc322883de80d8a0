import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from parley.operators import sequence
from parley.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def many_segments(spark, monkeypatch):
    """Keep every range partition and cut every key, so that small data really spreads over segments."""
    monkeypatch.setattr(sequence, "HOT_ROWS", 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
