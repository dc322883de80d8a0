"""Plans of joins to small fits: the fact is never shuffled by the columns of the fit."""

import re

import pytest

import __spark_entry__ as entry
from parley.plans import bindings as B
from parley.operators import metrics as E
from parley.operators import models as M
from parley.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"
LABELS = M.LABELS["seller_next_action"]


def exchanges(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "\n".join(re.findall(r"Exchange hashpartitioning\([^\n]*", plan))


@pytest.fixture(scope="module")
def halves(spark):
    rows = B.split_cases(Tables(spark, FOLDER), "seller_next_action")
    return rows.filter("region = 'train'"), rows.filter("region = 'development'")


def test_predictions_do_not_move_the_rows(halves):
    train, dev = halves
    for predict in (M.predict_category_majority, M.predict_histogram, M.predict_stumps):
        assert "_cat" not in exchanges(predict(dev, train, LABELS)) and "_k_" not in exchanges(predict(dev, train, LABELS))
    assert exchanges(E.outside_support(dev, train)) == ""


@pytest.mark.parametrize("name", ["e19_comparables", "f05_off_policy"])
def test_facts_stay_where_they_are(spark, name):
    found = [x for x in entry.queries() if x.startswith(name[:4])]
    for x in found:
        df = entry.queries()[x](spark, FOLDER)
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["e11_shadow_policy_gate", "e11_readiness_gate", "e11_abstention_reasons"])
def test_gates_read_the_line_items_once(spark, name):
    """The facts of a gate are staged, so that its counts, gaps and margins do not join all tables again."""
    df = entry.queries()[name](spark, FOLDER)
    assert "l_tax" not in df._jdf.queryExecution().toString()
