import hashlib
from itertools import combinations

import numpy as np
import pytest

from parley.operators import causal as A


def test_uplift_and_exact_permutations(spark):
    data = [(1, 1), (1, 1), (0, 0), (0, 1)]
    df = spark.createDataFrame(data, "treatment int, outcome int")
    assert A.uplift(df).first()["ate"] == 0.5
    out = A.permutation_test(df).first()
    y = [o for _, o in data]
    null = [sum(y[i] for i in s) / 2 - (sum(y) - sum(y[i] for i in s)) / 2 for s in combinations(range(4), 2)]
    assert len(null) == 6
    assert abs(out["p_value"] - sum(abs(a) >= 0.5 - 1e-12 for a in null) / 6) < 1e-12
    assert abs(out["null_mean"] - sum(null) / 6) < 1e-12


def test_empty_arm_gives_the_widest_interval(spark):
    df = spark.createDataFrame([("b", "t", 0.5, 1, True), ("b", "t", 0.5, 0, False)], "block string, arm string, probability double, outcome int, adherent boolean")
    row = A.treatment_compare(df, "t", "c").filter("scope = 'overall'").first()
    assert (row["low"], row["high"]) == (-1.0, 1.0) and "one_arm_empty" in row["warnings"] and row["nonadherent"] == 1


def test_ope_on_a_known_log(spark):
    logs = spark.createDataFrame([(0, "a", 0.5, 1.0), (0, "a", 0.5, 0.0), (0, "b", 0.5, 1.0), (0, "b", 0.5, 1.0)], "ctx int, action string, propensity double, reward double")
    policy = spark.createDataFrame([(0, "a", 0.0), (0, "b", 1.0), (0, "z", 0.0)], "ctx int, action string, prob double")
    got = {r["estimator"]: r for r in A.ope(logs, policy, ["ctx"]).collect()}
    assert got["ips"]["value"] == 1.0 and got["direct_method"]["value"] == 1.0 and got["doubly_robust"]["value"] == 1.0
    assert got["ips"]["effective_sample_size"] == 2.0 and got["ips"]["support_violations"] == 0


def test_assignment_is_reproducible(spark):
    units = spark.range(2000).withColumnRenamed("id", "u")
    a = A.assign(units, "u", 0.3, 1, "n").filter("arm = 'treatment'").count()
    b = A.assign(units.repartition(7), "u", 0.3, 1, "n").filter("arm = 'treatment'").count()
    assert a == b and 500 < a < 700


def test_permutation_refuses_other_outcomes(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.0)], "treatment int, outcome double")
    with pytest.raises(Exception, match="must be 0 or 1"):
        A.permutation_test(df).collect()


def _brute_force_draws(keys, y, treated, draws):
    """Each draw's treated by sorting whole rows."""
    x = np.array([int(hashlib.sha256(str(k).encode()).hexdigest()[-15:], 16) for k in keys], np.uint64)
    bits = A.mixed(x, np.arange(draws, dtype=np.uint64))
    chosen = np.argsort(bits, axis=0)[:treated]
    sums = np.array([y[chosen[:, d]].sum() for d in range(draws)])
    return sums / treated - (y.sum() - sums) / (len(y) - treated)


@pytest.mark.parametrize("treated", [1, 3, 250, 899])
def test_draws_equal_sorted_rows(spark, treated):
    y = np.random.default_rng(3).normal(5, 40, 900)
    df = spark.createDataFrame([(i, int(i < treated), float(v)) for i, v in enumerate(y)], "k long, treatment int, outcome double")
    out = A.permutation_draws(df.repartition(5), "k", draws=70).first()
    null = _brute_force_draws(range(900), y, treated, 70)
    ate = y[:treated].mean() - y[treated:].mean()
    assert (out["draws"], out["method"]) == (70, "sampled")
    assert abs(out["ate"] - ate) < 1e-9 and abs(out["null_mean"] - null.mean()) < 1e-9
    assert abs(out["p_value"] - (abs(null) >= abs(ate) - 1e-9).mean()) < 1e-12


def test_draws_agree_with_the_exact_form_on_binary_outcomes(spark):
    df = spark.range(4000).selectExpr("id", "cast(id % 3 = 0 as int) treatment", "cast(id % 7 < 2 + cast(id % 3 = 0 and id % 41 < 4 as int) as int) outcome")
    drawn, exact = A.permutation_draws(df, "id", draws=1500).first(), A.permutation_test(df).first()
    assert drawn["ate"] == pytest.approx(exact["ate"]) and 0.02 < exact["p_value"] < 0.98
    assert abs(drawn["p_value"] - exact["p_value"]) < 4 * (exact["p_value"] * (1 - exact["p_value"]) / 1500) ** 0.5


def test_few_assignments_are_all_taken(spark):
    y = [0.5, 2.0, -1.25, 7.0, 3.5]
    df = spark.createDataFrame([(i, int(i < 2), v) for i, v in enumerate(y)], "k int, treatment int, outcome double")
    out = A.permutation_draws(df, "k").first()
    null = [sum(y[i] for i in s) / 2 - (sum(y) - sum(y[i] for i in s)) / 3 for s in combinations(range(5), 2)]
    assert (out["draws"], out["method"]) == (10, "exact")
    assert out["p_value"] == sum(abs(a) >= abs(null[0]) - 1e-12 for a in null) / 10


def test_draws_with_repeated_keys_empty_arms_and_bad_rows(spark):
    schema = "k int, treatment int, outcome double"
    same = spark.createDataFrame([(1, i % 2, float(i)) for i in range(100)], schema)
    out = A.permutation_draws(same.union(spark.createDataFrame([(2, 0, 5.0)] * 3, schema)), "k", draws=20).first()
    assert out["method"] == "sampled" and out["draws"] == 20 and 0 <= out["p_value"] <= 1
    for rows in ([], [(1, 1, 2.0)], [(1, 0, 2.0), (2, 0, 1.0)]):
        assert A.permutation_draws(spark.createDataFrame(rows, schema), "k").first()["method"] == "empty_arm"
    for bad in ((3, 2, 1.0), (3, 1, None), (3, 1, float("nan")), (3, None, 1.0)):
        with pytest.raises(Exception, match="must be"):
            A.permutation_draws(spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0), bad], schema), "k").collect()
