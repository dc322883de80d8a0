"""Randomised comparisons, off-policy values, assignment and trial integrity."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.scalars import clip, hash_fraction, reasons
from parley.operators.fits import merged
from parley.operators.joins import lookup
from parley.operators.sequence import Sequence, running_sum

c = F.col


def _sums(arm: Column, weight: Column) -> list[Column]:
    y = c("outcome").cast("double")
    return [
        F.count("*").alias("n"), F.sum(y).alias("y"), F.sum(weight).alias("w"), F.sum(weight * y).alias("wy"),
        F.sum(weight * weight).alias("w2"), F.sum(weight * weight * y).alias("w2y"), F.min("probability").alias("lo"), F.max("probability").alias("hi"),
        F.count_if(~F.coalesce(c("adherent"), F.lit(True))).alias("off"),
    ]


def treatment_compare(trials: DataFrame, treatment: str, comparator: str) -> DataFrame:
    """Intention-to-treat difference of two randomised arms, by block and overall.

    trials: block, arm, probability (of treatment), outcome (0/1), adherent. Where probabilities vary the
    means are inverse-probability weighted (Hajek) with a sandwich error; else plain with an add-two interval.
    One pass to (block, arm) sums; everything after that works on those rows.
    """
    rows = trials.filter(c("arm").isin(treatment, comparator))
    weight = F.when(c("arm") == treatment, 1 / c("probability")).otherwise(1 / (1 - c("probability")))
    cells = rows.groupBy("block", "arm").agg(*_sums(c("arm"), weight))
    scopes = F.explode(F.array(F.struct(F.lit("block").alias("s"), c("block").alias("b")), F.struct(F.lit("overall").alias("s"), F.lit("all").alias("b"))))
    long = cells.withColumn("_x", scopes).select("_x.s", "_x.b", "arm", "n", "y", "w", "wy", "w2", "w2y", "lo", "hi", "off")

    def arm(name: str, tag: str) -> list[Column]:
        return [F.coalesce(F.sum(F.when(c("arm") == name, c(x))), F.lit(0.0)).cast("double").alias(f"{tag}{x}") for x in ("n", "y", "w", "wy", "w2", "w2y")]

    both = long.groupBy(c("s").alias("scope"), c("b").alias("block")).agg(
        *arm(treatment, "t_"), *arm(comparator, "c_"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("off").alias("nonadherent")
    )

    def mean(tag: str, weighted: bool) -> Column:
        top, low = (f"{tag}wy", f"{tag}w") if weighted else (f"{tag}y", f"{tag}n")
        return F.when(c(low) > 0, c(top) / c(low)).otherwise(0.0)

    varies = c("hi") - c("lo") > 1e-12
    means = {f"{tag}mean": F.when(varies, mean(tag, True)).otherwise(mean(tag, False)) for tag in ("t_", "c_")}
    both = both.withColumns({"varies": varies, **means}).withColumn("effect", c("t_mean") - c("c_mean"))

    def arm_variance(tag: str) -> Column:
        # outcomes are 0/1, so the sum of w2 (y - m)2 opens into sums already taken
        m = c(f"{tag}mean")
        return F.when(c(f"{tag}w") > 0, (c(f"{tag}w2y") * (1 - 2 * m) + m * m * c(f"{tag}w2")) / (c(f"{tag}w") * c(f"{tag}w"))).otherwise(0.0)

    def added(tag: str) -> Column:
        return (c(f"{tag}y") + 1) / (c(f"{tag}n") + 2)

    empty = (c("t_n") == 0) | (c("c_n") == 0)
    sandwich = F.sqrt(F.greatest(arm_variance("t_") + arm_variance("c_"), F.lit(0.0)))
    plus_two = F.sqrt(added("t_") * (1 - added("t_")) / (c("t_n") + 2) + added("c_") * (1 - added("c_")) / (c("c_n") + 2))
    use_sandwich = c("varies") & (sandwich > 1e-12)
    centre = F.when(use_sandwich, c("effect")).otherwise(added("t_") - added("c_"))
    se = F.when(empty, 0.0).when(use_sandwich, sandwich).otherwise(plus_two)
    return both.withColumns(
        {
            "standard_error": se,
            "low": F.when(empty, -1.0).otherwise(F.greatest(F.lit(-1.0), centre - 1.96 * se)),
            "high": F.when(empty, 1.0).otherwise(F.least(F.lit(1.0), centre + 1.96 * se)),
            "warnings": reasons(
                one_arm_empty=empty, small_sample=~empty & ((c("t_n") < 10) | (c("c_n") < 10)), nonadherent_trials=c("nonadherent") > 0, varying_probability=c("varies")
            ),
            "treatment_n": c("t_n").cast("long"), "comparator_n": c("c_n").cast("long"), "treatment_mean": c("t_mean"), "comparator_mean": c("c_mean"),
            "estimator": F.when(c("varies"), "hajek_weighted").otherwise("difference_in_means"),
        }
    ).select(
        "scope", "block", "treatment_n", "comparator_n", "treatment_mean", "comparator_mean", "effect", "standard_error", "low", "high", "nonadherent",
        "estimator", "warnings",
    )


def uplift(df: DataFrame, treatment: str = "treatment", outcome: str = "outcome") -> DataFrame:
    """Arm sizes and rates, average effect, its error and 95 % interval; NULL effect unless both arms exist."""
    t, y = c(treatment), c(outcome).cast("double")
    checked = df.withColumn("_t", F.when(t.isin(0, 1), t).otherwise(F.raise_error(F.lit("treatment must be 0 or 1")).cast("int")))
    out = checked.agg(
        F.count("*").alias("rows"), F.count_if(c("_t") == 1).alias("treated"), F.count_if(c("_t") == 0).alias("controls"),
        F.avg(F.when(c("_t") == 1, y)).alias("treatment_rate"), F.avg(F.when(c("_t") == 0, y)).alias("control_rate"),
        F.coalesce(F.var_samp(F.when(c("_t") == 1, y)), F.lit(0.0)).alias("_vt"), F.coalesce(F.var_samp(F.when(c("_t") == 0, y)), F.lit(0.0)).alias("_vc"),
    ).withColumns({"ate": c("treatment_rate") - c("control_rate"), "standard_error": F.sqrt(F.try_divide(c("_vt"), c("treated")) + F.try_divide(c("_vc"), c("controls")))})
    return out.drop("_vt", "_vc").withColumns({"low": c("ate") - 1.96 * c("standard_error"), "high": c("ate") + 1.96 * c("standard_error")})


def permutation_test(df: DataFrame, treatment: str = "treatment", outcome: str = "outcome") -> DataFrame:
    """Two-sided permutation p-value of the effect on a 0/1 outcome, and the mean effect under the null.

    Over all ways to pick the treated, the number of treated successes is hypergeometric. Its weights follow
    from neighbour ratios by a running sum of logarithms, so the test is exact: no draws, no seed. Other outcomes than
    0 and 1 are refused.
    """

    def binary(name: str) -> Column:
        told = F.raise_error(F.lit(f"{name} must be 0 or 1")).cast("long")
        return F.when(c(name).isin(0, 1), c(name).cast("long")).otherwise(told)

    y, z = binary(outcome), binary(treatment)
    totals = df.agg(F.count("*").alias("n"), F.sum(y).alias("k"), F.sum(z).alias("t"), F.sum(y * z).alias("x"))
    seen_totals = totals.first()
    n, k, t = c("n"), c("k"), c("t")
    numbers = {x: F.lit(seen_totals[x]).cast("long") for x in ("n", "k", "t", "x")}
    first, last = (0, -1) if not seen_totals["n"] else (max(0, seen_totals["k"] + seen_totals["t"] - seen_totals["n"]), min(seen_totals["k"], seen_totals["t"]))
    support = df.sparkSession.range(first, last + 1).withColumnRenamed("id", "i").withColumns({**numbers, "_low": F.lit(first)})
    step = (k - c("i") + 1) * (t - c("i") + 1).cast("double") / (c("i") * (n - k - t + c("i")))
    logs = support.withColumn("_step", F.when(c("i") == c("_low"), 0.0).otherwise(F.log(step)))
    seq = Sequence(logs, [], ["i"]).add(_log=running_sum(c("_step"))).frame
    top = seq.agg(F.max("_log")).scalar()
    ate = c("i") / t - (k - c("i")) / (n - t)
    seen = c("x") / t - (k - c("x")) / (n - t)
    mass = seq.select(F.exp(c("_log") - top).alias("w"), ate.alias("ate"), seen.alias("seen"))
    # a hair of slack: equal effects may differ in the last bit
    extreme = F.abs(c("ate")) >= F.abs(c("seen")) - 1e-12
    return mass.agg(
        F.max("seen").alias("ate"), (F.sum(F.when(extreme, c("w")).otherwise(0.0)) / F.sum("w")).alias("p_value"),
        (F.sum(c("w") * c("ate")) / F.sum("w")).alias("null_mean"),
    )


#: Bins that a draw's bracket is cut into, and the rows of a block times draws that a task holds at a time.
BINS, BLOCK = 256, 1_000_000


def mixed(x: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """64 mixed bits for every row (down) and draw (across), by the finaliser of the SplitMix generator."""
    z = x[:, None] + (draw[None, :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _binned(rows: DataFrame, draws: np.ndarray, low: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows and outcomes below each draw's bracket, and in each of its bins."""
    d, width = len(draws), len(draws) * BINS
    step = max(1, BLOCK // d)

    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(2 * d + 2 * width)
        below, inside = out[: 2 * d].reshape(2, d), out[2 * d :].reshape(2, width)
        for batch in batches:
            x = batch["x"].to_numpy(zero_copy_only=False).astype(np.uint64)
            y = batch["y"].to_numpy(zero_copy_only=False)
            for i in range(0, len(x), step):
                values = y[i : i + step]
                z = mixed(x[i : i + step], draws)
                under = z < low
                below += [under.sum(axis=0), values @ under]
                place = (z - low) >> shift
                row, draw = np.nonzero(~under & (place < BINS))
                at = draw * BINS + place[row, draw].astype(np.int64)
                inside[0] += np.bincount(at, minlength=width)
                inside[1] += np.bincount(at, values[row], minlength=width)
        return out

    sums = merged(rows, fold, 2 * d + 2 * width)
    return (*sums[: 2 * d].reshape(2, d), *sums[2 * d :].reshape(2, d, BINS))


def _drawn(rows: DataFrame, n: int, treated: int, draws: int) -> np.ndarray:
    """Sum of the outcomes of each draw's treated: the rows with the smallest mixed bits.

    Every draw has a bracket for its threshold, first eight standard errors around the expected one, and each pass over the
    rows cuts it into BINS, until an edge has the wanted number of rows below it. Rows are neither copied nor moved; what
    travels are counts and sums per draw and bin.
    """
    share, error = treated / n, 8 * math.sqrt(treated * (n - treated) / n) / n
    start, stop = int(max(0.0, share - error) * 2**64), int(min(1.0, share + error) * 2**64)
    bits = max(0, ((stop - start) // BINS).bit_length())
    low, shift = np.full(draws, start, np.uint64), np.full(draws, min(bits, 56), np.uint64)
    out, still = np.zeros(draws), np.arange(draws)
    while len(still):
        under, under_y, bins, bins_y = _binned(rows, still.astype(np.uint64), low[still], shift[still])
        missed = (under > treated) | (under + bins.sum(axis=1) < treated)
        count = under[:, None] + np.cumsum(bins, axis=1)
        total = under_y[:, None] + np.cumsum(bins_y, axis=1)
        edge = np.argmax(count >= treated, axis=1)
        pick = np.arange(len(still))
        before, before_y = count[pick, edge] - bins[pick, edge], total[pick, edge] - bins_y[pick, edge]
        # rows that share all bits cannot be told apart: those wanted of them count by the mean of them all
        wanted = (treated - before) / np.maximum(bins[pick, edge], 1)
        done = ~missed & ((count[pick, edge] == treated) | (shift[still] == 0))
        out[still[done]] = (before_y + wanted * bins_y[pick, edge])[done]
        now = still[missed]
        low[now], shift[now] = 0, 56
        cut = ~missed & ~done
        now = still[cut]
        low[now] += edge[cut].astype(np.uint64) << shift[now]
        shift[now] = np.maximum(shift[now].astype(np.int64) - 8, 0).astype(np.uint64)
        still = still[~done]
    return out


def permutation_draws(df: DataFrame, key: str, treatment: str = "treatment", outcome: str = "outcome", draws: int = 2000) -> DataFrame:
    """Two-sided permutation p-value of the effect on an outcome of any numbers, and the mean effect under the null.

    Every draw treats as many rows as were treated, by hashes of the ``key``: the same rows on every cluster (where only some
    of the rows of one key find a place, they count by the mean of that key). Where all ways to pick them are no more than
    ``draws``, all are taken. An outcome that is missing or not finite and a treatment other than 0 and 1 are refused; an
    empty arm or table gives NULL and the method "empty_arm".
    """
    told = F.raise_error(F.lit(f"{treatment} must be 0 or 1")).cast("long")
    z = F.when(c(treatment).isin(0, 1), c(treatment).cast("long")).otherwise(told)
    number = c(outcome).cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < math.inf)
    y = F.when(finite, number).otherwise(F.raise_error(F.lit(f"{outcome} must be a finite number")).cast("double"))
    # fifteen digits of the key's SHA-256
    x = F.conv(F.right(F.sha2(F.coalesce(c(key).cast("string"), F.lit("")), 256), F.lit(15)), 16, 10).cast("long")
    rows = df.select(x.alias("x"), y.alias("y"), z.alias("z"))
    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("z"), F.lit(0)).alias("m"), F.sum("y").alias("total"), F.sum(c("z") * c("y")).alias("treated")).first()
    n, m = seen["n"], seen["m"]
    spark, schema = df.sparkSession, "ate double, p_value double, null_mean double, draws long, method string"
    if not 0 < m < n:
        return spark.createDataFrame([(None, None, None, 0, "empty_arm")], schema)
    ways = math.comb(n, m) if min(m, n - m) == 1 or n <= 64 else math.inf
    if ways <= draws:  # so there are at most ``draws`` rows
        values = np.array([r.y for r in rows.select("y").collect()])
        sums = np.array([values[list(pick)].sum() for pick in combinations(range(n), m)])
        method = "exact"
    else:
        sums, method = _drawn(rows.select("x", "y"), n, m, draws), "sampled"
    null = sums / m - (seen["total"] - sums) / (n - m)
    ate = seen["treated"] / m - (seen["total"] - seen["treated"]) / (n - m)
    slack = 1e-12 * max(1.0, abs(ate))
    return spark.createDataFrame([(ate, float((np.abs(null) >= abs(ate) - slack).mean()), float(null.mean()), len(null), method)], schema)


def _policy_by_context(policy: DataFrame, means: DataFrame, context: list[str]) -> DataFrame:
    """Per context: action probabilities as a map and the modelled value of the policy."""
    return policy.join(means, "action", "left").groupBy(*context).agg(
        F.map_from_entries(F.collect_list(F.struct("action", "prob"))).alias("_policy"),
        F.sum(c("prob") * F.coalesce("mean_reward", F.lit(0.0))).alias("_model"),
    )


def unsupported_actions(logs: DataFrame, policy: DataFrame, context: list[str]) -> DataFrame:
    """Actions the policy may take in a logged context but that were never logged."""
    wanted = policy.filter("prob > 0").join(logs.select(*context).distinct(), context, "left_semi").select("action").distinct()
    return wanted.join(logs.select("action").distinct(), "action", "left_anti")


def ope(logs: DataFrame, policy: DataFrame, context: list[str], cap: float = 10.0) -> DataFrame:
    """Value of a policy from logged actions by five estimators, one pass over the logs.

    logs: context columns, action, propensity, reward. policy: context columns, action, prob.
    """
    means = logs.groupBy("action").agg(F.avg("reward").alias("mean_reward"))
    rows = lookup(lookup(logs, _policy_by_context(policy, means, context), context), means, ["action"])
    p = F.coalesce(F.try_element_at("_policy", c("action")), F.lit(0.0))
    ok = (p > 0) & (c("propensity") > 0)
    w = F.when(ok, p / F.nullif(c("propensity"), F.lit(0.0))).otherwise(0.0)
    model = F.coalesce("_model", F.lit(0.0))
    robust = F.when(p <= 0, model).when(ok, model + w * (c("reward") - c("mean_reward")))
    rows = rows.select(
        "reward", w.alias("w"), F.least(w, F.lit(float(cap))).alias("wc"), model.alias("model"), robust.alias("robust"),
        ((p > 0) & (c("propensity") <= 0)).alias("void"),
    )

    def both(x: Column, tag: str) -> list[Column]:
        return [F.avg(x).alias(f"{tag}_mean"), F.sqrt(F.coalesce(F.var_samp(x), F.lit(0.0)) / F.count(x)).alias(f"{tag}_se")]

    def ess(x: Column) -> Column:
        return F.coalesce(F.try_divide(F.sum(x) * F.sum(x), F.sum(x * x)), F.lit(0.0))

    lost = unsupported_actions(logs, policy, context).agg(F.count("*")).scalar()
    one = rows.agg(
        F.avg("reward").alias("on_policy"), F.count_if("void").alias("void"), F.avg("w").alias("mean_w"), ess(c("w")).alias("ess"), ess(c("wc")).alias("ess_capped"),
        # rows without a usable propensity do not enter the robust estimate
        ess(F.when(c("robust").isNotNull(), c("w"))).alias("ess_robust"),
        *both(c("model"), "dm"), *both(c("w") * c("reward"), "ips"), *both(c("wc") * c("reward"), "cap"), *both(c("robust"), "dr"),
    ).withColumn("lost", lost)

    def row(name: str, value: Column, se: Column, size: Column, violations: Column) -> Column:
        return F.struct(
            F.lit(name).alias("estimator"), value.alias("value"), size.cast("double").alias("effective_sample_size"), violations.cast("long").alias("support_violations"),
            (value - 1.96 * se).alias("low"), (value + 1.96 * se).alias("high"),
        )

    bad = c("lost") + c("void")
    scale = F.when(c("mean_w") != 0, 1 / c("mean_w")).otherwise(0.0)
    estimates = F.array(
        row("direct_method", c("dm_mean"), c("dm_se"), F.lit(None), c("lost")),
        row("ips", c("ips_mean"), c("ips_se"), c("ess"), bad),
        row("self_normalized_ips", c("ips_mean") * scale, c("ips_se") * scale, c("ess"), bad),
        row("doubly_robust", c("dr_mean"), c("dr_se"), c("ess_robust"), bad),
        row("switch_ips", c("cap_mean"), c("cap_se"), c("ess_capped"), bad),
    )
    long = one.select("on_policy", F.explode(estimates).alias("e")).select("on_policy", "e.*")
    return long.withColumn("relative_error", F.abs(c("value") - c("on_policy")) / F.greatest(F.abs(c("on_policy")), F.lit(1e-12)))


def assign(units: DataFrame, unit: str, p: float, seed: int, namespace: str, treatment: str = "treatment", comparator: str = "comparator") -> DataFrame:
    """Reproducible randomised arm per unit from a hash of seed, namespace and unit; no counter, no order."""
    if not 0 < p < 1:
        raise ValueError("probability must lie between 0 and 1")
    draw = hash_fraction(F.concat_ws(":", F.lit(seed), F.lit(namespace), c(unit)))
    rows = units.withColumn("draw", draw).withColumn("arm", F.when(c("draw") < p, treatment).otherwise(comparator))
    return rows.withColumns({"probability": F.lit(float(p)), "assigned_probability": F.when(c("arm") == treatment, float(p)).otherwise(1 - float(p))})


def context_block(context: str = "context") -> Column:
    """Block of a decision context: time of day, fatigue band, task size."""

    def value(name: str) -> Column:
        return F.coalesce(F.try_element_at(context, F.lit(name)), F.lit(0.0))

    return F.concat_ws(
        "|",
        F.concat(F.lit("fatigue_band="), F.when(value("fatigue") > 0.66, "high").when(value("fatigue") > 0.33, "medium").otherwise("low")),
        F.concat(F.lit("task_size="), F.when(value("task_size_large") != 0, "large").otherwise("small_or_medium")),
        F.concat(F.lit("time_of_day="), F.when(value("time_of_day_morning") != 0, "morning").otherwise("not_morning")),
    )


def trial_integrity(outcomes: DataFrame, assignments: DataFrame) -> DataFrame:
    """Outcomes with what is wrong about them; every outcome is kept.

    outcomes: trial_id, assignment_id, arm, recorded_at. assignments: assignment_id, arm, assigned_at.
    Of several outcomes of an assignment the first recorded stands, the others are duplicates.
    """
    a = assignments.select("assignment_id", c("arm").alias("_arm"), "assigned_at")
    first = outcomes.groupBy("assignment_id").agg(F.min(F.struct("recorded_at", "trial_id")).alias("_first"))
    rows = outcomes.join(a, "assignment_id", "left").join(first, "assignment_id")
    return rows.withColumn(
        "faults",
        reasons(
            no_assignment=c("_arm").isNull(), arm_mismatch=c("_arm") != c("arm"), before_assignment=c("recorded_at") < c("assigned_at"),
            duplicate=F.struct("recorded_at", "trial_id") != c("_first"),
        ),
    ).drop("_arm", "_first")


def over_plan(assignments: DataFrame, plans: DataFrame) -> DataFrame:
    """Registered experiments with more assignments than planned."""
    n = assignments.groupBy("preregistration_id").agg(F.count("*").alias("assigned"))
    return plans.join(n, "preregistration_id").filter(c("assigned") > c("planned"))


def propose_experiment(
    predictions: DataFrame, contexts: DataFrame, mode: str = "science", cost: float = 0.1, risk: float = 0.1, burden: float = 0.1
) -> DataFrame:
    """Contexts by what an experiment there would teach (or gain) less its cost; the first row of the order is the proposal.

    predictions: context_id, model, arm (treatment or comparator), p. contexts: context_id, task_size_large, fatigue.
    """
    if mode not in ("science", "optimization"):
        raise ValueError("mode must be 'science' or 'optimization'")
    pt, pc = (F.max(F.when(c("arm") == a, c("p"))) for a in ("treatment", "comparator"))
    per = predictions.groupBy("context_id", "model").agg(pt.alias("t"), pc.alias("k")).withColumn("e", c("t") - c("k"))
    spread = F.greatest(*[F.max(x) - F.min(x) for x in ("t", "k", "e")])
    gain = per.groupBy("context_id").agg((spread if mode == "science" else F.avg("e")).alias("separation"))
    large = F.coalesce(c("task_size_large"), F.lit(0.0)) != 0
    price = F.when(large, 0.2).otherwise(0.1) * cost + 0.05 * risk + (0.15 + 0.1 * F.coalesce(c("fatigue"), F.lit(0.0))) * burden
    return gain.join(contexts, "context_id").withColumn("utility", c("separation") - price)


def best_context(proposals: DataFrame) -> DataFrame:
    return proposals.orderBy(F.desc("utility"), "context_id").limit(1)
