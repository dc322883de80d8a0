"""Scores of predictions: losses, calibration, slices, comparison, selection.

Classification predictions carry row_id, label, prediction, probabilities (map);
binary ones carry target (0/1) and p; regression ones carry label_num, prediction.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.scalars import bin_of, clip
from parley.operators.fits import merged
from parley.operators.joins import lookup
from parley.operators.selection import Place, values_at
from parley.operators.sequence import Sequence, rank, running_min, running_sum, total

c = F.col


def probability(label: str | Column) -> Column:
    key = F.lit(label) if isinstance(label, str) else label
    return F.coalesce(F.try_element_at("probabilities", key), F.lit(0.0))


def score_binary(pred: DataFrame, by: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Log loss, Brier, calibration error, base rate and lift over the base rate, by group.

    One pass to (group, bin) sums; everything else is arithmetic on those few rows.
    """
    by = by or []
    p = clip(c("p"), 1e-6, 1 - 1e-6)
    y = c("target")
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    cells = pred.groupBy(*by, bin_of(p, bins).alias("_bin")).agg(
        F.count("*").alias("n"), F.sum(y.cast("double")).alias("y"), F.sum(p).alias("p"),
        F.sum(loss).alias("l"), F.sum((p - y) ** 2).alias("b"),
    )
    out = cells.groupBy(*by).agg(
        F.sum("n").alias("n"),
        (F.sum("l") / F.sum("n")).alias("log_loss"),
        (F.sum("b") / F.sum("n")).alias("brier"),
        (F.sum(F.abs(c("p") - c("y"))) / F.sum("n")).alias("calibration_error"),
        clip(F.sum("y") / F.sum("n"), 1e-6, 1 - 1e-6).alias("base_rate"),
    )
    r = c("base_rate")
    base_loss = -(r * F.log(r) + (1 - r) * F.log(1 - r))
    return out.withColumn("lift_over_base", base_loss - c("log_loss"))


def score_multiclass(pred: DataFrame, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """Accuracy, log loss and Brier score summed over labels."""
    eps = 1e-12
    true_p = F.coalesce(F.try_element_at("probabilities", c("label")), F.lit(eps))
    brier = reduce(
        lambda a, b: a + b, [(probability(l) - F.when(c("label") == l, 1.0).otherwise(0.0)) ** 2 for l in labels]
    )
    rows = pred.select(
        *(by or []), (c("label") == c("prediction")).cast("double").alias("hit"),
        (-F.log(clip(true_p, eps, 1 - eps))).alias("loss"), brier.alias("brier"),
    )
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("loss").alias("log_loss"), F.avg("brier").alias("brier")
    )


def pinball(y: Column, p: Column, q: float) -> Column:
    return F.greatest(F.lit(q) * (y - p), F.lit(q - 1) * (y - p))


def score_regression(pred: DataFrame, by: list[str] | None = None, q: float = 0.5) -> DataFrame:
    e = c("prediction") - c("label_num")
    return pred.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(pinball(c("label_num"), c("prediction"), q)).alias("quantile_loss"),
    )


def reliability(pred: DataFrame, kind: str, bins: int = 10, label: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Bins of predicted against observed rate. Kinds: ``label`` (one label against the rest), ``top`` label."""
    if kind == "label":
        p, hit = probability(label), c("label") == label
    elif kind == "top":
        best = F.array_max(F.transform(F.map_entries("probabilities"), lambda e: e["value"]))
        p, hit = best, c("label") == c("prediction")
    else:
        raise ValueError("kind must be 'label' or 'top'")
    return (
        pred.groupBy(*(by or []), bin_of(p, bins).alias("bin"))
        .agg(F.count("*").alias("count"), F.avg(p).alias("mean_prediction"), F.avg(hit.cast("double")).alias("empirical_rate"))
    )


def dense_bins(cells: DataFrame, bins: int, by: list[str] | None = None) -> DataFrame:
    """Adds the empty bins of every group as zeros."""
    by = by or []
    every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    spine = cells.select(*by).distinct().select(*by, every) if by else cells.sparkSession.range(bins).select(c("id").cast("int").alias("bin"))
    filled = [F.coalesce(x, F.lit(0)).alias(x) for x in ("count", "mean_prediction", "empirical_rate")]
    return spine.join(cells, [*by, "bin"], "left").select(*by, "bin", *filled)


def expected_calibration_error(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    gap = c("count") * F.abs(c("mean_prediction") - c("empirical_rate"))
    return cells.groupBy(*(by or [])).agg(F.sum("count").alias("n"), (F.sum(gap) / F.sum("count")).alias("ece"))


def classwise_ece(pred: DataFrame, labels: list[str], bins: int = 10) -> DataFrame:
    """One-vs-rest calibration error of every label, from one explode of the probability map."""
    cells = F.explode(F.array(*[F.struct(F.lit(l).alias("class"), probability(l).alias("p"), (c("label") == l).alias("hit")) for l in labels]))
    long = pred.select(cells.alias("s")).select("s.*")
    grouped = long.groupBy("class", bin_of(c("p"), bins).alias("bin")).agg(
        F.count("*").alias("count"), F.avg("p").alias("mean_prediction"), F.avg(c("hit").cast("double")).alias("empirical_rate")
    )
    return expected_calibration_error(grouped, ["class"])


def calibration_slices(pred: DataFrame, label: str, bins: int = 5) -> DataFrame:
    """Calibration error by category and by offer band, both from one scan."""
    r = F.coalesce(c("offer_to_asking_ratio"), F.lit(0.0))
    offer = F.when(r < 0.7, "low_offer").when(r < 0.85, "middle_offer").otherwise("high_offer")
    cells = F.array(
        F.struct(F.lit("category").alias("dimension"), F.coalesce("category", F.lit("missing")).alias("slice")),
        F.struct(F.lit("offer_range").alias("dimension"), offer.alias("slice")),
    )
    long = pred.withColumn("_s", F.explode(cells)).select("*", "_s.dimension", "_s.slice")
    return expected_calibration_error(reliability(long, "label", bins, label, ["dimension", "slice"]), ["dimension", "slice"])


def calibration_drift(pred: DataFrame, label: str, ts: str, key: str, bins: int = 5) -> DataFrame:
    """Calibration error of the earlier and the later half."""
    placed = Sequence(pred.select(ts, key, "label", "probabilities"), [], [ts, key]).add(_pos=rank(), _n=total()).frame
    half = F.when(c("_pos") <= F.floor(c("_n") / 2), "early").otherwise("late")
    cells = reliability(placed.withColumn("half", half), "label", bins, label, ["half"])
    out = expected_calibration_error(cells, ["half"])

    def side(name: str, x: str) -> Column:
        return F.max(F.when(c("half") == name, c(x)))

    return out.agg(
        side("early", "ece").alias("early_ece"), side("late", "ece").alias("late_ece"),
        side("early", "n").alias("early_rows"), side("late", "n").alias("late_rows"),
    ).withColumn("drift", F.abs(c("late_ece") - c("early_ece")))


def cumulative_values(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Distinct values per key with count, cumulative count and total.

    Copies of a value collapse before the sort, so neither a hot value nor a hot key fills one task.
    """
    keys = keys or []
    counted = df.filter(c(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return Sequence(counted, keys, [value]).add(_cum=running_sum(c("_n")), _total=total(c("_n"))).frame


def quantile_place(q: float) -> Place:
    """Nearest rank; the index is rounded half to even."""
    return q, lambda n: F.bround((n - 1) * F.lit(q), 0)


MIDDLE: dict[str, Place] = {"_low": (0.5, lambda n: F.floor((n - 1) / 2)), "_high": (0.5, lambda n: F.ceil((n - 1) / 2))}


def nearest_rank(df: DataFrame, value: str, quantiles: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """Quantiles by nearest rank; the index is rounded half to even."""
    return values_at(df, value, {name: quantile_place(q) for name, q in quantiles.items()}, keys).drop("_total")


def median(df: DataFrame, value: str, keys: list[str] | None = None, name: str = "median") -> DataFrame:
    """Exact interpolated median."""
    at = values_at(df, value, MIDDLE, keys)
    return at.select(*(keys or []), ((c("_low") + c("_high")) / 2).alias(name))


def quantiles_and_median(df: DataFrame, value: str, quantiles: dict[str, float], keys: list[str] | None = None, name: str = "mid") -> DataFrame:
    """Nearest ranks and the interpolated median, found together."""
    at = values_at(df, value, {**MIDDLE, **{x: quantile_place(q) for x, q in quantiles.items()}}, keys)
    return at.select(*(keys or []), ((c("_low") + c("_high")) / 2).alias(name), *quantiles)


def interval_report(pred: DataFrame, train: DataFrame, label: str = "label_num", level: float = 0.8) -> DataFrame:
    """Intervals of +- the residual quantile around predictions: coverage, width against the label spread, pinball ratio."""
    mid = median(train, label).scalar()
    radius = nearest_rank(train.select(F.abs(c(label) - mid).alias("_r")), "_r", {"r": level}).scalar()
    spread = nearest_rank(train, label, {"a": 0.25, "b": 0.75}).select(c("b") - c("a")).scalar()
    rows = pred.select("*", radius.alias("_radius"), spread.alias("_iqr"), mid.alias("_mid"))
    inside = F.abs(c(label) - c("prediction")) <= c("_radius")
    return rows.agg(
        F.count("*").alias("n"),
        F.avg(inside.cast("double")).alias("coverage"),
        F.max("_radius").alias("radius"),
        F.max(F.when(c("_iqr") != 0, 2 * c("_radius") / c("_iqr"))).alias("width_to_iqr"),
        (F.avg(pinball(c(label), c("prediction"), 0.5)) / F.greatest(F.avg(pinball(c(label), c("_mid"), 0.5)), F.lit(1e-12))).alias("pinball_ratio"),
    )


NUMERIC = (
    "listing_price current_amount offer_to_asking_ratio round_number prior_turn_count prior_counter_count event_hour"
).split()
CATEGORICAL = "category condition current_actor current_action".split()


def support_profile(train: DataFrame, numeric: list[str] = NUMERIC) -> DataFrame:
    """One row: minimum and maximum of every numeric feature seen in training."""
    return train.agg(*[f(x).alias(f"{n}_{x}") for x in numeric for f, n in ((F.min, "min"), (F.max, "max"))])


def outside_support(df: DataFrame, train: DataFrame, numeric: list[str] = NUMERIC, categorical: list[str] = CATEGORICAL) -> DataFrame:
    """Flag ``outside``: a number outside the trained range or a category never trained on."""
    profile = support_profile(train, numeric)
    bounds = profile.select(F.struct(*profile.columns)).scalar()
    out = df.withColumn("_b", bounds)
    flag = F.lit(False)
    for x in numeric:
        v = F.coalesce(c(x).cast("double"), F.lit(0.0))
        flag = flag | F.coalesce((v < c(f"_b.min_{x}")) | (v > c(f"_b.max_{x}")), F.lit(False))
    for x in categorical:
        known = train.select(F.coalesce(x, F.lit("missing")).alias(f"_v_{x}")).distinct().withColumn(f"_h_{x}", F.lit(True))
        out = lookup(out.withColumn(f"_v_{x}", F.coalesce(c(x), F.lit("missing"))), known, [f"_v_{x}"])
        flag = flag | c(f"_h_{x}").isNull()
    return out.withColumn("outside", flag).drop("_b", *[f"{p}_{x}" for x in categorical for p in ("_v", "_h")])


def _poisson_edges() -> list[int]:
    """Poisson(1) distribution function at 0, 1, 2, ... in sixteen bits, as long as it can be told from 1."""
    edges, mass, acc = [], math.exp(-1.0), 0.0
    for k in range(12):
        acc += mass
        mass /= k + 1
        if round(acc * 65536) < 65536:
            edges.append(round(acc * 65536))
    return edges


POISSON_EDGES = _poisson_edges()


def bootstrap_brier(pred: DataFrame, label: str, key: str, samples: int = 200, seed: int = 7) -> DataFrame:
    """Resampling interval of the Brier score with Poisson(1) weights, in one pass and the same on any cluster.

    The SHA-256 of seed, block and key holds sixteen draws of sixteen bits. A task adds up weights and weighted errors of all
    samples in two arrays; rows are neither copied nor moved.
    """
    square = (probability(label) - F.when(c("label") == label, 1.0).otherwise(0.0)) ** 2
    blocks = -(-samples // 16)
    edges = np.array(POISSON_EDGES)

    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((2, samples))
        for batch in batches:
            keys = [k.encode() for k in batch["k"].to_pylist()]
            heads = [f"{seed}:{b}:".encode() for b in range(blocks)]
            raw = b"".join([hashlib.sha256(h + k).digest() for k in keys for h in heads])
            draws = np.frombuffer(raw, ">u2").reshape(len(keys), -1)[:, :samples]
            weight = np.searchsorted(edges, draws, side="right").astype(np.float64)
            out += np.stack([batch["s"].to_numpy(zero_copy_only=False) @ weight, weight.sum(axis=0)])
        return out.ravel()

    rows = pred.select(F.coalesce(c(key).cast("string"), F.lit("")).alias("k"), square.alias("s"))
    errors, weights = merged(rows, fold, 2 * samples).reshape(2, samples)
    brier = (errors / weights)[weights > 0]
    found = [float(v) for v in (brier.mean(), np.quantile(brier, 0.025), np.quantile(brier, 0.975))] if len(brier) else [None] * 3
    return pred.sparkSession.createDataFrame([(*found, len(brier))], "mean_brier double, low double, high double, samples long")


def leaderboard(scores: DataFrame, metric: str, baselines: list[str]) -> DataFrame:
    """Rank of models by (task, split) and improvement over the best baseline; one row per model goes in."""
    w = Window.partitionBy("task", "split")
    base = F.min(F.when(c("model_id").isin(baselines), c(metric))).over(w)
    return scores.withColumns(
        {
            "place": F.row_number().over(w.orderBy(metric, "complexity", "model_id")),
            "relative_improvement": F.when(base != 0, (base - c(metric)) / F.abs(base)).otherwise(0.0),
            "error_ratio": c(metric) / F.greatest(base, F.lit(1e-12)),
        }
    )


def select_model(board: DataFrame, metric: str, tolerance: float = 0.01, strict: bool = False) -> DataFrame:
    """One model per (task, split): within tolerance of the best, then simplest, best calibrated, widest coverage."""
    w = Window.partitionBy("task", "split")
    if strict:
        order = [c(metric), c("complexity"), c("model_id")]
        rows = board
    else:
        best = F.min(metric).over(w)
        rows = board.withColumn("_best", best).filter(c(metric) <= c("_best") + F.greatest(F.abs(c("_best")) * tolerance, F.lit(1e-12)))
        order = [c("complexity"), c("calibration_error"), c("coverage").desc(), c(metric), c("model_id")]
    return rows.withColumn("_r", F.row_number().over(w.orderBy(*order))).filter("_r = 1").drop("_r", "_best")


def pareto(scores: DataFrame, loss: str = "log_loss", cost: str = "complexity") -> DataFrame:
    """Rows that no other row beats on both loss and cost: a sort with a running minimum, no self join."""
    best = scores.groupBy(cost).agg(F.min(loss).alias("_best"))
    seq = Sequence(best, [], [cost]).add(_before=running_min(c("_best"), inclusive=False)).frame
    front = seq.filter(c("_before").isNull() | (c("_best") < c("_before"))).select(c(cost).alias("_cost"), "_best")
    return scores.join(front, (c(cost) == c("_cost")) & (c(loss) == c("_best")), "left_semi")


def paired_compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Mean paired log-loss improvement of b over a with its normal interval and win rate."""

    def loss(p: Column) -> Column:
        q = clip(p, 1e-6, 1 - 1e-6)
        return -(c("target") * F.log(q) + (1 - c("target")) * F.log(1 - q))

    both = a.select(key, "target", c("p").alias("pa")).join(b.select(key, c("p").alias("pb")), key)
    d = loss(c("pa")) - loss(c("pb"))
    out = both.select(d.alias("d")).agg(
        F.count("*").alias("n"), F.avg("d").alias("improvement"),
        (F.stddev_pop("d") / F.sqrt(F.count("*"))).alias("_se"), F.avg((c("d") > 0).cast("double")).alias("b_wins"),
    )
    return out.select(
        "n", "improvement", (c("improvement") - 1.96 * c("_se")).alias("low"), (c("improvement") + 1.96 * c("_se")).alias("high"), "b_wins"
    )


def residuals(pred: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows with the largest absolute error."""
    p = clip(c("p"), 1e-6, 1 - 1e-6)
    return pred.withColumn("absolute_error", F.abs(p - c("target"))).orderBy(F.desc("absolute_error"), key).limit(k)


def counterexamples(a: DataFrame, b: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows on which two models differ most."""
    both = a.select(key, "target", c("p").alias("p_a")).join(b.select(key, c("p").alias("p_b")), key)
    return both.withColumn("gap", F.abs(c("p_a") - c("p_b"))).orderBy(F.desc("gap"), key).limit(k)


def long_features(df: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    """One row per (row, feature): name and value."""
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.coalesce(c(x).cast("double"), F.lit(0.0)).alias("value")) for x in names]))
    return df.select(*keep, cells.alias("_f")).select(*keep, "_f.name", "_f.value")


def residual_terms(pred: DataFrame, names: list[str]) -> DataFrame:
    """Features by absolute correlation with the residual."""
    rows = long_features(pred.withColumn("_r", c("target") - c("p")), ["_r"], names)
    flat = (F.stddev_pop("value") <= 1e-9) | (F.stddev_pop("_r") <= 1e-9)
    return rows.groupBy("name").agg(F.when(flat, 0.0).otherwise(F.abs(F.corr("value", "_r"))).alias("association"))


def rank_features(rows: DataFrame, names: list[str]) -> DataFrame:
    """Features by standardised difference of the class means."""
    long = long_features(rows, ["target"], names)
    gap = F.abs(F.avg(F.when(c("target") == 1, c("value"))) - F.avg(F.when(c("target") == 0, c("value"))))
    return long.groupBy("name").agg(F.coalesce(gap / F.greatest(F.stddev_pop("value"), F.lit(1e-9)), F.lit(0.0)).alias("association"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("dimension"), F.coalesce(c(x).cast("string"), F.lit("missing")).alias("value")) for x in columns]))
    return df.select(cells.alias("s")).groupBy("s.dimension", "s.value").agg(F.count("*").alias("n"))


def tied_timestamps(df: DataFrame, ts: str) -> DataFrame:
    per = df.groupBy(ts).agg(F.count("*").alias("n"))
    return per.agg(F.count_if(c("n") > 1).alias("tied_timestamps"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_tie"))


def lineage(train: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Order-free fingerprint of training rows and of their feature values: count, sum and xor of marks."""

    def mark(*xs: str) -> Column:
        parts = [F.coalesce(c(x).cast("string"), F.lit("")) for x in xs]
        return F.conv(F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 15), 16, 10).cast("bigint")

    rows = train.select(mark(key, *columns).alias("r"), mark(*columns).alias("f"))
    wide = "decimal(20,0)"
    return rows.agg(
        F.count("*").alias("rows"), F.sum(c("r").cast(wide)).cast("string").alias("row_sum"), F.bit_xor("r").alias("row_xor"),
        F.sum(c("f").cast(wide)).cast("string").alias("feature_sum"),
    )


def rotate_labels(df: DataFrame, order: list[str], label: str, by: list[str] | None = None) -> DataFrame:
    """Every row takes the label of the next one, the last that of the first: same mix, no signal."""
    by = by or []
    rows = Sequence(df, by, order).add(_pos=rank(), _n=total()).frame
    following = rows.select(*by, (F.when(c("_pos") == 1, c("_n")).otherwise(c("_pos") - 1)).alias("_pos"), c(label).alias("_next"))
    return rows.join(following, [*by, "_pos"]).withColumn(label, c("_next")).drop("_pos", "_n", "_next")


def finite_check(pred: DataFrame, columns: list[str], maps: list[str] | None = None) -> DataFrame:
    """Rows with a number that is NULL, NaN or infinite, and in which columns."""

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    faults = [F.when(bad(c(x)), F.lit(x)) for x in columns]
    faults += [F.when(F.exists(F.map_values(m), bad), F.lit(m)) for m in maps or []]
    return pred.withColumn("faults", F.array_compact(F.array(*faults))).filter(F.size("faults") > 0)


def censoring_control(manifest: DataFrame) -> DataFrame:
    """What counting unknown and censored rows as rejections would add to each task; refused wherever it adds any."""
    lost = c("unknown") + c("censored")
    return manifest.select(
        "task", lost.alias("affected_rows"), (c("supervised") + lost).alias("variant_supervised"), (lost > 0).alias("variant_refused")
    )
