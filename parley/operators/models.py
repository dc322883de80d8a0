"""Transparent models as aggregates: a fit is a small frame, a prediction is a column or a join.

Label lists are given by the task, so class counts are conditional counts in one pass.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.scalars import bin_of, clip, logit, sigmoid
from parley.operators import fits
from parley.operators.joins import lookup
from parley.operators.metrics import cumulative_values, long_features, median, quantiles_and_median, rank_features
from parley.operators.sequence import Sequence, lead, rank, running_max, running_sum, total
from parley.session import stage

c = F.col

LABELS = {
    "seller_next_action": ["accept", "counter", "decline", "expire"],
    "buyer_response_to_counter": ["accept", "counter", "decline", "expire"],
    "agreement": ["0", "1"],
}


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct column (scalar subquery)."""
    return df.select(F.struct(*df.columns)).scalar()


def label_counts(train: DataFrame, labels: list[str], by: list[Column] | None = None, label: str = "label") -> DataFrame:
    return train.groupBy(*(by or [])).agg(*[F.count_if(c(label) == x).alias(x) for x in labels])


def normalised(raw: dict[str, Column]) -> dict[str, Column]:
    """Negative parts cut off, divided by the sum; uniform if nothing is left."""
    kept = {k: F.greatest(v.cast("double"), F.lit(0.0)) for k, v in raw.items()}
    whole = reduce(lambda a, b: a + b, kept.values())
    return {k: F.when(whole > 0, v / whole).otherwise(1.0 / len(raw)) for k, v in kept.items()}


def top_label(p: dict[str, Column]) -> Column:
    """Most probable label; the first of the list wins a tie."""
    entries = [F.struct(v.alias("p"), F.lit(-i).alias("i"), F.lit(k).alias("l")) for i, (k, v) in enumerate(p.items())]
    return F.array_max(F.array(*entries))["l"]


def with_prediction(df: DataFrame, p: dict[str, Column], prediction: Column | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    pairs = [x for k, v in p.items() for x in (F.lit(k), v)]
    return df.withColumns({"prediction": top_label(p) if prediction is None else prediction, "probabilities": F.create_map(*pairs)}).drop(*drop)


def _shares(counts: Column, labels: list[str], smoothing: float = 0.0) -> dict[str, Column]:
    whole = reduce(lambda a, b: a + b, [counts[x] for x in labels]) + smoothing * len(labels)
    return {x: F.when(whole > 0, (counts[x] + smoothing) / whole).otherwise(0.0) for x in labels}


def predict_majority(df: DataFrame, train: DataFrame, labels: list[str], smoothing: float = 0.0) -> DataFrame:
    """Class shares of training (with Laplace smoothing if asked)."""
    rows = df.withColumn("_m", one_row(label_counts(train, labels)))
    return with_prediction(rows, _shares(c("_m"), labels, smoothing), drop=("_m",))


def predict_category_majority(df: DataFrame, train: DataFrame, labels: list[str], category: str = "category") -> DataFrame:
    """Class shares of the row's category, of all training for a category never seen."""
    key = F.coalesce(c(category), F.lit("missing"))
    model = label_counts(train, labels, [key.alias("_cat")]).select("_cat", F.struct(*labels).alias("_c"))
    rows = lookup(df.withColumns({"_g": one_row(label_counts(train, labels)), "_cat": key}), model, ["_cat"])
    return with_prediction(rows, _shares(F.coalesce("_c", "_g"), labels), drop=("_cat", "_c", "_g"))


def _one_sided(label: Column, labels: list[str], normal: bool = True) -> dict[str, Column]:
    raw = {x: F.when(label == x, 0.85).otherwise(0.05) for x in labels}
    return normalised(raw) if normal else raw


def predict_threshold(df: DataFrame, accept: float = 0.85, counter: float = 0.65) -> DataFrame:
    """Rule on the offered share of the asking price."""
    r = F.coalesce(c("offer_to_asking_ratio"), F.lit(0.0))
    label = F.when(r >= accept, "accept").when(r >= counter, "counter").otherwise("decline")
    return with_prediction(df, _one_sided(label, LABELS["seller_next_action"], normal=False), label)


def predict_split_difference(df: DataFrame, labels: list[str]) -> DataFrame:
    r = F.coalesce(c("offer_to_asking_ratio"), F.lit(0.0))
    label = F.lit("decline" if "decline" in labels else labels[0])
    if "counter" in labels:
        label = F.when(r >= 0.5, "counter").otherwise(label)
    if "accept" in labels:
        label = F.when(r >= 0.875, "accept").otherwise(label)
    return with_prediction(df, _one_sided(label, labels), label)


def predict_prior_concession(df: DataFrame, train: DataFrame, labels: list[str]) -> DataFrame:
    """Counter after a counter; otherwise the class shares."""
    rows = df.withColumn("_m", one_row(label_counts(train, labels)))
    base = _shares(c("_m"), labels)
    if "counter" not in labels:
        return with_prediction(rows, base, drop=("_m",))
    told = F.coalesce(c("prior_counter_count") > 0, F.lit(False))
    strong = _one_sided(F.lit("counter"), labels)
    p = {x: F.when(told, strong[x]).otherwise(base[x]) for x in labels}
    return with_prediction(rows, p, F.when(told, "counter").otherwise(top_label(base)), drop=("_m",))


def offer_bin(bins: int = 8) -> Column:
    """Equal bins of the offer share clipped to [0, 1.5]."""
    r = clip(F.coalesce(c("offer_to_asking_ratio"), F.lit(0.0)), 0.0, 1.5)
    return F.least(F.floor(r / 1.5 * bins), F.lit(bins - 1)).cast("int")


def predict_histogram(df: DataFrame, train: DataFrame, labels: list[str], bins: int = 8, smoothing: float = 1.0) -> DataFrame:
    """Counts by (category, offer bin) smoothed with the overall counts."""
    key = F.coalesce(c("category"), F.lit("missing"))
    model = label_counts(train, labels, [key.alias("_cat"), offer_bin(bins).alias("_bin")]).select("_cat", "_bin", F.struct(*labels).alias("_c"))
    rows = df.withColumns({"_g": one_row(label_counts(train, labels)), "_cat": key, "_bin": offer_bin(bins)})
    rows = lookup(rows, model, ["_cat", "_bin"])
    raw = {x: F.coalesce(c("_c")[x], F.lit(0)) + smoothing * (c("_g")[x] + smoothing) for x in labels}
    return with_prediction(rows, normalised(raw), drop=("_cat", "_bin", "_c", "_g"))


STUMP_NUMBERS = ["offer_to_asking_ratio", "round_number", "prior_counter_count"]
STUMP_CATEGORIES = ["category", "current_action"]


def predict_stumps(df: DataFrame, train: DataFrame, labels: list[str]) -> DataFrame:
    """Votes of three median stumps and two categorical branches, plus one each."""
    long = long_features(train, [], STUMP_NUMBERS)
    cuts = median(long, "value", ["name"])
    cut = one_row(cuts.agg(*[F.max(F.when(c("name") == x, c("median"))).alias(x) for x in STUMP_NUMBERS]))

    def side(x: str) -> Column:
        return F.coalesce(c(x).cast("double"), F.lit(0.0)) >= c(f"_cut.{x}")

    placed = train.withColumn("_cut", cut)
    votes = placed.agg(
        *[F.count_if((side(x) == s) & (c("label") == y)).alias(f"{x}_{int(s)}_{y}") for x in STUMP_NUMBERS for s in (False, True) for y in labels]
    )
    rows = df.withColumns({"_cut": cut, "_v": one_row(votes)})
    for x in STUMP_CATEGORIES:
        branch = label_counts(train, labels, [F.coalesce(c(x), F.lit("missing")).alias(f"_k_{x}")])
        branch = branch.select(f"_k_{x}", F.struct(*labels).alias(f"_c_{x}"))
        rows = lookup(rows.withColumn(f"_k_{x}", F.coalesce(c(x), F.lit("missing"))), branch, [f"_k_{x}"])
    raw = {}
    for y in labels:
        parts = [F.when(side(x), c(f"_v.{x}_1_{y}")).otherwise(c(f"_v.{x}_0_{y}")) for x in STUMP_NUMBERS]
        parts += [F.coalesce(c(f"_c_{x}")[y], F.lit(0)) for x in STUMP_CATEGORIES]
        raw[y] = reduce(lambda a, b: a + b, parts) + 1.0
    drop = ("_cut", "_v", *[f"_k_{x}" for x in STUMP_CATEGORIES], *[f"_c_{x}" for x in STUMP_CATEGORIES])
    return with_prediction(rows, normalised(raw), drop=drop)


def pooled(values: Column, weights: Column, n: int) -> Column:
    """Weighted isotonic fit of a short array by the max-min formula over its n places.

    Place i gets the largest over a <= i of the smallest over b >= i of the mean of places a..b.
    """
    mass = [F.get(values, F.lit(i)) * F.get(weights, F.lit(i)) for i in range(n)]
    w = [F.get(weights, F.lit(i)) for i in range(n)]

    def mean(a: int, b: int) -> Column:
        return reduce(lambda x, y: x + y, mass[a : b + 1]) / reduce(lambda x, y: x + y, w[a : b + 1])

    def low(a: int, i: int) -> Column:
        tails = [mean(a, b) for b in range(i, n)]
        return F.least(*tails) if len(tails) > 1 else tails[0]

    fits = []
    for i in range(n):
        tops = [low(a, i) for a in range(i + 1)]
        fits.append(F.greatest(*tops) if len(tops) > 1 else tops[0])
    return F.array(*fits)


def monotone_curve(train: DataFrame, positive: str = "accept", bins: int = 8) -> DataFrame:
    """One row: acceptance rate by offer bin, (k + 1/2) / (n + 1), made non-decreasing."""
    counts = train.agg(
        F.array(*[F.count_if(offer_bin(bins) == b) for b in range(bins)]).alias("n"),
        F.array(*[F.count_if((offer_bin(bins) == b) & (c("label") == positive)) for b in range(bins)]).alias("k"),
    )
    rates = F.zip_with("k", "n", lambda k, n: (k + 0.5) / (n + 1.0))
    weights = F.transform("n", lambda n: F.greatest(n, F.lit(1)).cast("double"))
    return counts.select("n", rates.alias("rates"), weights.alias("weights")).select(
        "n", "rates", pooled(c("rates"), c("weights"), bins).alias("curve")
    )


def predict_monotone(df: DataFrame, train: DataFrame, labels: list[str], positive: str = "accept", bins: int = 8) -> DataFrame:
    others = [x for x in labels if x != positive]
    curve = monotone_curve(train, positive, bins).select("curve").scalar()
    rows = df.withColumns({"_curve": curve, "_g": one_row(label_counts(train, labels))})
    p = F.get("_curve", offer_bin(bins))
    rest = reduce(lambda a, b: a + b, [c("_g")[x] for x in others])
    raw = {x: p if x == positive else (1 - p) * (c("_g")[x] + 1.0) / (rest + len(others)) for x in labels}
    return with_prediction(rows, normalised(raw), drop=("_curve", "_g"))


def predict_glm(df: DataFrame, train: DataFrame, labels: list[str], numeric: list[str], categorical: list[str], l2: float = 0.05) -> DataFrame:
    """Multinomial logistic regression with an L2 penalty; training rows with other labels take no part."""
    how, fit = fit_glm(train, labels, numeric, categorical, l2)
    rows, margins = fits.scores(df, how, fit.T)
    rows = rows.withColumns({f"_p{i}": p for i, p in enumerate(fits.softmax(margins))})
    return with_prediction(rows, {x: c(f"_p{i}") for i, x in enumerate(labels)}).select(*df.columns, "prediction", "probabilities")


def fit_glm(train: DataFrame, labels: list[str], numeric: list[str], categorical: list[str], l2: float = 0.05) -> tuple[fits.Design, np.ndarray]:
    """The design and the coefficients, one line for each label."""
    how = fits.design(train, numeric, categorical)
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), c("label")) - 1
    rows = how.rows(train.filter(c("label").isin(labels)), place)
    return how, fits.multinomial(rows, how.width, len(labels), l2)


def fit_ridge(train: DataFrame, numeric: list[str], categorical: list[str], l2: float = 0.05) -> tuple[fits.Design, np.ndarray]:
    """The design and the coefficients of a linear fit of label_num with an L2 penalty."""
    how = fits.design(train, numeric, categorical)
    return how, fits.ridge(how.rows(train, c("label_num")), how.width, l2)


def predict_ridge(df: DataFrame, train: DataFrame, numeric: list[str], categorical: list[str], l2: float = 0.05) -> DataFrame:
    """Linear regression with an L2 penalty."""
    how, fit = fit_ridge(train, numeric, categorical, l2)
    rows, (margin,) = fits.scores(df, how, fit[:, None])
    return rows.withColumn("prediction", margin).select(*df.columns, "prediction")


def _ratio() -> Column:
    return F.coalesce(c("offer_to_asking_ratio"), F.lit(0.0))


def regression_baselines(df: DataFrame, train: DataFrame) -> DataFrame:
    """Predictions of all regression baselines, one row per (row, model), with intervals where the model has them."""
    key = F.coalesce(c("category"), F.lit("missing"))
    levels = {"lower": 0.1, "median": 0.5, "upper": 0.9}
    # label by category, label of all rows and offer ratio: all quantiles are found in one go
    def told(of: str, category: Column, value: Column) -> Column:
        return F.struct(F.lit(of).alias("of"), category.alias("_cat"), value.cast("double").alias("v"))

    none = F.lit(None).cast("string")
    told = F.array(told("cat", key, c("label_num")), told("all", none, c("label_num")), told("ratio", none, _ratio()))
    found = stage(quantiles_and_median(train.select(F.explode(told).alias("x")).select("x.*"), "v", levels, ["of", "_cat"]))
    by_cat = found.filter("of = 'cat'").select("_cat", c("mid").alias("cat_median"), *levels)
    cut = found.filter("of = 'ratio'").select(c("mid").alias("cut")).scalar()
    split = train.withColumn("_cut", cut)
    y, r, k = c("label_num"), _ratio(), F.coalesce(c("prior_counter_count"), F.lit(0))
    fit = one_row(
        split.agg(
            F.avg(y).alias("mean"),
            F.coalesce(F.try_divide(F.sum(r * y), F.sum(r * r)), F.lit(1.0)).alias("slope"),
            F.coalesce(F.avg(F.when(k > 0, y)), F.avg(y)).alias("told"),
            F.coalesce(F.avg(F.when(k <= 0, y)), F.avg(y)).alias("untold"),
            F.max("_cut").alias("cut"),
            F.coalesce(F.avg(F.when(r < c("_cut"), y)), F.avg(y)).alias("left"),
            F.coalesce(F.avg(F.when(r >= c("_cut"), y)), F.avg(y)).alias("right"),
        )
    )
    whole = one_row(found.filter("of = 'all'").select("mid", *levels))
    rows = lookup(df.withColumns({"_f": fit, "_w": whole, "_cat": key}), by_cat, ["_cat"])
    listing = c("listing_price")

    def model(name: str, value: Column, lower: Column | None = None, upper: Column | None = None) -> Column:
        none = F.lit(None).cast("double")
        return F.struct(
            F.lit(name).alias("model_id"), value.cast("double").alias("prediction"),
            (none if lower is None else lower).alias("lower"), (none if upper is None else upper).alias("upper"),
        )

    models = F.array(
        model("median_regressor", c("_w.mid")),
        model("category_median_regressor", F.coalesce(c("cat_median"), c("_w.mid"))),
        model(
            "empirical_category_quantiles", F.coalesce(c("median"), c("_w.median")),
            F.coalesce(c("lower"), c("_w.lower")), F.coalesce(c("upper"), c("_w.upper")),
        ),
        model("offer_ratio_heuristic_regressor", r * c("_f.slope")),
        model("split_the_difference_regressor", F.when(listing != 0, ((F.coalesce(c("current_amount"), F.lit(0.0)) + listing) / 2) / listing).otherwise(0.0)),
        model("prior_concession_regressor", c("_f.mean") + (c("_f.told") - c("_f.untold")) * F.least(k, F.lit(1))),
        model("small_tree_regressor", F.when(r >= c("_f.cut"), c("_f.right")).otherwise(c("_f.left"))),
    )
    return rows.select("row_id", "label_num", F.explode(models).alias("m")).select("row_id", "label_num", "m.*")


def formula_terms() -> dict[str, Column]:
    """Term columns that formulas are built of; a missing number reads as zero."""
    amount = F.coalesce(c("current_amount"), F.lit(0.0))
    listing = F.coalesce(c("listing_price"), F.lit(0.0))
    rounds = F.coalesce(c("round_number"), F.lit(0)).cast("double")
    counters = F.coalesce(c("prior_counter_count"), F.lit(0)).cast("double")
    r = _ratio()
    return {
        "relative_offer": r,
        "gap_to_listing": F.when(listing != 0, (listing - amount) / listing).otherwise(0.0),
        "round_number": rounds,
        "timing_hour": F.coalesce(c("event_hour"), F.lit(0.0)) / 24.0,
        "seller_experience": counters,
        "prior_counter_count": counters,
        "listing_price_ratio": F.when(listing != 0, amount / listing).otherwise(0.0),
        "category_refurbished": F.when(F.lower("category").contains("refurbished"), 1.0).otherwise(0.0),
        "relative_offer_below_70": F.when(r < 0.70, 1.0).otherwise(0.0),
        "relative_offer_above_85": F.when(r >= 0.85, 1.0).otherwise(0.0),
        "relative_offer_x_round": r * rounds,
    }


# The stock formulas as (target label, terms).
FORMULAS = {
    "formula_relative_offer_accept": ("accept", ["relative_offer", "gap_to_listing", "round_number"]),
    "formula_low_offer_decline": ("decline", ["relative_offer_below_70", "gap_to_listing", "seller_experience"]),
    "formula_concession_counter": ("counter", ["relative_offer", "prior_counter_count", "round_number"]),
    "formula_timing_category_interaction": ("counter", ["timing_hour", "category_refurbished", "relative_offer_x_round"]),
    "formula_listing_price_threshold": ("accept", ["listing_price_ratio", "relative_offer_above_85", "round_number"]),
}


def fit_formulas(train: DataFrame, formulas: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """One row with intercept and coefficients of every formula: one aggregation for all of them."""
    terms = formula_terms()
    aggs = []
    for name, (target, used) in formulas.items():
        is_target = F.coalesce(c("label") == target, F.lit(False))
        rate = (F.count_if(is_target) + 0.5) / (F.count("*") + 1.0)
        aggs.append(F.log(rate / F.greatest(1 - rate, F.lit(1e-9))).alias(f"{name}__intercept"))
        for x in used:
            inside = F.coalesce(F.avg(F.when(is_target, terms[x])), F.lit(0.0))
            outside = F.coalesce(F.avg(F.when(~is_target, terms[x])), F.lit(0.0))
            aggs.append((inside - outside).alias(f"{name}__{x}"))
    return train.agg(*aggs)


def predict_formulas(
    df: DataFrame, train: DataFrame, labels: list[str], formulas: dict[str, tuple[str, list[str]]] = FORMULAS
) -> DataFrame:
    """Predictions of every formula, one row per (row, formula)."""
    terms = formula_terms()
    rows = df.withColumns({"_f": one_row(fit_formulas(train, formulas)), "_g": one_row(label_counts(train, labels))})
    models = []
    for name, (target, used) in formulas.items():
        score = reduce(lambda a, b: a + b, [c(f"_f.{name}__{x}") * terms[x] for x in used], c(f"_f.{name}__intercept"))
        models.append(F.struct(F.lit(name).alias("model_id"), F.lit(target).alias("target"), score.alias("score")))
    long = rows.select(*df.columns, "_g", F.explode(F.array(*models)).alias("_m"))
    long = long.withColumn("_p", 1 / (1 + F.exp(-clip(c("_m.score"), -20, 20))))
    # the probability left by the target is shared by the smoothed counts of the other labels
    hit = {x: c("_m.target") == x for x in labels}
    rest = reduce(lambda a, b: a + b, [F.when(hit[x], 0).otherwise(c("_g")[x]) for x in labels])
    long = long.withColumn("_rest", rest + len(labels) - 1)
    raw = {x: F.when(hit[x], c("_p")).otherwise((1 - c("_p")) * (c("_g")[x] + 1.0) / c("_rest")) for x in labels}
    return with_prediction(long.withColumn("model_id", c("_m.model_id")), normalised(raw), drop=("_g", "_m", "_p", "_rest"))


def smoothed_rate(hits: Column, n: Column) -> Column:
    return (hits + 1.0) / (n + 2.0)


def predict_base_rate(df: DataFrame, train: DataFrame) -> DataFrame:
    rate = train.agg(smoothed_rate(F.sum("target"), F.count("*"))).scalar()
    return df.withColumn("p", rate)


def predict_recent(df: DataFrame, train: DataFrame, ts: str, key: str, k: int = 25) -> DataFrame:
    """Smoothed rate of the last k training rows."""
    last = train.orderBy(F.desc(ts), F.desc(key)).limit(k)
    return df.withColumn("p", last.agg(smoothed_rate(F.sum("target"), F.count("*"))).scalar())


def threshold_candidates(train: DataFrame, names: list[str]) -> DataFrame:
    """In-sample log loss of every cut point of each variable.

    Cut points lie between neighbouring distinct values; what lies on each side comes from running
    sums over those values, so rows are aggregated once and never paired with candidates.
    """
    long = long_features(train, ["target"], names)
    values = long.groupBy("name", "value").agg(F.count("*").alias("n"), F.sum(c("target").cast("long")).alias("k"))
    seq = Sequence(values, ["name"], ["value"]).add(
        _next=lead(c("value")), low_n=running_sum(c("n")), low_k=running_sum(c("k")), _n=total(c("n")), _k=total(c("k"))
    ).frame
    rows = seq.filter(c("_next").isNotNull())
    high_n, high_k = c("_n") - c("low_n"), c("_k") - c("low_k")
    low_p, high_p = smoothed_rate(c("low_k"), c("low_n")), smoothed_rate(high_k, high_n)
    loss = -(
        c("low_k") * F.log(low_p) + (c("low_n") - c("low_k")) * F.log(1 - low_p) + high_k * F.log(high_p) + (high_n - high_k) * F.log(1 - high_p)
    ) / c("_n")
    return rows.select(
        "name", ((c("value") + c("_next")) / 2).alias("threshold"), low_p.alias("low_rate"), high_p.alias("high_rate"), loss.alias("log_loss")
    )


def fit_threshold(train: DataFrame, names: list[str]) -> DataFrame:
    """One row: the best of all cuts; earlier variables and smaller thresholds win ties."""
    found = threshold_candidates(train, names)
    place = F.array_position(F.array(*[F.lit(x) for x in names]), c("name"))
    return found.orderBy("log_loss", place, "threshold").limit(1)


def predict_threshold_rule(df: DataFrame, rule: DataFrame, names: list[str]) -> DataFrame:
    """Rate of the side that the rule's variable falls on."""
    rows = df.withColumn("_r", one_row(rule))
    value = reduce(lambda a, x: F.when(c("_r.name") == x, F.coalesce(c(x).cast("double"), F.lit(0.0))).otherwise(a), names, F.lit(0.0))
    return rows.withColumn("p", F.when(value > c("_r.threshold"), c("_r.high_rate")).otherwise(c("_r.low_rate"))).drop("_r")


def _scales(train: DataFrame, names: list[str]) -> Column:
    aggs = []
    for x in names:
        v = F.coalesce(c(x).cast("double"), F.lit(0.0))
        aggs += [F.avg(v).alias(f"m_{x}"), F.when(F.stddev_pop(v) > 1e-9, F.stddev_pop(v)).otherwise(1.0).alias(f"s_{x}")]
    return one_row(train.agg(*aggs))


def standardised(df: DataFrame, train: DataFrame, names: list[str]) -> DataFrame:
    """Array ``z`` of standardised values."""
    rows = df.withColumn("_s", _scales(train, names))
    z = [(F.coalesce(c(x).cast("double"), F.lit(0.0)) - c(f"_s.m_{x}")) / c(f"_s.s_{x}") for x in names]
    return rows.withColumn("z", F.array(*z)).drop("_s")


def _square_distance(z: Column, centre: list[float]) -> Column:
    parts = [(F.get(z, F.lit(i)) - F.lit(float(v))) ** 2 for i, v in enumerate(centre)]
    return reduce(lambda a, b: a + b, parts)


def predict_two_state(df: DataFrame, train: DataFrame, names: list[str], max_features: int | None = None, rounds: int = 20) -> DataFrame:
    """Two clusters of the standardised features; the rate is mixed by closeness to each.

    Only the two centres (a number per feature each) come to the driver between rounds. A state without
    training rows has the overall rate.
    """
    strongest = rank_features(train, names).orderBy(F.desc("association"), "name")
    used = [r["name"] for r in (strongest if max_features is None else strongest.limit(max_features)).collect()]
    rows = stage(standardised(train, train, used).select("z", "target"))
    first = rows.agg(F.min("z")).first()[0]
    second = rows.agg(F.max_by("z", F.struct(_square_distance(c("z"), first), "z"))).first()[0]
    centres = [list(first), list(second)]
    for _ in range(rounds):
        state = F.when(_square_distance(c("z"), centres[0]) <= _square_distance(c("z"), centres[1]), 0).otherwise(1)
        means = rows.groupBy(state.alias("s")).agg(F.array(*[F.avg(F.get("z", F.lit(i))) for i in range(len(used))]).alias("m"))
        moved = {r["s"]: list(r["m"]) for r in means.collect()}
        fresh = [moved.get(i, centres[i]) for i in (0, 1)]
        if fresh == centres:
            break
        centres = fresh
    state = F.when(_square_distance(c("z"), centres[0]) <= _square_distance(c("z"), centres[1]), 0).otherwise(1)
    overall = smoothed_rate(F.sum("target"), F.count("*"))
    rates = rows.select(state.alias("s"), "target").agg(
        *[F.when(F.count_if(c("s") == i) == 0, overall).otherwise(smoothed_rate(F.sum(F.when(c("s") == i, c("target"))), F.count_if(c("s") == i))).alias(f"r{i}") for i in (0, 1)]
    )
    scored = standardised(df, train, used).withColumn("_r", one_row(rates))
    w = [F.exp(-F.least(_square_distance(c("z"), centre), F.lit(50.0))) for centre in centres]
    return scored.withColumn("p", (w[0] * c("_r.r0") + w[1] * c("_r.r1")) / (w[0] + w[1])).drop("_r", "z")


def candidate_terms(train: DataFrame, names: list[str], limit: int | None = None) -> dict[str, Column]:
    """Plain features, indicators of their upper median, and products of two, strongest features first."""
    ranked = [r["name"] for r in rank_features(train, names).orderBy(F.desc("association"), "name").collect()]
    at = cumulative_values(long_features(train, [], ranked), "value", ["name"])
    middle = F.floor(c("_total") / 2)
    picks = at.filter((middle >= c("_cum") - c("_n")) & (middle < c("_cum")))
    cuts = {r["name"]: r["value"] for r in picks.collect()}

    def v(x: str) -> Column:
        return F.coalesce(c(x).cast("double"), F.lit(0.0))

    out = {x: v(x) for x in ranked}
    out.update({f"indicator({x} > {cuts[x]:.6g})": F.when(v(x) > cuts[x], 1.0).otherwise(0.0) for x in ranked if x in cuts})
    out.update({f"{a} * {b}": v(a) * v(b) for i, a in enumerate(ranked) for b in ranked[i + 1 :]})
    return dict(list(out.items())[:limit])


def forward_select(train: DataFrame, dev: DataFrame, names: list[str], max_terms: int = 5, limit: int | None = None, l2: float = 0.01) -> tuple[list[str], DataFrame]:
    """Greedy choice of formula terms by development log loss, and the development rows with p.

    Every open term of a round is fitted and judged; the best stays as long as the loss falls. Terms are standardised.
    """
    terms = candidate_terms(train, names, limit)

    def built(df: DataFrame) -> DataFrame:
        x = F.array(*[v.cast("double") for v in terms.values()])
        return stage(df.select(x.alias("x"), c("target").cast("double").alias("y")))

    chosen, fit, (mean, std) = fits.forward(built(train), built(dev), len(terms), max_terms, l2)
    columns = list(terms.values())
    parts = [(columns[t].cast("double") - F.lit(float(mean[t]))) / F.lit(float(std[t])) * F.lit(float(b)) for t, b in zip(chosen, fit[1:], strict=True)]
    p = sigmoid(reduce(lambda a, b: a + b, parts, F.lit(float(fit[0]))))
    return [list(terms)[t] for t in chosen], dev.withColumn("p", p)


def platt(pred: DataFrame) -> DataFrame:
    """Sigmoid recalibration of p against the 0/1 target: intercept and slope on the logit of p."""
    rows = stage(pred.select(F.array(F.lit(1.0), logit(c("p"))).alias("z"), F.array().cast("array<int>").alias("k"), c("target").cast("double").alias("y")))
    intercept, slope = (float(b) for b in fits.logistic(rows, 2, 0.0))
    return pred.withColumn("calibrated", sigmoid(F.lit(intercept) + F.lit(slope) * logit(c("p"))))


def isotonic(pred: DataFrame) -> DataFrame:
    """Monotone recalibration of p; equal p are pooled before the fit."""
    points = stage(pred.groupBy("p").agg(F.sum(c("target").cast("long")).alias("s"), F.count("*").alias("w")))
    pools = fits.monotone(points, "p", "s", "w")
    starts = pools.select(c("low").alias("p"), (c("total") / c("weight")).alias("fit"))
    # places in order carry the value of the last pool that began; values rise from pool to pool
    both = points.filter(c("p").isNotNull()).select("p", F.lit(None).cast("double").alias("fit"), F.lit(1).alias("asked")).unionByName(starts.withColumn("asked", F.lit(0)))
    curve = Sequence(both, [], ["p", "asked"]).add(calibrated=running_max(c("fit"))).frame.filter("asked = 1").select("p", "calibrated")
    return lookup(pred, curve, ["p"])


def counter_frontier(contexts: DataFrame, history: DataFrame, k: int = 5) -> DataFrame:
    """Candidate counters with the answers to the k most similar past offers of the category.

    contexts: context_id, category, listing_price, counter_amounts (array). history: category, ratio, label, seq (unique number).
    History is ranked by ratio inside its category; a candidate meets only the k ranks on either side
    of its place, by an equi-join on (category, rank), so no category is ever paired with itself.
    """
    cand = contexts.filter("listing_price > 0").select(
        "context_id", "category", "listing_price", F.explode("counter_amounts").alias("counter_amount")
    ).withColumn("ratio", c("counter_amount") / c("listing_price"))
    span = history.filter("ratio > 0").groupBy("category").agg(F.min("ratio").alias("_lo"), F.max("ratio").alias("_hi"), F.count("*").alias("support"))

    # place of every distinct (category, ratio) asked for: how many history rows lie at or below it
    asked = cand.select("category", "ratio").distinct()
    marks = history.select("category", "ratio", F.lit(0).alias("asked"), c("seq")).unionByName(
        asked.select("category", "ratio", F.lit(1).alias("asked"), F.lit(0).cast("long").alias("seq"))
    )
    placed = Sequence(marks, ["category"], ["ratio", "asked", "seq"]).add(place=running_sum(1 - c("asked"))).frame
    ups = placed.filter("asked = 0").select("category", "place", "ratio", "seq")
    # below the candidate the smallest seq of equal ratios must come last
    downs = Sequence(history.select("category", "ratio", (-c("seq")).alias("_neg")), ["category"], ["ratio", "_neg"]).add(place=rank()).frame
    near = placed.filter("asked = 1").select("category", c("ratio").alias("_asked"), "place")
    above = near.select("category", "_asked", F.explode(F.sequence(c("place") + 1, c("place") + k)).alias("place")).join(ups, ["category", "place"])
    below = near.select("category", "_asked", F.explode(F.sequence(c("place") - (k - 1), c("place"))).alias("place")).join(
        downs.select("category", "place", "ratio", (-c("_neg")).alias("seq")), ["category", "place"]
    )
    both = above.select("category", "_asked", "ratio", "seq").unionByName(below.select("category", "_asked", "ratio", "seq"))
    # at most 2k rows per asked ratio
    w = Window.partitionBy("category", "_asked").orderBy(F.abs(c("ratio") - c("_asked")), "seq")
    best = both.withColumn("_r", F.row_number().over(w)).filter(c("_r") <= k).join(history.select("seq", "label"), "seq")
    state = F.when(c("label").isin("accept", "counter"), c("label")).otherwise("exit")
    answers = best.groupBy("category", "_asked").agg(
        F.count("*").alias("comparables"), *[F.avg((state == s).cast("double")).alias(f"p_{s}") for s in ("accept", "counter", "exit")]
    )
    p = [c(f"p_{s}") for s in ("accept", "counter", "exit")]
    entropy = reduce(lambda a, b: a + b, [F.when(x > 0, -x * F.log2(x)).otherwise(0.0) for x in p])
    out = cand.join(span, "category", "left").withColumn("supported", F.coalesce(c("ratio").between(c("_lo"), c("_hi")), F.lit(False)))
    answers = answers.withColumnRenamed("category", "_answered")
    joined = out.join(answers, (c("category") == c("_answered")) & (c("ratio") == c("_asked")), "left").drop("_answered")
    shown = {x: F.when(c("supported"), c(x)) for x in ("comparables", "p_accept", "p_counter", "p_exit")}
    return joined.withColumns({**shown, "expected_rounds": F.when(c("supported"), 1 + c("p_counter")), "entropy": F.when(c("supported"), entropy)}).select(
        "context_id", "category", "ratio", "counter_amount", "supported", "support", "comparables",
        "p_accept", "p_counter", "p_exit", "expected_rounds", "entropy",
    )
