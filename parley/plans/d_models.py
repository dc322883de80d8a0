"""Models as aggregates, scoring, calibration, selection, controls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.scalars import clip
from parley.operators import cases as K
from parley.operators import metrics as E
from parley.operators import models as M
from parley.operators import splits as P
from parley.plans import bindings as B
from parley.plans.c_splits import CHRONO, region_sql
from parley.plans.registry import Tables, ctes, query
from parley.session import stage

c = F.col

NAMES = M.LABELS["seller_next_action"]
TASK = "seller_next_action"

SUP = """
sup AS (SELECT *, label_str AS label, coalesce(offer_to_asking_ratio, 0) AS r FROM kept WHERE task = 'seller_next_action' AND label_str IS NOT NULL),
train AS (SELECT * FROM sup WHERE region = 'train'),
dev AS (SELECT * FROM sup WHERE region = 'development')
"""
DATA = ctes(B.CASES, CHRONO, SUP)


def regions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter(c("region") == "train"), rows.filter(c("region") == "development")


def shown(pred: DataFrame) -> DataFrame:
    return pred.select("row_id", "prediction", F.round(E.probability(c("label")), 6).alias("p_label"))


def counts_sql(name: str) -> str:
    return f"count(CASE WHEN label = '{name}' THEN 1 END)"


def wide_sql(source: str, key: str = "") -> str:
    """Class counts as columns."""
    cols = ", ".join(f"{counts_sql(x)} AS {x}" for x in NAMES)
    return f"SELECT {key + ', ' if key else ''}{cols} FROM {source}{' GROUP BY ' + key if key else ''}"


def best_sql(values: dict[str, str]) -> str:
    """First label with the largest value."""
    top = f"greatest({', '.join(values.values())})"
    return "CASE " + " ".join(f"WHEN {v} = {top} THEN '{k}'" for k, v in values.items()) + " END"


def own_sql(values: dict[str, str], label: str = "label") -> str:
    return f"CASE {label} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def scored_sql(raw: dict[str, str], source: str) -> str:
    """Predictions from unnormalised weights."""
    whole = " + ".join(f"({v})" for v in raw.values())
    inner = ", ".join(f"({v})::DOUBLE / ({whole}) AS p_{k}" for k, v in raw.items())
    p = {k: f"p_{k}" for k in raw}
    return f"SELECT row_id, {best_sql(p)} AS prediction, round({own_sql(p)}, 6) AS p_label FROM (SELECT d.row_id, d.label, {inner} FROM {source})"


@query("d01_majority", DATA + scored_sql({x: f"g.{x}" for x in NAMES}, f"dev d, ({wide_sql('train')}) g"))
def d01(t: Tables) -> DataFrame:
    train, dev = regions(B.split_cases(t, TASK))
    return shown(M.predict_majority(dev, train, NAMES))


@query("d01_base_rate", DATA + scored_sql({x: f"(g.{x} + 1)" for x in NAMES}, f"dev d, ({wide_sql('train')}) g"))
def d01_laplace(t: Tables) -> DataFrame:
    train, dev = regions(B.split_cases(t, TASK))
    return shown(M.predict_majority(dev, train, NAMES, smoothing=1.0))


@query(
    "d02_category_majority",
    DATA
    + scored_sql({x: f"coalesce(m.{x}, g.{x})" for x in NAMES}, f"dev d LEFT JOIN ({wide_sql('train', 'category')}) m USING (category), ({wide_sql('train')}) g"),
)
def d02(t: Tables) -> DataFrame:
    train, dev = regions(B.split_cases(t, TASK))
    return shown(M.predict_category_majority(dev, train, NAMES))


MODEL_LOSS = """
p AS (SELECT d.task, {own}::DOUBLE / (m.accept + m.counter + m.decline + m.expire) AS q
      FROM dev d JOIN ({model}) m USING (category))
SELECT count(*) AS n, round(avg(-ln(greatest(least(q, 1 - 1e-12), 1e-12))), 6) AS log_loss FROM p
"""


@query(
    "flagship_next_action",
    DATA.rstrip() + ",\n" + MODEL_LOSS.format(own=own_sql({x: f"m.{x}" for x in NAMES}), model=wide_sql("train", "category")).strip(),
)
def flagship(t: Tables) -> DataFrame:
    train, dev = regions(B.split_cases(t, TASK))
    scores = E.score_multiclass(M.predict_category_majority(dev, train, NAMES), NAMES)
    return scores.select("n", F.round("log_loss", 6).alias("log_loss"))


@query(
    "d03_threshold_rule",
    DATA
    + """
    SELECT row_id, prediction, CASE WHEN prediction = label THEN 0.85::DOUBLE ELSE 0.05::DOUBLE END AS p_label FROM (
      SELECT *, CASE WHEN r >= 0.85 THEN 'accept' WHEN r >= 0.65 THEN 'counter' ELSE 'decline' END AS prediction FROM dev)
    """,
)
def d03(t: Tables) -> DataFrame:
    return shown(M.predict_threshold(regions(B.split_cases(t, TASK))[1]))


@query(
    "d03_split_difference",
    DATA
    + """
    SELECT row_id, prediction, round(CASE WHEN prediction = label THEN 0.85 ELSE 0.05 END::DOUBLE, 6) AS p_label FROM (
      SELECT *, CASE WHEN r >= 0.875 THEN 'accept' WHEN r >= 0.5 THEN 'counter' ELSE 'decline' END AS prediction FROM dev)
    """,
)
def d03_split(t: Tables) -> DataFrame:
    return shown(M.predict_split_difference(regions(B.split_cases(t, TASK))[1], NAMES))


@query(
    "d03_prior_concession",
    DATA
    + scored_sql(
        {x: f"CASE WHEN prior_counter_count > 0 THEN {0.85 if x == 'counter' else 0.05} ELSE g.{x} END::DOUBLE" for x in NAMES},
        f"dev d, ({wide_sql('train')}) g",
    ),
)
def d03_prior(t: Tables) -> DataFrame:
    train, dev = regions(B.split_cases(t, TASK))
    return shown(M.predict_prior_concession(dev, train, NAMES))


BIN = "least(floor(greatest(least(r, 1.5), 0) / 1.5 * 8), 7)"


@query(
    "d04_histogram",
    DATA
    + scored_sql(
        {x: f"coalesce(m.{x}, 0) + 1.0 * (g.{x} + 1.0)" for x in NAMES},
        f"(SELECT *, {BIN} AS bin FROM dev) d LEFT JOIN ({wide_sql(f'(SELECT *, {BIN} AS bin FROM train)', 'category, bin')}) m USING (category, bin), "
        f"({wide_sql('train')}) g",
    ),
)
def d04(t: Tables) -> DataFrame:
    train, dev = regions(B.split_cases(t, TASK))
    return shown(M.predict_histogram(dev, train, NAMES))


STUMP_NAMES = {"offer_to_asking_ratio": "r", "round_number": "round_number", "prior_counter_count": "prior_counter_count"}


def stump_sql() -> str:
    joins, raw = [], {x: [] for x in NAMES}
    for i, col in enumerate(STUMP_NAMES.values()):
        cut = f"(SELECT quantile_cont({col}::DOUBLE, 0.5) FROM train)"
        joins.append(f"LEFT JOIN ({wide_sql(f'(SELECT *, {col} >= {cut} AS s{i} FROM train)', f's{i}')}) m{i} ON m{i}.s{i} = (d.{col} >= {cut})")
        for x in NAMES:
            raw[x].append(f"coalesce(m{i}.{x}, 0)")
    for i, col in enumerate(M.STUMP_CATEGORIES):
        joins.append(f"LEFT JOIN ({wide_sql('train', col)}) k{i} ON k{i}.{col} = d.{col}")
        for x in NAMES:
            raw[x].append(f"coalesce(k{i}.{x}, 0)")
    return scored_sql({x: " + ".join(v) + " + 1.0" for x, v in raw.items()}, "dev d " + " ".join(joins))


@query("d05_stumps", DATA + stump_sql())
def d05(t: Tables) -> DataFrame:
    train, dev = regions(B.split_cases(t, TASK))
    return shown(M.predict_stumps(dev, train, NAMES))


CURVE = f"""
cells AS (
  SELECT i::INTEGER AS bin, count(label) AS n, count(CASE WHEN label = 'accept' THEN 1 END) AS k
  FROM range(8) s(i) LEFT JOIN (SELECT label, {BIN} AS b FROM train) ON b = i GROUP BY i),
rates AS (SELECT *, (k + 0.5) / (n + 1.0) AS rate, greatest(n, 1) AS w FROM cells),
spans AS (
  SELECT a.bin AS a, b.bin AS b, (SELECT sum(rate * w) / sum(w) FROM rates x WHERE x.bin BETWEEN a.bin AND b.bin) AS m
  FROM rates a JOIN rates b ON a.bin <= b.bin),
lows AS (SELECT r.bin, s.a, min(s.m) AS low FROM rates r JOIN spans s ON s.a <= r.bin AND s.b >= r.bin GROUP BY 1, 2),
fit AS (SELECT r.bin, r.n, r.rate, max(low) AS p FROM rates r JOIN lows USING (bin) GROUP BY r.bin, r.n, r.rate)
"""
REST = "(1 - f.p) * (g.{x} + 1.0) / (g.counter + g.decline + g.expire + 3)"


@query("d06_monotone_curve", DATA.rstrip() + ",\n" + CURVE.strip() + " SELECT bin, n, round(rate, 6) AS rate, round(p, 6) AS fitted FROM fit")
def d06(t: Tables) -> DataFrame:
    train, _ = regions(B.split_cases(t, TASK))
    rows = M.monotone_curve(train).select(F.posexplode(F.arrays_zip("n", "rates", "curve")).alias("bin", "s"))
    return rows.select("bin", "s.n", F.round("s.rates", 6).alias("rate"), F.round("s.curve", 6).alias("fitted"))


@query(
    "d06_monotone",
    DATA.rstrip()
    + ",\n"
    + CURVE.strip()
    + " "
    + scored_sql(
        {x: "f.p" if x == "accept" else REST.format(x=x) for x in NAMES},
        f"(SELECT *, ({BIN})::INTEGER AS bin FROM dev) d JOIN fit f USING (bin), ({wide_sql('train')}) g",
    ),
)
def d06_predict(t: Tables) -> DataFrame:
    train, dev = regions(B.split_cases(t, TASK))
    return shown(M.predict_monotone(dev, train, NAMES))


REG = """
regr AS (SELECT *, coalesce(offer_to_asking_ratio, 0) AS r FROM kept WHERE task = 'final_price_ratio' AND label_num IS NOT NULL),
train AS (SELECT * FROM regr WHERE region = 'train'),
dev AS (SELECT * FROM regr WHERE region = 'development'),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY label_num) - 1 AS i, count(*) OVER () AS m,
         row_number() OVER (PARTITION BY category ORDER BY label_num) - 1 AS ci, count(*) OVER (PARTITION BY category) AS cm FROM train)
"""
REG_DATA = ctes(B.CASES, CHRONO, REG)


def at_sql(q: float, i: str, m: str) -> str:
    return f"max(label_num) FILTER ({i} = round_even(({m} - 1) * {q}, 0))"


@query(
    "d08_regression_baselines",
    REG_DATA.rstrip()
    + f""",
    cat AS (SELECT category, quantile_cont(label_num, 0.5) AS med, {at_sql(0.5, 'ci', 'cm')} AS q FROM ordered GROUP BY category),
    al AS (SELECT quantile_cont(label_num, 0.5) AS med, {at_sql(0.5, 'i', 'm')} AS q, quantile_cont(r, 0.5) AS cut,
                  sum(r * label_num) / sum(r * r) AS slope, avg(label_num) AS mean,
                  coalesce(avg(label_num) FILTER (prior_counter_count > 0), avg(label_num)) AS told,
                  coalesce(avg(label_num) FILTER (prior_counter_count <= 0), avg(label_num)) AS untold FROM ordered),
    tree AS (SELECT avg(label_num) FILTER (r < cut) AS lo, avg(label_num) FILTER (r >= cut) AS hi FROM train, al),
    p AS (
      SELECT d.*, c.med AS cat_med, c.q AS cat_q, al.*, tree.* FROM dev d LEFT JOIN cat c USING (category), al, tree),
    long AS (
      SELECT 'median_regressor' AS model_id, label_num AS y, med AS x FROM p UNION ALL
      SELECT 'category_median_regressor', label_num, coalesce(cat_med, med) FROM p UNION ALL
      SELECT 'empirical_category_quantiles', label_num, coalesce(cat_q, q) FROM p UNION ALL
      SELECT 'offer_ratio_heuristic_regressor', label_num, r * slope FROM p UNION ALL
      SELECT 'split_the_difference_regressor', label_num, ((current_amount + listing_price) / 2) / listing_price FROM p UNION ALL
      SELECT 'prior_concession_regressor', label_num, mean + (told - untold) * least(prior_counter_count, 1) FROM p UNION ALL
      SELECT 'small_tree_regressor', label_num, CASE WHEN r >= cut THEN hi ELSE lo END FROM p)
    SELECT model_id, count(*) AS n, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse, round(avg(abs(x - y)), 6) AS mae,
           round(avg(greatest(0.5 * (y - x), -0.5 * (y - x))), 6) AS quantile_loss FROM long GROUP BY model_id
    """,
)
def d08(t: Tables) -> DataFrame:
    train, dev = regions(B.split_cases(t, "final_price_ratio"))
    scores = E.score_regression(M.regression_baselines(dev, train), ["model_id"])
    return scores.withColumns({x: F.round(x, 6) for x in ("rmse", "mae", "quantile_loss")})


TERMS = {
    "relative_offer": "r",
    "gap_to_listing": "(listing_price - current_amount) / listing_price",
    "round_number": "round_number",
    "timing_hour": "event_hour / 24.0",
    "seller_experience": "prior_counter_count",
    "prior_counter_count": "prior_counter_count",
    "listing_price_ratio": "current_amount / listing_price",
    "category_refurbished": "CASE WHEN lower(category) LIKE '%refurbished%' THEN 1 ELSE 0 END",
    "relative_offer_below_70": "CASE WHEN r < 0.70 THEN 1 ELSE 0 END",
    "relative_offer_above_85": "CASE WHEN r >= 0.85 THEN 1 ELSE 0 END",
    "relative_offer_x_round": "r * round_number",
}


def formula_sql() -> str:
    parts = []
    for name, (target, used) in M.FORMULAS.items():
        coef = ", ".join(
            f"avg({TERMS[x]}) FILTER (label = '{target}') - avg({TERMS[x]}) FILTER (label <> '{target}') AS b{i}" for i, x in enumerate(used)
        )
        rate = f"((count(*) FILTER (label = '{target}') + 0.5) / (count(*) + 1.0))"
        fit = f"SELECT ln({rate} / (1 - {rate})) AS b, {coef}, {', '.join(counts_sql(x) + ' AS n_' + x for x in NAMES)} FROM train"
        score = "b + " + " + ".join(f"b{i} * ({TERMS[x]})" for i, x in enumerate(used))
        rest = [x for x in NAMES if x != target]
        whole = " + ".join(f"n_{x}" for x in rest)
        p = {x: "p" if x == target else f"(1 - p) * (n_{x} + 1.0) / ({whole} + 3)" for x in NAMES}
        total = " + ".join(f"({v})" for v in p.values())
        parts.append(
            f"SELECT '{name}' AS model_id, row_id, ({own_sql(p)}) / ({total}) AS q FROM "
            f"(SELECT *, 1 / (1 + exp(-least(greatest({score}, -20), 20))) AS p FROM dev, ({fit}))"
        )
    return " UNION ALL ".join(parts)


@query(
    "d09_formulas",
    DATA + f"SELECT model_id, count(*) AS n, round(avg(-ln(greatest(least(q, 1 - 1e-12), 1e-12))), 6) AS log_loss FROM ({formula_sql()}) GROUP BY model_id",
)
def d09(t: Tables) -> DataFrame:
    train, dev = regions(B.split_cases(t, TASK))
    scores = E.score_multiclass(M.predict_formulas(dev, train, NAMES), NAMES, ["model_id"])
    return scores.select("model_id", "n", F.round("log_loss", 6).alias("log_loss"))


LONG_REG = "SELECT target, unnest(['chars', 'spaces', 'lines', 'capitals']) AS name, unnest([chars, spaces, lines, capitals]) AS value FROM train_reg"


@query(
    "d10_rank_features",
    ctes(B.CASE_REG)
    + f"""
    SELECT name, round(abs(avg(value) FILTER (target = 1) - avg(value) FILTER (target = 0)) / greatest(stddev_pop(value), 1e-9), 6) AS association
    FROM ({LONG_REG}) GROUP BY name
    """,
)
def d10(t: Tables) -> DataFrame:
    train, _ = regions(B.case_reg(t))
    return E.rank_features(train, B.REG_NAMES).withColumn("association", F.round("association", 6))


CUTS = f"""
long AS ({LONG_REG}),
vals AS (SELECT name, value, count(*) AS n, sum(target)::BIGINT AS k FROM long GROUP BY 1, 2),
run AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY name) AS m, lead(value) OVER w AS nxt,
         sum(n) OVER w AS ln, sum(k) OVER w AS lk, sum(n) OVER (PARTITION BY name) AS tn, sum(k) OVER (PARTITION BY name) AS tk
  FROM vals WINDOW w AS (PARTITION BY name ORDER BY value)),
cand AS (
  SELECT name, (value + nxt) / 2 AS threshold, (lk + 1.0) / (ln + 2.0) AS a, (tk - lk + 1.0) / (tn - ln + 2.0) AS b, ln, lk, tn, tk
  FROM run WHERE nxt IS NOT NULL),
loss AS (
  SELECT *, -(lk * ln(a) + (ln - lk) * ln(1 - a) + (tk - lk) * ln(b) + (tn - ln - tk + lk) * ln(1 - b)) / tn AS log_loss FROM cand)
"""


@query(
    "d11_threshold_candidates",
    ctes(B.CASE_REG, CUTS) + "SELECT name, threshold, round(a, 6) AS low_rate, round(b, 6) AS high_rate, round(log_loss, 6) AS log_loss FROM loss",
)
def d11(t: Tables) -> DataFrame:
    train, _ = regions(B.case_reg(t))
    rows = M.threshold_candidates(train, B.REG_NAMES)
    return rows.withColumns({x: F.round(x, 6) for x in ("low_rate", "high_rate", "log_loss")})


@query(
    "d11_threshold_rule",
    ctes(B.CASE_REG, CUTS)
    + """
    SELECT doc_id, round(CASE WHEN CASE l.name WHEN 'chars' THEN chars WHEN 'spaces' THEN spaces WHEN 'lines' THEN lines ELSE capitals END > threshold
                              THEN b ELSE a END, 6) AS p
    FROM dev_reg, (SELECT * FROM loss ORDER BY log_loss, list_position(['chars', 'spaces', 'lines', 'capitals'], name), threshold LIMIT 1) l
    """,
)
def d11_rule(t: Tables) -> DataFrame:
    train, dev = regions(B.case_reg(t))
    return M.predict_threshold_rule(dev, M.fit_threshold(train, B.REG_NAMES), B.REG_NAMES).select("doc_id", F.round("p", 6).alias("p"))


@query(
    "d14_recent",
    ctes(B.CASE_REG)
    + "SELECT doc_id, round((SELECT (sum(target) + 1.0) / (count(*) + 2.0) FROM (SELECT * FROM train_reg ORDER BY doc_id DESC LIMIT 25)), 6) AS p FROM dev_reg",
)
def d14(t: Tables) -> DataFrame:
    train, dev = regions(B.case_reg(t))
    return M.predict_recent(dev, train, "doc_id", "doc_id").select("doc_id", F.round("p", 6).alias("p"))


PREDS = ctes(B.CASES, B.PRED)


@query(
    "d15_score_binary",
    PREDS
    + """
    , q AS (SELECT category, target AS y, least(greatest(p_accept, 1e-6), 1 - 1e-6) AS p FROM pred),
    cells AS (SELECT category, least(floor(p * 10), 9) AS b, count(*) AS n, sum(y)::DOUBLE AS y, sum(p) AS p FROM q GROUP BY 1, 2),
    e AS (SELECT category, sum(abs(p - y)) / sum(n) AS ece, sum(y) / sum(n) AS r FROM cells GROUP BY 1),
    l AS (SELECT category, count(*) AS n, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS ll, avg((p - y) * (p - y)) AS br FROM q GROUP BY 1)
    SELECT category, n, round(ll, 6) AS log_loss, round(br, 6) AS brier, round(ece, 6) AS calibration_error, round(r, 6) AS base_rate,
           round(-(r * ln(r) + (1 - r) * ln(1 - r)) - ll, 6) AS lift_over_base FROM l JOIN e USING (category)
    """,
)
def d15(t: Tables) -> DataFrame:
    pred = B.predictions(t).withColumn("p", c("p_accept"))
    scores = E.score_binary(pred, ["category"])
    return scores.withColumns({x: F.round(x, 6) for x in ("log_loss", "brier", "calibration_error", "base_rate", "lift_over_base")})


BRIER = " + ".join(f"(p_{x} - (label = '{x}')::INT) * (p_{x} - (label = '{x}')::INT)" for x in NAMES)


@query(
    "d16_score_multiclass",
    PREDS
    + f"""
    SELECT category, count(*) AS n, round(avg((prediction = label)::INT), 6) AS accuracy,
           round(avg(-ln(greatest(least(p_label, 1 - 1e-12), 1e-12))), 6) AS log_loss, round(avg({BRIER}), 6) AS brier FROM pred GROUP BY category
    """,
)
def d16(t: Tables) -> DataFrame:
    scores = E.score_multiclass(B.predictions(t), NAMES, ["category"])
    return scores.withColumns({x: F.round(x, 6) for x in ("accuracy", "log_loss", "brier")})


@query(
    "d16_score_regression",
    ctes(B.CASES)
    + """
    SELECT category, count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(avg(greatest(-0.5 * e, 0.5 * e)), 6) AS quantile_loss
    FROM (SELECT category, offer_to_asking_ratio - label_num AS e FROM cases WHERE task = 'final_price_ratio' AND label_num IS NOT NULL) GROUP BY category
    """,
)
def d16_regression(t: Tables) -> DataFrame:
    rows = K.build_cases(stage(B.numbered(t)), ["final_price_ratio"]).filter(c("label_num").isNotNull())
    scores = E.score_regression(rows.withColumn("prediction", c("offer_to_asking_ratio")), ["category"])
    return scores.withColumns({x: F.round(x, 6) for x in ("rmse", "mae", "quantile_loss")})


def bins_sql(p: str, hit: str, bins: int, keys: str = "", source: str = "pred") -> str:
    return f"""SELECT {keys}least(floor({p} * {bins}), {bins - 1})::INTEGER AS bin, count(*) AS n, avg({p}) AS mp, avg(({hit})::INT) AS er
               FROM {source} GROUP BY ALL"""


@query(
    "d17_reliability",
    PREDS
    + f"""
    SELECT i::INTEGER AS bin, coalesce(n, 0) AS count, round(coalesce(mp, 0), 6) AS mean_prediction, round(coalesce(er, 0), 6) AS empirical_rate
    FROM range(10) s(i) LEFT JOIN ({bins_sql('p_accept', "label = 'accept'", 10)}) ON bin = i
    """,
)
def d17(t: Tables) -> DataFrame:
    cells = E.dense_bins(E.reliability(B.predictions(t), "label", 10, "accept"), 10)
    return cells.withColumns({x: F.round(x, 6) for x in ("mean_prediction", "empirical_rate")})


TOP = "greatest(p_accept, p_counter, p_decline, p_expire)"


@query(
    "d17_top_label_ece",
    PREDS + f"SELECT sum(n)::BIGINT AS n, round(sum(n * abs(mp - er)) / sum(n), 6) AS ece FROM ({bins_sql(TOP, 'label = prediction', 10)})",
)
def d17_top(t: Tables) -> DataFrame:
    out = E.expected_calibration_error(E.reliability(B.predictions(t), "top", 10))
    return out.withColumn("ece", F.round("ece", 6))


@query(
    "d17_classwise_ece",
    PREDS
    + " UNION ALL ".join(
        f"""SELECT '{x}' AS class, sum(n)::BIGINT AS n, round(sum(n * abs(mp - er)) / sum(n), 6) AS ece FROM ({bins_sql(f'p_{x}', f"label = '{x}'", 10)})"""
        for x in NAMES
    ),
)
def d17_class(t: Tables) -> DataFrame:
    return E.classwise_ece(B.predictions(t), NAMES).withColumn("ece", F.round("ece", 6))


@query(
    "d18_calibration_slices",
    PREDS
    + f"""
    , s AS (
      SELECT 'category' AS dimension, category AS slice, label, p_accept FROM pred UNION ALL
      SELECT 'offer_range', CASE WHEN offer_to_asking_ratio < 0.7 THEN 'low_offer' WHEN offer_to_asking_ratio < 0.85 THEN 'middle_offer' ELSE 'high_offer' END,
             label, p_accept FROM pred)
    SELECT dimension, slice, sum(n)::BIGINT AS n, round(sum(n * abs(mp - er)) / sum(n), 6) AS ece
    FROM ({bins_sql('p_accept', "label = 'accept'", 5, 'dimension, slice, ', 's')}) GROUP BY 1, 2
    """,
)
def d18(t: Tables) -> DataFrame:
    return E.calibration_slices(B.predictions(t), "accept").withColumn("ece", F.round("ece", 6))


@query(
    "d18_calibration_drift",
    PREDS
    + f"""
    , h AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY timestamp, row_id) <= floor(count(*) OVER () / 2) THEN 'early' ELSE 'late' END AS half FROM pred),
    e AS (SELECT half, sum(n)::BIGINT AS n, sum(n * abs(mp - er)) / sum(n) AS ece FROM ({bins_sql('p_accept', "label = 'accept'", 5, 'half, ', 'h')}) GROUP BY half)
    SELECT round(a.ece, 6) AS early_ece, round(b.ece, 6) AS late_ece, a.n AS early_rows, b.n AS late_rows, round(abs(b.ece - a.ece), 6) AS drift
    FROM e a, e b WHERE a.half = 'early' AND b.half = 'late'
    """,
)
def d18_drift(t: Tables) -> DataFrame:
    out = E.calibration_drift(B.predictions(t), "accept", "timestamp", "row_id")
    return out.withColumns({x: F.round(x, 6) for x in ("early_ece", "late_ece", "drift")})


@query(
    "d20_nearest_rank",
    """
    WITH o AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i,
                      count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT l_returnflag, max(v) FILTER (i = round_even((n - 1) * 0.1::DOUBLE, 0)) AS low, max(v) FILTER (i = round_even((n - 1) * 0.5::DOUBLE, 0)) AS mid,
           max(v) FILTER (i = round_even((n - 1) * 0.9::DOUBLE, 0)) AS high FROM o GROUP BY 1
    """,
)
def d20(t: Tables) -> DataFrame:
    return E.nearest_rank(t.lineitem, "l_extendedprice", {"low": 0.1, "mid": 0.5, "high": 0.9}, ["l_returnflag"])


@query(
    "d20_interval_report",
    REG_DATA.rstrip()
    + f""",
    mid AS (SELECT quantile_cont(label_num, 0.5) AS m FROM train),
    res AS (SELECT abs(label_num - m) AS e, row_number() OVER (ORDER BY abs(label_num - m)) - 1 AS i, count(*) OVER () AS n FROM train, mid),
    rad AS (SELECT max(e) FILTER (i = round_even((n - 1) * 0.8::DOUBLE, 0)) AS radius FROM res),
    iqr AS (SELECT {at_sql(0.75, 'i', 'm')} - {at_sql(0.25, 'i', 'm')} AS w FROM ordered)
    SELECT count(*) AS n, round(avg((abs(label_num - r) <= radius)::INT), 6) AS coverage, round(max(radius), 6) AS radius, round(max(2 * radius / w), 6) AS width_to_iqr,
           round(avg(greatest(0.5 * (label_num - r), -0.5 * (label_num - r))) / avg(greatest(0.5 * (label_num - m), -0.5 * (label_num - m))), 6) AS pinball_ratio
    FROM dev, mid, rad, iqr
    """,
)
def d20_interval(t: Tables) -> DataFrame:
    train, dev = regions(B.split_cases(t, "final_price_ratio"))
    out = E.interval_report(dev.withColumn("prediction", F.coalesce("offer_to_asking_ratio", F.lit(0.0))), train)
    return out.withColumns({x: F.round(x, 6) for x in out.columns if x != "n"})


@query(
    "d21_counter_frontier",
    DATA.rstrip()
    + """,
    hist AS (SELECT category, r AS ratio, label, row_number() OVER (ORDER BY row_id) AS seq FROM train),
    span AS (SELECT category, min(ratio) AS lo, max(ratio) AS hi, count(*) AS support FROM hist WHERE ratio > 0 GROUP BY 1),
    cand AS (
      SELECT row_id AS context_id, category, listing_price, unnest([0.55 * listing_price, 0.8 * listing_price, 1.3 * listing_price]) AS amount FROM dev),
    asked AS (SELECT *, amount / listing_price AS ratio FROM cand),
    near AS (
      SELECT a.context_id, a.ratio AS q, h.label, row_number() OVER (PARTITION BY a.context_id, a.ratio ORDER BY abs(h.ratio - a.ratio), seq) AS k
      FROM asked a JOIN hist h USING (category)),
    ans AS (
      SELECT context_id, q, count(*) AS comparables, avg((label = 'accept')::INT) AS pa, avg((label = 'counter')::INT) AS pc,
             avg((label NOT IN ('accept', 'counter'))::INT) AS px FROM near WHERE k <= 5 GROUP BY 1, 2)
    SELECT a.context_id, round(a.ratio, 6) AS ratio, a.ratio BETWEEN lo AND hi AS supported, support,
           CASE WHEN a.ratio BETWEEN lo AND hi THEN comparables::DOUBLE END AS comparables,
           CASE WHEN a.ratio BETWEEN lo AND hi THEN round(pa, 6) END AS p_accept, CASE WHEN a.ratio BETWEEN lo AND hi THEN round(pc, 6) END AS p_counter,
           CASE WHEN a.ratio BETWEEN lo AND hi THEN round(-(CASE WHEN pa > 0 THEN pa * log2(pa) ELSE 0 END + CASE WHEN pc > 0 THEN pc * log2(pc) ELSE 0 END
             + CASE WHEN px > 0 THEN px * log2(px) ELSE 0 END), 6) + 0.0 END AS entropy
    FROM asked a JOIN span USING (category) JOIN ans ON ans.context_id = a.context_id AND ans.q = a.ratio
    """,
)
def d21(t: Tables) -> DataFrame:
    from parley.operators.sequence import ranked

    train, dev = regions(B.split_cases(t, TASK))
    past = ranked(train, [], ["row_id"], "seq").select("category", F.coalesce("offer_to_asking_ratio", F.lit(0.0)).alias("ratio"), "label", "seq")
    amounts = F.array(*[F.lit(x) * c("listing_price") for x in (0.55, 0.8, 1.3)])
    contexts = dev.select(c("row_id").alias("context_id"), "category", "listing_price", amounts.alias("counter_amounts"))
    rows = M.counter_frontier(contexts, stage(past))
    six = {x: F.round(x, 6) for x in ("ratio", "p_accept", "p_counter", "entropy")}
    return rows.withColumns(six).select("context_id", "ratio", "supported", "support", c("comparables").cast("double"), "p_accept", "p_counter", "entropy")


@query(
    "d22_outside_support",
    DATA
    + """
    , b AS (SELECT min(listing_price) AS a1, max(listing_price) AS b1, min(current_amount) AS a2, max(current_amount) AS b2, min(offer_to_asking_ratio) AS a3,
                   max(offer_to_asking_ratio) AS b3, min(round_number) AS a4, max(round_number) AS b4, min(prior_turn_count) AS a5, max(prior_turn_count) AS b5,
                   min(prior_counter_count) AS a6, max(prior_counter_count) AS b6, min(event_hour) AS a7, max(event_hour) AS b7 FROM train)
    SELECT row_id, NOT (listing_price BETWEEN a1 AND b1 AND current_amount BETWEEN a2 AND b2 AND offer_to_asking_ratio BETWEEN a3 AND b3
                AND round_number BETWEEN a4 AND b4 AND prior_turn_count BETWEEN a5 AND b5 AND prior_counter_count BETWEEN a6 AND b6 AND event_hour BETWEEN a7 AND b7)
           OR category NOT IN (SELECT category FROM train) OR condition NOT IN (SELECT condition FROM train)
           OR current_actor NOT IN (SELECT current_actor FROM train) OR current_action NOT IN (SELECT current_action FROM train) AS outside
    FROM dev, b
    """,
)
def d22(t: Tables) -> DataFrame:
    train, dev = regions(B.split_cases(t, TASK))
    return E.outside_support(dev, train).select("row_id", "outside")


def board(t: Tables) -> DataFrame:
    """Scores of the five transparent classifiers on two splits; stage because ranking and selection read it."""
    rows = stage(K.build_cases(B.numbered(t), [TASK]).filter(c("outcome_state") == "supervised").withColumnRenamed("label_str", "label"))
    chrono, _ = P.chronological_purged_split(rows, "timestamp", "listing_id", "row_id")
    safe = P.hash_group_split(rows, "thread_id")
    scores = []
    for split, placed in (("chronological", stage(chrono)), ("thread_safe", stage(safe))):
        train, dev = regions(placed)
        parts = {
            "majority": (M.predict_majority(dev, train, NAMES), 1),
            "category_majority": (M.predict_category_majority(dev, train, NAMES), 1),
            "offer_ratio_threshold": (M.predict_threshold(dev), 1),
            "prior_concession_heuristic": (M.predict_prior_concession(dev, train, NAMES), 2),
            "split_the_difference_heuristic": (M.predict_split_difference(dev, NAMES), 3),
        }
        long = reduce(
            DataFrame.unionByName,
            [p.select(F.lit(m).alias("model_id"), F.lit(k).alias("complexity"), "label", "prediction", "probabilities") for m, (p, k) in parts.items()],
        )
        scored = E.score_multiclass(long, NAMES, ["model_id", "complexity"])
        ece = E.expected_calibration_error(E.reliability(long, "top", 10, by=["model_id"]), ["model_id"])
        scores.append(scored.join(ece.select("model_id", c("ece").alias("calibration_error")), "model_id").withColumn("split", F.lit(split)))
    return stage(reduce(DataFrame.unionByName, scores).withColumns({"task": F.lit(TASK), "coverage": F.lit(1.0)}))


def model_rows_sql(split: str, train: str, dev: str) -> str:
    g = f"({wide_sql(train)}) g"
    total = "(g.accept + g.counter + g.decline + g.expire)"
    share = {x: f"g.{x}::DOUBLE / {total}" for x in NAMES}
    own_cat = {x: f"coalesce(m.{x}::DOUBLE / (m.accept + m.counter + m.decline + m.expire), g.{x}::DOUBLE / {total})" for x in NAMES}
    cat = f"{dev} d LEFT JOIN ({wide_sql(train, 'category')}) m USING (category), {g}"
    thr = "CASE WHEN r >= 0.85 THEN 'accept' WHEN r >= 0.65 THEN 'counter' ELSE 'decline' END"
    mid = "CASE WHEN r >= 0.875 THEN 'accept' WHEN r >= 0.5 THEN 'counter' ELSE 'decline' END"
    prior = {x: f"CASE WHEN prior_counter_count > 0 THEN {0.85 if x == 'counter' else 0.05}::DOUBLE ELSE {share[x]} END" for x in NAMES}
    return f"""
    SELECT '{split}' AS split, 'majority' AS model_id, 1 AS complexity, {own_sql(share)} AS q FROM {dev} d, {g} UNION ALL
    SELECT '{split}', 'category_majority', 1, {own_sql(own_cat)} FROM {cat} UNION ALL
    SELECT '{split}', 'offer_ratio_threshold', 1, CASE WHEN label = {thr} THEN 0.85 ELSE 0.05 END::DOUBLE FROM {dev} UNION ALL
    SELECT '{split}', 'prior_concession_heuristic', 2, {own_sql(prior)} FROM {dev} d, {g} UNION ALL
    SELECT '{split}', 'split_the_difference_heuristic', 3, CASE WHEN label = {mid} THEN 0.85 ELSE 0.05 END::DOUBLE FROM {dev}"""


BOARD = f"""
sup0 AS (SELECT *, label_str AS label, coalesce(offer_to_asking_ratio, 0) AS r FROM cases WHERE task = 'seller_next_action' AND label_str IS NOT NULL),
pc AS (SELECT *, {region_sql('pos', 'n')} AS region FROM (
  SELECT *, row_number() OVER (ORDER BY timestamp, row_id) AS pos, count(*) OVER () AS n FROM sup0)),
kc AS (SELECT * FROM pc WHERE listing_id NOT IN (SELECT listing_id FROM pc GROUP BY 1 HAVING count(DISTINCT region) > 1)),
ks AS (SELECT s.*, g.region FROM sup0 s JOIN (
  SELECT thread_id, {region_sql('pos', 'n')} AS region FROM (
    SELECT thread_id, row_number() OVER (ORDER BY sha256('{{"group":"' || thread_id || '","split":"thread_id"}}'), thread_id) AS pos, count(*) OVER () AS n
    FROM (SELECT DISTINCT thread_id FROM sup0))) g USING (thread_id)),
tc AS (SELECT * FROM kc WHERE region = 'train'), dc AS (SELECT * FROM kc WHERE region = 'development'),
ts AS (SELECT * FROM ks WHERE region = 'train'), ds AS (SELECT * FROM ks WHERE region = 'development'),
scores AS (
  SELECT split, model_id, complexity, count(*) AS n, avg(-ln(greatest(least(q, 1 - 1e-12), 1e-12))) AS log_loss
  FROM ({model_rows_sql('chronological', 'tc', 'dc')} UNION ALL {model_rows_sql('thread_safe', 'ts', 'ds')}) GROUP BY 1, 2, 3),
best AS (SELECT split, min(log_loss) FILTER (model_id IN ('majority', 'category_majority', 'offer_ratio_threshold')) AS base FROM scores GROUP BY 1)
"""
BASELINES = ["majority", "category_majority", "offer_ratio_threshold"]


@query(
    "d24_leaderboard",
    ctes(B.CASES, BOARD)
    + """
    SELECT split, model_id, (row_number() OVER (PARTITION BY split ORDER BY log_loss, complexity, model_id))::INTEGER AS place, round(log_loss, 6) AS log_loss,
           round((base - log_loss) / abs(base), 6) + 0.0 AS relative_improvement, round(log_loss / base, 6) AS error_ratio
    FROM scores JOIN best USING (split)
    """,
)
def d24(t: Tables) -> DataFrame:
    rows = E.leaderboard(board(t), "log_loss", BASELINES)
    six = {x: F.round(x, 6) + 0.0 for x in ("log_loss", "relative_improvement", "error_ratio")}
    return rows.withColumns(six).select("split", "model_id", "place", *six)


@query(
    "d25_select_strict",
    ctes(B.CASES, BOARD)
    + """
    SELECT split, model_id FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY log_loss, complexity, model_id) AS k FROM scores) WHERE k = 1
    """,
)
def d25(t: Tables) -> DataFrame:
    return E.select_model(board(t), "log_loss", strict=True).select("split", "model_id")


@query("d25_select_tolerant")
def d25_tolerant(t: Tables) -> DataFrame:
    return E.select_model(board(t), "log_loss").select("split", "model_id", "complexity")


@query(
    "d26_pareto",
    """
    WITH s AS (SELECT l_partkey AS model_id, round(avg(l_discount), 6) AS log_loss, count(*) AS complexity FROM lineitem GROUP BY 1)
    SELECT model_id, log_loss, complexity FROM s a WHERE NOT EXISTS (
      SELECT 1 FROM s b WHERE b.log_loss <= a.log_loss AND b.complexity <= a.complexity AND (b.log_loss < a.log_loss OR b.complexity < a.complexity))
    """,
)
def d26(t: Tables) -> DataFrame:
    scores = t.lineitem.groupBy(c("l_partkey").alias("model_id")).agg(F.round(F.avg("l_discount"), 6).alias("log_loss"), F.count("*").alias("complexity"))
    return E.pareto(scores)


@query(
    "d27_paired_compare",
    PREDS
    + """
    , d AS (SELECT -(target * ln(p_accept) + (1 - target) * ln(1 - p_accept)) + (target * ln(p_other) + (1 - target) * ln(1 - p_other)) AS d FROM pred)
    SELECT count(*) AS n, round(avg(d), 6) AS improvement, round(avg(d) - 1.96 * stddev_pop(d) / sqrt(count(*)), 6) AS low,
           round(avg(d) + 1.96 * stddev_pop(d) / sqrt(count(*)), 6) AS high, round(avg((d > 0)::INT), 6) AS b_wins FROM d
    """,
)
def d27(t: Tables) -> DataFrame:
    pred = B.predictions(t)
    out = E.paired_compare(pred.withColumn("p", c("p_accept")), pred.withColumn("p", c("p_other")), "row_id")
    return out.withColumns({x: F.round(x, 6) for x in ("improvement", "low", "high", "b_wins")})


@query(
    "d28_residuals",
    PREDS + "SELECT row_id, round(abs(p_accept - target), 6) AS absolute_error FROM pred ORDER BY abs(p_accept - target) DESC, row_id LIMIT 20",
)
def d28(t: Tables) -> DataFrame:
    rows = E.residuals(B.predictions(t).withColumn("p", c("p_accept")), "row_id", 20)
    return rows.select("row_id", F.round("absolute_error", 6).alias("absolute_error"))


@query(
    "d28_counterexamples",
    PREDS + "SELECT row_id, round(abs(p_accept - p_other), 6) AS gap FROM pred ORDER BY abs(p_accept - p_other) DESC, row_id LIMIT 20",
)
def d28_pairs(t: Tables) -> DataFrame:
    pred = B.predictions(t)
    rows = E.counterexamples(pred.withColumn("p", c("p_accept")), pred.withColumn("p", c("p_other")), "row_id", 20)
    return rows.select("row_id", F.round("gap", 6).alias("gap"))


@query(
    "d29_residual_terms",
    PREDS
    + """
    , l AS (SELECT target - p_accept AS e, unnest(['listing_price', 'offer_to_asking_ratio', 'round_number', 'event_hour']) AS name,
                   unnest([listing_price, offer_to_asking_ratio, round_number::DOUBLE, event_hour]) AS v FROM pred)
    SELECT name, round(abs(corr(v, e)), 6) AS association FROM l GROUP BY name
    """,
)
def d29(t: Tables) -> DataFrame:
    names = ["listing_price", "offer_to_asking_ratio", "round_number", "event_hour"]
    return E.residual_terms(B.predictions(t).withColumn("p", c("p_accept")), names).withColumn("association", F.round("association", 6))


@query(
    "d30_rotate_labels",
    PREDS + "SELECT row_id, coalesce(lead(label) OVER (ORDER BY row_id), (SELECT arg_min(label, row_id) FROM pred)) AS label FROM pred",
)
def d30(t: Tables) -> DataFrame:
    return E.rotate_labels(B.predictions(t).select("row_id", "label"), ["row_id"], "label")


INFLATION = f"""
pr AS (SELECT *, {region_sql('pos', 'n')} AS region FROM (
  SELECT *, row_number() OVER (ORDER BY sha256(row_id), row_id) AS pos, count(*) OVER () AS n FROM sup0)),
pg AS (SELECT s.*, g.region FROM sup0 s JOIN (
  SELECT thread_id, {region_sql('pos', 'n')} AS region FROM (
    SELECT thread_id, row_number() OVER (ORDER BY thread_id) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT thread_id FROM sup0))) g USING (thread_id)),
tr AS (SELECT * FROM pr WHERE region = 'train'), dr AS (SELECT * FROM pr WHERE region = 'development'),
tg AS (SELECT * FROM pg WHERE region = 'train'), dg AS (SELECT * FROM pg WHERE region = 'development'),
il AS (
  SELECT split, model_id, avg(-ln(greatest(least(q, 1 - 1e-12), 1e-12))) AS l
  FROM ({model_rows_sql('random_rows', 'tr', 'dr')} UNION ALL {model_rows_sql('group_safe', 'tg', 'dg')})
  WHERE model_id IN ('majority', 'category_majority') GROUP BY 1, 2),
gain AS (SELECT a.split, (a.l - b.l) / a.l AS g FROM il a JOIN il b USING (split) WHERE a.model_id = 'majority' AND b.model_id = 'category_majority')
"""


@query(
    "d30_split_inflation",
    ctes(B.CASES, BOARD, INFLATION)
    + "SELECT round(max(CASE WHEN split = 'random_rows' THEN g END) - max(CASE WHEN split = 'group_safe' THEN g END), 6) + 0.0 AS inflation FROM gain",
)
def d30_inflation(t: Tables) -> DataFrame:
    """Gain of a category model under a random row split less its gain under a group-safe one."""
    rows = stage(K.build_cases(B.numbered(t), [TASK]).filter(c("outcome_state") == "supervised").withColumnRenamed("label_str", "label"))
    random = P.chronological_split(rows.withColumn("_h", F.sha2("row_id", 256)), "_h", "row_id").drop("_h")
    gains = []
    for name, placed in (("random_rows", stage(random)), ("group_safe", stage(P.group_split(rows, "thread_id", "row_id")))):
        train, dev = regions(placed)
        base = E.score_multiclass(M.predict_majority(dev, train, NAMES), NAMES).select("log_loss").scalar()
        own = E.score_multiclass(M.predict_category_majority(dev, train, NAMES), NAMES)
        gains.append(own.select(F.lit(name).alias("split"), ((base - c("log_loss")) / base).alias("gain")))
    both = gains[0].unionByName(gains[1])
    return both.agg(
        (F.max(F.when(c("split") == "random_rows", c("gain"))) - F.max(F.when(c("split") == "group_safe", c("gain")))).alias("inflation")
    ).select((F.round("inflation", 6) + 0.0).alias("inflation"))


@query(
    "d30_canaries",
    """
    SELECT unnest(['future_status', 'accepted_price', 'final_sale_price', 'seller_id', 'thread_id', 'artifact_name', 'listing_price']) AS feature,
           count(*) AS rows, unnest([true, true, true, true, true, true, false]) AS rejected FROM events
    """,
)
def d30_canaries(t: Tables) -> DataFrame:
    # a canary feature on every row must be rejected, a declared one must not
    names = ["future_status", "accepted_price", "final_sale_price", "seller_id", "thread_id", "artifact_name", "listing_price"]
    rows = t.events.select(F.explode(F.array(*[F.lit(x) for x in names])).alias("task"), F.lit("1").alias("v"))
    audit = K.leakage_audit(rows.withColumn("features", F.create_map("task", "v")))
    return audit.select(c("task").alias("feature"), "rows", (~c("passed")).alias("rejected"))


@query(
    "d30_censoring_control",
    ctes(B.CASES)
    + """
    SELECT task, count(CASE WHEN outcome_state <> 'supervised' THEN 1 END) AS affected_rows, count(*) AS variant_supervised,
           count(CASE WHEN outcome_state <> 'supervised' THEN 1 END) > 0 AS variant_refused FROM cases GROUP BY task
    """,
)
def d30_censoring(t: Tables) -> DataFrame:
    return E.censoring_control(K.task_manifest(B.cases(t), B.bare_turns(t), B.listings(t)))


@query(
    "d31_subgroup_counts",
    PREDS
    + """
    SELECT 'category' AS dimension, category AS value, count(*) AS n FROM pred GROUP BY category UNION ALL
    SELECT 'current_action', current_action, count(*) FROM pred GROUP BY current_action UNION ALL
    SELECT 'label', label, count(*) FROM pred GROUP BY label
    """,
)
def d31(t: Tables) -> DataFrame:
    return E.value_counts(B.predictions(t), ["category", "current_action", "label"])


@query(
    "d31_tied_timestamps",
    "SELECT count(CASE WHEN n > 1 THEN 1 END) AS tied_timestamps, max(n) AS largest_tie FROM (SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY 1)",
)
def d31_ties(t: Tables) -> DataFrame:
    return E.tied_timestamps(t.lineitem, "l_shipdate")


@query(
    "d32_lineage",
    PREDS
    + """
    , m AS (SELECT ('0x' || substr(sha256(concat_ws(chr(1), row_id, category, current_action, round_number, label)), 1, 15))::BIGINT AS r,
                   ('0x' || substr(sha256(concat_ws(chr(1), category, current_action, round_number, label)), 1, 15))::BIGINT AS f FROM pred)
    SELECT count(*) AS rows, sum(r)::VARCHAR AS row_sum, bit_xor(r) AS row_xor, sum(f)::VARCHAR AS feature_sum FROM m
    """,
)
def d32(t: Tables) -> DataFrame:
    return E.lineage(B.predictions(t), "row_id", ["category", "current_action", "round_number", "label"])


@query(
    "d34_finite_check",
    """
    SELECT l_orderkey % 1000 = 0 AS zero, count(*) AS n, CASE WHEN l_orderkey % 1000 = 0 THEN 'ratio,probabilities' ELSE 'ratio' END AS faults
    FROM lineitem WHERE l_discount = 0 OR l_orderkey % 1000 = 0 GROUP BY 1, 3
    """,
)
def d34(t: Tables) -> DataFrame:
    # dividing by the discount gives infinity where there is none, and one key in a thousand is made NaN
    bad = c("l_orderkey") % 1000 == 0
    ratio = F.when(bad, F.lit(float("nan"))).when(c("l_discount") == 0, F.lit(float("inf"))).otherwise(1 / F.nullif(c("l_discount"), F.lit(0.0)))
    rows = t.lineitem.select(bad.alias("zero"), ratio.alias("ratio"), F.create_map(F.lit("a"), F.when(bad, F.lit(float("nan"))).otherwise(c("l_tax"))).alias("probabilities"))
    found = E.finite_check(rows, ["ratio"], ["probabilities"])
    return found.groupBy("zero", F.array_join("faults", ",").alias("faults")).agg(F.count("*").alias("n"))
