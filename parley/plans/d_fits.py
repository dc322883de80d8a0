"""Fitted models, calibrators and resampling; their SQL solves the same systems by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import metrics as E
from parley.operators import models as M
from parley.plans import bindings as B
from parley.plans.d_models import DATA, NAMES, PREDS, REG_DATA, TASK, regions
from parley.plans.registry import Tables, ctes, query

c = F.col

BINARY = ("log_loss", "brier", "calibration_error", "base_rate", "lift_over_base")


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({x: F.round(x, 6) for x in names})


def binary_sql(source: str) -> str:
    """Scores of (target, p) in a table, as `score_binary` gives them."""
    return f"""
    , q AS (SELECT target AS y, least(greatest(p, 1e-6), 1 - 1e-6) AS p FROM {source}),
    cells AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, sum(y)::DOUBLE AS y, sum(p) AS p FROM q GROUP BY 1),
    e AS (SELECT sum(abs(p - y)) / sum(n) AS ece, sum(y) / sum(n) AS r FROM cells),
    l AS (SELECT count(*) AS n, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS ll, avg((p - y) * (p - y)) AS br FROM q)
    SELECT n, round(ll, 6) AS log_loss, round(br, 6) AS brier, round(ece, 6) AS calibration_error, round(r, 6) AS base_rate,
           round(-(r * ln(r) + (1 - r) * ln(1 - r)) - ll, 6) AS lift_over_base FROM l, e
    """


def _long() -> str:
    """Columns of the linear model in long form; a level seen only in development has no coefficient."""
    numbers = ", ".join(f"{{'name': '{x}', 'level': '', 'v': (coalesce({x}, 0)::DOUBLE - m_{x}) / s_{x}}}" for x in E.NUMERIC)
    levels = ", ".join(f"{{'name': '{x}', 'level': coalesce({x}, 'missing'), 'v': 1.0::DOUBLE}}" for x in E.CATEGORICAL)
    return f"""SELECT row_id, region, y, u.name AS name, u.level AS level, u.v AS v FROM (
      SELECT row_id, region, label_num AS y, unnest([{{'name': 'intercept', 'level': '', 'v': 1.0::DOUBLE}}, {numbers}, {levels}]) AS u FROM regr, scale)"""


SCALE = ", ".join(
    f"avg(coalesce({x}, 0)::DOUBLE) AS m_{x}, CASE WHEN stddev_pop(coalesce({x}, 0)::DOUBLE) > 1e-9 THEN stddev_pop(coalesce({x}, 0)::DOUBLE) ELSE 1 END AS s_{x}" for x in E.NUMERIC
)
# Normal equations of the ridge fit, solved by elimination without pivots (the system is positive definite).
RIDGE = (
    REG_DATA.replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + f""",
    scale AS (SELECT {SCALE} FROM train),
    long AS ({_long()}),
    terms AS (SELECT name, level, row_number() OVER (ORDER BY name <> 'intercept', level <> '', name, level) AS j FROM (SELECT DISTINCT name, level FROM long WHERE region = 'train')),
    x AS (SELECT row_id, y, j, v FROM long JOIN terms USING (name, level) WHERE region = 'train'),
    n AS (SELECT count(*)::DOUBLE AS n FROM train),
    gram AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS g FROM x a JOIN x b USING (row_id) GROUP BY 1, 2),
    rhs AS (SELECT j AS i, sum(v * y) AS g FROM x GROUP BY 1),
    cells AS (
      SELECT a.j AS i, b.j AS j, coalesce(g, 0) / n + CASE WHEN a.j = b.j AND a.name <> 'intercept' THEN 0.05 ELSE 0 END AS g
      FROM terms a, terms b, n LEFT JOIN gram ON gram.i = a.j AND gram.j = b.j),
    lines AS (SELECT i, list_append(list(cells.g ORDER BY j), any_value(rhs.g / n)) AS r FROM cells JOIN rhs USING (i), n GROUP BY i),
    aug AS (SELECT list(r ORDER BY i) AS m FROM lines),
    solve AS (
      SELECT 0 AS k, m FROM aug UNION ALL
      SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / r[k + 1])
                                                   ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)
      FROM solve WHERE k < len(m)),
    coef AS (SELECT unnest(list_transform(m, lambda r: r[len(r)])) AS b, unnest(range(1, len(m) + 1)) AS j FROM solve WHERE k = len(m))
    """
)


@query("d07_ridge_coefficients", RIDGE + "SELECT name, nullif(level, '') AS level, round(b, 6) + 0.0 AS coefficient FROM coef JOIN terms USING (j)")
def d07_ridge_coefficients(t: Tables) -> DataFrame:
    train, _ = regions(B.split_cases(t, "final_price_ratio"))
    how, fit = M.fit_ridge(train, E.NUMERIC, E.CATEGORICAL)
    return how.frame(fit[:, None]).select("name", "level", (F.round(F.get("coefficient", F.lit(0)), 6) + 0.0).alias("coefficient"))


@query(
    "d07_ridge",
    RIDGE
    + """, pred AS (SELECT row_id, any_value(y) AS y, sum(v * b) AS p FROM long JOIN terms USING (name, level) JOIN coef USING (j) WHERE region = 'development' GROUP BY 1)
    SELECT count(*) AS n, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae,
           round(avg(greatest(0.5 * (y - p), -0.5 * (y - p))), 6) AS quantile_loss FROM pred""",
)
def d07_ridge(t: Tables) -> DataFrame:
    train, dev = regions(B.split_cases(t, "final_price_ratio"))
    return six(E.score_regression(M.predict_ridge(dev, train, E.NUMERIC, E.CATEGORICAL)), "rmse", "mae", "quantile_loss")


@query("d07_glm")
def d07(t: Tables) -> DataFrame:
    train, dev = regions(B.split_cases(t, TASK))
    pred = M.predict_glm(dev, train, NAMES, E.NUMERIC, E.CATEGORICAL)
    return six(E.score_multiclass(pred, NAMES), "accuracy", "log_loss", "brier")


@query(
    "d07_glm_balance",
    DATA
    + "SELECT x AS label, round(avg((label = x)::INT), 6) AS mean_probability FROM train, (SELECT unnest(['accept', 'counter', 'decline', 'expire']) AS x) GROUP BY x",
)
def d07_balance(t: Tables) -> DataFrame:
    """Intercepts carry no penalty, so where the gradient vanishes the mean probability of a label is its share in training."""
    train, _ = regions(B.split_cases(t, TASK))
    pred = M.predict_glm(train, train, NAMES, E.NUMERIC, E.CATEGORICAL)
    p = F.array(*[F.struct(F.lit(x).alias("label"), E.probability(x).alias("p")) for x in NAMES])
    return pred.select(F.explode(p).alias("s")).groupBy("s.label").agg(F.round(F.avg("s.p"), 6).alias("mean_probability"))


Z = ", ".join(f"({x} - m_{x}) / s_{x}" for x in B.REG_NAMES)
REG_SCALE = ", ".join(f"avg({x}) AS m_{x}, CASE WHEN stddev_pop({x}) > 1e-9 THEN stddev_pop({x}) ELSE 1 END AS s_{x}" for x in B.REG_NAMES)
ORDERED = "[" + ", ".join(f"{{'a': -abs(avg({x}) FILTER (target = 1) - avg({x}) FILTER (target = 0)) / greatest(stddev_pop({x}), 1e-9), 'name': '{x}', 'i': {i + 1}}}" for i, x in enumerate(B.REG_NAMES)) + "]"


def _distance(z: str, centre: str) -> str:
    return f"list_sum(list_transform(range(1, len({z}) + 1), lambda i: ({z}[i] - {centre}[i]) * ({z}[i] - {centre}[i])))"


# Features stand in the order of their association; the first centre is the smallest vector in that order.
TWO_STATE = (
    ctes(B.CASE_REG).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + f""",
    scale AS (SELECT {REG_SCALE} FROM train_reg),
    places AS (SELECT list_transform(list_sort({ORDERED}), lambda s: s.i) AS o FROM train_reg),
    zt AS (SELECT target, list_transform(o, lambda i: [{Z}][i]) AS z FROM train_reg, scale, places),
    zd AS (SELECT target, list_transform(o, lambda i: [{Z}][i]) AS z FROM dev_reg, scale, places),
    one AS (SELECT min(z) AS a FROM zt),
    two AS (SELECT a, (SELECT z FROM zt ORDER BY {_distance('z', 'a')} DESC, z DESC LIMIT 1) AS b FROM one),
    km AS (
      SELECT 0 AS k, a, b FROM two UNION ALL
      SELECT k + 1, coalesce(list(m ORDER BY i) FILTER (s = 0), any_value(a)), coalesce(list(m ORDER BY i) FILTER (s = 1), any_value(b)) FROM (
        SELECT k, a, b, s, i, avg(z[i]) AS m FROM (
          SELECT k, a, b, z, CASE WHEN {_distance('z', 'a')} <= {_distance('z', 'b')} THEN 0 ELSE 1 END AS s, unnest(range(1, len(z) + 1)) AS i FROM km, zt WHERE k < 20)
        GROUP BY k, a, b, s, i) GROUP BY k, a, b),
    ends AS (SELECT a, b FROM km WHERE k = 20),
    marked AS (SELECT target, CASE WHEN {_distance('z', 'a')} <= {_distance('z', 'b')} THEN 0 ELSE 1 END AS s FROM zt, ends),
    rates AS (
      SELECT CASE WHEN count(*) FILTER (s = 0) = 0 THEN (sum(target) + 1.0) / (count(*) + 2.0) ELSE ((sum(target) FILTER (s = 0)) + 1.0) / (count(*) FILTER (s = 0) + 2.0) END AS r0,
             CASE WHEN count(*) FILTER (s = 1) = 0 THEN (sum(target) + 1.0) / (count(*) + 2.0) ELSE ((sum(target) FILTER (s = 1)) + 1.0) / (count(*) FILTER (s = 1) + 2.0) END AS r1 FROM marked),
    w AS (SELECT target, exp(-least({_distance('z', 'a')}, 50)) AS wa, exp(-least({_distance('z', 'b')}, 50)) AS wb FROM zd, ends),
    pred AS (SELECT target, (wa * r0 + wb * r1) / (wa + wb) AS p FROM w, rates)
    """.rstrip()
)


@query("d12_two_state", TWO_STATE + binary_sql("pred"))
def d12(t: Tables) -> DataFrame:
    train, dev = regions(B.case_reg(t))
    return six(E.score_binary(M.predict_two_state(dev, train, B.REG_NAMES)), *BINARY)


@query("d13_forward_select")
def d13(t: Tables) -> DataFrame:
    train, dev = regions(B.case_reg(t))
    return six(E.score_binary(M.forward_select(train, dev, B.REG_NAMES)[1]), *BINARY)


CLIPPED = "least(greatest(p_accept, 1e-6), 1 - 1e-6)"
# Intercept and slope on the logit, by Newton's method on two numbers.
PLATT = (
    PREDS.replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + f""",
    pts AS (SELECT l, count(*) AS w, sum(target)::DOUBLE AS s FROM (SELECT target, ln({CLIPPED} / (1 - {CLIPPED})) AS l FROM pred) GROUP BY 1),
    fit AS (
      SELECT 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL
      SELECT k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
        SELECT k, a, b, sum(w * q - s) AS ga, sum((w * q - s) * l) AS gb, sum(w * q * (1 - q)) AS haa, sum(w * q * (1 - q) * l) AS hab, sum(w * q * (1 - q) * l * l) AS hbb
        FROM (SELECT k, a, b, l, w, s, 1 / (1 + exp(-(a + b * l))) AS q FROM fit, pts WHERE k < 15) GROUP BY k, a, b)),
    calibrated AS (SELECT target, 1 / (1 + exp(-(a + b * ln({CLIPPED} / (1 - {CLIPPED}))))) AS p FROM pred, fit WHERE k = 15)
    """.rstrip()
)


@query("d19_platt", PLATT + binary_sql("calibrated"))
def d19(t: Tables) -> DataFrame:
    pred = B.predictions(t).select("row_id", "target", c("p_accept").alias("p"))
    return six(E.score_binary(M.platt(pred).withColumn("p", c("calibrated"))), *BINARY)


# Place i gets the largest over a <= i of the smallest over b >= i of the mean of places a..b.
ISOTONIC = (
    PREDS.rstrip()
    + """,
    pts AS (SELECT p_accept AS p, row_number() OVER (ORDER BY p_accept) AS i, sum(sum(target)) OVER (ORDER BY p_accept) AS cs, sum(count(*)) OVER (ORDER BY p_accept) AS cw,
                   sum(target) AS s, count(*) AS w FROM pred GROUP BY 1),
    spans AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s)::DOUBLE / (b.cw - a.cw + a.w) AS m FROM pts a JOIN pts b ON a.i <= b.i),
    lows AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS low FROM spans),
    curve AS (SELECT i, max(low) AS fit FROM lows GROUP BY i),
    calibrated AS (SELECT row_id, target, fit AS p FROM pred JOIN pts ON pts.p = p_accept JOIN curve USING (i))
    """.rstrip()
)


@query("d19_isotonic", ISOTONIC + binary_sql("calibrated"))
def d19_isotonic(t: Tables) -> DataFrame:
    pred = B.predictions(t).select("row_id", "target", c("p_accept").alias("p"))
    return six(E.score_binary(M.isotonic(pred).withColumn("p", c("calibrated"))), *BINARY)


@query("d19_isotonic_rows", ISOTONIC + " SELECT row_id, round(p, 6) AS calibrated FROM calibrated")
def d19_isotonic_rows(t: Tables) -> DataFrame:
    pred = B.predictions(t).select("row_id", "target", c("p_accept").alias("p"))
    return M.isotonic(pred).select("row_id", F.round("calibrated", 6).alias("calibrated"))


# Sixteen bits of a hash are one draw; a weight is how many edges of the Poisson distribution the draw has passed.
BOOTSTRAP = (
    PREDS.rstrip()
    + f""",
    s AS (SELECT row_id, (p_accept - (label = 'accept')::INT) * (p_accept - (label = 'accept')::INT) AS s FROM pred),
    h AS (SELECT s, b, sha256('7:' || b || ':' || row_id) AS h FROM s, range(13) r(b)),
    d AS (SELECT b * 16 + j AS rep, s, ('0x' || substr(h, j * 4 + 1, 4))::INTEGER AS u FROM h, range(16) r(j)),
    w AS (SELECT rep, s, {' + '.join(f'(u >= {e})::INT' for e in E.POISSON_EDGES)} AS w FROM d WHERE rep < 200),
    reps AS (SELECT rep, sum(s * w) / sum(w) AS brier FROM w GROUP BY 1)
    SELECT round(avg(brier), 6) AS mean_brier, round(quantile_cont(brier, 0.025), 6) AS low, round(quantile_cont(brier, 0.975), 6) AS high, count(*) AS samples FROM reps
    """
)


@query("d23_bootstrap_brier", BOOTSTRAP)
def d23(t: Tables) -> DataFrame:
    return six(E.bootstrap_brier(B.predictions(t), "accept", "row_id"), "mean_brier", "low", "high")
