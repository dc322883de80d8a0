"""Fits whose state is a bounded array of sums: moments, gradients and curvature, added up over partitions.

A task folds its rows into one array, arrays are merged in a tree, and the driver solves a system as wide as the model. What
travels grows with the model, not with the rows. A model has an intercept, standardised numbers (a missing one reads as
zero) and one column for each level of a category; levels get their place in the model by a join.

The objective is the mean loss plus half of ``l2`` times the squared coefficients, without the intercept. All fits are
Newton's method, so they end where the gradient vanishes, in whatever order rows come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.joins import lookup
from parley.session import stage

c = F.col

#: Columns of a model at most: the driver solves a dense system of that size.
WIDEST = 4_000
#: Partial sums that meet in one task of the tree, and in the end on the driver.
FAN = 16
#: Cells of the dense piece of rows that a task holds at a time.
PIECE = 2_000_000
#: Newton steps at most, and the largest gradient that counts as none.
STEPS, FLAT = 60, 1e-10

Fold = Callable[[Iterator[pa.RecordBatch]], np.ndarray]


def merged(rows: DataFrame, fold: Fold, size: int) -> np.ndarray:
    """Sum over all tasks of the array that ``fold`` makes of a task's rows."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([fold(batches).tobytes()], pa.binary())], ["v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            for v in batch["v"]:
                out += np.frombuffer(v.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["v"])

    n = 4 * rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.coalesce(n).mapInArrow(one, "v binary")
    while n > FAN:
        n = -(-n // FAN)
        parts = parts.repartition(n).mapInArrow(add, "v binary")
    return reduce(lambda a, b: a + b, [np.frombuffer(r.v) for r in parts.collect()], np.zeros(size))


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of a symmetric system; where it is not definite, the shortest of the best ones."""
    try:
        low = np.linalg.cholesky(a)
        return np.linalg.solve(low.T, np.linalg.solve(low, b))
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def newton(start: np.ndarray, at: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minimum of a convex function that gives value, gradient and curvature at a point. Steps that rise are halved."""
    best, value, step = start, np.inf, np.zeros_like(start)
    point = start
    for _ in range(STEPS):
        now, gradient, curvature = at(point)
        if now > value + 1e-12 * max(1.0, abs(value)):
            step = step / 2
            point = best + step
            continue
        best, value = point, now
        if np.abs(gradient).max(initial=0) < FLAT:
            break
        step = -solved(curvature, gradient)
        point = best + step
    return best


# ---- designs


@dataclass
class Design:
    """What turns rows into columns of a model: scales of the numbers, places of the levels."""

    numeric: list[str]
    categorical: list[str]
    scales: list[tuple[float, float]]
    #: name, level, place
    levels: DataFrame
    width: int

    @property
    def dense(self) -> int:
        """Intercept and numbers."""
        return 1 + len(self.numeric)

    def numbers(self) -> Column:
        z = [(_number(x) - m) / s for x, (m, s) in zip(self.numeric, self.scales, strict=True)]
        return F.array(F.lit(1.0), *z)

    def joined(self, df: DataFrame, values: DataFrame, value: str) -> tuple[DataFrame, list[str]]:
        """df with the value of each row's level, one column for each category; values: name, level and the value."""
        out, names = df, []
        for i, x in enumerate(self.categorical):
            side = values.filter(c("name") == x).select(c("level").alias(f"_k{i}"), c(value).alias(f"_v{i}"))
            out = lookup(out.withColumn(f"_k{i}", F.coalesce(c(x).cast("string"), F.lit("missing"))), side, [f"_k{i}"])
            names.append(f"_v{i}")
        return out, names

    def rows(self, df: DataFrame, y: Column) -> DataFrame:
        """z (intercept and numbers), k (places of the levels that are known) and y of every row, staged for the passes."""
        out, names = self.joined(df, self.levels, "place")
        places = F.array_compact(F.array(*[c(x) for x in names])) if names else F.array().cast("array<int>")
        return stage(out.select(self.numbers().alias("z"), places.alias("k"), y.cast("double").alias("y")))

    def frame(self, coefficients: np.ndarray, columns: str = "coefficient") -> DataFrame:
        """name, level (none for numbers and the intercept) and an array of coefficients, one for each column of the array."""
        spark = self.levels.sparkSession
        first = [("intercept" if i == 0 else self.numeric[i - 1], None, [float(v) for v in coefficients[i]]) for i in range(self.dense)]
        head = spark.createDataFrame(first, f"name string, level string, {columns} array<double>")
        tail = spark.createDataFrame([(i, [float(v) for v in coefficients[i]]) for i in range(self.dense, self.width)], f"place int, {columns} array<double>")
        return head.unionByName(self.levels.join(F.broadcast(tail), "place").select("name", "level", columns))


def _number(name: str) -> Column:
    return F.coalesce(c(name).cast("double"), F.lit(0.0))


def design(train: DataFrame, numeric: list[str], categorical: list[str]) -> Design:
    """Scales and places as training has them; refuses models wider than WIDEST."""
    aggs = [f(_number(x)).alias(f"{n}_{x}") for x in numeric for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]
    row = train.agg(F.count("*").alias("n"), *aggs).first()
    scales = [(row[f"m_{x}"] or 0.0, row[f"s_{x}"] if (row[f"s_{x}"] or 0.0) > 1e-9 else 1.0) for x in numeric]
    spark = train.sparkSession
    if not categorical:
        return Design(numeric, categorical, scales, spark.createDataFrame([], "name string, level string, place int"), 1 + len(numeric))
    pairs = F.array(*[F.struct(F.lit(x).alias("name"), F.coalesce(c(x).cast("string"), F.lit("missing")).alias("level")) for x in categorical])
    found = stage(train.select(F.explode(pairs).alias("p")).select("p.*").distinct())
    n = found.count()
    if 1 + len(numeric) + n > WIDEST:
        raise ValueError(f"{n} levels make a model wider than {WIDEST} columns")
    place = F.row_number().over(Window.orderBy("name", "level")) + len(numeric)  # at most WIDEST rows
    return Design(numeric, categorical, scales, stage(found.withColumn("place", place.cast("int"))), 1 + len(numeric) + n)


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dense pieces of the rows and their y."""
    for batch in batches:
        step = max(1, PIECE // width)
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            x = np.zeros((part.num_rows, width))
            z = part["z"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            x[:, : z.shape[1]] = z
            k = part["k"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            x[np.repeat(np.arange(part.num_rows), part["k"].value_lengths().to_numpy(zero_copy_only=False)), k] = 1
            yield x, part["y"].to_numpy(zero_copy_only=False)


def penalty(width: int, l2: float) -> np.ndarray:
    """Weight of each squared coefficient: none for the intercept."""
    out = np.full(width, l2)
    out[0] = 0.0
    return out


def ridge(rows: DataFrame, width: int, l2: float) -> np.ndarray:
    """Coefficients of the linear fit, from one pass that adds up products of columns."""

    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        gram, cross, n = np.zeros((width, width)), np.zeros(width), 0
        for x, y in _pieces(batches, width):
            gram += x.T @ x
            cross += x.T @ y
            n += len(y)
        return np.concatenate([gram.ravel(), cross, [n]])

    got = merged(rows, fold, width * width + width + 1)
    n = max(1.0, got[-1])
    gram = got[: width * width].reshape(width, width) / n
    return solved(gram + np.diag(penalty(width, l2)), got[width * width : -1] / n)


def logistic(rows: DataFrame, width: int, l2: float) -> np.ndarray:
    """Coefficients of the logistic fit of a 0/1 y."""
    weight = penalty(width, l2)

    def at(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(2 + width + width * width)
            for x, y in _pieces(batches, width):
                out += logistic_sums(x, y, b)
            return out

        got = merged(rows, fold, 2 + width + width * width)
        return logistic_state(got, b, weight)

    return newton(np.zeros(width), at)


def logistic_sums(x: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows, loss, gradient and curvature at b, added up over rows."""
    margin = x @ b
    p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
    loss = np.logaddexp(0, margin) - y * margin
    return np.concatenate([[len(y), loss.sum()], x.T @ (p - y), (x.T @ (x * (p * (1 - p))[:, None])).ravel()])


def logistic_state(sums: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    width, n = len(b), max(1.0, sums[0])
    gradient = sums[2 : 2 + width] / n + weight * b
    curvature = sums[2 + width :].reshape(width, width) / n + np.diag(weight)
    return float(sums[1] / n + (weight * b * b).sum() / 2), gradient, curvature


def multinomial(rows: DataFrame, width: int, classes: int, l2: float) -> np.ndarray:
    """Coefficients, one line for each class, of the multinomial fit; y is the place of the class. Intercepts add up to 0."""
    weight = penalty(width, l2)
    pairs = [(k, m) for k in range(classes) for m in range(k, classes)]
    size = 2 + classes * width + len(pairs) * width * width

    def at(flat: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        b = flat.reshape(classes, width)

        def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(size)
            for x, y in _pieces(batches, width):
                margin = x @ b.T
                top = margin.max(axis=1, keepdims=True)
                p = np.exp(margin - top)
                whole = p.sum(axis=1, keepdims=True)
                p /= whole
                own = y.astype(np.int64)
                loss = (top + np.log(whole))[:, 0] - margin[np.arange(len(own)), own]
                out[:2] += len(own), loss.sum()
                p_minus = p.copy()
                p_minus[np.arange(len(own)), own] -= 1
                out[2 : 2 + classes * width] += (p_minus.T @ x).ravel()
                for i, (k, m) in enumerate(pairs):
                    a = 2 + classes * width + i * width * width
                    curve = p[:, k] * ((k == m) - p[:, m])
                    out[a : a + width * width] += (x.T @ (x * curve[:, None])).ravel()
            return out

        got = merged(rows, fold, size)
        n = max(1.0, got[0])
        gradient = got[2 : 2 + classes * width].reshape(classes, width) / n + weight * b
        curvature = np.zeros((classes * width, classes * width))
        for i, (k, m) in enumerate(pairs):
            a = 2 + classes * width + i * width * width
            block = got[a : a + width * width].reshape(width, width) / n
            curvature[k * width : (k + 1) * width, m * width : (m + 1) * width] = block
            curvature[m * width : (m + 1) * width, k * width : (k + 1) * width] = block
        curvature += np.diag(np.tile(weight, classes))
        # one number added to all intercepts changes nothing; this keeps their sum where it is
        curvature[::width, ::width] += 1.0
        return float(got[1] / n + (weight * b * b).sum() / 2), gradient.ravel(), curvature

    return newton(np.zeros(classes * width), at).reshape(classes, width)


def scores(df: DataFrame, how: Design, coefficients: np.ndarray) -> tuple[DataFrame, list[Column]]:
    """df with what its levels add, and the linear score for each column of the coefficients (a line for each column of the model)."""
    n = coefficients.shape[1]
    values = how.frame(coefficients, "v").filter("level IS NOT NULL")
    rows, names = how.joined(df, values, "v")
    z = [F.lit(1.0), *[(_number(x) - m) / s for x, (m, s) in zip(how.numeric, how.scales, strict=True)]]
    out = []
    for j in range(n):
        parts = [v * F.lit(float(coefficients[i, j])) for i, v in enumerate(z)]
        parts += [F.coalesce(F.get(c(x), F.lit(j)), F.lit(0.0)) for x in names]
        out.append(reduce(lambda a, b: a + b, parts))
    return rows, out


def softmax(margins: list[Column]) -> list[Column]:
    top = F.greatest(*margins) if len(margins) > 1 else margins[0]
    parts = [F.exp(m - top) for m in margins]
    whole = reduce(lambda a, b: a + b, parts)
    return [p / whole for p in parts]


# ---- choice of terms


def forward(train: DataFrame, dev: DataFrame, terms: int, most: int, l2: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Places of the chosen terms, coefficients (intercept first) and scales of all terms.

    Both frames hold x (an array of all terms) and y. In each round the logistic fits with one more term are made for all open
    terms at once: a pass over the training rows takes one Newton step of every fit. One pass over development then gives all
    losses; the term with the smallest stays if the loss falls. Without development rows, training judges.
    """

    def matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, terms)
        return x, batch["y"].to_numpy(zero_copy_only=False)

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(1 + 2 * terms)
        for batch in batches:
            x, _ = matrix(batch)
            out += np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
        return out

    first = merged(train, moments, 1 + 2 * terms)
    n = max(1.0, first[0])
    mean = first[1 : 1 + terms] / n

    def spread(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(terms)
        for batch in batches:
            out += ((matrix(batch)[0] - mean) ** 2).sum(axis=0)
        return out

    std = np.sqrt(merged(train, spread, terms) / n)
    std[std <= 1e-9] = 1.0
    scales = np.stack([mean, std])

    def columns(batch: pa.RecordBatch, used: list[int]) -> tuple[np.ndarray, np.ndarray]:
        x, y = matrix(batch)
        return np.column_stack([np.ones(len(y)), (x[:, used] - mean[used]) / std[used]]), y

    def fitted(chosen: list[int], open_terms: list[int]) -> list[np.ndarray]:
        width = len(chosen) + 2
        weight, cell = penalty(width, l2), 2 + width + width * width
        point = {t: np.zeros(width) for t in open_terms}
        best, value = dict(point), dict.fromkeys(open_terms, np.inf)
        step = {t: np.zeros(width) for t in open_terms}
        going = list(open_terms)
        for _ in range(STEPS):
            if not going:
                break

            def fold(batches: Iterator[pa.RecordBatch], going=tuple(going), at=dict(point)) -> np.ndarray:
                out = np.zeros((len(going), cell))
                for batch in batches:
                    for i, t in enumerate(going):
                        out[i] += logistic_sums(*columns(batch, [*chosen, t]), at[t])
                return out.ravel()

            got = merged(train, fold, len(going) * cell).reshape(len(going), cell)
            left = []
            for t, sums in zip(going, got, strict=True):
                now, gradient, curvature = logistic_state(sums, point[t], weight)
                if now > value[t] + 1e-12 * max(1.0, abs(value[t])):
                    step[t] = step[t] / 2
                else:
                    best[t], value[t] = point[t], now
                    if np.abs(gradient).max() < FLAT:
                        continue
                    step[t] = -solved(curvature, gradient)
                point[t] = best[t] + step[t]
                left.append(t)
            going = left
        return [best[t] for t in open_terms]

    def losses(rows: DataFrame, chosen: list[int], open_terms: list[int], fits: list[np.ndarray]) -> np.ndarray:
        def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(1 + len(open_terms))
            for batch in batches:
                out[0] += batch.num_rows
                for i, (t, b) in enumerate(zip(open_terms, fits, strict=True)):
                    x, y = columns(batch, [*chosen, t])
                    p = np.clip(1 / (1 + np.exp(-np.clip(x @ b, -700, 700))), 1e-6, 1 - 1e-6)
                    out[1 + i] -= (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
            return out

        got = merged(rows, fold, 1 + len(open_terms))
        return got[1:] / got[0] if got[0] else np.full(len(open_terms), np.nan)

    chosen: list[int] = []
    kept, best = np.zeros(0), np.inf
    for _ in range(min(most, terms)):
        open_terms = [t for t in range(terms) if t not in chosen]
        fits = fitted(chosen, open_terms)
        judged = losses(dev, chosen, open_terms, fits)
        if np.isnan(judged).any():
            judged = losses(train, chosen, open_terms, fits)
        won, low = None, best
        for i, loss in enumerate(judged):
            if loss < low - 1e-8:
                won, low = i, loss
        if won is None:
            break
        best, kept = low, fits[won]
        chosen = [*chosen, open_terms[won]]
    if not chosen and terms:
        chosen, kept = [0], fitted([], [0])[0]
    return chosen, kept, scales


# ---- monotone curves


def pooled(blocks: Iterator[tuple[int, int, float, float]]) -> list[list]:
    """Stack of pools (sum, weight, first and last place) of blocks in order, whose means rise; sums and weights are whole numbers."""
    stack: list[list] = []
    for total, weight, low, high in blocks:
        stack.append([int(total), int(weight), low, high])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            total, weight, _, high = stack.pop()
            stack[-1][0] += total
            stack[-1][1] += weight
            stack[-1][3] = high
    return stack


STACK = "segment long, total array<long>, weight array<long>, low array<double>, high array<double>"


def monotone(points: DataFrame, place: str, total: str, weight: str) -> DataFrame:
    """total, weight, low and high of the pools of the monotone fit; points hold distinct places with whole sums and weights.

    Points are range-partitioned by place and every segment pools its own. Neighbouring stacks are then merged, FAN at a time
    and in the order of ranges, until one is left: pooling what is pooled already changes nothing but the ends that meet. Only
    stacks move. Means of 0/1 targets that rise strictly are distinct fractions, so of n rows at most some n ** (2/3) pools
    can be left, usually far fewer.
    """
    ranged = points.filter(c(place).isNotNull()).select(c(place).cast("double").alias("p"), c(total).cast("long").alias("s"), c(weight).cast("long").alias("w"))
    ranged = ranged.repartitionByRange("p").sortWithinPartitions("p").withColumn("segment", F.spark_partition_id().cast("long"))

    def packed(segment: int, stack: list[list]) -> pa.RecordBatch:
        columns = list(map(list, zip(*stack, strict=True)))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), *(pa.array([x], pa.list_(k)) for x, k in zip(columns, kinds, strict=True))], ["segment", "total", "weight", "low", "high"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, segment = [], 0
        for batch in batches:
            segment = batch["segment"][0].as_py() if batch.num_rows else segment
            rows = zip(*(batch[x].to_pylist() for x in ("s", "w", "p", "p")), strict=True)
            stack = pooled([*stack, *rows])
        if stack:
            yield packed(segment, stack)

    stacks = stage(ranged.mapInArrow(own, STACK))

    def met(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("segment")
        blocks = [b for r in rows.itertuples() for b in zip(r.total, r.weight, r.low, r.high, strict=True)]
        stack = list(map(list, zip(*pooled(blocks), strict=True)))
        return pd.DataFrame({"segment": [rows["group"].iloc[0]], **dict(zip(("total", "weight", "low", "high"), [[x] for x in stack], strict=True))})

    while stacks.count() > 1:
        group = F.floor(c("segment") / FAN).cast("long")
        stacks = stage(stacks.withColumn("group", group).groupBy("group").applyInPandas(met, STACK))
    pools = stacks.select(F.explode(F.arrays_zip("total", "weight", "low", "high")).alias("x"))
    return pools.select("x.total", "x.weight", "x.low", "x.high")
