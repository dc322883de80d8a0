"""Rows at given positions of an order, found by counting instead of sorting.

A first pass sketches the order of every group and brackets each position; a second pass counts what lies outside the brackets
in bulk and what lies inside value by value. The bracket holds a few thousandths of the rows, and copies of a value are one
count, so what is put in order is small next to the input, and the rows themselves never move. Counts are exact: a sketch
that missed would show, and then all values are counted. All groups and all positions are found together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators import sequence
from parley.operators.joins import lookup
from parley.operators.sequence import Sequence, rank, running_sum, total
from parley.session import stage

c = F.col

#: Rank error of the sketch is at most one in so many rows; brackets are twice as wide to either side.
ACCURACY = 1_000
#: Values of a group that are counted one by one without a sketch.
FEW = 5_000

#: A wanted place: about which share of the rows lies before it, and its exact 0-based index given the number of rows.
Place = tuple[float, Callable[[Column], Column]]


#: The group of all rows where there is no key.
ALL = "_all"


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """df with names for its keys that no other column has, and at least one key."""
    if not keys:
        return df.withColumn(ALL, F.lit(0)), [ALL]
    return df.withColumns({f"_g{i}": c(k) for i, k in enumerate(keys)}), [f"_g{i}" for i in range(len(keys))]


def _one_key(groups: list[str]) -> Column:
    """A group's keys as one value that is never missing; a missing key is a group like any other."""
    return F.struct(*[x for g in groups for x in (F.coalesce(c(g).cast("string"), F.lit("")).alias(g), c(g).isNull().alias(f"{g}_none"))])


def _matched(df: DataFrame, small: DataFrame, groups: list[str]) -> DataFrame:
    """df with the other columns of its group's row in small; a missing key is a group like any other."""
    if groups == [ALL]:
        return _with_row(df, small.drop(ALL))
    one = _one_key(groups)
    return lookup(df.withColumn("_gk", one), small.withColumn("_gk", one).drop(*groups), ["_gk"], "inner").drop("_gk")


def _with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a frame of one row."""
    return df.withColumn("_row1", one.select(F.struct(*one.columns)).scalar()).select(*df.columns, *[c("_row1")[x].alias(x) for x in one.columns])


def _cells(rows: DataFrame, groups: list[str], value: str, places: dict[str, Place]) -> DataFrame:
    """Counts per group of single values inside the brackets and of the stretches between them.

    A small group is sketched exactly, but rounding may move a place by one row: in a group of a few thousand rows a bracket
    may be too narrow by that, so groups of up to FEW values have no bracket but count all values.
    """
    ends = [x for share, _ in places.values() for x in (max(0.0, share - 2 / ACCURACY), min(1.0, share + 2 / ACCURACY))]
    sketch = rows.groupBy(*groups).agg(F.percentile_approx(value, ends, ACCURACY).alias("_ends"), F.count(value).alias("_few"), F.min(value).alias("_a"), F.max(value).alias("_b"))
    wide = F.flatten(F.array_repeat(F.array("_a", "_b"), len(places)))
    sketch = sketch.select(*groups, F.when(c("_few") <= FEW, wide).otherwise(c("_ends")).alias("_ends"))
    near = _matched(rows.select(*groups, value), sketch, groups)
    low, high = ([c("_ends")[2 * i + j] for i in range(len(places))] for j in (0, 1))
    v = c(value)
    inside = reduce(lambda a, b: a | b, [(v >= a) & (v <= b) for a, b in zip(low, high, strict=True)])
    stretch = reduce(lambda a, b: a + b, [(v >= a).cast("int") + (v > b).cast("int") for a, b in zip(low, high, strict=True)])
    return near.groupBy(*groups, F.when(inside, v).alias("_one"), F.coalesce(stretch, F.lit(-1)).alias("_stretch")).agg(F.count("*").alias("_n"), F.max(v).alias("_top"))


def _running(cells: DataFrame, groups: list[str]) -> DataFrame:
    """Running and whole counts; one task does it while all cells together are what it may hold of a key anyway."""
    cells = stage(cells)
    order = ["_top", "_stretch"]
    if cells.count() <= sequence.HOT_ROWS:
        whole = Window.partitionBy(*groups)
        upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return cells.withColumns({"_cum": F.sum("_n").over(upto), "_total": F.sum("_n").over(whole)})
    return Sequence(cells, groups, order).add(_cum=running_sum(c("_n")), _total=total(c("_n"))).frame


def _picked(cells: DataFrame, groups: list[str], places: dict[str, Place]) -> DataFrame:
    """For each group and place the cell that covers it: its value, whether it is one value, and what lies before it."""
    picks = []
    for name, (_, index) in places.items():
        at = index(c("_total")).cast("long")
        cell = F.struct(c("_top").alias("value"), (c("_one").isNotNull() | c("_top").isNull()).alias("single"), (at - (c("_cum") - c("_n"))).alias("rest"), c("_n").alias("equal"))
        picks.append(F.max(F.when((at >= c("_cum") - c("_n")) & (at < c("_cum")), cell)).alias(name))
    return cells.groupBy(*groups).agg(F.max("_total").alias("_total"), *picks)


def placed(rows: DataFrame, groups: list[str], value: str, places: dict[str, Place]) -> DataFrame:
    """One row for each group: ``_total`` and, for each place, a struct of the value there and its index among equal values."""
    found = stage(_picked(_running(_cells(rows, groups, value, places), groups), groups, places))
    missed = reduce(lambda a, b: a | b, [~F.coalesce(c(f"{name}.single"), F.lit(True)) for name in places])
    if found.filter(missed).isEmpty():
        return found
    every = rows.groupBy(*groups, c(value).alias("_one"), F.lit(0).alias("_stretch")).agg(F.count("*").alias("_n"), F.max(value).alias("_top"))
    return stage(_picked(_running(every, groups), groups, places))


def text_start(text: Column) -> Column:
    """The first seven bytes as a number, which never falls along the order of texts."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")


def values_at(df: DataFrame, value: str, places: dict[str, Place], keys: list[str] | None = None) -> DataFrame:
    """keys, ``_total`` (rows with a value) and the value at each place."""
    keys = keys or []
    rows, groups = _keyed(df.filter(c(value).isNotNull()).select(*keys, c(value).alias("_v")), keys)
    found = placed(stage(rows.select(*groups, "_v")), groups, "_v", places)
    return found.select(*[c(g).alias(k) for g, k in zip(groups, keys)], "_total", *[c(f"{name}.value").alias(name) for name in places])


def rows_at(df: DataFrame, by: list[str], first: Column, order: list[str], places: dict[str, Place], staged: bool = False) -> tuple[DataFrame, list[str]]:
    """df with ``_total`` of its group and, for each place, the order columns of the row there (null beyond the end).

    ``first`` is a number or time that never falls along ``order``; rows with equal ones are put in order where a place lies
    among them. A frame that is not ``staged`` is, as every pass reads it. Returns the names of the new columns along.
    """
    df = df if staged else stage(df)
    return with_cuts(df, by, cuts_at(df, by, first, order, places)), ["_total", *[f"_cut_{x}" for x in places]]


def cuts_at(df: DataFrame, by: list[str], first: Column, order: list[str], places: dict[str, Place]) -> DataFrame:
    """What ``rows_at`` adds, one row for each group. Every pass reads df, each with its own columns."""
    rows, groups = _keyed(df, by)
    narrow = rows.select(*groups, first.alias("_v"), *order)
    found = placed(narrow, groups, "_v", places)
    names = list(places)
    wanted = F.array(*[F.struct(F.lit(x).alias("name"), c(f"{x}.value").alias("value"), c(f"{x}.rest").alias("rest"), c(x).isNotNull().alias("is")) for x in names])
    asked = found.select(*groups, F.explode(wanted).alias("w"))
    one = _one_key(groups)
    sought = F.broadcast(asked.filter("w.is").select(one.alias("_gk"), "w"))  # one row for each group and place
    ties = narrow.withColumn("_gk", one).join(sought, "_gk").filter(c("_v").eqNullSafe(c("w.value")))
    ties = ties.select("_gk", c("w.name").alias("_name"), c("w.rest").alias("_rest"), *order)
    most = found.agg(F.max(F.greatest(*[F.coalesce(c(f"{x}.equal"), F.lit(0)) for x in names], F.lit(0)))).first()[0] or 0
    if most <= sequence.HOT_ROWS:
        ranked = ties.withColumn("_at", F.row_number().over(Window.partitionBy("_gk", "_name").orderBy(*order)))
    else:
        ranked = Sequence(ties, ["_gk", "_name"], order).add(_at=rank()).frame
    cut = ranked.filter(c("_at") == c("_rest") + 1).groupBy("_gk").pivot("_name", names).agg(F.first(F.struct(*order)))
    ends = found.select(one.alias("_gk"), "_total").join(cut, "_gk", "left")
    return ends.select("_gk", "_total", *[c(x).alias(f"_cut_{x}") for x in names])


def with_cuts(df: DataFrame, by: list[str], cuts: DataFrame) -> DataFrame:
    """df with the columns of its group's row in ``cuts``."""
    rows, groups = _keyed(df, by)
    if groups == [ALL]:
        return _with_row(df, cuts.drop("_gk"))
    return lookup(rows.withColumn("_gk", _one_key(groups)), cuts, ["_gk"]).drop("_gk", *groups)
