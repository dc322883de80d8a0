"""Ordered columns (rank, running totals, lead, lag) that survive one hot key.

``Window.partitionBy(key).orderBy(...)`` puts every row of a key into one task, and a window without keys puts the whole table
there. Keys are counted first. A key of at most HOT_ROWS rows is ordered by one task, as a window does it. Rows of keys with
more, and rows without keys, are range-partitioned by (keys, order) instead, so a key with a third of all rows is cut over
many segments, and staged once: segments must not change between uses. Windows run inside (segment, key); what a segment owes
to its predecessors is a carry table. A range boundary falls inside at most one key, so the carry has at most two rows per
range partition: its broadcast is bounded by ``spark.sql.shuffle.partitions`` and does not grow with the data. Both kinds of
keys get the same columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import stage

SEGMENT = "_segment"
#: Rows of a key that one task orders; more are cut into segments.
HOT_ROWS = 1_000_000


@dataclass(frozen=True)
class Spec:
    kind: str
    value: Column | None = None
    inclusive: bool = True


def rank() -> Spec:
    """1-based position inside the key."""
    return Spec("rank")


def total(value: Column | None = None) -> Spec:
    """Rows of the key (or the sum of a value over them), on every row."""
    return Spec("total", value)


def running_sum(value: Column, inclusive: bool = True) -> Spec:
    return Spec("sum", value, inclusive)


def running_max(value: Column, inclusive: bool = True) -> Spec:
    return Spec("max", value, inclusive)


def running_min(value: Column, inclusive: bool = True) -> Spec:
    return Spec("min", value, inclusive)


def lead(value: Column) -> Spec:
    """Value of the next row of the key."""
    return Spec("lead", value)


def lag(value: Column) -> Spec:
    """Value of the previous row of the key."""
    return Spec("lag", value)


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


class Sequence:
    """Rows with ordered columns per key; ``order`` must be total, ascending."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str]):
        self.keys = keys
        self.order = order
        # rows of keys that one task can order, and staged rows of all others
        self._cold, self._df = None, None
        if not keys:
            self._df = self._segmented(df)
            return
        hot = stage(df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_ROWS).select(*[F.col(c).alias(f"_h_{c}") for c in keys]))
        if hot.isEmpty():
            self._cold = df
            return
        match = reduce(lambda a, b: a & b, [df[c].eqNullSafe(hot[f"_h_{c}"]) for c in keys])
        self._cold = df.join(F.broadcast(hot), match, "left_anti")  # of n rows at most n / HOT_ROWS keys are hot
        self._df = self._segmented(df.join(F.broadcast(hot), match, "left_semi"))

    def _segmented(self, df: DataFrame) -> DataFrame:
        ranged = df.repartitionByRange(*[F.col(c) for c in self.keys + self.order])
        return stage(ranged.withColumn(SEGMENT, F.spark_partition_id()))

    def _with(self, cold: DataFrame | None, df: DataFrame | None) -> Sequence:
        out = object.__new__(Sequence)
        out.keys, out.order, out._cold, out._df = self.keys, self.order, cold, df
        return out

    @property
    def frame(self) -> DataFrame:
        parts = [x for x in (self._cold, self._df and self._df.drop(SEGMENT)) if x is not None]
        return reduce(DataFrame.unionByName, parts)

    def map(self, **columns: Column) -> Sequence:
        """Row-wise columns that keep the order."""
        return self._with(self._cold and self._cold.withColumns(columns), self._df and self._df.withColumns(columns))

    def add(self, **specs: Spec) -> Sequence:
        return self._with(self._cold and self._added(specs), self._df and self._carried(specs))

    def _added(self, specs: dict[str, Spec]) -> DataFrame:
        """Plain windows for the keys that one task can order."""
        whole = Window.partitionBy(*self.keys)
        inside = whole.orderBy(*self.order)
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        before = inside.rowsBetween(Window.unboundedPreceding, -1)
        new = {}
        for name, spec in specs.items():
            frame = upto if spec.inclusive else before
            if spec.kind == "rank":
                new[name] = F.row_number().over(inside).cast("long")
            elif spec.kind == "total":
                new[name] = (F.count(F.lit(1)) if spec.value is None else F.sum(spec.value)).over(whole)
            elif spec.kind in ("lead", "lag"):
                new[name] = (F.lead if spec.kind == "lead" else F.lag)(spec.value).over(inside)
            else:
                new[name] = {"sum": F.sum, "max": F.max, "min": F.min}[spec.kind](spec.value).over(frame)
        keep = [c for c in self._cold.columns if c not in specs]
        return self._cold.select(*keep, *[c.alias(n) for n, c in new.items()])

    def _straddling(self) -> DataFrame:
        """Rows of the keys that lie in more than one segment."""
        if not self.keys:
            return self._df
        key = F.struct(*self.keys)
        edges = (
            self._df.groupBy(SEGMENT)
            .agg(F.min(key).alias("a"), F.max(key).alias("b"))
            .select(SEGMENT, F.explode(F.array("a", "b")).alias("k"))
            .groupBy("k")
            .agg(F.countDistinct(SEGMENT).alias("n"))
            .filter("n > 1")
            .select(*[F.col(f"k.{c}").alias(c) for c in self.keys])
        )
        return self._df.join(F.broadcast(edges), _same(self._df, edges, self.keys), "left_semi")

    def _carried(self, specs: dict[str, Spec]) -> DataFrame:
        """Windows inside segments, and what earlier segments of the key add to them."""
        inside = Window.partitionBy(SEGMENT, *self.keys).orderBy(*self.order)
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        before = inside.rowsBetween(Window.unboundedPreceding, -1)
        across = Window.partitionBy(*self.keys).orderBy(SEGMENT) if self.keys else Window.orderBy(SEGMENT)
        earlier = across.rowsBetween(Window.unboundedPreceding, -1)
        position = F.struct(*self.order)

        local, aggs, carried, final = {}, [], [], {}
        for name, spec in specs.items():
            loc, agg, car = f"_l_{name}", f"_a_{name}", f"_c_{name}"
            frame = upto if spec.inclusive else before
            if spec.kind in ("rank", "sum"):
                value = F.lit(1) if spec.kind == "rank" else spec.value
                local[loc] = F.row_number().over(inside).cast("long") if spec.kind == "rank" else F.sum(value).over(frame)
                aggs.append((F.count(F.lit(1)) if spec.kind == "rank" else F.sum(value)).alias(agg))
                carried.append(F.sum(agg).over(earlier).alias(car))
                both = F.coalesce(F.col(loc), F.lit(0)) + F.coalesce(F.col(car), F.lit(0))
                final[name] = F.when(F.col(loc).isNotNull() | F.col(car).isNotNull(), both)
            elif spec.kind == "total":
                fold = F.count(F.lit(1)) if spec.value is None else F.sum(spec.value)
                local[loc] = fold.over(Window.partitionBy(SEGMENT, *self.keys))
                aggs.append(fold.alias(agg))
                carried.append(F.sum(agg).over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(car))
                final[name] = F.coalesce(F.col(car), F.col(loc))
            elif spec.kind in ("max", "min"):
                fold, pick = (F.max, F.greatest) if spec.kind == "max" else (F.min, F.least)
                local[loc] = fold(spec.value).over(frame)
                aggs.append(fold(spec.value).alias(agg))
                carried.append(fold(agg).over(earlier).alias(car))
                final[name] = pick(F.col(loc), F.col(car))
            else:
                shift = F.lead if spec.kind == "lead" else F.lag
                edge = F.min_by if spec.kind == "lead" else F.max_by
                cell = F.struct(spec.value.alias("v"))
                local[loc] = shift(cell).over(inside)
                aggs.append(edge(cell, position).alias(agg))
                carried.append(shift(agg).over(across).alias(car))
                final[name] = F.coalesce(F.col(loc), F.col(car))["v"]

        body = self._df.withColumns(local)
        keep = [c for c in self._df.columns if c not in specs]
        on = [SEGMENT, *self.keys]
        carry = (
            self._straddling().groupBy(*on).agg(*aggs)
            .select(*on, *carried)
            .select(*[F.col(c).alias(f"_k_{c}") for c in on], *[f"_c_{n}" for n in specs])
        )
        match = reduce(lambda a, b: a & b, [body[c].eqNullSafe(carry[f"_k_{c}"]) for c in on])
        joined = body.join(F.broadcast(carry), match, "left")
        return joined.select(*keep, *[c.alias(n) for n, c in final.items()])


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    return Sequence(df, keys, order).add(**{name: rank()}).frame
