"""Joining facts to fitted tables that usually are small, whatever their keys look like."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import stage

#: Rows of a fitted table that are sent to every executor; checked by a count before each join.
BROADCAST_ROWS = 200_000
#: A key is hot if it holds more than one of so many rows of the fact: there are at most as many hot keys.
HOT_SHARE = 10_000


def lookup(fact: DataFrame, small: DataFrame, on: list[str], how: str = "left", most: int | None = None) -> DataFrame:
    """fact joined to the one row of ``small`` with the same values of ``on``; the fact is not shuffled while small is small.

    small has one row for each key. Beyond ``most`` rows it is not broadcast: rows of hot keys meet only the broadcast rows
    of these keys, of which there are few, and the rest is joined by a shuffle in which no key stands out. The rows are the
    same either way.
    """
    most = BROADCAST_ROWS if most is None else most
    small = stage(small)
    if small.count() <= most:
        return fact.join(F.broadcast(small), on, how)
    fact = stage(fact)
    counts = fact.groupBy(*on).agg(F.count("*").alias("_n"))
    hot = stage(counts.filter(F.col("_n") * HOT_SHARE > F.lit(fact.count())).select(*[F.col(x).alias(f"_h_{x}") for x in on]))

    def among(df: DataFrame, kind: str) -> DataFrame:
        same = reduce(lambda a, b: a & b, [df[x].eqNullSafe(hot[f"_h_{x}"]) for x in on])
        return df.join(F.broadcast(hot), same, kind)

    few = among(small, "left_semi")
    frequent = among(fact, "left_semi").join(F.broadcast(few), on, how)
    return frequent.unionByName(among(fact, "left_anti").join(small.hint("shuffle_merge"), on, how))
