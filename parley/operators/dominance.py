"""Counting by two orders at once: how many earlier points of a key have a smaller value.

Points and questions are range-partitioned by key and time into segments of bounded size. Inside a segment the answer comes
from merging halves, level by level. Points of earlier segments matter only to keys that are cut by a boundary, at most one
for each boundary; for these, segments form the leaves of a tree, a prefix of segments is a union of at most log2 of their
number of nodes, and in each node a question takes its place among the sorted values. Work is points and questions times the
logarithm of the segments, whatever the number of different questions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.sequence import Sequence, running_sum
from parley.session import stage

c = F.col

#: Points and questions of a segment on average.
SEGMENT_ROWS = 200_000


def counted(at: np.ndarray, value: np.ndarray, tag: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each row the number of points (tag 1) of its key that stand before it in time and before it by (value, tag).

    At equal times questions (other tags) come first, so they see strictly earlier points.
    """
    n = len(at)
    point = tag == 1
    by_time = np.lexsort((point, at, key))
    place = np.empty(n, np.int64)
    place[by_time] = np.arange(n)
    by_value = np.lexsort((tag, value, key))
    rows = place[by_value]  # places in time, in the order of values
    is_point = point[by_value]
    found = np.zeros(n, np.int64)
    for level in range(max(1, n - 1).bit_length()):
        block, late = rows >> (level + 1), (rows >> level) & 1
        order = np.argsort(block, kind="stable")
        seen = np.cumsum(is_point[order] & (late[order] == 0))
        first = np.flatnonzero(np.append(True, np.diff(block[order]) != 0)) if n else np.zeros(0, np.int64)
        before = np.repeat(np.append(0, seen[first[1:] - 1]), np.diff(np.append(first, n)))
        mine = late[order] == 1
        found[by_value[order[mine]]] += (seen - before)[mine]
    # both orders begin with the key: points of smaller keys were counted along
    smaller = np.sort(key[point])
    return found - np.searchsorted(smaller, key, side="left")


def below(points: DataFrame, questions: DataFrame, keys: list[str], at: str, value: str, question: str, inclusive: str) -> DataFrame:
    """question and ``n``: points of the same key with a smaller ``at`` and a smaller value (or an equal one, if inclusive).

    at is a whole number; a question has a unique name; NaN is the largest value; points without value do not count.
    """
    columns = [*keys, "_at", "_value", "_tag", "_q"]
    told = points.filter(c(value).isNotNull()).select(*keys, c(at).cast("long").alias("_at"), c(value).cast("double").alias("_value"), F.lit(1).alias("_tag"), F.lit(None).cast("string").alias("_q"))
    asked = questions.select(*keys, c(at).cast("long").alias("_at"), c(value).cast("double").alias("_value"), F.when(c(inclusive), 2).otherwise(0).alias("_tag"), c(question).cast("string").alias("_q"))
    both = stage(told.unionByName(asked).withColumn("_point", (c("_tag") == 1).cast("int")).withColumn("_row", F.monotonically_increasing_id()))
    segments = max(1, -(-both.count() // SEGMENT_ROWS))
    ranged = both.repartitionByRange(segments, *keys, "_at", "_point", "_value", "_row")
    placed = stage(ranged.withColumn("_segment", F.spark_partition_id()))

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows.groupby(keys, dropna=False, sort=True).ngroup().to_numpy() if keys else np.zeros(len(rows), np.int64)
        n = counted(rows["_at"].to_numpy(), rows["_value"].to_numpy(np.float64), rows["_tag"].to_numpy(), key)
        asked = rows["_tag"].to_numpy() != 1
        return pd.DataFrame({"_q": rows["_q"].to_numpy()[asked], "n": n[asked]})

    answers = placed.select("_segment", *columns).groupBy("_segment").applyInPandas(inside, "_q string, n long")
    if segments > 1:
        answers = answers.unionByName(_across(placed, keys, segments))
    return answers.groupBy("_q").agg(F.sum("n").alias("n")).select(c("_q").alias(question), "n")


def _across(placed: DataFrame, keys: list[str], segments: int) -> DataFrame:
    """What points of earlier segments add to the questions of cut keys."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0))
    ends = placed.groupBy("_segment").agg(F.min(key).alias("a"), F.max(key).alias("b"))
    cut = ends.select("_segment", F.explode(F.array("a", "b")).alias("_k")).groupBy("_k").agg(F.countDistinct("_segment").alias("m")).filter("m > 1").select("_k")
    rows = placed.join(F.broadcast(cut), key.eqNullSafe(c("_k")), "left_semi")  # at most one key for each boundary
    levels = F.explode(F.sequence(F.lit(0), F.lit(max(1, (segments - 1).bit_length()) - 1))).alias("_level")
    rows = rows.select("*", levels).withColumn("_half", F.expr("shiftright(_segment, _level)"))
    # a prefix of segments is the union of the left siblings on the way up; points wait in left nodes
    told = rows.filter((c("_point") == 1) & (c("_half") % 2 == 0)).withColumn("_node", c("_half"))
    asked = rows.filter((c("_point") == 0) & (c("_half") % 2 == 1)).withColumn("_node", c("_half") - 1)
    ordered = Sequence(told.unionByName(asked).drop("_half", "_segment"), [*keys, "_level", "_node"], ["_value", "_tag", "_row"])
    return ordered.add(n=running_sum(c("_point"))).frame.filter("_point = 0").select("_q", c("n").cast("long").alias("n"))
