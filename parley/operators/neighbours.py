"""Exact nearest neighbour over cells of a k-d tree.

Distinct trained vectors are dealt to cells. The tree comes from a bounded sample: each node is cut at the median of the
coordinate along which its sample spreads most, so a coordinate that is the same everywhere is never cut. A cell is known by
the box around its vectors. A query looks into its own cell first; the distance found there rules out all boxes that are
farther away, and only the rest is visited. Cells hold a bounded share of the vectors; where many queries meet in a cell, they
are dealt to copies of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.joins import lookup
from parley.operators.models import standardised
from parley.session import stage

c = F.col

#: Vectors of a cell on average; cells at most; sampled vectors for each cell.
CELL_ROWS, CELLS, PER_CELL = 4_096, 4_096, 16
#: Queries of a cell that one task answers on average.
ASKED_ROWS = 50_000
#: Distances that a task holds at a time.
PIECE = 2_000_000
#: A hair of slack, so that rounding cannot hide an equal distance.
SLACK = 1e-9

FOUND = "z array<double>, d2 double, seq bigint, target int"


@dataclass
class Tree:
    """Inner nodes as arrays: coordinate, cut and first child (the second follows); leaves have their cell as -1 - child."""

    axis: np.ndarray
    cut: np.ndarray
    child: np.ndarray

    def cells(self, z: np.ndarray) -> np.ndarray:
        """Cell of every vector."""
        node = np.zeros(len(z), np.int64)
        going = self.child[node] >= 0
        while going.any():
            at = node[going]
            node[going] = self.child[at] + (z[going, self.axis[at]] > self.cut[at])
            going = self.child[node] >= 0
        return -1 - self.child[node]


def tree_of(sample: np.ndarray, cells: int) -> tuple[Tree, int]:
    """A tree with at most so many cells, each with about the same share of the sample; and how many there are."""
    axis, cut, child, n = [0], [0.0], [0], 0
    todo = [(0, sample, max(1, cells))]
    while todo:
        node, part, wanted = todo.pop()
        spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(1)
        if wanted > 1 and spread.max() > 0:
            a = int(spread.argmax())
            values = np.sort(part[:, a])
            middle = values[(len(values) - 1) // 2]
            if middle == values[-1]:  # more than half lie at the top: cut just below it
                middle = values[values < middle][-1]
            low = part[:, a] <= middle
            first = len(axis)
            axis += [0, 0]
            cut += [0.0, 0.0]
            child += [0, 0]
            axis[node], cut[node], child[node] = a, float(middle), first
            todo += [(first, part[low], wanted // 2), (first + 1, part[~low], wanted - wanted // 2)]
        else:
            child[node] = -1 - n
            n += 1
    return Tree(np.array(axis), np.array(cut), np.array(child)), n


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def with_cell(df: DataFrame, tree: Tree, width: int) -> DataFrame:
    """df with the cell of its vector z as a last column."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = pa.array(tree.cells(_matrix(batch["z"], width)), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cell"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(place, f"{kinds}, cell long")


def _search(group: pd.DataFrame) -> pd.DataFrame:
    """Nearest trained vector of the cell for each query in it, smallest seq on equal distance."""
    trained = group[group["kind"] == 0].sort_values("seq")
    asked = group[group["kind"] == 1]
    if len(trained) == 0 or len(asked) == 0:
        return pd.DataFrame([], columns=["z", "d2", "seq", "target"])
    points, queries = (np.array(x["z"].tolist(), dtype=float) for x in (trained, asked))
    best, at = np.empty(len(queries)), np.empty(len(queries), np.int64)
    step = max(1, PIECE // len(points))
    for a in range(0, len(queries), step):
        # the same order of additions as a column expression would use
        d2 = np.zeros((len(queries[a : a + step]), len(points)))
        for j in range(points.shape[1]):
            d2 = d2 + (points[:, j] - queries[a : a + step, j, None]) ** 2
        at[a : a + step] = d2.argmin(axis=1)
        best[a : a + step] = d2[np.arange(len(d2)), at[a : a + step]]
    return pd.DataFrame({"z": asked["z"].tolist(), "d2": best, "seq": trained["seq"].to_numpy()[at], "target": trained["target"].to_numpy()[at]})


def _answered(trained: DataFrame, asked: DataFrame) -> DataFrame:
    """Best vector of its cell for every query; cells with many queries are copied."""
    copies = asked.groupBy("cell").agg(F.ceil(F.count("*") / ASKED_ROWS).cast("int").alias("copies"))  # at most CELLS rows
    copies = F.broadcast(copies)
    spread = asked.join(copies, "cell").select("cell", F.pmod(F.xxhash64("z"), c("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"), "z", F.lit(None).cast("int").alias("target"), F.lit(None).cast("long").alias("seq"))
    held = trained.join(copies, "cell").select("cell", F.explode(F.sequence(F.lit(0), c("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), "z", "target", "seq")
    return held.unionByName(spread).groupBy("cell", "copy").applyInPandas(_search, FOUND)


def visits(asked: DataFrame, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """z and every other cell whose box is not farther from it than d2; boxes are given by their corners."""
    width = low.shape[1]

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PIECE // max(1, len(low)))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                z, d2 = _matrix(part["z"], width), part["d2"].to_numpy(zero_copy_only=False)
                gap = np.zeros((len(z), len(low)))
                for j in range(width):
                    gap += np.maximum(0, np.maximum(low[:, j] - z[:, j, None], z[:, j, None] - high[:, j])) ** 2
                near = gap <= (d2 * (1 + SLACK) + SLACK)[:, None]
                near[np.arange(len(z)), part["cell"].to_numpy(zero_copy_only=False)] = False
                row, cell = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([part["z"].take(pa.array(row)), pa.array(cell, pa.int64())], ["z", "cell"])

    return asked.select("z", "cell", "d2").mapInArrow(reach, "z array<double>, cell long")


def searched(trained: DataFrame, asked: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """z, d2, seq and target of the nearest vector for every query, and the visits beyond the own cell.

    trained: distinct z with seq and target; asked: distinct z.
    """
    trained = stage(trained)
    n = trained.count()
    wanted = min(CELLS, max(1, -(-n // CELL_ROWS)))
    rows = trained.select("z").orderBy(F.xxhash64("z"), "z").limit(wanted * PER_CELL).collect() if wanted > 1 else []
    tree, cells = tree_of(np.array([r.z for r in rows], dtype=float).reshape(len(rows), width), wanted)
    trained, asked = stage(with_cell(trained, tree, width)), stage(with_cell(asked, tree, width))
    corners = [f(F.get("z", F.lit(j))).alias(f"{name}{j}") for j in range(width) for f, name in ((F.min, "a"), (F.max, "b"))]
    low, high = np.full((cells, width), np.inf), np.full((cells, width), -np.inf)
    for r in trained.groupBy("cell").agg(*corners).collect():  # at most CELLS rows
        low[r["cell"]], high[r["cell"]] = [r[f"a{j}"] for j in range(width)], [r[f"b{j}"] for j in range(width)]
    first = stage(_answered(trained, asked))
    # a query whose own cell is empty has found nothing yet
    open_asked = asked.join(first.select("z", "d2"), "z", "left").withColumn("d2", F.coalesce("d2", F.lit(np.inf)))
    beyond = stage(visits(open_asked, low, high))
    second = _answered(trained, beyond)
    best = first.unionByName(second).groupBy("z").agg(F.min(F.struct("d2", "seq", "target")).alias("_b"))
    return best.select("z", "_b.*"), beyond


def nearest(df: DataFrame, train: DataFrame, names: list[str], seq: str, target: str = "target") -> DataFrame:
    """Rows with ``near_target`` of the nearest training row by standardised distance; the first row wins ties."""
    rows = standardised(df, train, names)
    known = standardised(train, train, names).groupBy("z").agg(F.min_by(c(target).cast("int"), seq).alias("target"), F.min(c(seq).cast("long")).alias("seq"))
    best, _ = searched(known, rows.select("z").distinct(), len(names))
    return lookup(rows, best.select("z", c("target").alias("near_target")), ["z"], "inner").drop("z")


def predict_nearest(df: DataFrame, train: DataFrame, names: list[str], seq: str, target: str = "target") -> DataFrame:
    """0.8 where the nearest training row is positive, else 0.2."""
    return nearest(df, train, names, seq, target).withColumn("p", F.when(c("near_target") == 1, 0.8).otherwise(0.2)).drop("near_target")
