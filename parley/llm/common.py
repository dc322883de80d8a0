"""Helpers shared by the operators on text: column picking, session folders, fold of a row."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import staging_root


def place(df: DataFrame, name: str) -> int:
    """Position of a column: the exact name first, else the name in another case."""
    names = df.columns
    if name in names:
        return names.index(name)
    lower = [n.lower() for n in names]
    if name.lower() in lower:
        return lower.index(name.lower())
    raise ValueError(f"no column {name} among {names}")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns. Extra columns, also such as differ in case alone or are repeated, are left behind."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{place(df, n)}").alias(n) for n in names))


def packed(df: DataFrame, *names: str) -> DataFrame:
    """The named columns next to the whole row as struct ``packed_row``, whose fields c0, c1, ... can clash with nothing."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(F.struct(*plain.columns).alias("packed_row"), *(F.col(f"c{place(df, n)}").alias(n) for n in names))


def restored(df: DataFrame, like: DataFrame, replaced: dict[str, Column] | None = None, added: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``like`` again from ``packed_row``; ``replaced`` gives columns new values.

    ``added`` columns come last; they take the place of columns of ``like`` with the same name in any case.
    """
    at = {place(like, n): c for n, c in (replaced or {}).items()}
    new = {n.lower() for n in added or {}}
    kept = [at.get(i, F.col(f"packed_row.c{i}")).alias(n) for i, n in enumerate(like.columns) if n.lower() not in new]
    return df.select(*kept, *(c.alias(n) for n, c in (added or {}).items()))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def share(*columns: str, seed: str = "") -> Column:
    """A number in [0, 1) drawn from a hash of the columns: the same for a row in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / float(1 << 40)


def per_worker(key: tuple, build):
    """What ``build`` makes, once for each Python worker: functions of this package travel by value, so their modules hold nothing."""
    held = sys.modules.setdefault("parley_worker_memory", types.ModuleType("parley_worker_memory")).__dict__
    if key not in held:
        held[key] = build()
    return held[key]


class Scratch:
    """Tables staged in the shared folder for the steps of one operator, removed once what follows is staged itself."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.frames: list[tuple[DataFrame, str]] = []

    def stage(self, df: DataFrame) -> DataFrame:
        path = f"{staging_root(self.spark)}/stage-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.frames.append((out, path))
        return out

    def clear(self, *keep: DataFrame) -> None:
        """Remove all tables but those kept; nothing that is still to be computed may read them."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        left = []
        for df, name in self.frames:
            if any(df is k for k in keep):
                left.append((df, name))
                continue
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        self.frames = left
