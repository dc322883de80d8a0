"""Exports whose format is told by the file suffix and whose columns vary by file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def format_of(path: str) -> str:
    name = path.lower().rstrip("/")
    for suffix, kind in [(".csv", "csv"), (".csv.gz", "csv"), (".jsonl", "jsonl"), (".json", "json"), (".parquet", "parquet")]:
        if name.endswith(suffix):
            return kind
    raise ValueError(f"no reader for {path}")


def _json(spark: SparkSession, path: str, whole: bool, schema: T.StructType | None) -> DataFrame:
    """Records of a JSON file: a line or list element each, or the elements of ``rows`` in one object."""
    reader = spark.read.option("multiLine", whole).option("primitivesAsString", True)
    if not whole:
        return (reader.schema(schema) if schema else reader).json(path)
    if schema:
        df = reader.schema(T.StructType([*schema.fields, T.StructField("rows", T.ArrayType(schema))])).json(path)
        plain = F.array(F.struct(*[F.col(f"`{x}`") for x in schema.names]))
        return df.select(F.inline(F.coalesce("rows", plain)))
    df = reader.json(path)
    nested = "rows" in df.columns and isinstance(df.schema["rows"].dataType, T.ArrayType) and isinstance(df.schema["rows"].dataType.elementType, T.StructType)
    return df.select(F.inline("rows")) if nested else df


def scan_export(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One export as text columns. Without a schema the column names are read from the file."""
    kind = format_of(path)
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "csv":
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else reader).csv(path)
    else:
        df = _json(spark, path, kind == "json", schema)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def scan_exports(spark: SparkSession, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
    """Union of several exports; a column that a file lacks is NULL there."""
    parts = [scan_export(spark, p, schema) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
