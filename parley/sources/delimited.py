"""Delimited files with an exact header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


class HeaderMismatch(ValueError):
    pass


def header_report(spark: SparkSession, path: str, expected: list[str], sep: str = ",") -> dict:
    """Missing, extra and misplaced columns, from the first line only."""
    first = spark.read.text(path).first()
    found = [h.strip().strip('"') for h in first[0].split(sep)] if first else []
    return {
        "missing": [h for h in expected if h not in found],
        "extra": [h for h in found if h not in expected],
        "order_matches": [h for h in found if h in expected] == [h for h in expected if h in found],
        "matches": found == expected,
    }


def scan_delimited(
    spark: SparkSession, path: str, schema: T.StructType, strict_header: bool = True, sep: str = ","
) -> DataFrame:
    if strict_header:
        report = header_report(spark, path, schema.fieldNames(), sep)
        if not report["matches"]:
            raise HeaderMismatch(f"header of {path} differs: {report}")
    # enforceSchema=False makes every file of the folder check its own header
    return (
        spark.read.schema(schema).option("header", True).option("enforceSchema", not strict_header)
        .option("sep", sep).option("mode", "FAILFAST").csv(path)
    )


def scan_with_rejects(spark: SparkSession, path: str, columns: list[str], header: bool = False, sep: str = ",") -> DataFrame:
    """All columns as text; rows whose field count differs carry their line in _corrupt_record."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])
    return (
        spark.read.schema(schema).option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path)
    )
