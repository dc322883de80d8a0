from datetime import datetime, timedelta
import hashlib
import pytest
from pyspark.sql import functions as F

from parley.operators import splits as P
from parley.plans import c_splits as C
from parley.plans.registry import Tables

T0 = datetime(2024, 1, 1)


def bounds(n):
    train = max(1, int(n * 0.6))
    dev = max(train, int(n * 0.8))
    return train, min(dev, n - 1) if n >= 3 else dev


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 23])
def test_region_sizes(spark, n):
    df = spark.range(n).select("id", (F.col("id") * 3).alias("t"))
    got = {r["region"]: r["count"] for r in P.chronological_split(df, "t", "id").groupBy("region").count().collect()}
    train, dev = bounds(n)
    want = {"train": train, "development": dev - train, "hidden": n - dev}
    assert got == {k: v for k, v in want.items() if v}


def test_fractions_must_leave_a_hidden_part(spark):
    with pytest.raises(ValueError):
        P.chronological_split(spark.range(3).withColumn("t", F.col("id")), "t", "id", train=0.8, development=0.2)


def test_purge_leaves_disjoint_groups(many_segments):
    spark = many_segments
    df = spark.range(400).select("id", F.col("id").alias("t"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.floor(F.col("id") / 7) + 2).alias("g"))
    kept, audit = P.chronological_purged_split(df, "t", "g", "id")
    checks = P.validate_split(kept.withColumnRenamed("id", "row_id"), "g", "t").first()
    assert checks["groups_in_two_regions"] == 0 and checks["rows_in_two_regions"] == 0 and checks["chronological"]
    # the group with a third of all rows straddles both boundaries and goes as a whole
    assert {r["g"]: r["rows"] for r in audit.collect()}["1"] == 134
    assert kept.count() + audit.agg(F.sum("rows")).first()[0] == 400


def test_missing_groups_stay_apart(spark):
    df = spark.range(30).select("id", F.when(F.col("id") < 10, F.lit("a")).alias("g"))
    placed = P.group_split(df, "g", "id")
    assert placed.count() == 30
    assert placed.filter("g is null").select("region").distinct().count() > 1


def test_missing_policy(spark):
    df = spark.range(4).select("id", F.when(F.col("id") > 0, F.col("id")).alias("g"))
    assert P.hash_group_split(df, "g", missing="exclude").count() == 3
    with pytest.raises(Exception, match="missing g"):
        P.hash_group_split(df, "g").collect()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 17])
def test_episode_split_allocates_every_row(spark, n):
    df = spark.range(n).select("id", F.col("id").alias("t"))
    got = {r["split"]: r["count"] for r in P.episode_split(df, "t", "id").groupBy("split").count().collect()}
    assert sum(got.values()) == n and "prospective" not in got
    assert got["training"] >= 1
    if n >= 2:
        assert got["development"] >= 1
    if n >= 3:
        assert got["hidden"] >= 1


def test_validation_by_task(spark):
    """Task a mixes a group and the order of times, task b does neither, task c lacks regions."""
    rows = [("a", 1, "g", 1, "train"), ("a", 2, "g", 5, "hidden"), ("a", 3, "h", 6, "development"), ("b", 4, "g", 1, "train"), ("b", 5, "h", 1, "development"), ("c", 6, "g", 9, "hidden")]
    df = spark.createDataFrame(rows, "task string, row_id int, grp string, at int, region string")
    got = {r.task: (r.rows, r.rows_in_two_regions, r.groups_in_two_regions, r.chronological) for r in P.validate_split(df, "grp", "at", ["task"]).collect()}
    assert got == {"a": (3, 0, 1, False), "b": (2, 0, 0, True), "c": (1, 0, 0, True)}
    whole = P.validate_split(df, "grp", "at").first()
    assert (whole.rows, whole.rows_in_two_regions, whole.groups_in_two_regions, whole.chronological) == (6, 0, 1, False)


def test_rows_of_a_split_are_not_moved(spark):
    """By task: equal to a plain sort of rows or hashes; no window and no shuffle of the rows. A missing task has no group region."""
    rows = [(f"r{i:03}", "xy"[i % 2] if i % 50 else None, T0 + timedelta(minutes=i // 3), f"g{i % 37}") for i in range(400)]
    df = spark.createDataFrame(rows, "row_id string, task string, ts timestamp, g string")
    chrono, groups = P.chronological_split(df, "ts", "row_id", ["task"]), P.hash_group_split(df, "g", by=["task"])
    for out in (chrono, groups):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange hashpartitioning" not in plan

    def regions(items):
        n = len(items)
        return {x: "train" if i < int(n * 0.6) else "development" if i < int(n * 0.8) else "hidden" for i, x in enumerate(items)}

    for task in ("x", "y"):
        mine = [r for r in rows if r[1] == task]
        want = regions([r[0] for r in sorted(mine, key=lambda r: (r[2], r[0]))])
        assert {r.row_id: r.region for r in chrono.filter(F.col("task") == task).collect()} == want
        sha = lambda g: hashlib.sha256(f'{{"group":"{g}","split":"g"}}'.encode()).hexdigest()
        want = regions(sorted({r[3] for r in mine}, key=lambda g: (sha(g), g)))
        assert {r.g: r.region for r in groups.filter(F.col("task") == task).collect()} == want
    assert chrono.count() == 400 and groups.count() == 392


def test_hidden_tokens_are_made_once(spark):
    """c08 makes tokens of hidden and used rows only, and what is read three times is staged with the columns it needs."""
    hidden, used = C._hidden_tokens(Tables(spark, "/root/testdata/sf0.001"))
    assert hidden.columns == ["task", "row_id", *P.TOKENS] and used.columns == ["token"]
    plan = hidden._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan and "Exchange" not in plan
