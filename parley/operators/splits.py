"""Leakage-safe splits: chronological, purged, group-disjoint, post-freeze."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parley.operators.selection import cuts_at, rows_at, text_start, with_cuts
from parley.operators.sequence import Sequence, rank, total
from parley.session import stage

c = F.col

TRAIN, DEVELOPMENT, HIDDEN = "train", "development", "hidden"


def _place() -> Column:
    """1, 2, 3 for train, development, hidden."""
    return F.array_position(F.array(F.lit(TRAIN), F.lit(DEVELOPMENT), F.lit(HIDDEN)), c("region"))


def check_fractions(train: float, development: float) -> None:
    if train <= 0 or development < 0 or train + development >= 1:
        raise ValueError("fractions must leave a non-empty hidden region")


def region(position: Column, n: Column, train: float = 0.6, development: float = 0.2) -> Column:
    """Region of a 1-based position among n: train holds at least one, hidden too once n is 3."""
    check_fractions(train, development)
    train_end = F.greatest(F.lit(1), F.floor(n * F.lit(train)))
    reach = F.greatest(train_end, F.floor(n * F.lit(train + development)))
    dev_end = F.when(n >= 3, F.least(reach, n - 1)).otherwise(reach)
    return F.when(position <= train_end, TRAIN).when(position <= dev_end, DEVELOPMENT).otherwise(HIDDEN)


def _ends(train: float, development: float) -> dict:
    """Places of the last rows of train and development, as 0-based indices."""
    check_fractions(train, development)

    def train_end(n: Column) -> Column:
        return F.greatest(F.lit(1), F.floor(n * F.lit(train)))

    def dev_end(n: Column) -> Column:
        reach = F.greatest(train_end(n), F.floor(n * F.lit(train + development)))
        return F.when(n >= 3, F.least(reach, n - 1)).otherwise(reach)

    return {"train": (train, lambda n: train_end(n) - 1), "dev": (train + development, lambda n: dev_end(n) - 1)}


def _at_cuts(order: list[str]) -> Column:
    """Region of a row that carries the last rows of train and development of its group."""
    own = F.struct(*order)
    return F.when(own <= c("_cut_train"), TRAIN).when(own <= c("_cut_dev"), DEVELOPMENT).otherwise(HIDDEN)


def _start(df: DataFrame, column: str) -> Column:
    """A number or time that never falls along a column."""
    return text_start(c(column)) if isinstance(df.schema[column].dataType, StringType) else c(column)


def chronological_split(
    df: DataFrame, ts: str, key: str, by: list[str] | None = None, train: float = 0.6, development: float = 0.2, staged: bool = False
) -> DataFrame:
    """Region by time rank, ties by key, separately for each value of ``by``.

    Rows are compared with the last ones of train and development, none is moved. df is staged first unless it is ``staged``.
    """
    rows, extra = rows_at(df, by or [], _start(df, ts), [ts, key], _ends(train, development), staged)
    return rows.withColumn("region", _at_cuts([ts, key])).drop(*extra)


def group_value(group: str, key: str) -> Column:
    """Missing groups stay apart: each missing row is a group of its own."""
    text = c(group).cast("string")
    return F.when(text.isNull() | (text == ""), F.concat(F.lit("__missing__:"), c(key).cast("string"))).otherwise(text)


def straddling_groups(placed: DataFrame, group: str, key: str, by: list[str]) -> DataFrame:
    """Groups that lie in more than one region."""
    at = _place()
    return (
        placed.groupBy(*by, group_value(group, key).alias("_group"))
        .agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("rows"))
        .filter("a <> b")
    )


def chronological_purged_split(
    df: DataFrame, ts: str, group: str, key: str, by: list[str] | None = None, train: float = 0.6, development: float = 0.2, staged: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Chronological regions without the groups that cross a boundary, and the audit of those."""
    by = by or []
    placed = chronological_split(df, ts, key, by, train, development, staged)
    purged = straddling_groups(placed, group, key, by)
    kept = placed.withColumn("_group", group_value(group, key)).join(purged.select(*by, "_group"), [*by, "_group"], "left_anti")
    return kept.drop("_group"), purged.select(*by, c("_group").alias(group), "rows")


def _place_groups(rows: DataFrame, groups: DataFrame, by: list[str], order: list[str], train: float, development: float) -> DataFrame:
    """Region of every row's group: its place among the distinct groups. Rows are compared with the groups at the cuts, none is moved."""
    groups = stage(groups)
    cuts = cuts_at(groups, by, _start(groups, order[0]), order, _ends(train, development))
    told = reduce(lambda df, x: df.filter(c(x).isNotNull()), by, rows)
    names = [*by, *[x for x in rows.columns if x not in by and x not in order], "region"]
    return with_cuts(told, by, cuts).withColumn("region", _at_cuts(order)).select(*names)


def group_split(df: DataFrame, group: str, key: str, by: list[str] | None = None, train: float = 0.6, development: float = 0.2) -> DataFrame:
    """Whole groups to regions, groups in text order."""
    by = by or []
    rows = df.withColumn("_group", group_value(group, key))
    return _place_groups(rows, rows.select(*by, "_group").distinct(), by, ["_group"], train, development)


def _required(df: DataFrame, group: str, missing: str = "error") -> DataFrame:
    """df with its group. Missing groups: ``error`` or ``exclude``."""
    rows = df.withColumn("_group", F.nullif(c(group).cast("string"), F.lit("")))
    if missing == "error":
        fault = F.raise_error(F.lit(f"missing {group} in a required split"))
        return rows.withColumn("_group", F.coalesce(c("_group"), fault.cast("string")))
    if missing == "exclude":
        return rows.filter(c("_group").isNotNull())
    raise ValueError("missing must be 'error' or 'exclude'")


def _hashed(df: DataFrame, split_name: str) -> DataFrame:
    """df with the hash that orders its groups."""
    return df.withColumn("_hash", F.sha2(F.concat(F.lit('{"group":"'), c("_group"), F.lit(f'","split":"{split_name}"}}')), 256))


def hash_group_split(
    df: DataFrame, group: str, split_name: str | None = None, by: list[str] | None = None, missing: str = "error",
    train: float = 0.6, development: float = 0.2,
) -> DataFrame:
    """Whole groups to regions, groups in hash order. Missing groups: ``error`` or ``exclude``."""
    by, rows, name = by or [], _required(df, group, missing), split_name or group
    groups = _hashed(rows.select(*by, "_group").distinct(), name)
    return _place_groups(_hashed(rows, name), groups, by, ["_hash", "_group"], train, development)


def standard_splits(cases: DataFrame) -> DataFrame:
    """The five splits of every task, long: split_name, task, row_id, region. ``cases`` is staged: every split reads it."""
    lean = cases.select("task", "row_id", "timestamp", "listing_id")
    chrono = chronological_purged_split(lean, "timestamp", "listing_id", "row_id", ["task"], staged=True)[0]
    asked = {
        "seller_disjoint": ("seller_id", "error"), "buyer_disjoint": ("buyer_id", "exclude"),
        "category_disjoint_diagnostic": ("category", "error"), "thread_safe_nested_development": ("thread_id", "error"),
    }
    # the groups of all splits and tasks take their places together
    rows, groups = [], []
    for name, (column, missing) in asked.items():
        part = _required(cases.select("task", "row_id", column), column, missing).select(F.lit(name).alias("split_name"), "task", "row_id", "_group")
        rows.append(_hashed(part, column))
        groups.append(_hashed(part.select("split_name", "task", "_group").distinct(), column))
    union = DataFrame.unionByName
    safe = _place_groups(reduce(union, rows), reduce(union, groups), ["split_name", "task"], ["_hash", "_group"], 0.6, 0.2)
    names = ["split_name", "task", "row_id", "region"]
    return chrono.withColumn("split_name", F.lit("chronological_listing_purged")).select(*names).unionByName(safe.select(*names))


def assignment_counts(assign: DataFrame) -> DataFrame:
    return assign.groupBy("split_name", "task", "region").agg(F.count("*").alias("rows"))


def validate_split(assign: DataFrame, group: str, ts: str, by: list[str] | None = None) -> DataFrame:
    """One row for each value of ``by``: rows in two regions, groups in two regions, and whether region bounds follow in time."""
    at, by = _place(), by or []

    def in_two(key: str, name: str) -> DataFrame:
        per = assign.groupBy(*by, key).agg((F.min(at) != F.max(at)).alias("_x"))
        return per.groupBy(*by).agg(F.count_if("_x").alias(name))

    def bound(fold, name: str) -> Column:
        return fold(F.when(c("region") == name, c(ts)))

    follows = (
        F.coalesce(bound(F.max, TRAIN) <= bound(F.min, DEVELOPMENT), F.lit(True))
        & F.coalesce(bound(F.max, DEVELOPMENT) <= bound(F.min, HIDDEN), F.lit(True))
    )
    out = assign.groupBy(*by).agg(F.count("*").alias("rows"), follows.alias("chronological"))
    twice, shared = in_two("row_id", "rows_in_two_regions"), in_two(group, "groups_in_two_regions")
    if by:
        out = out.join(twice, by).join(shared, by)
    else:
        out = out.withColumns({x: df.scalar() for x, df in (("rows_in_two_regions", twice), ("groups_in_two_regions", shared))})
    return out.select(*by, "rows", "rows_in_two_regions", "groups_in_two_regions", "chronological")


TOKENS = ["case_token", "content_token", "source_token"]


def long_tokens(cases: DataFrame) -> DataFrame:
    return cases.select("row_id", F.explode(F.array(*TOKENS)).alias("token"))


def fresh_hidden(hidden: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hidden cases none of whose tokens was used before, and the excluded ones. ``hidden`` is staged: it is read three times."""
    seen = stage(long_tokens(hidden).join(used.select("token").distinct(), "token", "left_semi").select("row_id").distinct())
    return hidden.join(seen, "row_id", "left_anti"), hidden.join(seen, "row_id", "left_semi")


def set_fingerprint(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Order-free content hash of the set of items per key: count, sum and xor of 60-bit marks."""
    mark = F.conv(F.substring(F.sha2(c(item).cast("string"), 256), 1, 15), 16, 10).cast("bigint")
    distinct = df.select(*keys, item).distinct().withColumn("_m", mark)
    return distinct.groupBy(*keys).agg(
        F.count("*").alias("items"), F.sum(c("_m").cast("decimal(20,0)")).cast("string").alias("mark_sum"), F.bit_xor("_m").alias("mark_xor")
    )


def lockbox_conflicts(candidates: DataFrame, reservations: DataFrame) -> DataFrame:
    """Candidate lockboxes that reuse an id, a whole case set, or any single case of an earlier reservation."""
    old_ids = reservations.select(c("lockbox_id").alias("_old")).distinct()
    same_id = candidates.select("lockbox_id").distinct().join(old_ids, c("lockbox_id") == c("_old"), "left_semi")
    new_sets = set_fingerprint(candidates, ["lockbox_id"], "token")
    old_sets = set_fingerprint(reservations, ["lockbox_id"], "token").drop("lockbox_id")
    same_set = new_sets.join(old_sets, ["items", "mark_sum", "mark_xor"], "left_semi").select("lockbox_id")
    shared = (
        candidates.join(reservations.select("token").distinct(), "token", "left_semi")
        .groupBy("lockbox_id").agg(F.countDistinct("token").alias("shared_tokens"))
    )
    flag = F.lit(True)
    return (
        candidates.select("lockbox_id").distinct()
        .join(same_id.withColumn("id_reused", flag), "lockbox_id", "left")
        .join(same_set.distinct().withColumn("set_reused", flag), "lockbox_id", "left")
        .join(shared, "lockbox_id", "left")
        .select(
            "lockbox_id", F.coalesce("id_reused", F.lit(False)).alias("id_reused"),
            F.coalesce("set_reused", F.lit(False)).alias("set_reused"), F.coalesce("shared_tokens", F.lit(0)).alias("shared_tokens"),
        )
    )


def episode_split(
    df: DataFrame, ts: str, key: str, by: list[str] | None = None,
    train: float = 0.6, development: float = 0.2, hidden: float = 0.2, prospective: float = 0.0,
) -> DataFrame:
    """Chronological four-way split by floors; what floors leave over goes to hidden."""
    shares = [train, development, hidden, prospective]
    if min(shares) < 0 or not 0 < sum(shares) <= 1 + 1e-9:
        raise ValueError("fractions must be non-negative with a sum in (0, 1]")
    n = c("_n")
    low_dev = F.when(n >= 2, 1).otherwise(0) if development > 0 else F.lit(0)
    low_hid = F.when(n >= 3, 1).otherwise(0) if hidden > 0 else F.lit(0)
    want = {
        "_t": F.greatest(F.lit(1), F.floor(n * train)),
        "_d": F.greatest(low_dev, F.floor(n * development)),
        "_h": F.greatest(low_hid, F.floor(n * hidden)),
        "_p": F.floor(n * prospective),
    }
    placed = Sequence(df, by or [], [ts, key]).add(_pos=rank(), _n=total()).frame.withColumns(want)
    over = c("_t") + c("_d") + c("_h") + c("_p") - n
    # too many: take from prospective, then hidden, then development, then training
    zero = F.lit(0)
    cut_p = F.greatest(zero, F.least(c("_p"), over))
    cut_h = F.greatest(zero, F.least(c("_h") - low_hid, over - cut_p))
    cut_d = F.greatest(zero, F.least(c("_d") - low_dev, over - cut_p - cut_h))
    cut_t = F.greatest(zero, over - cut_p - cut_h - cut_d)
    t_end = F.greatest(F.lit(1), c("_t") - cut_t)
    d_end = t_end + c("_d") - cut_d
    h_end = d_end + c("_h") - cut_h + F.greatest(zero, -over)
    pos = c("_pos")
    split = F.when(pos <= t_end, "training").when(pos <= d_end, "development").when(pos <= h_end, "hidden").otherwise("prospective")
    return placed.withColumn("split", split).drop("_pos", "_n", *want)


def classify_new_rows(rows: DataFrame, assigned: DataFrame, freezes: DataFrame) -> DataFrame:
    """Rows not yet assigned: prospective only if decided after the cut-off and ingested after the freeze."""
    latest = freezes.groupBy("campaign_id").agg(F.max_by(F.struct("freeze_id", "data_cutoff_time", "frozen_at"), "seq").alias("f"))
    fresh = rows.join(assigned.select("campaign_id", "case_id"), ["campaign_id", "case_id"], "left_anti")
    out = fresh.join(latest, "campaign_id", "left")
    late = (c("decision_time") > c("f.data_cutoff_time")) & (c("eligibility_recorded_at") > c("f.frozen_at"))
    return out.withColumns(
        {
            "split": F.when(late, "prospective").otherwise("staging"),
            "policy": F.when(c("f").isNull(), "pre_freeze_staging").when(late, "post_freeze_prospective").otherwise("post_freeze_backfill_staging"),
            "freeze_id": F.when(late, c("f.freeze_id")),
        }
    ).drop("f")
