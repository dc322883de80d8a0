"""Ingest quality: canonical rows and quarantine, duplicates, samples, profiles, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import scalars as S
from parley.operators.sequence import ranked
from parley.sources import mapping as M
from parley.sources.delimited import CORRUPT

c = F.col

# Offer type -> (actor, action) and status -> name.
OFFER_TYPES = {0: ("buyer", "offer"), 1: ("buyer", "counter"), 2: ("seller", "counter")}
STATUSES = {
    0: "expired",
    1: "accepted",
    2: "declined",
    6: "auto_declined",
    7: "countered",
    8: "declined_other_accepted",
    9: "auto_accepted",
}


def _lookup(values: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.size("reasons") == 0).drop("reasons"), df.filter(F.size("reasons") > 0)


def reason_counts(quarantine: DataFrame) -> DataFrame:
    return quarantine.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def reason_examples(quarantine: DataFrame, key: str, k: int) -> DataFrame:
    """k example keys per reason. Ranking runs over reason segments, so a common reason is spread."""
    long = quarantine.select(F.explode("reasons").alias("reason"), c(key))
    return ranked(long, ["reason"], [key], "example").filter(c("example") <= k)


def canonicalize(df: DataFrame, table: str, mapping: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Canonical rows, and the rows that break a rule with all their reasons."""
    rows = M.apply_mapping(df, table, mapping)
    rows = rows.select(*[S.clean(c(x)).alias(x) for x in rows.columns])
    names = rows.columns
    instants = {x: F.when(S.has_offset(c(x)), c(x).try_cast("timestamp")) for x in names if x in M.TIMES}
    checks: dict[str, Column] = {}
    for x in M.REQUIRED[table].split():
        checks[f"missing_{x}"] = c(x).isNull()
    for x, instant in instants.items():
        checks[f"bad_time_{x}"] = c(x).isNotNull() & instant.isNull()
    checks["available_before_event"] = instants["available_at"] < instants["event_time"]
    if table == "offers":
        checks["response_before_event"] = instants["seller_response_time"] < instants["event_time"]
    if "currency" in names:
        checks["bad_currency"] = ~F.coalesce(c("currency").rlike("^[A-Z]{3}$"), F.lit(False))
    for x in (x for x in names if x in M.MONEY):
        amount = c(x).try_cast("double")
        checks[f"bad_amount_{x}"] = c(x).isNotNull() & ~F.coalesce((amount >= 0) & (amount < float("inf")), F.lit(False))
    for x in (x for x in names if x in M.WHOLE):
        checks[f"bad_integer_{x}"] = c(x).isNotNull() & ~F.coalesce(c(x).try_cast("bigint") >= 0, F.lit(False))
    if "inventory_age_days" in names:
        age = c("inventory_age_days")
        checks["bad_inventory_age"] = age.isNotNull() & ~F.coalesce(age.try_cast("double") >= 0, F.lit(False))
    return _split(rows.withColumn("reasons", S.reasons(**checks)))


def decode_turns(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names for the codes of raw turns; rows without ids or with unknown codes are set aside."""
    checks = {
        "missing_identifier": reduce(lambda a, b: a | b, [S.clean(c(x)).isNull() for x in ("thread_id", "listing_id", "buyer_id", "seller_id")]),
        "unknown_status": ~F.coalesce(c("status_id").isin(*STATUSES), F.lit(False)),
        "unknown_offer_type": ~F.coalesce(c("offer_type").isin(*OFFER_TYPES), F.lit(False)),
    }
    named = raw.withColumns(
        {
            # a row is charged with its first fault only
            "reasons": F.slice(S.reasons(**checks), 1, 1),
            "actor": _lookup({k: v[0] for k, v in OFFER_TYPES.items()}, c("offer_type")),
            "action": _lookup({k: v[1] for k, v in OFFER_TYPES.items()}, c("offer_type")),
            "status": _lookup(STATUSES, c("status_id")),
        }
    )
    return _split(named)


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Distinct rows. Copies collapse before the shuffle, so a hot group of copies is cheap."""
    return df.dropDuplicates()


def copies_removed(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows, copies removed."""
    per = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return per.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count("*").alias("kept"),
        F.coalesce(F.sum(c("_n") - 1), F.lit(0)).alias("removed"),
    )


def dedupe_by_key(df: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """First row per key in the given order, and the rest with the number of copies of each.

    Copies collapse to a count, the least row of a key is an aggregate that starts before the shuffle, and the rest is what
    remains of the counts without it: no key and no group of copies is gathered or ordered.
    """
    columns = df.columns
    copies = df.groupBy(*columns).agg(F.count("*").alias("copies"))
    # a column that is both key and order is the same in all rows of a key
    least = F.struct(*order, *[x for x in columns if x not in order and x not in key])
    first = copies.groupBy(*key).agg(F.min(least).alias("_first")).select(*[c(x) if x in key else c(f"_first.{x}").alias(x) for x in columns])
    left = copies.unionByName(first.withColumn("copies", F.lit(-1).cast("long"))).groupBy(*columns).agg(F.sum("copies").alias("copies"))
    return first, left.filter("copies > 0")


def linked(listings: DataFrame, turns: DataFrame, key: str = "listing_id") -> DataFrame:
    """Listings that some turn refers to."""
    return listings.join(turns.select(key).distinct(), key, "left_semi")


def link_stats(listings: DataFrame, turns: DataFrame, key: str = "listing_id") -> DataFrame:
    refs = turns.select(key).distinct()
    have = listings.select(key).distinct().withColumn("_have", F.lit(True))
    return refs.join(have, key, "left").agg(
        F.count("*").alias("referenced"),
        F.count_if(c("_have")).alias("matched"),
        F.count_if(c("_have").isNull()).alias("unmatched"),
    )


def limit_entities(df: DataFrame, key: str, n: int, salt: str = "") -> DataFrame:
    """All rows of n entities, chosen by hash of the key: the same on every cluster."""
    chosen = (
        df.select(key).distinct()
        .orderBy(F.sha2(F.concat(F.lit(salt), c(key).cast("string")), 256), c(key))
        .limit(n)
    )
    return df.join(chosen, key, "left_semi")


def sample_k(df: DataFrame, k: int, seed: str, key: str) -> DataFrame:
    """Uniform sample of k rows by hash of (seed, key): a distributed top-k."""
    digest = F.sha2(F.concat(F.lit(seed), c(key).cast("string")), 256)
    return df.orderBy(digest, c(key)).limit(k)


def chrono_samples(df: DataFrame, ts: str, key: str, k: int) -> DataFrame:
    """k earliest rows, k latest rows and the k rows nearest the middle of the time range."""
    at = F.unix_micros(c(ts).cast("timestamp"))
    rows = df.withColumn("_at", at)
    # scalar subqueries; twice the distance keeps it in whole microseconds
    bounds = rows.agg((F.min("_at") + F.max("_at")).alias("s"))
    far = F.abs(c("_at") * 2 - bounds.scalar())
    slices = {"early": [c("_at"), c(key)], "middle": [far, c(key)], "late": [c("_at").desc(), c(key)]}
    parts = [rows.orderBy(*order).limit(k).withColumn("slice", F.lit(name)) for name, order in slices.items()]
    return reduce(DataFrame.unionByName, parts).drop("_at")


def redact(df: DataFrame, id_columns: list[str]) -> DataFrame:
    """Identifiers replaced by 16 hex digits of their hash; empty ones stay."""

    def hidden(x: str) -> Column:
        text = c(x).cast("string")
        return F.when(F.length(text) > 0, F.substring(F.sha2(text, 256), 1, 16)).otherwise(text)

    return df.withColumns({x: hidden(x) for x in id_columns})


def profile(turns: DataFrame, listings: DataFrame) -> DataFrame:
    """One row of counts and ranges over both tables."""
    linked_rows = linked(listings, turns)
    a = turns.agg(
        F.count("*").alias("turns"),
        F.min("event_time").alias("event_time_min"),
        F.max("event_time").alias("event_time_max"),
        F.min("response_time").alias("response_time_min"),
        F.max("response_time").alias("response_time_max"),
    )
    b = linked_rows.agg(F.count("*").alias("listings"))

    def distinct(df: DataFrame, **names: str) -> DataFrame:
        # all counts from one scan: values of the named columns below each other, made distinct before the shuffle
        cells = F.array(*[F.struct(F.lit(i).alias("i"), c(x).cast("string").alias("v")) for i, x in enumerate(names.values())])
        values = df.select(F.explode(cells).alias("cell")).select("cell.i", "cell.v").filter("v IS NOT NULL").distinct()
        return values.agg(*[F.count_if(c("i") == i).alias(name) for i, name in enumerate(names)])

    counts = distinct(turns, threads="thread_id", buyers="buyer_id", sellers="seller_id", referenced_listings="listing_id")
    kinds = distinct(linked_rows, categories="category")
    one = counts.select(F.struct("*").alias("s")).scalar()
    return a.select("*", b.scalar().alias("listings"), one.alias("_n"), kinds.scalar().alias("categories")).select(
        *a.columns, "listings", "_n.threads", "_n.buyers", "_n.sellers", "_n.referenced_listings", "categories"
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long counts by column and value from one scan."""
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("column"), c(x).cast("string").alias("value")) for x in columns]))
    return df.select(cells.alias("cell")).groupBy("cell.column", "cell.value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    counts = df.filter(S.clean(c(column)).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)


def partition_fingerprints(df: DataFrame, part: str) -> DataFrame:
    """Rows and an order-free content hash per partition value."""
    body = [x for x in sorted(df.columns) if x != part]
    mark = F.xxhash64(*body)
    return df.groupBy(part).agg(
        F.count("*").alias("rows"),
        F.sum(mark.cast("decimal(20,0)")).alias("content_sum"),
        F.bit_xor(mark).alias("content_xor"),
    )


def audit_partitions(df: DataFrame, part: str, manifest: DataFrame) -> DataFrame:
    """Found partitions against a manifest of fingerprints."""
    found = partition_fingerprints(df, part)
    want = manifest.select(part, *[c(x).alias(f"want_{x}") for x in ("rows", "content_sum", "content_xor")])
    same = [c(x).eqNullSafe(c(f"want_{x}")) for x in ("rows", "content_sum", "content_xor")]
    return found.join(want, part, "full").select(
        part, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("want_rows", F.lit(0)).alias("expected_rows"), (same[0] & same[1] & same[2]).alias("intact")
    )


def inventory(rows: DataFrame, date_columns: list[str]) -> DataFrame:
    """Accepted and rejected rows, parseable dates and their range; input of scan_with_rejects."""
    good = c(CORRUPT).isNull()
    at = F.coalesce(*[S.to_instant(c(x)) for x in date_columns])
    return rows.select(good.alias("good"), F.when(good, at).alias("at")).agg(
        F.count_if("good").alias("accepted"),
        F.count_if(~c("good")).alias("rejected"),
        F.count("at").alias("parseable_dates"),
        F.min("at").cast("date").alias("min_date"),
        F.max("at").cast("date").alias("max_date"),
    )


RECORD = T.MapType(T.StringType(), T.StringType())
_RECORDS = T.ArrayType(RECORD)
_PAYLOAD = T.StructType(
    [
        T.StructField("records", _RECORDS),
        T.StructField("items", _RECORDS),
        T.StructField("data", _RECORDS),
        T.StructField("result", T.StructType([T.StructField("records", _RECORDS), T.StructField("data", _RECORDS)])),
        T.StructField(
            "features",
            T.ArrayType(T.StructType([T.StructField("properties", RECORD), T.StructField("attributes", RECORD)])),
        ),
        T.StructField("entity", _RECORDS),
    ]
)


def extract_records(df: DataFrame, payload: str, adapter: Column) -> DataFrame:
    """One row per record of a JSON payload, found where its adapter keeps records."""
    p = F.from_json(c(payload), _PAYLOAD)
    listed = F.from_json(c(payload), _RECORDS)
    plain = F.coalesce(p["records"], p["items"], p["data"], p["result"]["records"], p["result"]["data"], listed)
    records = (
        F.when(adapter == "geojson", F.transform(p["features"], lambda x: x["properties"]))
        .when(adapter == "arcgis_feature_server", F.transform(p["features"], lambda x: x["attributes"]))
        .when(adapter == "gtfs_realtime", p["entity"])
        .otherwise(plain)
    )
    keep = [x for x in df.columns if x != payload]
    return df.select(*keep, F.posexplode(records).alias("record_index", "record"))


def series_quality(records: DataFrame, series: dict[str, str], event: Column, available: Column, drop_missing: bool) -> DataFrame:
    """Per series: observations, and what kept the other records from being one."""
    timed = S.has_offset(event) & S.has_offset(available)
    cells = F.array(*[F.struct(F.lit(name).alias("series"), F.try_element_at("record", F.lit(field)).alias("value")) for name, field in series.items()])
    long = records.select(timed.alias("timed"), F.explode(cells).alias("s")).select("timed", "s.series", S.clean(c("s.value")).alias("value"))
    numeric = c("value").try_cast("double").isNotNull()
    lost = "dropped_missing" if drop_missing else "missing_value"
    out = long.groupBy("series").agg(
        F.count_if(c("timed") & numeric).alias("observations"),
        F.count_if(~c("timed")).alias("bad_time"),
        F.count_if(c("timed") & c("value").isNull()).alias(lost),
        F.count_if(c("timed") & c("value").isNotNull() & ~numeric).alias("not_numeric"),
    )
    faults = c("bad_time") + c("not_numeric") + (F.lit(0) if drop_missing else c(lost))
    return out.withColumn("status", F.when((c("observations") > 0) & (faults == 0), "passed").otherwise("failed"))


def backfill_chunks(ranges: DataFrame, chunk_days: int) -> DataFrame:
    """Date chunks of every source range, each with a stable id."""
    start = F.explode(F.sequence("start_date", "end_date", F.make_dt_interval(F.lit(chunk_days)))).alias("chunk_start")
    chunks = ranges.select("source_id", "end_date", start).select(
        "source_id", "chunk_start", F.least(F.date_add("chunk_start", chunk_days - 1), "end_date").alias("chunk_end")
    )
    body = F.concat(
        F.lit('{"end":"'), c("chunk_end").cast("string"), F.lit('","source_id":"'), c("source_id").cast("string"),
        F.lit('","start":"'), c("chunk_start").cast("string"), F.lit('"}'),
    )
    return chunks.withColumn("chunk_id", F.substring(F.sha2(body, 256), 1, 16))


def backfill_gaps(ranges: DataFrame, completed: DataFrame, chunk_days: int) -> DataFrame:
    """Open chunks per source and the next one to fetch."""
    open_chunks = backfill_chunks(ranges, chunk_days).join(completed.select("chunk_id"), "chunk_id", "left_anti")
    return open_chunks.groupBy("source_id").agg(F.count("*").alias("open_chunks"), F.min("chunk_start").alias("next_start"))


def material_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Valid and blank-or-invalid values per money column, from one scan."""
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("column"), S.to_number(c(x)).alias("v")) for x in columns]))
    return (
        df.select(cells.alias("s")).groupBy("s.column")
        .agg(F.count("*").alias("rows"), F.count("s.v").alias("valid"), F.count_if(c("s.v").isNull()).alias("blank_or_invalid"))
    )


def merge_new(existing: DataFrame, incoming: DataFrame, key: str, digest: str, order: str) -> DataFrame:
    """Verdict per incoming row: insert, skip (same content) or conflict (other content)."""
    first = incoming.groupBy(key).agg(F.min_by(F.struct(order, digest), order).alias("_first"))
    known = existing.select(key, c(digest).alias("_known"))
    verdict = (
        F.when(c("_known").isNotNull(), F.when(c("_known") == c(digest), "skip").otherwise("conflict"))
        .when(c(order) == c(f"_first.{order}"), "insert")
        .when(c(f"_first.{digest}") == c(digest), "skip")
        .otherwise("conflict")
    )
    return incoming.join(first, key).join(known, key, "left").withColumn("verdict", verdict).drop("_first", "_known")


def validate_episodes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Domain rules of task episodes; rows that break one go to quarantine."""
    checks = {
        "blank_task_type": S.clean(c("task_type")).isNull(),
        "fatigue_range": ~F.coalesce(c("fatigue").between(0, 3), F.lit(False)),
        "ambiguity_range": ~F.coalesce(c("ambiguity").between(0, 3), F.lit(False)),
        "minutes_not_positive": ~F.coalesce(c("estimated_minutes") > 0, F.lit(False)),
        "deadline_without_flag": ~c("has_deadline") & c("deadline_hours").isNotNull(),
        "deadline_missing": c("has_deadline") & c("deadline_hours").isNull(),
        "deadline_negative": F.coalesce(c("deadline_hours") < 0, F.lit(False)),
        "switches_negative": ~F.coalesce(c("recent_context_switches") >= 0, F.lit(False)),
        "cutoff_after_decision": c("observation_cutoff") > c("decision_time"),
        "no_actions": F.coalesce(F.size("available_actions"), F.lit(0)) <= 0,
        "repeated_actions": F.size(F.array_distinct("available_actions")) < F.size("available_actions"),
        "outcome_among_features": F.arrays_overlap(F.map_keys("features"), F.map_keys("outcome")),
    }
    return _split(df.withColumn("reasons", S.reasons(**checks)))


def redact_secrets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whole values that look like a secret are replaced; ``secret_hit`` tells which rows."""
    hits = []
    changes = {}
    for field in (f for f in df.schema.fields if f.name in columns):
        x = c(field.name)
        if isinstance(field.dataType, T.MapType):
            hidden = F.transform_values(x, lambda k, v: F.when(S.secret_like(k) | S.secret_like(v), F.lit(S.REDACTED_TEXT)).otherwise(v))
            hit = F.exists(F.map_entries(x), lambda e: S.secret_like(e["key"]) | S.secret_like(e["value"]))
        elif isinstance(field.dataType, T.ArrayType):
            hidden = F.transform(x, lambda v: F.when(S.secret_like(v), F.lit(S.REDACTED_TEXT)).otherwise(v))
            hit = F.exists(x, S.secret_like)
        else:
            hidden = F.when(S.secret_like(x), F.lit(S.REDACTED_TEXT)).otherwise(x)
            hit = S.secret_like(x)
        hits.append(F.coalesce(hit, F.lit(False)))
        changes[field.name] = hidden
    return df.withColumn("secret_hit", reduce(lambda a, b: a | b, hits)).withColumns(changes)


#: Words that announce a credential, also as the last part of a longer name such as ``map_key`` or ``X-Api-Key``.
CREDENTIAL = "key|token|secret|password|passwd|credentials?|auth(?:orization)?|session|sig(?:nature)?"
#: name=value in a query string or at the start of a text; a header line with its value; a value after an access scheme.
SECRET_SPANS = (
    rf"(?i)((?:\A|[?&;])(?:[a-z0-9]+[_-]){{0,3}}(?:{CREDENTIAL})=)[^\s&;]+",
    rf"(?i)(\b(?:[a-z0-9]+[_-]){{0,3}}(?:{CREDENTIAL}):[ \t]*(?:(?:bearer|basic)[ \t]+)?)[^\s,;]+",
    r"(?i)(\b(?:bearer|basic)[ \t]+)[A-Za-z0-9._~+/=-]{6,}",
)


def mask_secrets(text: Column) -> Column:
    """Only the secret spans are replaced, the text around them stays."""
    for pattern in SECRET_SPANS:
        text = F.regexp_replace(text, pattern, F.lit(f"$1{S.REDACTED_TEXT}"))
    return text


def latest_batch(rows: DataFrame, imports: DataFrame, pilot: str, batch: str, seq: str) -> DataFrame:
    """Rows of the most recent import of each pilot."""
    last = imports.groupBy(pilot).agg(F.max_by(batch, seq).alias(batch))
    return rows.join(last, [pilot, batch], "left_semi")


def normalize(raw: DataFrame, listings: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw turns to numbered turns, the listings they refer to, and the quarantine.

    Rows without identifiers are set aside as they come; copies are removed before unknown codes are set aside.
    """
    lost = reduce(lambda a, b: a | b, [S.clean(c(x)).isNull() for x in ("thread_id", "listing_id", "buyer_id", "seller_id")])
    unique = dedupe_rows(raw.filter(~lost))
    good, unknown = decode_turns(unique)
    anonymous = decode_turns(raw.filter(lost))[1]
    turns = ranked(good, ["thread_id"], order, "turn_index")
    return turns, linked(listings, good), unknown.unionByName(anonymous)
