"""Sources, sinks and ingest quality."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import scalars as S
from parley.operators import ingest as I
from parley.operators.sequence import Sequence, rank
from parley.plans import bindings as B
from parley.plans.registry import Tables, ctes, query
from parley.session import staging_root
from parley.sources import mapping as M
from parley.sources.bucketed import read_bucketed, write_bucketed
from parley.sources.delimited import scan_delimited, scan_with_rejects
from parley.sources.exports import scan_exports

c = F.col


def _folder(t: Tables, suffix: str) -> str:
    return f"{staging_root(t.spark)}/export-{uuid.uuid4().hex}{suffix}"


@query(
    "a01_scan_delimited",
    """
    SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS total_size, round(max(p_retailprice), 4) AS top_price
    FROM part GROUP BY p_brand
    """,
)
def a01(t: Tables) -> DataFrame:
    path = _folder(t, ".csv")
    part = t.part
    part.write.option("header", True).csv(path)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in part.schema.fields])
    back = scan_delimited(t.spark, path, schema)
    return back.groupBy("p_brand").agg(
        F.count("*").alias("n"), F.sum("p_size").alias("total_size"), F.round(F.max("p_retailprice"), 4).alias("top_price")
    )


@query(
    "a02_scan_exports",
    """
    SELECT c_mktsegment, count(*) AS n, count(CASE WHEN c_nationkey >= 8 THEN 1 END) AS with_name,
           count(CASE WHEN c_nationkey < 16 THEN 1 END) AS with_balance
    FROM customer GROUP BY c_mktsegment
    """,
)
def a02(t: Tables) -> DataFrame:
    # three formats that together hold the whole table, each lacking another column
    rows, nation = t.customer, c("c_nationkey")
    paths = [_folder(t, s) for s in (".csv", ".jsonl", ".parquet")]
    rows.filter(nation < 8).drop("c_name").write.option("header", True).option("compression", "gzip").csv(paths[0])
    rows.filter((nation >= 8) & (nation < 16)).write.json(paths[1])
    rows.filter(nation >= 16).drop("c_acctbal").write.parquet(paths[2])
    return scan_exports(t.spark, paths).groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.count("c_name").alias("with_name"), F.count("c_acctbal").alias("with_balance")
    )


def _foreign_orders(t: Tables) -> DataFrame:
    """Orders under the column names of a foreign export."""
    return t.orders.select(
        c("o_orderkey").alias("Transaction ID"),
        c("o_custkey").alias("Item-ID"),
        c("o_orderdate").alias("EventTime"),
        c("o_orderdate").alias("available_at"),
        c("o_totalprice").alias("Sold Price"),
        F.lit("USD").alias("Currency"),
        c("o_orderstatus").alias("Status"),
        c("o_orderpriority").alias("Clerk Note"),
    )


@query(
    "a03_column_mapping",
    """
    SELECT 'order_id' AS target, count(o_orderkey) AS filled FROM orders UNION ALL
    SELECT 'listing_id', count(o_custkey) FROM orders UNION ALL
    SELECT 'event_time', count(o_orderdate) FROM orders UNION ALL
    SELECT 'available_at', count(o_orderdate) FROM orders UNION ALL
    SELECT 'sale_price_amount', count(o_totalprice) FROM orders UNION ALL
    SELECT 'currency', count(*) FROM orders UNION ALL
    SELECT 'order_status', count(o_orderstatus) FROM orders UNION ALL
    SELECT unnest(['offer_id', 'paid_at', 'completed_at', 'return_window_matured_at', 'quantity']), 0::BIGINT
    """,
)
def a03(t: Tables) -> DataFrame:
    rows = _foreign_orders(t)
    mapping = M.propose_mapping(rows.columns, "orders")
    problems = M.validate_mapping(rows.columns, "orders", mapping)
    if any(problems.values()):
        raise ValueError(f"mapping is not usable: {problems}")
    mapped = M.apply_mapping(rows, "orders", mapping)
    counts = mapped.agg(*[F.count(x).alias(x) for x in mapped.columns])
    return counts.unpivot([], mapped.columns, "target", "filled")


DIRTY_OFFER = """
dirty AS (
  SELECT event_id, event_id % 13 = 0 AS no_zone, event_id % 17 = 0 AS early, event_id % 19 = 0 AS low_currency,
         event_id % 23 = 0 AS negative, event_id % 29 = 0 AS answered_early, event_id % 31 = 0 AS no_state
  FROM events)
"""


def _dirty_offers(t: Tables) -> DataFrame:
    e = c("event_id")

    def text(at, zone):
        return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), zone)

    hour = F.expr("INTERVAL 1 HOUR")
    zone = F.when(e % 13 == 0, "").otherwise("+00:00")
    return t.events.select(
        e.cast("string").alias("BestOfferId"),
        c("user_id").cast("string").alias("ItemId"),
        text(c("ts"), zone).alias("createdAt"),
        text(F.when(e % 17 == 0, c("ts") - hour).otherwise(c("ts") + hour), F.lit("+00:00")).alias("available_at"),
        F.when(e % 23 == 0, -c("value") - 1).otherwise(c("value")).cast("string").alias("Offer Price"),
        F.when(e % 19 == 0, "usd").otherwise("USD").alias("currency"),
        F.when(e % 31 == 0, "  ").otherwise(c("event_type")).alias("offer_state"),
        text(F.when(e % 29 == 0, c("ts") - hour).otherwise(c("ts") + hour), F.lit("Z")).alias("respondedAt"),
    )


@query(
    "a04_canonicalize",
    ctes(DIRTY_OFFER)
    + """
    SELECT reason, count(*) AS n FROM (
      SELECT unnest(list_filter([
        CASE WHEN no_state THEN 'missing_offer_state' END,
        CASE WHEN no_zone THEN 'bad_time_event_time' END,
        CASE WHEN early AND NOT no_zone THEN 'available_before_event' END,
        CASE WHEN answered_early AND NOT no_zone THEN 'response_before_event' END,
        CASE WHEN low_currency THEN 'bad_currency' END,
        CASE WHEN negative THEN 'bad_amount_offer_amount' END], lambda x: x IS NOT NULL)) AS reason
      FROM dirty) GROUP BY reason
    UNION ALL
    SELECT 'accepted', count(*) FROM dirty
    WHERE NOT (no_zone OR early OR low_currency OR negative OR answered_early OR no_state)
    """,
)
def a04(t: Tables) -> DataFrame:
    rows = _dirty_offers(t)
    good, bad = I.canonicalize(rows, "offers", M.propose_mapping(rows.columns, "offers"))
    accepted = good.agg(F.lit("accepted").alias("reason"), F.count("*").alias("n"))
    return I.reason_counts(bad).unionByName(accepted)


DIRTY_TURN = B.LISTING + """,
raw0 AS (
  SELECT event_id, ts AS event_time, CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS thread_id,
         user_id * 13 AS listing_id, CASE WHEN event_id % 89 <> 0 THEN user_id END AS buyer_id, user_id // 20 AS seller_id,
         CASE WHEN event_id % 61 = 0 THEN 4 WHEN event_type IN ('view', 'signup') THEN 0
              WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 2 END AS offer_type,
         CASE WHEN event_id % 97 = 0 THEN 5 ELSE [0, 1, 2, 6, 7, 8, 9][event_id % 7 + 1] END AS status_id
  FROM events),
raw AS (SELECT r.* FROM raw0 r, range(2) copy(i) WHERE i = 0 OR event_id % 50 = 0)
"""


def dirty_turns(t: Tables) -> DataFrame:
    """Raw turns with unknown codes, missing buyers and whole-row copies planted."""
    e = c("event_id")
    rows = B.bare_turns(t).select(
        e, "event_time", "thread_id",
        (c("buyer_id") * 13).alias("listing_id"),
        F.when(e % 89 != 0, c("buyer_id")).alias("buyer_id"),
        F.floor(c("buyer_id") / 20).cast("long").alias("seller_id"),
        F.when(e % 61 == 0, 4).otherwise(c("offer_type")).alias("offer_type"),
        F.when(e % 97 == 0, 5).otherwise(c("status_id")).alias("status_id"),
    )
    return rows.withColumn("_c", F.explode(F.sequence(F.lit(1), F.when(e % 50 == 0, 2).otherwise(1)))).drop("_c")


@query(
    "a05_decode_turns",
    ctes(DIRTY_TURN)
    + """
    SELECT outcome, count(*) AS n FROM (
      SELECT CASE WHEN buyer_id IS NULL THEN 'missing_identifier' WHEN status_id = 5 THEN 'unknown_status'
                  WHEN offer_type = 4 THEN 'unknown_offer_type'
                  ELSE CASE WHEN offer_type = 2 THEN 'seller ' ELSE 'buyer ' END || CASE WHEN offer_type = 0 THEN 'offer ' ELSE 'counter ' END ||
                       CASE status_id WHEN 0 THEN 'expired' WHEN 1 THEN 'accepted' WHEN 2 THEN 'declined' WHEN 6 THEN 'auto_declined'
                            WHEN 7 THEN 'countered' WHEN 8 THEN 'declined_other_accepted' ELSE 'auto_accepted' END END AS outcome
      FROM raw) GROUP BY outcome
    """,
)
def a05(t: Tables) -> DataFrame:
    good, bad = I.decode_turns(dirty_turns(t))
    named = good.groupBy(F.concat_ws(" ", "actor", "action", "status").alias("outcome")).agg(F.count("*").alias("n"))
    return named.unionByName(I.reason_counts(bad).withColumnRenamed("reason", "outcome"))


@query(
    "a05_quarantine_examples",
    ctes(DIRTY_TURN)
    + """
    SELECT reason, event_id, example FROM (
      SELECT reason, event_id, row_number() OVER (PARTITION BY reason ORDER BY event_id) AS example FROM (
        SELECT event_id, CASE WHEN buyer_id IS NULL THEN 'missing_identifier' WHEN status_id = 5 THEN 'unknown_status'
                              WHEN offer_type = 4 THEN 'unknown_offer_type' END AS reason FROM raw)
      WHERE reason IS NOT NULL) WHERE example <= 5
    """,
)
def a05_examples(t: Tables) -> DataFrame:
    _, bad = I.decode_turns(dirty_turns(t))
    return I.reason_examples(bad, "event_id", 5)


@query(
    "a06_dedupe_rows",
    ctes(DIRTY_TURN)
    + """
    SELECT (SELECT count(*) FROM raw)::BIGINT AS rows, count(*) AS kept,
           ((SELECT count(*) FROM raw) - count(*))::BIGINT AS removed
    FROM (SELECT DISTINCT * FROM raw)
    """,
)
def a06(t: Tables) -> DataFrame:
    return I.copies_removed(dirty_turns(t))


@query(
    "a06_distinct_turns",
    ctes(DIRTY_TURN) + "SELECT status_id, count(*) AS n, min(event_id) AS first_id FROM (SELECT DISTINCT * FROM raw) GROUP BY status_id",
)
def a06_distinct(t: Tables) -> DataFrame:
    return I.dedupe_rows(dirty_turns(t)).groupBy("status_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(
    "a07_linked_listings",
    ctes(B.TURN)
    + """
    SELECT category, count(*) AS n, round(sum(listing_price), 4) AS total FROM listing
    WHERE listing_id IN (SELECT listing_id FROM turn) GROUP BY category
    """,
)
def a07(t: Tables) -> DataFrame:
    rows = I.linked(B.listings(t), B.bare_turns(t))
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum("listing_price"), 4).alias("total"))


@query(
    "a07_link_stats",
    """
    WITH refs AS (SELECT DISTINCT l_partkey + 5 AS k FROM lineitem)
    SELECT count(*) AS referenced, count(CASE WHEN k IN (SELECT p_partkey FROM part) THEN 1 END) AS matched,
           count(CASE WHEN k NOT IN (SELECT p_partkey FROM part) THEN 1 END) AS unmatched FROM refs
    """,
)
def a07_stats(t: Tables) -> DataFrame:
    refs = t.lineitem.select((c("l_partkey") + 5).alias("listing_id"))
    return I.link_stats(B.listings(t), refs)


@query(
    "a08_dedupe_by_key",
    """
    SELECT l_orderkey, count(*) AS kept, (sum(n) - count(*))::BIGINT AS quarantined, round(sum(p), 4) AS first_price FROM (
      SELECT l_orderkey, l_linenumber, count(*) AS n,
             (list(l_extendedprice ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice))[1] AS p
      FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY l_orderkey
    """,
)
def a08(t: Tables) -> DataFrame:
    kept, rest = I.dedupe_by_key(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    a = kept.groupBy("l_orderkey").agg(F.count("*").alias("kept"), F.round(F.sum("l_extendedprice"), 4).alias("first_price"))
    b = rest.groupBy("l_orderkey").agg(F.sum("copies").alias("quarantined"))
    return a.join(b, "l_orderkey", "left").select("l_orderkey", "kept", F.coalesce("quarantined", F.lit(0)).alias("quarantined"), "first_price")


@query(
    "a09_number_turns",
    ctes(B.TURN) + "SELECT event_id, thread_id, turn_index FROM numbered",
)
def a09(t: Tables) -> DataFrame:
    return Sequence(B.turns(t), ["thread_id"], B.ORDER).add(turn_index=rank()).frame.select("event_id", "thread_id", "turn_index")


@query(
    "a10_limit_entities",
    """
    SELECT user_id, count(*) AS n FROM events WHERE user_id IN (
      SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY sha256('s1' || user_id::VARCHAR), user_id LIMIT 40)
    GROUP BY user_id
    """,
)
def a10(t: Tables) -> DataFrame:
    return I.limit_entities(t.events, "user_id", 40, "s1").groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "a11_profile",
    ctes(B.TURN)
    + """
    SELECT count(*) AS turns, min(event_time) AS event_time_min, max(event_time) AS event_time_max,
           min(response_time) AS response_time_min, max(response_time) AS response_time_max,
           (SELECT count(*) FROM listing WHERE listing_id IN (SELECT listing_id FROM turn)) AS listings,
           count(DISTINCT thread_id) AS threads, count(DISTINCT buyer_id) AS buyers, count(DISTINCT seller_id) AS sellers,
           count(DISTINCT listing_id) AS referenced_listings, count(DISTINCT category) AS categories
    FROM turn
    """,
)
def a11(t: Tables) -> DataFrame:
    return I.profile(B.turns(t), B.listings(t))


@query(
    "a11_value_counts",
    ctes(B.TURN)
    + """
    SELECT 'status_id' AS "column", status_id::VARCHAR AS value, count(*) AS n FROM turn GROUP BY status_id UNION ALL
    SELECT 'offer_type', offer_type::VARCHAR, count(*) FROM turn GROUP BY offer_type UNION ALL
    SELECT 'action', action, count(*) FROM turn GROUP BY action UNION ALL
    SELECT 'actor', actor, count(*) FROM turn GROUP BY actor
    """,
)
def a11_values(t: Tables) -> DataFrame:
    return I.value_counts(B.turns(t), ["status_id", "offer_type", "action", "actor"])


@query("a11_top_categories", "SELECT p_name AS category, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 25")
def a11_top(t: Tables) -> DataFrame:
    return I.top_values(t.part.withColumnRenamed("p_name", "category"), "category", 25)


@query(
    "a12_bucketed_sink",
    """
    SELECT (('0x' || right(sha256(l_orderkey::VARCHAR), 15))::BIGINT % 64)::INTEGER AS bucket, count(*) AS n,
           count(DISTINCT l_orderkey) AS keys FROM lineitem GROUP BY 1
    """,
)
def a12(t: Tables) -> DataFrame:
    path = _folder(t, "")
    write_bucketed(t.lineitem, "l_orderkey", 64, path)
    return read_bucketed(t.spark, path).groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("keys"))


@query(
    "a13_partition_audit",
    """
    SELECT (('0x' || right(sha256(o_orderkey::VARCHAR), 15))::BIGINT % 16)::INTEGER AS bucket,
           count(*) AS rows, count(*) AS expected_rows, count(CASE WHEN o_orderkey = 7 THEN 1 END) = 0 AS intact FROM orders GROUP BY 1
    """,
)
def a13(t: Tables) -> DataFrame:
    # one changed cell must be found in its bucket, all others must be intact
    path = _folder(t, "")
    price = c("o_totalprice") + F.when(c("o_orderkey") == 7, 1.0).otherwise(0.0)
    write_bucketed(t.orders.withColumn("o_totalprice", price), "o_orderkey", 16, path)
    expected = I.partition_fingerprints(t.orders.withColumn("bucket", S.hash_bucket(c("o_orderkey"), 16)), "bucket")
    return I.audit_partitions(read_bucketed(t.spark, path), "bucket", expected)


@query(
    "a14_inventory",
    """
    SELECT count(CASE WHEN ok THEN 1 END) AS accepted, count(CASE WHEN NOT ok THEN 1 END) AS rejected,
           count(CASE WHEN ok AND event_id % 5 <> 4 THEN 1 END) AS parseable_dates,
           min(CASE WHEN ok AND event_id % 5 <> 4 THEN ts::DATE END) AS min_date,
           max(CASE WHEN ok AND event_id % 5 <> 4 THEN ts::DATE END) AS max_date
    FROM (SELECT event_id, ts, event_id % 31 <> 0 AND event_id % 37 <> 0 AS ok FROM events)
    """,
)
def a14(t: Tables) -> DataFrame:
    e, ts = c("event_id"), c("ts")
    day = (
        F.when(e % 5 == 0, F.date_format(ts, "yyyy-MM-dd"))
        .when(e % 5 == 1, F.date_format(ts, "yyyy/MM/dd"))
        .when(e % 5 == 2, F.lower(F.date_format(ts, "ddMMMyyyy HH:mm:ss")))
        .when(e % 5 == 3, F.date_format(ts, "MM/dd/yyyy"))
        .otherwise("unknown")
    )
    line = F.when(e % 31 == 0, F.concat_ws(",", e, c("user_id"))).when(e % 37 == 0, F.concat_ws(",", e, "user_id", day, "value", "event_type"))
    path = _folder(t, "")
    t.events.select(line.otherwise(F.concat_ws(",", e, "user_id", day, "value")).alias("line")).write.text(path)
    rows = scan_with_rejects(t.spark, path, ["event_id", "user_id", "created", "value"])
    return I.inventory(rows, ["created"])


@query(
    "a15_sample_k",
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY sha256('seed-7' || o_orderkey::VARCHAR), o_orderkey LIMIT 100",
)
def a15(t: Tables) -> DataFrame:
    return I.sample_k(t.orders, 100, "seed-7", "o_orderkey").select("o_orderkey", "o_custkey")


@query(
    "a16_chrono_samples",
    """
    WITH b AS (SELECT epoch_us(min(ts)) + epoch_us(max(ts)) AS s FROM events)
    (SELECT 'early' AS slice, event_id FROM events ORDER BY ts, event_id LIMIT 20) UNION ALL
    (SELECT 'middle', event_id FROM events, b ORDER BY abs(epoch_us(ts) * 2 - s), event_id LIMIT 20) UNION ALL
    (SELECT 'late', event_id FROM events ORDER BY ts DESC, event_id LIMIT 20)
    """,
)
def a16(t: Tables) -> DataFrame:
    return I.chrono_samples(t.events, "ts", "event_id", 20).select("slice", "event_id")


@query(
    "a17_redact",
    """
    SELECT substr(sha256(c_custkey::VARCHAR), 1, 16) AS c_custkey, substr(sha256(c_name), 1, 16) AS c_name, c_mktsegment FROM customer
    """,
)
def a17(t: Tables) -> DataFrame:
    return I.redact(t.customer, ["c_custkey", "c_name"]).select("c_custkey", "c_name", "c_mktsegment")


def payloads(t: Tables) -> DataFrame:
    """Events as nested payloads in six shapes, two records each; some values blank or not numeric."""
    e = c("event_id")
    ts = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(e % 41 == 0, "").otherwise("Z"))
    k = F.get_json_object("props", "$.k")
    value = F.when(e % 43 == 0, "").when(e % 47 == 0, "n/a").otherwise(k)
    record = F.to_json(F.struct(ts.alias("at"), value.alias("k"), c("value").cast("string").alias("v")))
    both = F.concat(F.lit("["), record, F.lit(","), record, F.lit("]"))

    def wrapped(before, item, after):
        return F.concat(F.lit(before), item, F.lit(after))

    body = (
        F.when(e % 6 == 0, wrapped('{"records":', both, "}"))
        .when(e % 6 == 1, wrapped('{"result":{"records":', both, "}}"))
        .when(e % 6 == 2, F.concat(F.lit('{"features":[{"properties":'), record, F.lit('},{"properties":'), record, F.lit("}]}")))
        .when(e % 6 == 3, F.concat(F.lit('{"features":[{"attributes":'), record, F.lit('},{"attributes":'), record, F.lit("}]}")))
        .when(e % 6 == 4, wrapped('{"entity":', both, "}"))
        .otherwise(both)
    )
    adapter = (
        F.when(e % 6 == 2, "geojson").when(e % 6 == 3, "arcgis_feature_server").when(e % 6 == 4, "gtfs_realtime").otherwise("json_api")
    )
    return t.events.select(e, "event_type", adapter.alias("adapter"), body.alias("payload"))


@query(
    "a18_extract_records",
    """
    SELECT CASE event_id % 6 WHEN 2 THEN 'geojson' WHEN 3 THEN 'arcgis_feature_server' WHEN 4 THEN 'gtfs_realtime' ELSE 'json_api' END AS adapter,
           2 * count(*) AS records,
           2 * sum(CASE WHEN event_id % 43 <> 0 AND event_id % 47 <> 0 THEN (props->>'$.k')::BIGINT ELSE 0 END)::BIGINT AS total
    FROM events GROUP BY 1
    """,
)
def a18(t: Tables) -> DataFrame:
    rows = I.extract_records(payloads(t), "payload", c("adapter"))
    number = F.try_element_at("record", F.lit("k")).try_cast("bigint")
    return rows.groupBy("adapter").agg(F.count("*").alias("records"), F.coalesce(F.sum(number), F.lit(0)).alias("total"))


@query(
    "a19_series_quality",
    """
    WITH r AS (SELECT event_id, event_id % 41 = 0 AS bad, event_id % 43 = 0 AS blank, event_id % 47 = 0 AND event_id % 43 <> 0 AS text FROM events)
    SELECT 'k' AS series, 2 * count(CASE WHEN NOT bad AND NOT blank AND NOT text THEN 1 END) AS observations,
           2 * count(CASE WHEN bad THEN 1 END) AS bad_time, 2 * count(CASE WHEN NOT bad AND blank THEN 1 END) AS missing_value,
           2 * count(CASE WHEN NOT bad AND text THEN 1 END) AS not_numeric, 'failed' AS status FROM r UNION ALL
    SELECT 'v', 2 * count(CASE WHEN NOT bad THEN 1 END), 2 * count(CASE WHEN bad THEN 1 END), 0, 0, 'failed' FROM r
    """,
)
def a19(t: Tables) -> DataFrame:
    records = I.extract_records(payloads(t), "payload", c("adapter"))
    at = F.try_element_at("record", F.lit("at"))
    return I.series_quality(records, {"k": "k", "v": "v"}, at, at, drop_missing=False)


RANGES = """
span AS (SELECT user_id AS source_id, min(ts)::DATE AS a, max(ts)::DATE AS b FROM events GROUP BY user_id),
chunk AS (
  SELECT source_id, s::DATE AS chunk_start, least(s::DATE + 3, b) AS chunk_end
  FROM (SELECT *, unnest(generate_series(a, b, INTERVAL 4 DAY)) AS s FROM span)),
done AS (
  SELECT DISTINCT source_id, chunk_start FROM chunk JOIN events ON user_id = source_id AND ts::DATE = chunk_start)
"""


@query(
    "a20_backfill_gaps",
    ctes(RANGES)
    + """
    SELECT source_id, count(*) AS open_chunks, min(chunk_start) AS next_start FROM chunk c
    WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.source_id = c.source_id AND d.chunk_start = c.chunk_start) GROUP BY source_id
    """,
)
def a20(t: Tables) -> DataFrame:
    days = t.events.select(c("user_id").alias("source_id"), c("ts").cast("date").alias("day"))
    ranges = days.groupBy("source_id").agg(F.min("day").alias("start_date"), F.max("day").alias("end_date"))
    chunks = I.backfill_chunks(ranges, 4)
    done = chunks.join(days.distinct().withColumnRenamed("day", "chunk_start"), ["source_id", "chunk_start"], "left_semi")
    return I.backfill_gaps(ranges, done, 4)


@query(
    "a20_chunk_ids",
    ctes(RANGES)
    + """
    SELECT source_id, chunk_start, substr(sha256('{"end":"' || chunk_end::VARCHAR || '","source_id":"' || source_id::VARCHAR
           || '","start":"' || chunk_start::VARCHAR || '"}'), 1, 16) AS chunk_id FROM chunk
    """,
)
def a20_ids(t: Tables) -> DataFrame:
    days = t.events.select(c("user_id").alias("source_id"), c("ts").cast("date").alias("day"))
    ranges = days.groupBy("source_id").agg(F.min("day").alias("start_date"), F.max("day").alias("end_date"))
    return I.backfill_chunks(ranges, 4).select("source_id", "chunk_start", "chunk_id")


@query(
    "a21_material_coverage",
    """
    SELECT 'fee_amount' AS "column", count(*) AS rows, count(CASE WHEN l_orderkey % 20 <> 0 THEN 1 END) AS valid,
           count(CASE WHEN l_orderkey % 20 = 0 THEN 1 END) AS blank_or_invalid FROM lineitem UNION ALL
    SELECT 'shipping_cost_amount', count(*), count(CASE WHEN l_partkey % 30 <> 0 THEN 1 END),
           count(CASE WHEN l_partkey % 30 = 0 THEN 1 END) FROM lineitem
    """,
)
def a21(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.when(c("l_orderkey") % 20 == 0, "").otherwise(c("l_tax").cast("string")).alias("fee_amount"),
        F.when(c("l_partkey") % 30 == 0, "n/a").otherwise(c("l_quantity").cast("string")).alias("shipping_cost_amount"),
    )
    return I.material_coverage(rows, ["fee_amount", "shipping_cost_amount"])


@query(
    "a23_merge_new",
    """
    SELECT verdict, count(*) AS n FROM (
      SELECT CASE WHEN event_id % 10 = 0 THEN 'insert' WHEN event_id % 7 = 0 THEN 'conflict' ELSE 'skip' END AS verdict FROM events
      UNION ALL SELECT CASE WHEN event_id % 10 <> 0 THEN CASE WHEN event_id % 7 = 0 THEN 'conflict' ELSE 'skip' END
                            ELSE 'skip' END FROM events) GROUP BY verdict
    """,
)
def a23(t: Tables) -> DataFrame:
    e = c("event_id")
    existing = t.events.select(e.cast("string").alias("id"), F.sha2(c("props"), 256).alias("digest"))
    # every row arrives twice; a tenth under a new id, a seventh with other content
    seen = F.when(e % 10 == 0, F.concat(F.lit("new-"), e)).otherwise(e.cast("string"))
    body = F.when((e % 7 == 0) & (e % 10 != 0), F.concat(c("props"), F.lit(" "))).otherwise(c("props"))
    incoming = t.events.select(
        seen.alias("id"), F.sha2(body, 256).alias("digest"), F.explode(F.array(e * 2, e * 2 + 1)).alias("arrival")
    )
    return I.merge_new(existing, incoming, "id", "digest", "arrival").groupBy("verdict").agg(F.count("*").alias("n"))


@query(
    "a24_validate_episodes",
    """
    SELECT reason, count(*) AS n FROM (
      SELECT unnest(list_filter([
        CASE WHEN event_id % 23 = 0 THEN 'blank_task_type' END,
        CASE WHEN event_id % 5 > 3 THEN 'fatigue_range' END,
        CASE WHEN event_id % 60 = 0 THEN 'minutes_not_positive' END,
        CASE WHEN event_id % 2 = 1 AND event_id % 4 <> 3 THEN 'deadline_without_flag' END,
        CASE WHEN event_id % 4 = 2 THEN 'deadline_missing' END,
        CASE WHEN event_id % 4 IN (0, 1) AND event_id % 100 < 10 THEN 'deadline_negative' END,
        CASE WHEN event_id % 19 = 0 THEN 'cutoff_after_decision' END,
        CASE WHEN event_type = 'error' THEN 'no_actions' END,
        CASE WHEN event_type = 'view' AND user_id % 2 = 0 THEN 'repeated_actions' END,
        CASE WHEN user_id % 7 = 0 THEN 'outcome_among_features' END], lambda x: x IS NOT NULL)) AS reason FROM events) GROUP BY reason
    """,
)
def a24(t: Tables) -> DataFrame:
    e, u = c("event_id"), c("user_id")
    rows = t.events.select(
        e,
        F.when(e % 23 == 0, " ").otherwise(c("event_type")).alias("task_type"),
        (e % 5).alias("fatigue"),
        (e % 4).alias("ambiguity"),
        (e % 60).alias("estimated_minutes"),
        (e % 2 == 0).alias("has_deadline"),
        F.when(e % 4 < 2, (e % 100 - 10).cast("double")).alias("deadline_hours"),
        (e % 9).alias("recent_context_switches"),
        c("ts").alias("decision_time"),
        F.when(e % 19 == 0, c("ts") + F.expr("INTERVAL 1 MINUTE")).otherwise(c("ts")).alias("observation_cutoff"),
        F.when(c("event_type") == "error", F.array().cast("array<string>"))
        .when((c("event_type") == "view") & (u % 2 == 0), F.array(F.lit("start"), F.lit("start")))
        .otherwise(F.array(F.lit("start"), F.lit("wait"))).alias("available_actions"),
        F.create_map(F.when(u % 7 == 0, "completed").otherwise("fatigue"), F.lit(1.0)).alias("features"),
        F.create_map(F.lit("completed"), F.lit(True)).alias("outcome"),
    )
    return I.reason_counts(I.validate_episodes(rows)[1])


@query(
    "a25_redact_secrets",
    """
    SELECT doc_id, hit AS secret_hit, md5(CASE WHEN hit THEN '[REDACTED]' ELSE text END) AS digest FROM (
      SELECT *, lower(text) LIKE '%api\\_key%' ESCAPE '\\' OR lower(text) LIKE '%apikey%' OR lower(text) LIKE '%password%'
             OR lower(text) LIKE '%secret%' OR lower(text) LIKE '%sk-%' OR lower(text) LIKE '%token%' AS hit FROM documents)
    """,
)
def a25(t: Tables) -> DataFrame:
    return I.redact_secrets(t.documents, ["text"]).select("doc_id", "secret_hit", F.md5("text").alias("digest"))


@query(
    "a25_mask_secret_spans",
    r"""
    SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text,
      '(?i)((?:\A|[?&;])(?:[a-z0-9]+[_-]){0,3}(?:key|token|secret|password|passwd|credentials?|auth(?:orization)?|session|sig(?:nature)?)=)[^\s&;]+', '\1[REDACTED]', 'g'),
      '(?i)(\b(?:[a-z0-9]+[_-]){0,3}(?:key|token|secret|password|passwd|credentials?|auth(?:orization)?|session|sig(?:nature)?):[ \t]*(?:(?:bearer|basic)[ \t]+)?)[^\s,;]+', '\1[REDACTED]', 'g'),
      '(?i)(\b(?:bearer|basic)[ \t]+)[A-Za-z0-9._~+/=-]{6,}', '\1[REDACTED]', 'g')) AS digest FROM documents
    """,
)
def a25_mask(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(I.mask_secrets(c("text"))).alias("digest"))


@query(
    "a26_latest_batch",
    """
    SELECT user_id % 5 AS pilot, e.ts::DATE AS batch, count(*) AS n FROM events e JOIN (
      SELECT user_id % 5 AS p, max(ts::DATE) AS d FROM events GROUP BY 1) m ON user_id % 5 = p AND ts::DATE = d GROUP BY 1, 2
    """,
)
def a26(t: Tables) -> DataFrame:
    rows = t.events.select((c("user_id") % 5).alias("pilot"), c("ts").cast("date").alias("batch"), "event_id")
    imports = rows.select("pilot", "batch", c("batch").alias("seq")).distinct()
    return I.latest_batch(rows, imports, "pilot", "batch", "seq").groupBy("pilot", "batch").agg(F.count("*").alias("n"))


@query(
    "a00_normalize",
    ctes(DIRTY_TURN)
    + """
    , good AS (SELECT DISTINCT * FROM raw WHERE buyer_id IS NOT NULL AND status_id <> 5 AND offer_type <> 4)
    SELECT 'turns' AS part, count(*) AS rows, count(DISTINCT thread_id) AS keys FROM good UNION ALL
    SELECT 'listings', count(*), count(DISTINCT listing_id) FROM listing WHERE listing_id IN (SELECT listing_id FROM good) UNION ALL
    SELECT 'longest thread', max(n), 1 FROM (SELECT count(*) AS n FROM good GROUP BY thread_id) UNION ALL
    SELECT 'quarantine', (SELECT count(*) FROM raw WHERE buyer_id IS NULL)
           + (SELECT count(*) FROM (SELECT DISTINCT * FROM raw WHERE buyer_id IS NOT NULL AND (status_id = 5 OR offer_type = 4))),
           (SELECT count(DISTINCT event_id) FROM raw WHERE buyer_id IS NULL OR status_id = 5 OR offer_type = 4)
    """,
)
def a00(t: Tables) -> DataFrame:
    """Raw turns and listings to bucketed Parquet and back: the whole way in."""
    turns, linked, bad = I.normalize(dirty_turns(t), B.listings(t), ["event_time", "offer_type", "event_id"])
    folder = _folder(t, "")
    write_bucketed(turns, "thread_id", 16, f"{folder}/turns")
    linked.write.parquet(f"{folder}/listings")
    bad.write.parquet(f"{folder}/quarantine")
    back = read_bucketed(t.spark, f"{folder}/turns")

    def counted(part: str, rows, keys) -> list:
        return [F.lit(part).alias("part"), rows.alias("rows"), keys.alias("keys")]

    one = back.agg(*counted("turns", F.count("*"), F.countDistinct("thread_id")))
    two = t.spark.read.parquet(f"{folder}/listings").agg(*counted("listings", F.count("*"), F.countDistinct("listing_id")))
    longest = back.agg(*counted("longest thread", F.max("turn_index"), F.lit(1).cast("long")))
    four = t.spark.read.parquet(f"{folder}/quarantine").agg(*counted("quarantine", F.count("*"), F.countDistinct("event_id")))
    return one.unionByName(two).unionByName(longest).unionByName(four)
