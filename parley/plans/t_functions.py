"""Scalar functions and plug points over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import scalars as S
from parley.functions import terms as T
from parley.plans.registry import Tables, query

c = F.col


@query(
    "fn_conversion",
    """
    SELECT count(*) FILTER (event_id % 5 <> 4 AND event_id % 5 <> 3) AS numbers, sum(CASE WHEN event_id % 5 IN (0, 1) THEN event_id WHEN event_id % 5 = 2 THEN event_id END)::BIGINT AS whole,
           count(*) FILTER (event_id % 3 = 0) AS yes, count(*) FILTER (event_id % 3 = 1) AS no FROM events
    """,
)
def conversion(t: Tables) -> DataFrame:
    e = c("event_id")
    text = F.when(e % 5 == 0, e.cast("string")).when(e % 5 == 1, F.concat(e, F.lit(".0"))).when(e % 5 == 2, F.concat(F.lit(" "), e, F.lit(" "))).when(e % 5 == 3, "n/a").otherwise(" ")
    flag = F.when(e % 3 == 0, "1").when(e % 3 == 1, "0").otherwise("")
    rows = t.events.select(S.to_number(text).alias("n"), S.to_whole(text).alias("w"), S.to_flag(flag).alias("f"))
    return rows.agg(F.count("n").alias("numbers"), F.sum("w").alias("whole"), F.count_if("f").alias("yes"), F.count_if(~c("f")).alias("no"))


@query(
    "fn_dates",
    """
    SELECT event_id, date_trunc('second', CASE WHEN event_id % 6 IN (0, 2) THEN ts WHEN event_id % 6 <> 5 THEN ts::DATE END) AS at,
           event_id % 6 = 2 AS zoned, strftime(ts, '%G-W%V') AS week, substr(ts::VARCHAR, 1, 7) AS month, datediff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS days FROM events
    """,
)
def dates(t: Tables) -> DataFrame:
    e, ts = c("event_id"), c("ts")
    text = (
        F.when(e % 6 == 0, F.lower(F.date_format(ts, "ddMMMyyyy HH:mm:ss"))).when(e % 6 == 1, F.lower(F.date_format(ts, "ddMMMyyyy")))
        .when(e % 6 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(e % 6 == 3, F.date_format(ts, "yyyy/MM/dd")).when(e % 6 == 4, F.date_format(ts, "yyyyMMdd")).otherwise("soon")
    )
    zoned = F.when(e % 6 == 2, F.concat(text, F.lit("+02:00"))).otherwise(text)
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))
    return t.events.select(
        e, S.to_instant(text).cast("timestamp_ntz").alias("at"), S.has_offset(zoned).alias("zoned"), week.alias("week"),
        F.substring(ts.cast("string"), 1, 7).alias("month"), F.datediff(F.to_date(ts), F.lit("2024-01-01")).alias("days"),
    )


@query(
    "fn_hash_bucket",
    "SELECT (('0x' || right(sha256(c_name), 15))::BIGINT % 32)::INTEGER AS bucket, count(*) AS n, min(substr(sha256(c_name), 1, 20)) AS first_digest FROM customer GROUP BY 1",
)
def hashes(t: Tables) -> DataFrame:
    return t.customer.groupBy(S.hash_bucket(c("c_name"), 32).alias("bucket")).agg(
        F.count("*").alias("n"), F.min(F.substring(F.sha2("c_name", 256), 1, 20)).alias("first_digest")
    )


@query(
    "fn_canonical_hash",
    """
    SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}') AS digest FROM customer
    """,
)
def canonical(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.canonical_hash("c_nationkey", "c_custkey", "c_mktsegment").alias("digest"))


@query(
    "fn_math",
    """
    SELECT l_returnflag, round(avg(1 / (1 + exp(-least(greatest(l_quantity - 25, -35), 35)))), 6) AS sigmoid, round(avg(ln(p / (1 - p))), 6) AS logit,
           round(avg(least(greatest(l_discount * 20, 0.3), 1.2)), 6) AS clipped, round(avg(CASE WHEN l_tax <> 0 THEN l_discount / l_tax END), 6) AS ratio,
           sum(greatest(least(floor((l_quantity - 10) / 20.0::DOUBLE * 8), 7), 0))::BIGINT AS bins
    FROM (SELECT *, least(greatest(l_discount * 10, 1e-6), 1 - 1e-6) AS p FROM lineitem) GROUP BY 1
    """,
)
def math(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_returnflag").agg(
        F.avg(S.sigmoid(c("l_quantity") - 25)).alias("sigmoid"), F.avg(S.logit(c("l_discount") * 10)).alias("logit"), F.avg(S.clip(c("l_discount") * 20, 0.3, 1.2)).alias("clipped"),
        F.avg(S.ratio(c("l_discount"), c("l_tax"))).alias("ratio"), F.sum(S.bin_of(c("l_quantity"), 8, 10.0, 30.0)).alias("bins"),
    )
    return rows.withColumns({x: F.round(x, 6) for x in ("sigmoid", "logit", "clipped", "ratio")})


@query(
    "fn_money",
    "SELECT l_returnflag, sum(CAST(l_extendedprice AS DECIMAL(18, 2)))::DOUBLE AS total, max(CAST(l_extendedprice AS DECIMAL(18, 2)))::DOUBLE AS top FROM lineitem GROUP BY 1",
)
def cash(t: Tables) -> DataFrame:
    amount = S.money(c("l_extendedprice"))
    return t.lineitem.groupBy("l_returnflag").agg(F.sum(amount).cast("double").alias("total"), F.max(amount).cast("double").alias("top"))


@query(
    "fn_terms",
    """
    SELECT l_linestatus, round(avg(l_quantity + l_tax * l_discount + CASE WHEN abs(l_discount) > 1e-12 THEN l_tax / l_discount ELSE 0 END + pow(l_tax, 6)
             + CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END + ln(greatest(l_discount, 1e-12)) + sqrt(greatest(l_tax - 0.04, 0)) + exp(least(l_quantity * 2, 50)) / exp(50)), 6) AS score
    FROM lineitem GROUP BY 1
    """,
)
def terms(t: Tables) -> DataFrame:
    q, d, x = T.var("l_quantity"), T.var("l_discount"), T.var("l_tax")
    parts = [
        q, T.interaction(x, d), T.divide(x, d), T.power(x, F.lit(9.0)), T.threshold(q, F.lit(25.0)), T.log(d), T.sqrt(x - 0.04), T.exp(q * 2) / F.exp(F.lit(50.0)),
    ]
    return t.lineitem.groupBy("l_linestatus").agg(F.round(F.avg(T.score(parts)), 6).alias("score"))


@query(
    "fn_bands_and_reasons",
    """
    SELECT CASE WHEN p_size IS NULL THEN 'none' WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS band,
           concat_ws(',', CASE WHEN p_retailprice > 950 THEN 'dear' END, CASE WHEN p_type = 'LARGE' THEN 'bulky' END) AS reasons, count(*) AS n FROM part GROUP BY 1, 2
    """,
)
def bands(t: Tables) -> DataFrame:
    label = S.band(c("p_size"), [(10, "small"), (30, "middle")], "large", "none")
    why = F.array_join(S.reasons(dear=c("p_retailprice") > 950, bulky=c("p_type") == "LARGE"), ",")
    return t.part.groupBy(label.alias("band"), why.alias("reasons")).agg(F.count("*").alias("n"))


@query("fn_json_path", "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(props->>'$.missing') AS missing FROM events GROUP BY 1")
def json_path(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(
        F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("total"), F.count(F.get_json_object("props", "$.missing")).alias("missing")
    )


@query(
    "fn_python_predictor",
    "SELECT event_type, count(*) AS n, round(avg(value / (value + 100)), 6) AS mean_p FROM events GROUP BY 1",
)
def predictor(t: Tables) -> DataFrame:
    """A Python model behind the predictor plug point: Arrow batches, one vectorised call per batch."""
    import pandas as pd

    def score(batches):
        for batch in batches:
            yield pd.DataFrame({"event_type": batch["event_type"], "p": batch["value"] / (batch["value"] + 100)})

    scored = t.events.select("event_type", "value").mapInPandas(score, "event_type string, p double")
    return scored.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))
