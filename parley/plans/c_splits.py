"""Splits, purging, freezes and lockbox membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import cases as K
from parley.operators import splits as P
from parley.plans import bindings as B
from parley.plans.b_cases import TOKEN_SQL
from parley.plans.registry import Tables, ctes, query
from parley.session import stage

c = F.col

REGION = """
CASE WHEN {pos} <= greatest(1, floor({n} * 0.6)) THEN 'train'
     WHEN {pos} <= CASE WHEN {n} >= 3 THEN least(greatest(1, floor({n} * 0.6), floor({n} * 0.8)), {n} - 1)
                       ELSE greatest(1, floor({n} * 0.6), floor({n} * 0.8)) END THEN 'development' ELSE 'hidden' END
"""


def region_sql(pos: str, n: str) -> str:
    return REGION.format(pos=pos, n=n)


CHRONO = f"""
placed AS (
  SELECT *, {region_sql('pos', 'n')} AS region FROM (
    SELECT *, row_number() OVER (PARTITION BY task ORDER BY timestamp, row_id) AS pos, count(*) OVER (PARTITION BY task) AS n FROM cases)),
cut AS (SELECT task, listing_id, count(*) AS rows FROM placed GROUP BY 1, 2 HAVING count(DISTINCT region) > 1),
kept AS (SELECT * FROM placed p WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.task = p.task AND c.listing_id = p.listing_id))
"""


@query("c01_chronological_split", ctes(B.CASES, CHRONO) + "SELECT task, row_id, region FROM placed")
def c01(t: Tables) -> DataFrame:
    return P.chronological_split(B.cases(t).select("task", "row_id", "timestamp"), "timestamp", "row_id", ["task"]).drop("timestamp")


@query(
    "c01_global_split",
    f"""
    SELECT o_orderkey, {region_sql('pos', 'n')} AS region FROM (
      SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos, count(*) OVER () AS n FROM orders)
    """,
)
def c01_global(t: Tables) -> DataFrame:
    return P.chronological_split(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "region")


@query("c02_purged_split", ctes(B.CASES, CHRONO) + "SELECT task, row_id, region FROM kept")
def c02(t: Tables) -> DataFrame:
    lean = B.cases(t).select("task", "row_id", "timestamp", "listing_id")
    return P.chronological_purged_split(lean, "timestamp", "listing_id", "row_id", ["task"])[0].select("task", "row_id", "region")


@query("c02_purge_audit", ctes(B.CASES, CHRONO) + "SELECT task, listing_id::VARCHAR AS listing_id, rows FROM cut")
def c02_audit(t: Tables) -> DataFrame:
    lean = B.cases(t).select("task", "row_id", "timestamp", "listing_id")
    return P.chronological_purged_split(lean, "timestamp", "listing_id", "row_id", ["task"])[1]


def group_sql(group: str, order: str, where: str = "TRUE") -> str:
    return f"""
    SELECT c.task, c.row_id, g.region FROM cases c JOIN (
      SELECT task, g, {region_sql('pos', 'n')} AS region FROM (
        SELECT task, g, row_number() OVER (PARTITION BY task ORDER BY {order}) AS pos, count(*) OVER (PARTITION BY task) AS n
        FROM (SELECT DISTINCT task, {group}::VARCHAR AS g FROM cases WHERE {where}))) g
    ON g.task = c.task AND g.g = c.{group}::VARCHAR
    """


def hash_sql(group: str) -> str:
    return group_sql(group, f"""sha256('{{"group":"' || g || '","split":"{group}"}}'), g""")


@query("c03_group_split", ctes(B.CASES) + group_sql("seller_id", "g"))
def c03(t: Tables) -> DataFrame:
    return P.group_split(B.cases(t).select("task", "row_id", "seller_id"), "seller_id", "row_id", ["task"]).select("task", "row_id", "region")


@query("c04_hash_group_split", ctes(B.CASES) + hash_sql("seller_id"))
def c04(t: Tables) -> DataFrame:
    return P.hash_group_split(B.cases(t).select("task", "row_id", "seller_id"), "seller_id", by=["task"]).select("task", "row_id", "region")


STANDARD = f"""
assign AS (
  SELECT 'chronological_listing_purged' AS split_name, task, row_id, region FROM kept UNION ALL
  SELECT 'seller_disjoint', * FROM ({hash_sql('seller_id')}) UNION ALL
  SELECT 'buyer_disjoint', * FROM ({hash_sql('buyer_id')}) UNION ALL
  SELECT 'category_disjoint_diagnostic', * FROM ({hash_sql('category')}) UNION ALL
  SELECT 'thread_safe_nested_development', * FROM ({hash_sql('thread_id')}))
"""


@query("c05_standard_splits", ctes(B.CASES, CHRONO, STANDARD) + "SELECT split_name, task, region, count(*) AS rows FROM assign GROUP BY 1, 2, 3")
def c05(t: Tables) -> DataFrame:
    columns = ["task", "row_id", "timestamp", "listing_id", "seller_id", "buyer_id", "category", "thread_id"]
    return P.assignment_counts(P.standard_splits(stage(B.cases(t).select(*columns))))


@query(
    "c06_missing_groups",
    f"""
    WITH g AS (SELECT event_id, CASE WHEN user_id % 6 = 0 THEN '__missing__:' || event_id ELSE user_id::VARCHAR END AS g FROM events)
    SELECT event_id, region FROM g JOIN (
      SELECT g, {region_sql('pos', 'n')} AS region FROM (
        SELECT g, row_number() OVER (ORDER BY g) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM g))) USING (g)
    """,
)
def c06(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.when(c("user_id") % 6 != 0, c("user_id")).alias("owner"))
    return P.group_split(rows, "owner", "event_id").select("event_id", "region")


@query(
    "c07_validate_split",
    ctes(B.CASES, CHRONO)
    + """
    SELECT task, count(*) AS rows, 0::BIGINT AS rows_in_two_regions,
           (SELECT count(*) FROM (SELECT listing_id FROM kept g WHERE g.task = k.task GROUP BY 1 HAVING count(DISTINCT region) > 1)) AS groups_in_two_regions,
           coalesce(max(CASE WHEN region = 'train' THEN timestamp END) <= min(CASE WHEN region = 'development' THEN timestamp END), true)
           AND coalesce(max(CASE WHEN region = 'development' THEN timestamp END) <= min(CASE WHEN region = 'hidden' THEN timestamp END), true) AS chronological
    FROM kept k GROUP BY task
    """,
)
def c07(t: Tables) -> DataFrame:
    lean = B.cases(t).select("task", "row_id", "timestamp", "listing_id")
    kept, _ = P.chronological_purged_split(lean, "timestamp", "listing_id", "row_id", ["task"])
    return P.validate_split(stage(kept), "listing_id", "timestamp", ["task"])


USED = """
used AS (SELECT sha256(source) AS token FROM tokens JOIN cases USING (row_id) WHERE current_actor = 'seller'),
hid AS (SELECT k.task, k.row_id, sha256(source || chr(1) || content) AS a, sha256(content) AS b, sha256(source) AS s
        FROM kept k JOIN tokens USING (row_id) WHERE region = 'hidden')
"""


def _hidden_tokens(t: Tables) -> tuple[DataFrame, DataFrame]:
    cases = stage(B.cases(t).select(*K.TOKEN_FIELDS))
    kept, _ = P.chronological_purged_split(cases, "timestamp", "listing_id", "row_id", ["task"], staged=True)
    used = K.case_tokens(cases.filter(c("current_actor") == "seller")).select(c("source_token").alias("token"))
    hidden = K.case_tokens(kept.filter(c("region") == "hidden"))
    return stage(hidden.select("task", "row_id", *P.TOKENS)), used


@query(
    "c08_fresh_hidden",
    ctes(B.CASES, CHRONO, TOKEN_SQL, USED)
    + """
    SELECT task, count(CASE WHEN NOT old THEN 1 END) AS fresh, count(CASE WHEN old THEN 1 END) AS excluded FROM (
      SELECT task, a IN (SELECT token FROM used) OR b IN (SELECT token FROM used) OR s IN (SELECT token FROM used) AS old FROM hid)
    GROUP BY task
    """,
)
def c08(t: Tables) -> DataFrame:
    fresh, old = P.fresh_hidden(*_hidden_tokens(t))
    both = fresh.select("task", F.lit(1).alias("f"), F.lit(0).alias("o")).unionByName(old.select("task", F.lit(0).alias("f"), F.lit(1).alias("o")))
    return both.groupBy("task").agg(F.sum("f").alias("fresh"), F.sum("o").alias("excluded"))


@query(
    "c09_lockbox_conflicts",
    """
    SELECT 'day-' || day(o_orderdate) AS lockbox_id, day(o_orderdate) <= 5 AS id_reused, day(o_orderdate) = 9 AS set_reused,
           CASE WHEN day(o_orderdate) = 9 THEN count(DISTINCT o_orderkey)
                ELSE count(DISTINCT CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN o_orderkey END) END AS shared_tokens
    FROM orders GROUP BY day(o_orderdate)
    """,
)
def c09(t: Tables) -> DataFrame:
    # earlier: the urgent finished orders under the ids of days 1 to 5 or of other boxes, and the whole of day 9
    day = F.dayofmonth("o_orderdate")
    rows = t.orders.withColumn("day", day).withColumn("token", F.sha2(c("o_orderkey").cast("string"), 256))
    candidates = rows.select(F.concat(F.lit("day-"), "day").alias("lockbox_id"), "token")
    urgent = rows.filter((c("o_orderstatus") == "F") & (c("o_orderpriority") == "1-URGENT"))
    named = urgent.select(F.when(c("day") <= 5, F.concat(F.lit("day-"), "day")).otherwise("other").alias("lockbox_id"), "token")
    whole = rows.filter(c("day") == 9).select(F.lit("ninth").alias("lockbox_id"), "token")
    return P.lockbox_conflicts(candidates, named.unionByName(whole))


@query(
    "c10_episode_split",
    """
    SELECT event_id AS case_id, CASE WHEN pos <= floor(n * 0.5) THEN 'training' WHEN pos <= floor(n * 0.5) + floor(n * 0.2) THEN 'development'
             WHEN pos <= n - floor(n * 0.1) THEN 'hidden' ELSE 'prospective' END AS split
    FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS pos, count(*) OVER () AS n FROM events WHERE event_type <> 'error')
    """,
)
def c10(t: Tables) -> DataFrame:
    rows = K.supervised_rows(B.episodes(t), "purchased").select("case_id", "decision_time")
    return P.episode_split(rows, "decision_time", "case_id", train=0.5, development=0.2, hidden=0.2, prospective=0.1).select("case_id", "split")


FREEZE = """
frozen AS (
  SELECT user_id % 5 AS campaign_id, arg_max('f' || event_id, ts) AS freeze_id, max(ts) - INTERVAL 9 DAY AS cutoff, max(ts) - INTERVAL 8 DAY AS frozen_at
  FROM events WHERE event_type = 'signup' AND user_id % 5 <> 4 GROUP BY 1)
"""


def freezes(t: Tables) -> DataFrame:
    """Sign-ups freeze their campaign; campaign 4 never froze."""
    campaign = c("user_id") % 5
    rows = t.events.filter((c("event_type") == "signup") & (campaign != 4))
    return rows.select(
        campaign.alias("campaign_id"), F.concat(F.lit("f"), "event_id").alias("freeze_id"), c("ts").alias("seq"),
        (c("ts") - F.expr("INTERVAL 9 DAYS")).alias("data_cutoff_time"), (c("ts") - F.expr("INTERVAL 8 DAYS")).alias("frozen_at"),
    )


def arrivals(t: Tables) -> DataFrame:
    return t.events.select(
        (c("user_id") % 5).alias("campaign_id"), c("event_id").alias("case_id"), "event_type", c("ts").alias("decision_time"),
        (c("ts") + F.expr("INTERVAL 6 HOURS")).alias("eligibility_recorded_at"),
    )


ARRIVAL_SQL = """
SELECT e.event_id AS case_id, CASE WHEN late THEN 'prospective' ELSE 'staging' END AS split,
       CASE WHEN freeze_id IS NULL THEN 'pre_freeze_staging' WHEN late THEN 'post_freeze_prospective' ELSE 'post_freeze_backfill_staging' END AS policy,
       CASE WHEN late THEN freeze_id END AS freeze_id
FROM (SELECT event_id, freeze_id, coalesce(ts > cutoff AND ts + INTERVAL 6 HOUR > frozen_at, false) AS late
      FROM events LEFT JOIN frozen ON user_id % 5 = campaign_id WHERE event_type <> 'purchase') e
"""


@query("c11_classify_new_rows", ctes(FREEZE) + ARRIVAL_SQL)
def c11(t: Tables) -> DataFrame:
    rows = arrivals(t)
    assigned = rows.filter(c("event_type") == "purchase")
    return P.classify_new_rows(rows, assigned, freezes(t)).select("case_id", "split", "policy", "freeze_id")


@query(
    "c12_split_fingerprint",
    ctes(B.CASES, CHRONO)
    + """
    SELECT task, region, count(*) AS items, sum(m)::VARCHAR AS mark_sum, bit_xor(m) AS mark_xor FROM (
      SELECT task, region, ('0x' || substr(sha256(row_id), 1, 15))::BIGINT AS m FROM kept) GROUP BY 1, 2
    """,
)
def c12(t: Tables) -> DataFrame:
    lean = B.cases(t).select("task", "row_id", "timestamp", "listing_id")
    kept, _ = P.chronological_purged_split(lean, "timestamp", "listing_id", "row_id", ["task"])
    return P.set_fingerprint(kept, ["task", "region"], "row_id")
