"""Published moments of a negotiation data set: observed values against expectation and tolerance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.cases import ACCEPTED, COUNTERED
from parley.session import stage

c = F.col

# Fixed values: (moment, component, expected, tolerance, fatal).
TARGETS = [
    ("raw_listings", "count", 98307281.0, 0.0, True),
    ("main_sample_listings", "count", 88388220.0, 0.0, True),
    ("l1_price_over_1000", "count", 9547987.0, 0.0, True),
    ("l1_price_over_1000", "fraction", 0.0971, 0.00005, True),
    ("l2_sale_above_listing", "count", 42524.0, 0.0, True),
    ("l2_sale_above_listing", "fraction", 0.000433, 0.0000005, True),
    ("t1_offer_above_listing", "count", 386096.0, 0.0, True),
    ("t1_offer_above_listing", "fraction", 0.00393, 0.000005, True),
    ("t2_offer_limit", "buyer_count", 3529.0, 0.0, True),
    ("t2_offer_limit", "buyer_fraction", 0.0000359, 0.00000005, True),
    ("t2_offer_limit", "seller_count", 0.0, 0.0, True),
    ("t2_offer_limit", "seller_fraction", 0.0, 0.00000005, True),
    ("t3_t4_sequence", "missing_counter_count", 1453.0, 0.0, True),
    ("t3_t4_sequence", "missing_counter_fraction", 0.0000148, 0.00000005, True),
    ("t3_t4_sequence", "accepted_not_last_count", 1111.0, 0.0, True),
    ("t3_t4_sequence", "accepted_not_last_fraction", 0.0000113, 0.00000005, True),
    ("listing_price_mean", "value", 94.6, 0.05, True),
    ("listing_used_rate", "value", 0.548, 0.0005, True),
    ("listing_used_rate", "denominator", 60709655.0, 0.0, True),
    ("listing_revised_rate", "value", 0.263, 0.0005, True),
    ("listing_sold_rate", "value", 0.215, 0.0005, True),
    ("listing_sold_best_offer_rate", "value", 0.132, 0.0005, True),
    ("listing_received_offer_rate", "value", 0.206, 0.0005, True),
    ("listing_sale_price_to_list", "value", 0.832, 0.0005, True),
    ("listing_bargained_price_to_list", "value", 0.727, 0.0005, True),
    ("sellers", "seller_count", 1197419.0, 0.0, True),
    ("sellers", "feedback_sellers", 1145426.0, 0.0, True),
    ("sellers", "feedback_mean", 99.4, 0.05, True),
    ("buyers", "count", 4701455.0, 0.0, True),
    ("threads", "count", 25458516.0, 0.0, True),
    ("thread_offers_mean", "value", 1.66, 0.005, True),
    ("thread_agreement_rate", "value", 0.454, 0.0005, True),
    ("thread_first_offer_to_list", "value", 0.608, 0.0005, True),
    ("reference_listings", "count", 2047079.0, 0.0, False),
    ("reference_sold_rate", "value", 0.467, 0.0005, False),
    ("reference_received_offer_rate", "value", 0.427, 0.0005, False),
    ("reference_bargained_price_to_list", "value", 0.813, 0.0005, False),
    ("reference_thread_agreement_rate", "value", 0.25, 0.0005, False),
    ("game_tree_root", "count", 25117275.0, 0.0, False),
    ("first_seller_response", "accept_share", 0.33, 0.005, False),
    ("first_seller_response", "counter_share", 0.27, 0.005, False),
    ("first_seller_response", "decline_share", 0.40, 0.005, False),
]
USED_FROM = 3000
REFERENCE_COUNT = 20


def thread_facts(features: DataFrame) -> DataFrame:
    """One row per thread from its ordered turns: counts, first offer, sequence faults."""
    due = F.when(c("actor") == "buyer", "seller").otherwise("buyer")
    follows = F.coalesce((c("next_actor") == due) & (c("next_action") == "counter"), F.lit(False))
    return features.groupBy("listing_id", "thread_id").agg(
        F.count("*").alias("rounds"), F.count_if(c("offer_type") != 2).alias("buyer_offers"), F.count_if(c("offer_type") == 2).alias("seller_offers"),
        F.max("amount").alias("top_amount"), F.min_by(F.struct("amount", "status_id", "offer_type"), "turn_index").alias("first"),
        F.bool_or(c("status_id").isin(ACCEPTED)).alias("agreed"), F.bool_or((c("status_id") == COUNTERED) & ~follows).alias("missing_counter"),
        F.bool_or(c("status_id").isin(ACCEPTED) & c("next_actor").isNotNull()).alias("accepted_not_last"),
    )


def listing_facts(listings: DataFrame, threads: DataFrame) -> DataFrame:
    """Every listing with its exclusion flags; ``main`` marks the sample that none of them hits."""
    per = threads.groupBy("listing_id").agg(
        F.max("top_amount").alias("_top"), F.bool_or(c("buyer_offers") > 3).alias("t2b"), F.bool_or(c("seller_offers") > 3).alias("t2s"),
        F.bool_or("missing_counter").alias("t3"), F.bool_or("accepted_not_last").alias("t4"),
    )
    rows = listings.join(per, "listing_id", "left")
    price = c("listing_price")
    flags = {
        "l1": price > 1000, "l2": c("final_sale_price") > price, "t1": c("_top") > price, "t2b": c("t2b"), "t2s": c("t2s"), "t3": c("t3"), "t4": c("t4"),
    }
    rows = rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}).withColumn("has_thread", c("_top").isNotNull()).drop("_top")
    any_flag = reduce(lambda a, b: a | b, [c(k) for k in flags])
    reference = ~any_flag & F.coalesce(c("reference_count") >= REFERENCE_COUNT, F.lit(False)) & c("condition_id").isNotNull()
    return rows.withColumns({"main": ~any_flag, "reference": reference})


def observed_moments(listings: DataFrame, features: DataFrame) -> DataFrame:
    """Long frame (moment, component, observed) from one aggregation over listings and one over threads."""
    # four aggregations read them
    threads = stage(thread_facts(features))
    rows = stage(listing_facts(listings, threads))
    main, ref = c("main"), c("reference")
    sold, bargained = c("final_sale_price").isNotNull(), c("sold_by_best_offer")
    share = c("final_sale_price") / c("listing_price")

    def rate(cond: Column, inside: Column) -> Column:
        return F.avg(F.when(inside, cond.cast("double")))

    def flagged(name: str) -> tuple[Column, Column]:
        return F.count_if(name).cast("double"), F.avg(c(name).cast("double"))

    pairs: dict[tuple[str, str], Column] = {
        ("raw_listings", "count"): F.count("*").cast("double"),
        ("main_sample_listings", "count"): F.count_if(main).cast("double"),
        ("listing_price_mean", "value"): F.avg(F.when(main, c("listing_price"))),
        ("listing_used_rate", "value"): rate(c("condition_id") >= USED_FROM, main & c("condition_id").isNotNull()),
        ("listing_used_rate", "denominator"): F.count_if(main & c("condition_id").isNotNull()).cast("double"),
        ("listing_revised_rate", "value"): rate(c("revised"), main),
        ("listing_sold_rate", "value"): rate(sold, main),
        ("listing_sold_best_offer_rate", "value"): rate(bargained, main),
        ("listing_received_offer_rate", "value"): rate(c("has_thread"), main),
        ("listing_sale_price_to_list", "value"): F.avg(F.when(main & sold, share)),
        ("listing_bargained_price_to_list", "value"): F.avg(F.when(main & bargained, share)),
        ("reference_listings", "count"): F.count_if(ref).cast("double"),
        ("reference_sold_rate", "value"): rate(sold, ref),
        ("reference_received_offer_rate", "value"): rate(c("has_thread"), ref),
        ("reference_bargained_price_to_list", "value"): F.avg(F.when(ref & bargained, share)),
    }
    for moment, flag, prefix in (
        ("l1_price_over_1000", "l1", ""), ("l2_sale_above_listing", "l2", ""), ("t1_offer_above_listing", "t1", ""), ("t2_offer_limit", "t2b", "buyer_"),
        ("t2_offer_limit", "t2s", "seller_"), ("t3_t4_sequence", "t3", "missing_counter_"), ("t3_t4_sequence", "t4", "accepted_not_last_"),
    ):
        pairs[(moment, f"{prefix}count")], pairs[(moment, f"{prefix}fraction")] = flagged(flag)

    sample = rows.filter("main")
    people = sample.groupBy("seller_id").agg(F.max("feedback_positive").alias("f"))
    sellers = {
        ("sellers", "seller_count"): F.count("*").cast("double"), ("sellers", "feedback_sellers"): F.count("f").cast("double"), ("sellers", "feedback_mean"): F.avg("f"),
    }
    buyers = {("buyers", "count"): F.count("*").cast("double")}
    joined = threads.join(sample.select("listing_id", "listing_price", "reference"), "listing_id").withColumn("ratio", c("first.amount") / c("listing_price"))
    panel, first = c("ratio") <= 1, c("first.status_id")
    root = c("first.offer_type") == 0
    by_thread = {
        ("threads", "count"): F.count_if(panel).cast("double"),
        ("thread_offers_mean", "value"): F.avg(F.when(panel, c("rounds"))),
        ("thread_agreement_rate", "value"): rate(c("agreed"), panel),
        ("thread_first_offer_to_list", "value"): F.avg(F.when(panel, c("ratio"))),
        ("reference_thread_agreement_rate", "value"): rate(c("agreed"), panel & c("reference")),
        ("game_tree_root", "count"): F.count_if(root).cast("double"),
        ("first_seller_response", "accept_share"): rate(first.isin(ACCEPTED), root),
        ("first_seller_response", "counter_share"): rate(first == COUNTERED, root),
        ("first_seller_response", "decline_share"): rate(~first.isin(*ACCEPTED, COUNTERED), root),
    }

    def long(df: DataFrame, values: dict[tuple[str, str], Column]) -> DataFrame:
        wide = df.agg(*[v.alias(f"{m}.{k}") for (m, k), v in values.items()])
        cells = F.array(*[F.struct(F.lit(m).alias("moment"), F.lit(k).alias("component"), c(f"`{m}.{k}`").alias("observed")) for m, k in values])
        return wide.select(F.explode(cells).alias("x")).select("x.*")

    distinct_buyers = sample.filter(c("buyer_id_if_sold").isNotNull()).select("buyer_id_if_sold").distinct()
    parts = [long(rows, pairs), long(people, sellers), long(distinct_buyers, buyers), long(joined, by_thread)]
    return reduce(DataFrame.unionByName, parts)


def replication_check(observed: DataFrame, targets: list[tuple] = TARGETS) -> DataFrame:
    """Observed moments against the targets: passed, failed or not evaluated."""
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("moment"), F.lit(k).alias("component"), F.lit(e).alias("expected"), F.lit(tol).alias("tolerance"), F.lit(fatal).alias("fatal"), F.lit(i).alias("i")
            )
            for i, (m, k, e, tol, fatal) in enumerate(targets)
        ]
    )
    frame = observed.sparkSession.range(1).select(F.explode(rows).alias("t")).select("t.*").drop("i")
    out = frame.join(observed, ["moment", "component"], "left")
    near = F.abs(c("observed") - c("expected")) <= c("tolerance")
    return out.withColumn("status", F.when(c("observed").isNull(), "not_evaluated").when(near, "passed").otherwise("failed"))
