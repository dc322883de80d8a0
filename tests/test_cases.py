from datetime import datetime

from pyspark.sql import functions as F

from parley.operators import cases as K

T0 = datetime(2024, 1, 1, 10)


def turns(spark, rows):
    """rows: thread, price, actor, action, amount, status_id, minute."""
    data = [
        (t, hash(t) % 5, "b", "s", T0.replace(minute=m), i, 2 if actor == "seller" else 0, actor, action, amount, status, float(price), "cat", "new", float(price) * 0.8, True, None)
        for i, (t, price, actor, action, amount, status, m) in enumerate(rows)
    ]
    schema = (
        "thread_id string, listing_id int, buyer_id string, seller_id string, event_time timestamp, event_id int, offer_type int, actor string, action string, amount double, "
        "status_id int, listing_price double, category string, condition string, final_sale_price double, sold_by_best_offer boolean, response_time timestamp"
    )
    return K.turn_features(spark.createDataFrame(data, schema), ["event_time", "event_id"])


SMALL = [
    ("t1", 100, "buyer", "offer", 70.0, None, 0), ("t1", 100, "seller", "counter", 85.0, None, 5), ("t1", 100, "buyer", "accept", 85.0, None, 9),
    ("t2", 200, "buyer", "offer", 120.0, None, 0), ("t2", 200, "seller", "decline", None, None, 3),
    ("t3", 150, "buyer", "offer", 110.0, None, 0), ("t3", 150, "seller", "counter", 130.0, None, 1), ("t3", 150, "buyer", "counter", 120.0, None, 2), ("t3", 150, "seller", "accept", 120.0, None, 3),
]


def test_next_row_labels_of_the_small_sample(spark):
    f = turns(spark, SMALL)
    labels = {r["row_id"]: r["label_str"] for r in K.seller_next_action(f, "next_row").collect()}
    assert labels == {
        "t1:1:seller_next_action": "counter", "t2:1:seller_next_action": "decline", "t3:1:seller_next_action": "counter", "t3:3:seller_next_action": "accept",
    }
    buyer = {r["row_id"]: r["label_str"] for r in K.buyer_response(f, "next_row").collect()}
    assert buyer == {"t1:2:buyer_response": "accept", "t3:2:buyer_response": "counter"}
    agreed = {r["thread_id"]: r["agreement"] for r in K.agreement(f).collect()}
    assert agreed == {"t1": "1", "t2": "0", "t3": "1"}
    ratios = {r["thread_id"]: r["label_num"] for r in K.final_price_ratio(f, "accepted").collect()}
    assert ratios == {"t1": 0.85, "t3": 0.8}
    seconds = {r["row_id"]: r["label_num"] for r in K.response_latency(f, "next_turn").collect()}
    assert seconds["t1:1:response_latency"] == 300.0 and len(seconds) == 6


def test_status_labels_and_censoring(spark):
    f = turns(
        spark,
        [
            ("a", 100, "buyer", "offer", 50.0, 7, 0), ("a", 100, "seller", "counter", 80.0, 7, 1), ("b", 100, "buyer", "offer", 50.0, 7, 0), ("c", 100, "buyer", "offer", 50.0, 8, 0),
            ("d", 100, "buyer", "offer", 50.0, 9, 0), ("d", 100, "buyer", "offer", 55.0, 8, 1), ("e", 100, "buyer", "offer", 50.0, 6, 0),
        ],
    )
    cases = {r["row_id"]: r for r in K.build_cases(f).collect()}
    assert cases["a:1:seller_next_action"]["label_str"] == "counter"
    # countered without the counter that must follow is unknown, never a decline
    assert cases["b:1:seller_next_action"]["label_str"] is None and cases["b:1:seller_next_action"]["outcome_state"] == "unknown"
    assert cases["c:1:seller_next_action"]["outcome_state"] == "censored"
    # an acceptance outweighs a censored turn
    assert cases["d:agreement"]["label_str"] == "1" and cases["c:agreement"]["outcome_state"] == "censored"
    assert cases["e:agreement"]["label_str"] == "0"
    assert cases["a:2:buyer_response"]["label_str"] is None


def test_history_chunks_are_bounded_and_whole(spark):
    f = turns(spark, [("long", 100, "buyer", "offer", float(i), 0, i) for i in range(50)])
    chunks = K.history_chunks(f, 8)
    sizes = [r[0] for r in chunks.select(F.size("turns")).collect()]
    assert max(sizes) <= 8 and sum(sizes) == 50


def test_feature_contract_names():
    assert K.contract_faults(["category", "round_number"]) == []
    assert K.contract_faults(["status", "mood"]) == ["mood", "status"]


def test_utterances(spark):
    said = [("How about $120 if I can pick up", 120.0, "counter"), ("deal", None, "accept"), ("80 or 95", 95.0, "propose"), ("nevermind", None, "quit"), ("100 is too low", 100.0, "reject")]
    df = spark.createDataFrame([(1, i, *x) for i, x in enumerate(said)], "d int, t int, text string, want double, want_act string")
    facts = K.utterance_facts(df, "text")
    got = [(r["price"], r["act"]) for r in facts.orderBy("t").collect()]
    assert got == [(p, a) for _, p, a in said]
    assert [r["price"] for r in K.price_sequence(facts, "d", "t").orderBy("place").collect()] == [120.0, 95.0, 100.0]
    out = K.extraction_accuracy(facts, "want", "want_act").first()
    assert out["offer_accuracy"] == 1.0 and out["act_accuracy"] == 1.0 and out["ambiguous"] == 1


def test_histories_in_another_order_have_other_digests(spark):
    """Equal turns in another order, and missing amounts, give other histories and tokens."""
    turns = {
        "a": [("buyer", "offer", 10.0), ("seller", "counter", 20.0), ("seller", "counter", 15.0), ("buyer", "offer", 1.0)],
        "b": [("seller", "counter", 20.0), ("buyer", "offer", 10.0), ("seller", "counter", 15.0), ("buyer", "offer", 1.0)],
        "c": [("buyer", "offer", None), ("seller", "counter", 20.0), ("seller", "counter", 15.0), ("buyer", "offer", 1.0)],
        "d": [("buyer", "offer", 10.0), ("seller", "counter", 20.0), ("seller", "counter", 15.0), ("buyer", "offer", 1.0)],
    }
    rows = [(t, i, *turn) for t, items in turns.items() for i, turn in enumerate(items)]
    df = spark.createDataFrame(rows, "thread_id string, event_time int, actor string, action string, amount double").withColumn("listing_price", F.lit(100.0))
    last = {r.thread_id: r.history_digest for r in K.turn_features(df, ["event_time"]).filter("turn_index = 4").collect()}
    assert last["a"] == last["d"] and len({last["a"], last["b"], last["c"]}) == 3
