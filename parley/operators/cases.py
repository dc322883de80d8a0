"""Supervised cases from negotiation turns: context columns, labels, outcome states, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.sequence import Sequence, lead, rank, running_sum

c = F.col

# Status codes by meaning.
ACCEPTED = [1, 9]
DECLINED = [2, 6]
EXPIRED = 0
COUNTERED = 7
CENSORED = 8

# Endings that mean no agreement.
NEGATIVE_ACTIONS = ["decline", "expire", "leave", "reject", "quit"]
NEGATIVE_STATUSES = ["declined", "expired", "rejected", "closed_no_agreement"]

# The features a model may see.
FEATURES = (
    "category condition listing_price current_actor current_action current_amount offer_to_asking_ratio round_number "
    "prior_turn_count prior_counter_count event_hour"
).split()

# Names that must never be a feature.
FORBIDDEN = (
    "accept_price accepted_price agreement artifact_name auto_accept_price auto_decline_price bin_rev bo_ck_yn buyer_id "
    "buyer_id_if_sold buyer_us_if_sold decline_price event_time excluded_reference_price_ref_price4 final_price "
    "final_sale_price final_status future_rounds future_status future_turn_count item_price label later_response_time "
    "listing_id outcome ref_price4 reference_price response_time row_id seller_id sold_by_best_offer source_row_id status "
    "status_id terminal_thread_state thread_id total_rounds"
).split()
RESOLVED = ["accepted", "declined", "expired", "finalized"]

# Keys of decision context that belong to the time after the decision.
POST_DECISION = "observed_action later_outcomes outcomes adherence target label actual_action".split()


def history_mark(half: int) -> Column:
    """60 bits of the content hash of one turn at its place in the thread; a missing amount is told from any other."""
    amount = F.coalesce(F.floor(c("amount") * 1000).cast("string"), F.lit("none"))
    body = F.concat_ws("|", c("turn_index").cast("string"), F.coalesce("actor", F.lit("")), F.coalesce("action", F.lit("")), amount)
    return F.conv(F.substring(F.sha2(body, 256), 1 + 15 * half, 15), 16, 10).cast("decimal(38,0)")


def turn_features(turns: DataFrame, order: list[str], thread: str = "thread_id") -> DataFrame:
    """Position, look-ahead and prior counts of every turn; turns carry their listing's columns.

    One range shuffle serves all of them, and a hot thread is cut over many segments. The digest of a history is the sum
    of 120-bit marks of (place, turn), so histories with the same turns in another order differ.
    """
    seq = Sequence(turns, [thread], order).add(
        turn_index=rank(),
        next_actor=lead(c("actor")),
        next_action=lead(c("action")),
        next_time=lead(c("event_time")),
        prior_counters=running_sum(F.when(c("action") == "counter", 1).otherwise(0), inclusive=False),
    )
    seq = seq.map(_mark_a=history_mark(0), _mark_b=history_mark(1)).add(_sum_a=running_sum(c("_mark_a")), _sum_b=running_sum(c("_mark_b")))
    usable = (c("amount") != 0) & (c("listing_price") != 0)
    return seq.frame.withColumn("history_digest", F.concat_ws("-", c("_sum_a").cast("string"), c("_sum_b").cast("string"))).drop("_mark_a", "_mark_b", "_sum_a", "_sum_b").withColumns(
        {
            "prior_turns": c("turn_index") - 1,
            "prior_counters": F.coalesce(c("prior_counters"), F.lit(0)).cast("long"),
            "offer_ratio": F.when(usable, c("amount") / c("listing_price")),
        }
    )


def history_chunks(features: DataFrame, size: int = 64) -> DataFrame:
    """Sanitised history, at most ``size`` turns per row.

    A case (thread, turn) observes the chunks of its thread up to its turn. Kept once per
    thread, history stays linear in the turns, and no row grows with a long thread.
    """
    turn = F.struct("turn_index", "actor", "action", "amount")
    return (
        features.groupBy("thread_id", F.floor((c("turn_index") - 1) / size).cast("long").alias("chunk"))
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    )


def status_label(counter_actor: str) -> Column:
    """Label by status code; a countered turn counts only if the counter follows."""
    s = c("status_id")
    follows = (c("next_actor") == counter_actor) & (c("next_action") == "counter")
    return (
        F.when(s.isin(ACCEPTED), "accept")
        .when(s.isin(DECLINED), "decline")
        .when(s == EXPIRED, "expire")
        .when((s == COUNTERED) & follows, "counter")
    )


def next_row_label(actor: str, named: list[str], other: str) -> Column:
    """Label by the next row for sources without status codes; NULL if it is not that actor's."""
    a = c("next_action")
    return F.when(c("next_actor") == actor, F.when(a.isin(named), a).otherwise(other))


def _turn_cases(features: DataFrame, asked: Column, label: Column, task: str, suffix: str) -> DataFrame:
    rows = features.filter(asked).withColumn("label_str", label).filter(c("label_str").isNotNull())
    return _case_columns(rows, task, suffix).withColumn("label_num", F.lit(None).cast("double"))


def _case_columns(rows: DataFrame, task: str, suffix: str) -> DataFrame:
    return rows.withColumn("task", F.lit(task)).withColumn("row_id", F.concat_ws(":", "thread_id", "turn_index", F.lit(suffix)))


def seller_next_action(features: DataFrame, mode: str = "status") -> DataFrame:
    if mode == "status":
        asked = (c("actor") == "buyer") & c("action").isin("offer", "counter")
        label = status_label("seller")
    else:
        asked = c("actor") == "buyer"
        label = next_row_label("seller", ["accept", "counter", "decline"], "expire")
    return _turn_cases(features, asked, label, "seller_next_action", "seller_next_action")


def buyer_response(features: DataFrame, mode: str = "status") -> DataFrame:
    asked = (c("actor") == "seller") & (c("action") == "counter")
    if mode == "status":
        label = status_label("buyer")
    else:
        label = next_row_label("buyer", ["accept", "counter", "expire"], "leave")
    return _turn_cases(features, asked, label, "buyer_response_to_counter", "buyer_response")


def agreement(features: DataFrame) -> DataFrame:
    """One row per thread: agreement label (NULL if censored or open) and what else is read off its turns.

    The first accepted amount and the last turn come from min_by and max_by, not from a sorted list.
    """
    s = c("status_id")
    status = c("status") if "status" in features.columns else F.lit(None).cast("string")
    accepted = s.isin(ACCEPTED)
    taken = (accepted | (c("action") == "accept")) & c("amount").isNotNull()
    per = features.groupBy("thread_id").agg(
        F.bool_or(accepted).alias("any_accepted"),
        F.bool_or(s == CENSORED).alias("any_censored"),
        F.bool_or(F.lower("action") == "accept").alias("any_accept_action"),
        F.max_by(F.struct(s.alias("s"), F.lower("action").alias("a"), F.lower(status).alias("t")), "turn_index").alias("last"),
        F.min_by(F.when(taken, c("amount")), F.when(taken, c("turn_index"))).alias("accepted_amount"),
        F.count("*").alias("turns"),
    )
    lost = c("last.s").isin([EXPIRED, *DECLINED]) | c("last.a").isin(NEGATIVE_ACTIONS) | c("last.t").isin(NEGATIVE_STATUSES)
    label = (
        F.when(c("any_accepted"), "1")
        .when(c("any_censored"), F.lit(None).cast("string"))
        .when(c("any_accept_action"), "1")
        .when(lost, "0")
    )
    return per.withColumn("agreement", label).drop("last")


def opening_cases(features: DataFrame) -> DataFrame:
    """First turn of every thread with the thread's outcome: a one-to-one join."""
    return features.filter(c("turn_index") == 1).join(agreement(features), "thread_id")


def final_price_label(mode: str = "listing") -> Column:
    if mode == "listing":
        usable = c("sold_by_best_offer") & (c("agreement") == "1") & (c("listing_price") != 0)
        return F.when(usable, F.round(c("final_sale_price") / c("listing_price"), 6))
    return F.when(c("listing_price") != 0, F.round(c("accepted_amount") / c("listing_price"), 6))


def final_price_ratio(features: DataFrame, mode: str = "listing") -> DataFrame:
    rows = opening_cases(features).withColumn("label_num", final_price_label(mode)).filter(c("label_num").isNotNull())
    return rows.withColumn("task", F.lit("final_price_ratio")).withColumn("row_id", F.concat_ws(":", "thread_id", F.lit("final_price_ratio")))


def latency_label(mode: str = "response") -> Column:
    """Seconds to the response, or to the next turn for sources without response times."""
    end = c("response_time") if mode == "response" else c("next_time")
    seconds = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(c("event_time").cast("timestamp"))) / F.lit(1e6)
    if mode != "response":
        return seconds
    return F.when((seconds >= 0) & ~F.coalesce(c("status_id") == CENSORED, F.lit(False)), seconds)


def response_latency(features: DataFrame, mode: str = "response") -> DataFrame:
    rows = features.withColumn("label_num", latency_label(mode)).filter(c("label_num").isNotNull())
    return _case_columns(rows, "response_latency", "response_latency")


TURN_TASKS = ["seller_next_action", "buyer_response_to_counter", "response_latency"]
THREAD_TASKS = ["agreement", "final_price_ratio"]


def build_cases(features: DataFrame, tasks: list[str] | None = None) -> DataFrame:
    """Cases of the tasks (default: all) with outcome state; a label is NULL unless the state is ``supervised``.

    Turn-level tasks come from one explode over the turns, thread-level tasks from one over the openings.
    """
    tasks = tasks or TURN_TASKS + THREAD_TASKS
    none_s, none_n = F.lit(None).cast("string"), F.lit(None).cast("double")

    def task(name: str, suffix: str, asked: Column, label_str: Column, label_num: Column) -> Column:
        return F.when(
            asked if name in tasks else F.lit(False),
            F.struct(F.lit(name).alias("task"), F.lit(suffix).alias("suffix"), label_str.alias("label_str"), label_num.alias("label_num")),
        )

    buyer = (c("actor") == "buyer") & c("action").isin("offer", "counter")
    seller = (c("actor") == "seller") & (c("action") == "counter")
    by_turn = F.array_compact(
        F.array(
            task("seller_next_action", "seller_next_action", buyer, status_label("seller"), none_n),
            task("buyer_response_to_counter", "buyer_response", seller, status_label("buyer"), none_n),
            task("response_latency", "response_latency", F.lit(True), none_s, latency_label()),
        )
    )
    by_thread = F.array_compact(
        F.array(
            task("agreement", "agreement", F.lit(True), c("agreement"), none_n),
            task("final_price_ratio", "final_price_ratio", F.lit(True), none_s, final_price_label()),
        )
    )
    rows = None
    if set(tasks) & set(TURN_TASKS):
        rows = features.select(
            "*", F.explode(by_turn).alias("_t"), F.coalesce(c("status_id") == CENSORED, F.lit(False)).alias("_censored")
        ).withColumn("row_id", F.concat_ws(":", "thread_id", "turn_index", "_t.suffix"))
    if set(tasks) & set(THREAD_TASKS):
        openings = opening_cases(features).select(
            *features.columns, F.explode(by_thread).alias("_t"), F.coalesce("any_censored", F.lit(False)).alias("_censored")
        ).withColumn("row_id", F.concat_ws(":", "thread_id", "_t.suffix"))
        rows = openings if rows is None else rows.unionByName(openings)
    known = c("_t.label_str").isNotNull() | c("_t.label_num").isNotNull()
    state = F.when(known, "supervised").when(c("_censored"), "censored").otherwise("unknown")
    return rows.select(
        "row_id", c("_t.task").alias("task"), c("_t.label_str").alias("label_str"), c("_t.label_num").alias("label_num"),
        state.alias("outcome_state"), "thread_id", "listing_id", "seller_id", "buyer_id", c("event_time").alias("timestamp"),
        "category", "condition", "listing_price", c("actor").alias("current_actor"), c("action").alias("current_action"),
        c("amount").alias("current_amount"), c("offer_ratio").alias("offer_to_asking_ratio"), c("turn_index").alias("round_number"),
        c("prior_turns").alias("prior_turn_count"), c("prior_counters").alias("prior_counter_count"),
        (F.hour("event_time") + F.minute("event_time") / 60.0).alias("event_hour"), "history_digest",
    )


def task_manifest(cases: DataFrame, turns: DataFrame, listings: DataFrame) -> DataFrame:
    """Eligible, supervised, unknown, censored rows per task, and threads lost for want of a listing."""
    state = c("outcome_state")
    lost = (
        turns.join(listings.select("listing_id"), "listing_id", "left_anti").select("thread_id").distinct()
        .agg(F.count("*")).scalar()
    )
    return cases.groupBy("task").agg(
        F.count("*").alias("eligible"),
        F.count_if(state == "supervised").alias("supervised"),
        F.count_if(state == "unknown").alias("unknown"),
        F.count_if(state == "censored").alias("censored"),
    ).withColumn("excluded", lost)


LABELS = ["label_str", "label_num"]


def publish_cases(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases without labels for everyone, and labels of supervised rows under lock."""
    public = cases.drop(*LABELS)
    return public, cases.filter(c("outcome_state") == "supervised").select("row_id", "task", *LABELS)


def read_supervised(public: DataFrame, labels: DataFrame) -> DataFrame:
    return public.join(labels, ["task", "row_id"])


def contract_faults(columns: list[str]) -> list[str]:
    """Feature names that are forbidden or not declared; metadata only."""
    return sorted(x for x in columns if x in FORBIDDEN or x not in FEATURES)


def leakage_audit(cases: DataFrame, features: str = "features", history: str | None = None) -> DataFrame:
    """Per task: rows whose feature map or history tells the future."""
    keys = F.map_keys(features)
    forbidden = F.array(*[F.lit(x) for x in FORBIDDEN])
    undeclared = F.size(F.array_except(keys, F.array(*[F.lit(x) for x in FEATURES]))) > 0
    told = F.lit(False)
    if history is not None:
        told = F.exists(
            history,
            lambda h: F.arrays_overlap(F.map_keys(h), forbidden)
            | F.exists(F.map_keys(h), lambda k: k.contains("future_"))
            | F.coalesce(F.lower(F.try_element_at(h, F.lit("status"))).isin(RESOLVED), F.lit(False)),
        )
    return cases.groupBy("task").agg(
        F.count("*").alias("rows"),
        F.count_if(F.arrays_overlap(keys, forbidden)).alias("forbidden"),
        F.count_if(undeclared).alias("undeclared"),
        F.count_if(told).alias("history_leaks"),
        F.bool_and(~F.arrays_overlap(keys, forbidden) & ~undeclared & ~told).alias("passed"),
    )


#: Columns of a case that its tokens are made of.
TOKEN_FIELDS = (
    "task row_id thread_id listing_id timestamp category condition listing_price current_actor current_action current_amount round_number "
    "prior_counter_count history_digest"
).split()


def case_tokens(cases: DataFrame) -> DataFrame:
    """Three content hashes per case: all of it, its content alone, its source ids alone."""

    def text(*names: str) -> list[Column]:
        return [F.coalesce(c(x).cast("string"), F.lit("")) for x in names]

    content = [
        *text("task"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"), *text("category", "condition"),
        F.floor(c("listing_price") * 1000).cast("string"), *text("current_actor", "current_action"),
        F.floor(c("current_amount") * 1000).cast("string"), *text("round_number", "prior_counter_count", "history_digest"),
    ]
    source = text("task", "row_id", "thread_id", "listing_id")

    def digest(parts: list[Column]) -> Column:
        return F.sha2(F.concat_ws("\u0001", *parts), 256)

    return cases.withColumns(
        {"case_token": digest(source + content), "content_token": digest(content), "source_token": digest(source)}
    )


def sequence_violations(features: DataFrame) -> DataFrame:
    """Per listing: a countered turn without the counter that must follow; an accepted turn that is not the last."""
    due = F.when(c("actor") == "buyer", "seller").otherwise("buyer")
    follows = F.coalesce((c("next_actor") == due) & (c("next_action") == "counter"), F.lit(False))
    return features.groupBy("listing_id").agg(
        F.bool_or((c("status_id") == COUNTERED) & ~follows).alias("missing_counter"),
        F.bool_or(c("status_id").isin(ACCEPTED) & c("next_actor").isNotNull()).alias("accepted_not_last"),
    )


def supervised_rows(episodes: DataFrame, target: str, through: Column | None = None) -> DataFrame:
    """Episodes with a known target as rows of features (plus bias) and 0/1 target, known by a cut-off time."""
    rows = episodes.filter(F.map_contains_key("outcomes", target))
    if through is not None:
        rows = rows.filter((c("decision_time") <= through) & (c("observation_cutoff") <= through))
    reserved = F.array(*[F.lit(x) for x in [*POST_DECISION, target]])
    return rows.select(
        c("episode_id").alias("case_id"), "decision_time", "observation_cutoff",
        F.map_concat("context", F.create_map(F.lit("bias"), F.lit(1.0))).alias("features"),
        F.when(F.try_element_at("outcomes", F.lit(target)), 1).otherwise(0).alias("target"),
        (F.arrays_overlap(F.transform(F.map_keys("context"), F.lower), reserved) | (c("observation_cutoff") > c("decision_time"))).alias("leaks"),
    )


def trial_rows(trials: DataFrame, assignments: DataFrame, target: str) -> DataFrame:
    """Trial outcomes dated by their assignment: late outcomes cannot pass for late decisions."""
    a = assignments.select("assignment_id", "assigned_at", c("written_at").alias("_assigned_written"))
    return (
        trials.filter(F.map_contains_key("outcomes", target))
        .join(a, "assignment_id", "left")
        .select(
            c("trial_id").alias("case_id"),
            F.coalesce("assigned_at", "recorded_at", "written_at").alias("decision_time"),
            F.coalesce("_assigned_written", "written_at").alias("eligibility_recorded_at"),
            c("written_at").alias("recorded_at"),
            "context",
            F.when(F.try_element_at("outcomes", F.lit(target)), 1).otherwise(0).alias("target"),
        )
    )


def feature_catalog(rows: DataFrame, features: str = "features") -> DataFrame:
    """Names of numeric features that occur, with how often."""
    return (
        rows.select(F.explode(features).alias("name", "value")).filter((c("name") != "bias") & c("value").isNotNull())
        .groupBy("name").agg(F.count("*").alias("rows"))
    )


# The price pattern and the words of each act, in order of precedence.
PRICE = r"(?i)(?:\$|usd\s*)?(\d+(?:\.\d{1,2})?)"
ACCEPT_WORDS = ["accept", "deal", "sounds good", "you got it"]
REJECT_WORDS = ["no thanks", "reject", "can't do", "too low"]
QUIT_WORDS = ["bye", "nevermind", "walk away", "not interested"]
COUNTER_WORDS = ["counter", "meet", "instead", "how about", "could do"]
CONDITION_WORDS = {
    "delivery_or_shipping": ["deliver", "delivery", "ship", "shipping"],
    "pickup_or_meetup": ["pickup", "pick up", "meet"],
    "payment_method": ["cash", "paypal", "venmo"],
}
CONCESSION_WORDS = ["lower", "come down", "meet you", "split", "best i can", "final offer"]


def _any_word(low: Column, words: list[str]) -> Column:
    out = low.contains(words[0])
    for w in words[1:]:
        out = out | low.contains(w)
    return out


def utterance_facts(df: DataFrame, text: str) -> DataFrame:
    """Last price named, dialogue act, side conditions and concession flag of whole texts."""
    low = F.lower(text)
    prices = F.regexp_extract_all(c(text), F.lit(PRICE), 1)
    priced = c("price").isNotNull()
    act = (
        F.when(_any_word(low, ACCEPT_WORDS), "accept")
        .when(_any_word(low, REJECT_WORDS), "reject")
        .when(_any_word(low, QUIT_WORDS), "quit")
        .when(priced & _any_word(low, COUNTER_WORDS), "counter")
        .when(priced, "propose")
        .otherwise("other")
    )
    conditions = F.array_compact(F.array(*[F.when(_any_word(low, w), F.lit(n)) for n, w in CONDITION_WORDS.items()]))
    return (
        df.withColumn("numbers", F.size(prices))
        .withColumn("price", F.try_element_at(prices, F.lit(-1)).try_cast("double"))
        .withColumns({"act": act, "conditions": conditions, "concession": _any_word(low, CONCESSION_WORDS)})
    )


def price_sequence(facts: DataFrame, dialogue: str, turn: str) -> DataFrame:
    """Prices of each dialogue in order, one row per price with its place."""
    from parley.operators.sequence import ranked

    return ranked(facts.filter(c("price").isNotNull()).select(dialogue, turn, "price"), [dialogue], [turn], "place")


def extraction_accuracy(facts: DataFrame, want_price: str, want_act: str) -> DataFrame:
    return facts.agg(
        F.count("*").alias("rows"),
        F.avg(c("price").eqNullSafe(c(want_price)).cast("double")).alias("offer_accuracy"),
        F.avg(c("act").eqNullSafe(c(want_act)).cast("double")).alias("act_accuracy"),
        F.count_if(c("numbers") > 1).alias("ambiguous"),
    )
