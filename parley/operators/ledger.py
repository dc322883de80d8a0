"""Tables of decisions, events, sources and budgets: latest state, integrity, totals, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.scalars import REDACTED_TEXT, clip, money, reasons, secret_like
from parley.functions.terms import score
from parley.operators.models import one_row
from parley.operators.sequence import Sequence, lag, rank, running_max, running_sum

c = F.col
MONEY = "decimal(18,2)"

# Fields that a later entry of a decision may not change, and states that end it.
IMMUTABLE = ["decision_timestamp", "selected_action", "conservative_net"]
RESOLVED_STATES = ["resolved_paper", "resolved_real"]
MATERIAL_COSTS = ["fees", "slippage", "shipping", "holding_costs", "return_refund_allowance", "research_api_cost"]
NO_ACTIONS = ["abstain", "no_trade", "cash"]


def latest_entries(df: DataFrame, decision: str, seq: str) -> DataFrame:
    """Last entry of every decision: an aggregate, not a window."""
    columns = [x for x in df.columns if x != decision]
    return df.groupBy(decision).agg(F.max_by(F.struct(*columns), seq).alias("_e")).select(decision, "_e.*")


def supersession_check(df: DataFrame, decision: str, seq: str) -> DataFrame:
    """Entries with what breaks their chain: wrong predecessor, mixed designations, rewritten fields, silent corrections."""
    kept = ["record_hash", "designation", "contract_hash", "evidence_state", *IMMUTABLE]
    rows = Sequence(df, [decision], [seq]).add(_p=lag(F.struct(*kept))).frame
    first = c("_p").isNull()

    def changed(x: str) -> Column:
        return ~first & ~c(x).eqNullSafe(c(f"_p.{x}"))

    silent = c("correction_reason").isNull()
    faults = reasons(
        first_entry_supersedes=first & c("supersedes").isNotNull(),
        wrong_predecessor=~first & ~c("supersedes").eqNullSafe(c("_p.record_hash")),
        designation_mixed=changed("designation"),
        contract_changed=changed("contract_hash"),
        immutable_field_rewritten=reduce(lambda a, b: a | b, [changed(x) for x in IMMUTABLE]),
        same_state_without_correction=~first & (c("evidence_state") == c("_p.evidence_state")) & silent,
        changed_after_resolution=~first & c("_p.evidence_state").isin(RESOLVED_STATES) & silent,
    )
    return rows.withColumn("faults", faults).drop("_p")


def resolution_check(df: DataFrame) -> DataFrame:
    """Resolved rows with faults: costs unknown, missing or negative, or net unequal to gross less costs."""
    costs = c("realized_costs")
    known = F.array(*[F.lit(x) for x in MATERIAL_COSTS])
    values = F.map_values(costs)
    total = F.aggregate(values, F.lit(0).cast("decimal(28,2)"), lambda acc, x: (acc + F.coalesce(money(x), F.lit(0).cast(MONEY))).cast("decimal(28,2)"))
    off = (money(c("realized_gross")) - total).cast(MONEY) != money(c("realized_net"))
    return df.withColumn(
        "faults",
        reasons(
            costs_empty=F.coalesce(F.size(costs), F.lit(0)) <= 0,
            cost_field_missing=F.size(F.array_except(known, F.map_keys(costs))) > 0,
            cost_unknown=F.exists(values, lambda x: x.isNull()),
            cost_negative=F.exists(values, lambda x: F.coalesce(x < 0, F.lit(False))),
            net_does_not_add_up=off,
        ),
    )


def unique_events(entries: DataFrame, seq: str) -> DataFrame:
    """Last entry per decision, then the last decision per economic event."""
    last = latest_entries(entries, "decision_id", seq).withColumn("_event", F.coalesce("economic_event_key", c("decision_id").cast("string")))
    columns = [x for x in last.columns if x != "_event"]
    best = last.groupBy("_event").agg(F.max_by(F.struct(*columns), F.struct("decision_timestamp", "decision_id")).alias("_e"), F.count("*").alias("decisions"))
    return best.select("_event", "decisions", "_e.*")


def entry_value() -> Column:
    """Realised value if there is one, else the conservative expectation, else zero."""
    return F.coalesce(money(c("realized_net")), money(c("conservative_net")), F.lit(0).cast(MONEY))


def money_summary(events: DataFrame) -> DataFrame:
    """One row of counts and exposure over unique events."""
    loss = F.coalesce(money(c("maximum_possible_loss")), F.lit(0).cast(MONEY))
    return events.agg(
        F.count("*").alias("opportunities"), F.sum("decisions").alias("decisions"), F.sum(c("decisions") - 1).alias("duplicates"),
        F.count_if(c("selected_action") == c("no_action")).alias("no_action"), F.sum(F.coalesce(money(c("capital_required")), F.lit(0).cast(MONEY))).cast("double").alias("capital_at_risk"),
        F.sum(loss).cast("double").alias("maximum_loss"), F.max(loss).cast("double").alias("largest_loss"), F.sum(entry_value()).cast("double").alias("total_value"),
        (F.min("designation") != F.max("designation")).alias("mixed_designations"),
    )


def value_by(events: DataFrame, dimensions: list[str], value: Column) -> DataFrame:
    """Counts and value by every dimension from one scan."""
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("dimension"), F.coalesce(c(x).cast("string"), F.lit("unknown")).alias("key")) for x in dimensions]))
    return events.select(value.alias("_v"), cells.alias("s")).groupBy("s.dimension", "s.key").agg(
        F.count("*").alias("n"), F.sum("_v").cast("double").alias("value")
    )


def max_drawdown(df: DataFrame, order: list[str], value: Column, keys: list[str] | None = None) -> DataFrame:
    """Largest fall of the cumulative value below its earlier peak, with the places of both; the first of equals."""
    keys = keys or []
    seq = Sequence(df.withColumn("_v", value), keys, order).add(_pos=rank(), _cum=running_sum(c("_v")))
    place = c("_pos") - 1
    seq = seq.add(_peak=running_max(F.struct(c("_cum").alias("v"), (-place).alias("i"))))
    fall = c("_peak.v") - c("_cum")
    worst = F.min(F.struct((-fall).alias("f"), place.alias("t"), (-c("_peak.i")).alias("p")))
    out = seq.frame.groupBy(*keys).agg(worst.alias("w"))
    falls = c("w.f") < 0
    return out.select(
        *keys, (-c("w.f")).cast("double").alias("maximum_drawdown"), F.when(falls, c("w.p")).otherwise(0).alias("peak_index"),
        F.when(falls, c("w.t")).otherwise(0).alias("trough_index"),
    )


def verify_chain(df: DataFrame, chain: str, seq: str, body: Column, genesis: str) -> DataFrame:
    """Records whose hash does not match their body, whose predecessor is not the record before, or whose number is taken."""
    cell = F.struct(c(seq).alias("seq"), c("record_hash").alias("hash"))
    rows = Sequence(df, [chain], [seq, "record_hash"]).add(_before=lag(cell)).frame
    want = F.when(c(seq) == 1, F.lit(genesis)).when(c("_before.seq") == c(seq) - 1, c("_before.hash"))
    again = F.coalesce(c("_before.seq") == c(seq), F.lit(False))
    faults = reasons(hash_mismatch=F.sha2(body, 256) != c("record_hash"), repeated_seq=again, broken_link=~again & ~c("previous_hash").eqNullSafe(want))
    return rows.withColumn("faults", faults).drop("_before").filter(F.size("faults") > 0)


def period_report(events: DataFrame) -> DataFrame:
    """Realised and prospective value by contract, strategy and source, kept apart.

    events: kind (decision, resolved, failed), contract_id, strategy_id, source_id, realized_net, conservative_net, capital_required.
    """
    source = F.when(secret_like(c("source_id")), REDACTED_TEXT).otherwise(F.coalesce("source_id", F.lit("unknown")))
    cells = F.array(
        *[F.struct(F.lit(n).alias("dimension"), x.cast("string").alias("key")) for n, x in (("contract", c("contract_id")), ("strategy", c("strategy_id")), ("source", source))],
        F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("key")),
    )
    zero = F.lit(0).cast(MONEY)
    decided, resolved = c("kind") == "decision", c("kind") == "resolved"
    rows = events.select("*", F.explode(cells).alias("s"))
    idle = decided & c("selected_action").isin(NO_ACTIONS)
    return rows.groupBy("s.dimension", "s.key").agg(
        F.coalesce(F.sum(F.when(resolved, money(c("realized_net")))), zero).cast("double").alias("realized_value"),
        F.coalesce(F.sum(F.when(decided, money(c("conservative_net")))), zero).cast("double").alias("prospective_value"),
        F.coalesce(F.sum(F.when(decided, money(c("capital_required")))), zero).cast("double").alias("capital"),
        F.count_if(decided).alias("decisions"), F.round(F.coalesce(F.try_divide(F.count_if(idle), F.count_if(decided)), F.lit(0.0)), 6).alias("no_action_rate"),
        F.count_if(c("kind") == "failed").alias("incidents"),
    )


def longest_streak(df: DataFrame, keys: list[str], day: Column, step: str = "day") -> DataFrame:
    """Longest run of consecutive days or ISO weeks per key, and the number of distinct periods."""
    days = 1 if step == "day" else 7
    period = F.to_date(day) if step == "day" else F.date_trunc("week", day).cast("date")
    distinct = df.select(*keys, period.alias("_d")).distinct()
    placed = Sequence(distinct, keys, ["_d"]).add(_i=rank()).frame
    island = F.date_sub("_d", (c("_i") * days).cast("int"))
    runs = placed.groupBy(*keys, island.alias("_g")).agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest"), F.sum("n").alias("periods"))


def duration_gate(df: DataFrame, keys: list[str], day: Column, start: Column, min_days: int, min_periods: int, step: str = "day") -> DataFrame:
    """Whether each key has been observed long enough and without interruption."""
    streak = longest_streak(df, keys, day, step)
    elapsed = df.groupBy(*keys).agg(F.greatest(F.lit(0), F.datediff(F.max(F.to_date(day)), F.to_date(start)) + 1).alias("elapsed_days"))
    progress = F.least(F.lit(1.0), c("elapsed_days") / max(min_days, 1), c("longest") / max(min_periods, 1))
    return streak.join(elapsed, keys).withColumns(
        {"passed": (c("elapsed_days") >= min_days) & (c("longest") >= min_periods), "progress": F.round(progress, 6)}
    )


def usage_vs_budget(events: DataFrame, limits: DataFrame, as_of: Column) -> DataFrame:
    """Uses per kind in the last 7 days and on the day itself, against limits (kind, weekly_limit, daily_limit)."""
    at = c("event_time")
    week = (at >= as_of - F.expr("INTERVAL 7 DAYS")) & (at <= as_of)
    today = F.to_date(at) == F.to_date(as_of)
    used = events.filter(week | today).groupBy("kind").agg(F.count_if(week).alias("week"), F.count_if(today).alias("day"))
    out = limits.join(used, "kind", "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("week", "day")})
    return out.withColumns(
        {"week_left": F.greatest(F.lit(0), c("weekly_limit") - c("week")), "day_left": F.greatest(F.lit(0), c("daily_limit") - c("day"))}
    )


def unrepeated_failures(df: DataFrame, keys: list[str]) -> DataFrame:
    """Failures that were seen exactly once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(c("n") == 1).drop("n")


def classify_sources() -> Column:
    """Worth of a source from its metrics."""

    def v(x: str) -> Column:
        return F.coalesce(c(x).cast("double"), F.lit(0.0))

    economic, predictive, usage, reliable = v("economic_lift"), v("predictive_lift"), v("usage"), v("reliability")
    return (
        F.when((reliable < 0.5) | (v("incidents") >= 3), "broken")
        .when((v("redundancy") >= 0.9) & (economic <= 0), "redundant")
        .when((usage <= 0) & (predictive <= 0) & (economic <= 0), "low_value")
        .when((usage >= 3) & (reliable >= 0.95) & (economic > 0), "core")
        .when((reliable >= 0.8) & ((predictive > 0) | (economic > 0)), "useful")
        .otherwise("experimental")
    )


COMMERCIAL = ["commercial_training", "production_inference", "production_export"]


def permission() -> Column:
    """Why a source may not serve a use; NULL if it may. Columns of the registry plus ``use`` and ``has_evidence``."""
    allowed = F.coalesce(F.try_element_at("allowed_uses", c("use")), F.lit(False))
    trade = c("use").isin(COMMERCIAL)
    return (
        F.when(c("license_status").isNull() & c("allowed_uses").isNull(), "unknown_source")
        .when(~allowed, "use_not_allowed")
        .when(trade & (c("license_status") != "confirmed"), "license_not_confirmed")
        .when(trade & c("requires_evidence") & ~F.coalesce(c("has_evidence"), F.lit(False)), "evidence_missing")
    )


def lineage_permissions(lineage: DataFrame, registry: DataFrame, use: str) -> DataFrame:
    """Per artifact: allowed only if every source of its lineage is; lineage: artifact_id, source_id, has_evidence."""
    rows = lineage.join(registry, "source_id", "left").withColumn("use", F.lit(use)).withColumn("_why", permission())
    return rows.groupBy("artifact_id").agg(
        F.bool_and(c("_why").isNull()).alias("allowed"), F.count("*").alias("sources"), F.array_sort(F.collect_set("_why")).alias("refusals")
    )


def capture_status(captures: DataFrame, as_of: Column) -> DataFrame:
    """Captures by status with pending and overdue follow-ups; followups: array of status and due_at."""
    pending = F.filter("followups", lambda f: f["status"] == "pending")
    overdue = F.filter(pending, lambda f: f["due_at"] < as_of)
    return captures.groupBy("episode_status").agg(
        F.count("*").alias("captures"), F.sum(F.size(pending)).alias("pending"),
        F.sum(F.when(c("episode_status") == "active", F.size(overdue)).otherwise(0)).alias("overdue"), F.count_if(c("missed")).alias("missed"),
    )


def ranking_value(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Value that ranks a group: realised where resolved, else expected; both totals stay apart."""
    realized = F.sum(money(c("realized_net")))
    expected = F.sum(F.when(c("realized_net").isNull(), F.coalesce(money(c("conservative_net")), F.lit(0).cast(MONEY))))
    zero = F.lit(0).cast(MONEY)
    return entries.groupBy(*keys).agg(
        (F.coalesce(realized, zero) + F.coalesce(expected, zero)).cast("double").alias("ranking_value"), F.coalesce(realized, zero).cast("double").alias("realized_value"),
        F.coalesce(expected, zero).cast("double").alias("expected_value"),
    )


def formula_scores(train: DataFrame, rows: DataFrame, terms: list[Column], target: str, label: str = "label") -> DataFrame:
    """Probability from the distance of a formula's score to the middle of the two training class means."""
    hit = c(label) == target
    s = score(terms)
    fit = one_row(
        train.agg(
            ((F.coalesce(F.avg(F.when(hit, s)), F.lit(0.0)) + F.coalesce(F.avg(F.when(~hit, s)), F.lit(0.0))) / 2).alias("cut"),
            ((F.count_if(hit) + 0.5) / (F.count("*") + 1.0)).alias("base"),
        )
    )
    out = rows.withColumn("_f", fit)
    return out.withColumn("p", clip(c("_f.base") + 0.25 * F.tanh(s - c("_f.cut")), 1e-6, 1 - 1e-6)).drop("_f")


def diagnose(message: Column) -> Column:
    """Cause of a source failure from its text; the first match counts."""
    low = F.lower(message)

    def has(*words: str) -> Column:
        return reduce(lambda a, b: a | b, [low.contains(w) for w in words])

    return F.when(has("schema", "field"), "schema_drift").when(has("404", "gone"), "dead_source").when(has("rate", "429"), "rate_limited").otherwise("source_degraded")


def source_gaps(proposals: DataFrame, catalog: DataFrame) -> DataFrame:
    """Families that proposals need and no usable source offers, with how many need them."""
    wanted = proposals.select(F.explode("families").alias("family")).filter(F.trim("family") != "").groupBy("family").agg(F.count("*").alias("needed"))
    usable = catalog.filter(~c("status").isin("broken", "rejected") & c("source_id").isNotNull())
    return wanted.join(usable.select("family").distinct(), "family", "left_anti")


def catalog_families(catalog: DataFrame, seq: str) -> DataFrame:
    """The source that serves each family: the last usable one of the catalog."""
    usable = catalog.filter(~c("status").isin("broken", "rejected") & c("source_id").isNotNull())
    return usable.groupBy("family").agg(F.max_by("source_id", seq).alias("source_id"))


def overdue_cycles(snapshots: DataFrame, cadence: DataFrame, as_of: Column) -> DataFrame:
    """Last observation per lab and whether its next cycle is due; cadence: lab, cadence_days."""
    last = snapshots.groupBy("lab").agg(F.max("observed_at").alias("last_observed"))
    return cadence.join(last, "lab", "left").withColumn(
        "due", F.coalesce(F.datediff(F.to_date(as_of), F.to_date("last_observed")) >= c("cadence_days"), F.lit(True))
    )


def latest_fits(fits: DataFrame, seq: str) -> DataFrame:
    return fits.groupBy("campaign_id", "model_id").agg(F.max_by("fit_id", seq).alias("fit_id"), F.count("*").alias("fits"))


def lineage_edges(hypotheses: DataFrame) -> DataFrame:
    return hypotheses.select(F.explode("parent_ids").alias("parent"), c("hypothesis_id").alias("child"))


def budget_usage(events: DataFrame, limits: DataFrame, reserved: str, completed: str) -> DataFrame:
    """Uses of each campaign and split: reservations, or completions where none was reserved, against their limit."""
    n = events.groupBy("campaign_id", "split").agg(F.count_if(c("event_type") == reserved).alias("_r"), F.count_if(c("event_type") == completed).alias("_c"))
    used = n.withColumn("used", F.when(c("_r") > 0, c("_r")).otherwise(c("_c"))).drop("_r", "_c")
    out = used.join(limits, "split")
    return out.withColumns({"remaining": F.greatest(F.lit(0), c("allowed") - c("used")), "exhausted": c("used") >= c("allowed")})
