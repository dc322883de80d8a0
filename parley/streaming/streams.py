"""Continuous forms of ingest, classification, action mix and overdue detection.

Streams are started with any trigger and give back the query handle; the forms that return a frame run over what is
there now. Aggregates bound their state by watermarks. Ingest forgets nothing: it keeps the hashes of the rows it has
seen in the shared folder, by day, in runs that are merged as they grow in number; a batch reads the days of its own rows only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from parley.operators.ingest import decode_turns
from parley.operators.splits import classify_new_rows
from parley.session import remove, staging_root

c = F.col


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def start_to_folder(df: DataFrame, root: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Write a stream to ``root``/out with its state beside it; trigger as for DataStreamWriter.trigger."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/state")
    return writer.trigger(**(trigger or {"availableNow": True})).start(f"{root}/out")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which timers and state variables need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _new_root(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/stream-{uuid.uuid4().hex}"


def run_to_folder(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a Parquet folder and read that folder."""
    spark = df.sparkSession
    root = _new_root(spark)
    start_to_folder(df, root, mode).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


SEEN = T.StructType([T.StructField("copy", T.StringType()), T.StructField("day", T.DateType()), T.StructField("run", T.StringType())])
#: Runs of hashes that are merged into one of the next level.
RUNS = 8


def runs_of(batches: int, fan: int) -> list[tuple[int, int]]:
    """Level and first batch of the runs that hold the batches before this one: the digits of that number, so fewer than ``fan`` a level."""
    out, level, first = [], 0, 0
    while fan ** (level + 1) <= batches:
        level += 1
    while level >= 0:
        while first + fan**level <= batches:
            out.append((level, first))
            first += fan**level
        level -= 1
    return out


class SeenRows:
    """Hashes of all rows ever seen, by day, below a folder.

    Every batch adds a run; whenever ``fan`` runs of a level stand beside each other they become one of the next, so a hash is written
    once a level and a batch reads a number of runs that grows with the logarithm of the number of batches. What a batch reads and
    writes follows from its number alone, so a retried batch does not see its own first try and overwrites it.
    """

    def __init__(self, spark: SparkSession, root: str, fan: int = RUNS):
        self.spark, self.root, self.fan = spark, root, fan

    def _path(self, level: int, first: int) -> str:
        return f"{self.root}/run=level{level}-{first}"

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.schema(SEEN).option("basePath", self.root).parquet(*[self._path(*r) for r in runs]).drop("run")

    def unseen(self, rows: DataFrame, copy: str, day: str, batch: int) -> DataFrame:
        """Rows whose hash is in no batch before this one."""
        runs = runs_of(batch, self.fan)
        if not runs:
            return rows
        days = [r[0] for r in rows.select(day).distinct().collect()]
        return rows.join(self._read(runs).filter(c("day").isin(days)), c(copy) == c("copy"), "left_anti")

    def add(self, rows: DataFrame, copy: str, day: str, batch: int) -> None:
        """The hashes of a batch, and the merges that its number asks for."""
        rows.select(c(copy).alias("copy"), c(day).alias("day")).write.mode("overwrite").partitionBy("day").parquet(self._path(0, batch))
        for runs, new in self._merges(batch):
            merged = self._read(runs).repartitionByRange("day", "copy").sortWithinPartitions("day", "copy")
            merged.write.mode("overwrite").partitionBy("day").parquet(self._path(*new))

    def tidy(self, batch: int) -> None:
        """Remove the runs that the batch before this one, which is committed by now, has merged."""
        for runs, _ in self._merges(batch - 1):
            for run in runs:
                remove(self.spark, self._path(*run))

    def _merges(self, batch: int) -> list[tuple[list[tuple[int, int]], tuple[int, int]]]:
        out, level, done = [], 1, batch + 1
        while done > 0 and done % self.fan**level == 0:
            first, part = done - self.fan**level, self.fan ** (level - 1)
            out.append(([(level - 1, first + i * part) for i in range(self.fan)], (level, first)))
            level += 1
        return out


def start_turns(raw: DataFrame, root: str, trigger: dict | None = None) -> StreamingQuery:
    """Decode arriving turns into ``root``/good and ``root``/bad, one folder per micro-batch.

    Copies have the same event time, so a batch is compared with the hashes of its own days (``SeenRows``). However late a row
    comes, it lands in one of the two folders or is a copy; no state store forgets it.
    """
    spark = raw.sparkSession
    names = raw.columns
    seen = SeenRows(spark, f"{root}/seen")

    def write(batch: DataFrame, batch_id: int) -> None:
        body = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
        day = F.coalesce(F.to_date("event_time"), F.lit("0001-01-01").cast("date"))
        marked = batch.withColumns({"_copy": body, "_day": day}).dropDuplicates(["_copy"]).persist()
        seen.tidy(batch_id)
        fresh = seen.unseen(marked, "_copy", "_day", batch_id).persist()
        good, bad = decode_turns(fresh.drop("_copy", "_day"))
        good.write.mode("overwrite").parquet(f"{root}/good/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{root}/bad/batch={batch_id}")
        seen.add(fresh, "_copy", "_day", batch_id)
        fresh.unpersist()
        marked.unpersist()

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_turns(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded turns and quarantined ones of all that is there now."""
    spark = raw.sparkSession
    root = _new_root(spark)
    start_turns(raw, root).awaitTermination()
    return spark.read.parquet(f"{root}/good"), spark.read.parquet(f"{root}/bad")


def stream_prospective(rows: DataFrame, freezes: DataFrame, assigned: DataFrame | None = None) -> DataFrame:
    """Arriving rows that are not yet assigned, against the latest freeze of their campaign, as in the batch form."""
    if assigned is None:
        assigned = rows.sparkSession.createDataFrame([], rows.select("campaign_id", "case_id").schema)
    return classify_new_rows(rows, assigned, freezes)


def stream_action_mix(turns: DataFrame, width: str = "1 hour", late: str = "2 hours", by: list[str] | None = None) -> DataFrame:
    """Turns and mean response seconds per tumbling window and action; windows close once the watermark passes them."""
    seconds = F.unix_micros(c("response_time").cast("timestamp")) - F.unix_micros(c("event_time").cast("timestamp"))
    rows = turns.withColumn("event_time", c("event_time").cast("timestamp")).withColumn("_s", seconds / F.lit(1e6)).withWatermark("event_time", late)
    out = rows.groupBy(F.window("event_time", width), *(by or []), "action").agg(F.count("*").alias("turns"), F.avg("_s").alias("mean_latency"))
    return out.select(c("window.start").alias("start"), c("window.end").alias("end"), *(by or []), "action", "turns", "mean_latency")


def stream_sessions(turns: DataFrame, key: str, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Turns per activity session of a buyer; a session closes when nothing came for the gap."""
    rows = turns.withColumn("event_time", c("event_time").cast("timestamp")).withWatermark("event_time", late)
    out = rows.groupBy(F.session_window("event_time", gap), key).agg(F.count("*").alias("turns"))
    return out.select(key, c("session_window.start").alias("start"), c("session_window.end").alias("end"), "turns")


def stream_overdue(offers: DataFrame, responses: DataFrame, ttl: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Offers without a response inside the deadline, told once the watermark has passed it.

    offers: offer_id, event_time. responses: offer_id, response_time. The join key is the offer itself, so no
    thread or buyer is gathered, and both sides forget what the deadline has passed.
    """
    a = offers.withColumn("event_time", c("event_time").cast("timestamp")).withWatermark("event_time", late)
    b = responses.select(c("offer_id").alias("_offer"), c("response_time").cast("timestamp").alias("response_time")).withWatermark("response_time", late)
    inside = (c("offer_id") == c("_offer")) & (c("response_time") >= c("event_time")) & (c("response_time") <= c("event_time") + F.expr(f"INTERVAL {ttl}"))
    return a.join(b, inside, "left").filter(c("_offer").isNull()).drop("_offer", "response_time")


class Reminders(StatefulProcessor):
    """Offers and answers of a bucket of offers, with one timer at its next deadline. Facts of an offer may come in any order.

    An offer told twice keeps the time it was first told with, and of its answers the first that is not before it counts; both are kept
    until its last deadline. An answer without an offer is kept until the watermark has passed it, as its offer would be late by then.
    A batch reads and writes the state of a bucket once, so its cost is that of the facts, not of calls for each offer.
    """

    def __init__(self, steps: list[int], key_type: T.DataType):
        self.steps, self.key_type = steps, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = {"id": self.key_type, "offered": T.LongType(), "answered": T.LongType(), "told": T.IntegerType(), "early_id": self.key_type, "early": T.LongType()}
        self.state = handle.getValueState("bucket", T.StructType([T.StructField(x, T.ArrayType(t)) for x, t in columns.items()]))

    def _load(self) -> tuple[dict, dict]:
        """By offer: its time, its first answer and how many deadlines were told; answers that have no offer yet."""
        ids, offered, answered, told, early_ids, early = self.state.get() or [[]] * 6
        before: dict = {}
        for offer, at in zip(early_ids, early):
            before.setdefault(offer, set()).add(at)
        return {offer: facts for offer, *facts in zip(ids, offered, answered, told)}, before

    def _keep(self, known: dict, before: dict, watermark: int) -> None:
        """Write the state and see to it that a timer comes at the first moment that changes it, if not earlier."""
        if not known and not before:
            self.state.clear()
            return
        early = [(offer, at) for offer, ats in before.items() for at in ats]
        columns = [list(known), *([facts[i] for facts in known.values()] for i in range(3)), [offer for offer, _ in early], [at for _, at in early]]
        self.state.update(tuple(columns))
        due = min([(offered + self.steps[told]) // 1000 for offered, _, told in known.values()] + [at // 1000 for _, at in early])
        if not any(watermark < t <= due for t in self.handle.listTimers()):
            self.handle.registerTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known, before = self._load()
        first: dict = {}
        for batch in rows:
            for offer, is_offer, at in zip(batch["offer_id"].tolist(), batch["is_offer"].tolist(), batch["micros"].tolist()):
                if not is_offer:
                    before.setdefault(offer, set()).add(at)
                elif offer not in known:
                    first[offer] = min(at, first.get(offer, at))
        for offer, at in first.items():
            known[offer] = [at, None, 0]
        for offer in [x for x in before if x in known]:
            facts = known[offer]
            answers = before.pop(offer) | ({facts[1]} - {None})
            facts[1] = min((a for a in answers if a >= facts[0]), default=None)
        self._keep(known, before, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        known, before = self._load()
        out = []
        for offer, facts in known.items():
            offered, answered, told = facts
            while told < len(self.steps) and (offered + self.steps[told]) // 1000 <= now:
                deadline = offered + self.steps[told]
                told += 1
                if answered is None or answered > deadline:
                    out.append((offer, told, offered, deadline))
            facts[2] = told
        known = {offer: facts for offer, facts in known.items() if facts[2] < len(self.steps)}
        before = {offer: {at for at in ats if at // 1000 > now} for offer, ats in before.items()}
        self._keep(known, {offer: ats for offer, ats in before.items() if ats}, now)
        if out:
            yield pd.DataFrame(out, columns=["offer_id", "step", "event_time", "deadline"])


def stream_reminders(offers: DataFrame, responses: DataFrame, steps: list[int], late: str = "1 hour", buckets: int = 8192) -> DataFrame:
    """Every deadline of an offer that passed without an answer, told once the watermark has passed it.

    offers: offer_id, event_time. responses: offer_id, response_time. steps: seconds from an offer to its deadlines, numbered from
    1. An answer at the very deadline is in time. State is kept by hash buckets of offers, so a hot buyer or thread is spread like any
    other; a bucket holds the offers of the last step and ``late`` only, and their number must stay the same for a checkpoint. One
    watermark runs over both kinds of facts; what comes after it passed is late and not looked at. Facts without an id or time are left
    out. Start inside ``rocks_state``.
    """
    facts = offers.select("offer_id", F.lit(True).alias("is_offer"), c("event_time").cast("timestamp").alias("at")).unionByName(
        responses.select("offer_id", F.lit(False).alias("is_offer"), c("response_time").cast("timestamp").alias("at"))
    )
    rows = facts.filter(c("offer_id").isNotNull() & c("at").isNotNull()).withWatermark("at", late)
    rows = rows.withColumns({"micros": F.unix_micros("at"), "bucket": F.pmod(F.xxhash64("offer_id"), F.lit(buckets)).cast("int")})
    key_type = offers.schema["offer_id"].dataType
    schema = T.StructType([T.StructField("offer_id", key_type), *[T.StructField(x, t) for x, t in (("step", T.IntegerType()), ("event_time", T.LongType()), ("deadline", T.LongType()))]])
    micros = sorted({s * 1_000_000 for s in steps})
    out = rows.groupBy("bucket").transformWithStateInPandas(Reminders(micros, key_type), schema, "append", "eventTime")
    return out.withColumns({x: F.timestamp_micros(x) for x in ("event_time", "deadline")})
