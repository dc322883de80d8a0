from datetime import datetime, timedelta

from pyspark.sql import functions as F

from parley.streaming import streams as Z

T0 = datetime(2024, 1, 1)


def test_overdue_offers_equal_brute_force(spark, tmp_path):
    offers = [(i, T0 + timedelta(minutes=i)) for i in range(600)]
    answers = [(i, t + timedelta(minutes=(i * 13) % 50)) for i, t in offers if i % 4]
    spark.createDataFrame(offers, "offer_id long, event_time timestamp").coalesce(1).write.parquet(str(tmp_path / "o"))
    spark.createDataFrame(answers, "offer_id long, response_time timestamp").coalesce(1).write.parquet(str(tmp_path / "r"))
    a = Z.file_stream(spark, str(tmp_path / "o"), "*.parquet", spark.read.parquet(str(tmp_path / "o")).schema)
    b = Z.file_stream(spark, str(tmp_path / "r"), "*.parquet", spark.read.parquet(str(tmp_path / "r")).schema)
    got = {r["offer_id"] for r in Z.run_to_folder(Z.stream_overdue(a, b, "20 minutes", "30 minutes")).collect()}
    late = dict(answers)
    want = {i for i, t in offers if i not in late or late[i] > t + timedelta(minutes=20)}
    # only what the watermark has not passed yet may be missing
    cut = max(t for _, t in offers) - timedelta(minutes=30)
    told = {i for i, t in offers if t + timedelta(minutes=20) < cut}
    assert got <= want and want & told <= got and len(got) > 100


def test_no_row_is_lost_over_several_batches(spark, tmp_path):
    """Late rows and copies of earlier batches: every row is accepted, quarantined or a copy."""
    schema = "thread_id string, listing_id string, buyer_id string, seller_id string, offer_type int, status_id int, event_time timestamp, response_time timestamp, n int"
    rows = [(f"t{i}", "l", None if i % 7 == 0 else "b", "s", i % 3, 5 if i % 11 == 0 else i % 3, T0 + timedelta(hours=i), None, i) for i in range(60)]
    batches = [rows[30:50], rows[50:] + rows[35:40], rows[:30] + rows[30:33] + rows[:3]]  # the last comes days late
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    root = str(tmp_path / "out")
    query = Z.start_turns(stream, root, {"availableNow": True})
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    good, bad = (spark.read.parquet(f"{root}/{x}") for x in ("good", "bad"))
    assert sorted(r.n for r in good.select("n").collect() + bad.select("n").collect()) == list(range(60))
    assert {r.n for r in bad.collect()} == {i for i in range(60) if i % 7 == 0 or i % 11 == 0}


def test_a_stream_runs_until_it_is_stopped(spark, tmp_path):
    spark.range(5).withColumn("event_time", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, event_time timestamp").parquet(str(tmp_path / "in"))
    query = Z.start_to_folder(stream, str(tmp_path / "out"), trigger={"processingTime": "1 second"})
    query.processAllAvailable()
    assert query.isActive and spark.read.parquet(str(tmp_path / "out" / "out")).count() == 5
    query.stop()


def _batches(spark, folder, kind, schema, batches):
    """One file for each micro-batch, told apart by age."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{kind}/b{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{kind}/*")


def test_reminders_over_micro_batches(spark, tmp_path):
    """Answers before their offers, at the deadline, after it, late ones, repeated facts: as a plain loop says."""
    at = lambda m: T0 + timedelta(minutes=m)
    offers = [[(i, at(i)) for i in range(0, 200)], [(i, at(i)) for i in range(200, 400)] + [(199, at(200))], [(i, at(i)) for i in range(400, 600)] + [(None, at(599)), (7_000, None)]]
    # by offer: never, before its deadline, at it, after the first and before the second, after both
    wait = [None, 5, 20, 35, 70]
    given = [(i, at(i + wait[i % 5])) for i in range(600) if wait[i % 5] is not None]
    # the answer of 202 comes before its offer, those of 190 to 199 a batch after theirs
    answers = [[r for r in given if r[0] < 190 or r[0] == 202], [r for r in given if 190 <= r[0] < 400 and r[0] != 202], [r for r in given if r[0] >= 400] * 2]
    o = _batches(spark, tmp_path, "o", "offer_id long, event_time timestamp", offers)
    a = _batches(spark, tmp_path, "a", "offer_id long, response_time timestamp", answers)
    with Z.rocks_state(spark):
        query = Z.start_to_folder(Z.stream_reminders(o, a, [3000, 1200], "5 hours"), str(tmp_path / "x"))
        query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    got = [(r.offer_id, r.step) for r in spark.read.parquet(str(tmp_path / "x" / "out")).collect()]
    mark = max(t for _, t in given) - timedelta(hours=5)
    told = {i: t for i, t in given}
    want = []
    for i in range(600):
        for step, minutes in ((1, 20), (2, 50)):
            due = at(i + minutes)
            if due <= mark and (i not in told or told[i] > due):
                want.append((i, step))
    assert sorted(got) == want and len(want) > 150


def test_reminders_go_on_after_a_restart(spark, tmp_path):
    """Offers of the first run are told by the second one, which knows their answers from its state."""
    o_schema, a_schema = "offer_id long, event_time timestamp", "offer_id long, response_time timestamp"
    folder = str(tmp_path)

    def run():
        o = spark.readStream.schema(o_schema).parquet(f"{folder}/o/*")
        a = spark.readStream.schema(a_schema).parquet(f"{folder}/a/*")
        with Z.rocks_state(spark):
            Z.start_to_folder(Z.stream_reminders(o, a, [600], "1 minute"), f"{folder}/x").awaitTermination()
        return sorted(r.offer_id for r in spark.read.schema("offer_id long").parquet(f"{folder}/x/out").collect())

    _batches(spark, tmp_path, "o", o_schema, [[(1, T0), (2, T0), (3, T0 + timedelta(minutes=5))]])
    _batches(spark, tmp_path, "a", a_schema, [[(1, T0 + timedelta(minutes=3))]])
    assert run() == []
    spark.createDataFrame([(9, T0 + timedelta(hours=2))], o_schema).write.parquet(f"{folder}/o/next")
    spark.createDataFrame([(3, T0 + timedelta(minutes=9))], a_schema).write.parquet(f"{folder}/a/next")
    assert run() == [2]


def test_runs_hold_every_batch_once():
    for fan in (2, 3, 8):
        for n in range(200):
            runs = Z.runs_of(n, fan)
            assert [b for level, first in runs for b in range(first, first + fan**level)] == list(range(n))
            assert all(sum(x == level for x, _ in runs) < fan for level, _ in runs)


def test_hashes_are_merged_and_none_is_forgotten(spark, tmp_path):
    """Nine batches of two days, each with rows of all earlier ones; every third batch is tried twice."""
    seen, schema = Z.SeenRows(spark, str(tmp_path / "seen"), 3), "copy_ string, day_ date"
    days = [T0.date(), (T0 + timedelta(days=1)).date()]
    for batch in range(9):
        seen.tidy(batch)
        rows = spark.createDataFrame([(f"r{i}", days[i % 2]) for i in range((batch + 1) * 4)], schema)
        for _ in range(2 if batch % 3 == 2 else 1):
            fresh = seen.unseen(rows, "copy_", "day_", batch)
            assert sorted(r.copy_ for r in fresh.collect()) == sorted(f"r{i}" for i in range(batch * 4, batch * 4 + 4))
            seen.add(fresh, "copy_", "day_", batch)
    seen.tidy(9)
    assert [p.name for p in (tmp_path / "seen").iterdir()] == ["run=level2-0"]
    assert seen.unseen(rows, "copy_", "day_", 9).count() == 0


def test_an_empty_batch_leaves_an_empty_run(spark, tmp_path):
    seen = Z.SeenRows(spark, str(tmp_path / "seen"), 2)
    none = spark.createDataFrame([], "copy_ string, day_ date")
    some = spark.createDataFrame([("a", T0.date())], none.schema)
    for batch, rows in enumerate([none, none, some, none]):
        seen.add(seen.unseen(rows, "copy_", "day_", batch), "copy_", "day_", batch)
    assert seen.unseen(some, "copy_", "day_", 4).count() == 0


def test_reminders_of_many_offers_share_a_bucket(spark, tmp_path):
    """Three buckets hold 900 offers with ids of text: timers of a bucket tell each deadline once, over three batches and one state a bucket."""
    offers = [(f"o{i}", T0 + timedelta(minutes=i)) for i in range(900)]
    answers = [(k, t + timedelta(minutes=5 + 30 * (i % 3))) for i, (k, t) in enumerate(offers) if i % 4]
    o = _batches(spark, tmp_path, "o", "offer_id string, event_time timestamp", [offers[i : i + 300] for i in (0, 300, 600)])
    a = _batches(spark, tmp_path, "a", "offer_id string, response_time timestamp", [answers[i : i + 225] for i in (0, 225, 450)])
    with Z.rocks_state(spark):
        query = Z.start_to_folder(Z.stream_reminders(o, a, [1200, 2400], "2 hours", buckets=3), str(tmp_path / "x"))
        query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < 30
    got = sorted((r.offer_id, r.step) for r in spark.read.parquet(str(tmp_path / "x" / "out")).collect())
    mark, told = max(t for _, t in answers) - timedelta(hours=2), dict(answers)
    due = [(k, step, t + timedelta(minutes=20 * step)) for k, t in offers for step in (1, 2)]
    assert got == sorted((k, step) for k, step, at in due if at <= mark and (k not in told or told[k] > at)) and len(got) > 500
