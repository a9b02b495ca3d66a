"""Batch writes, upserts, versioned tables and run logs."""
import datetime as dt
import random
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clinlytics.functions.core import ratio_1dp_half_even
from clinlytics.operators import dashboard as db
from clinlytics.operators import lists as ls
from clinlytics.operators import upsert as up
from clinlytics.operators import writes as wr
from tests import seed


def test_register_first_valid_wins(spark):
    t = seed.tables(spark)
    req = spark.createDataFrame([
        (1, dt.date(2025, 1, 1), "A", "B", dt.date(1990, 1, 1), "robot", "9000000001", None),   # invalid gender
        (2, dt.date(2025, 1, 2), "C", "D", dt.date(1990, 1, 1), "male", "9000000001", None),    # wins
        (3, dt.date(2025, 1, 3), "E", "F", dt.date(1990, 1, 1), "female", "9000000001", None),  # duplicate
        (4, dt.date(2025, 1, 1), "G", "H", dt.date(1990, 1, 1), "male", "9876543210", "B+"),    # exists
        (5, dt.date(2025, 1, 1), "I", "J", dt.date(1990, 1, 1), "male", "+91 98-7654-3299", "Z"),  # bad blood
    ], "request_id long, request_time date, first_name string, last_name string, date_of_birth date, "
       "gender string, phone string, blood_group string")
    out = {r.request_id: r.reason for r in wr.register_patients(req, t["patients"]).collect()}
    assert out == {1: "gender must be male, female or other", 2: None, 3: "duplicate phone in batch",
                   4: "phone already registered", 5: "invalid blood group"}


def test_booking_rules(spark):
    appts = seed.seed_rows()["appointments"] + [(4, 2, 1, 1, seed.AS_OF, "15:00", "cancelled")]
    t = seed.tables(spark, {"appointments": appts})
    req = spark.createDataFrame([
        (10, 1, 1, 1, seed.AS_OF, "09:00"),   # held by a live (completed) appointment
        (15, 1, 1, 1, seed.AS_OF, "15:00"),   # shown free (cancelled) but unique over all statuses
        (11, 1, 1, 1, seed.AS_OF, "12:00"),   # ok
        (12, 2, 1, 1, seed.AS_OF, "12:00"),   # same slot later in batch
        (13, 1, 1, 2, seed.AS_OF, "13:00"),   # doctor not in department
        (14, 1, 1, 1, seed.AS_OF - dt.timedelta(days=1), "14:00"),  # past
    ], "request_id long, patient_id long, doctor_id long, department_id int, appointment_date date, "
       "appointment_time string")
    out = {r.request_id: r.reason for r in wr.book_appointments(t, req, t["appointments"], seed.AS_OF).collect()}
    assert out == {10: "slot already booked", 15: "slot already booked (unique)", 11: None, 12: "slot already booked in batch",
                   13: "doctor does not belong to department", 14: "date is in the past"}


def _fold(status0, events):
    allowed = {(f, t): r for f, t, r in wr.TRANSITIONS}
    cur, out = status0, []
    for e in sorted(events):
        ok = cur is not None and e[3] in allowed.get((cur, e[2]), ())
        out.append((e[1], ok))
        if ok:
            cur = e[2]
    return out


def test_transitions_equal_sequential_fold(spark):
    rnd = random.Random(3)
    targets = ["in_progress", "completed", "cancelled", "no_show", "scheduled"]
    roles = ["doctor", "front_desk", "admin"]
    appts = [(i, 1, 1, 1, seed.AS_OF, "09:00", s) for i, s in
             enumerate(["scheduled", "in_progress", "completed", "scheduled", "scheduled"] * 4)]
    events = []
    for k in range(400):
        a = rnd.randrange(22)  # ids 20, 21 do not exist
        events.append((dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(10000)), k, rnd.choice(targets),
                       rnd.choice(roles), a))
    adf = spark.createDataFrame(appts, seed.SCHEMAS["appointments"])
    edf = spark.createDataFrame([(e[4], e[1], e[0], e[2], e[3]) for e in events],
                                "appointment_id long, event_id long, ts timestamp, to_status string, role string")
    got = {r.event_id: r.accepted for r in wr.validate_transitions(adf, edf).collect()}
    status0 = {a[0]: a[6] for a in appts}
    for a in range(22):
        for eid, ok in _fold(status0.get(a), [e[:4] for e in events if e[4] == a]):
            assert got[eid] == ok


def test_item_changes_and_totals(spark):
    t = seed.tables(spark)
    ch = spark.createDataFrame([
        (1, "add", 1, None, "CBC", "test", Decimal("50.00")),      # invoice paid -> rejected
        (2, "remove", 1, 0, None, None, None),                     # consultation -> rejected
        (3, "update", 1, 1, "ECG", "test", Decimal("250.00")),     # update checks neither
        (4, "remove", 1, 7, None, None, None),                     # missing item
    ], "request_id long, kind string, billing_record_id long, item_no int, description string, category string, "
       "amount decimal(10,2)")
    out, items = wr.apply_item_changes(t["billing_records"], t["billing_items"], ch)
    reasons = {r.request_id: r.reason for r in out.collect()}
    assert reasons == {1: "cannot add items to a billing record with status 'paid'",
                       2: "cannot remove consultation fee", 3: None, 4: "line item not found"}
    tot = wr.recalculate_totals(t["billing_records"], items).collect()[0]
    assert tot.total_amount == Decimal("750.00") and not tot.unchanged


def test_payments(spark):
    t = seed.tables(spark)
    req = spark.createDataFrame([(1, 1, "upi"), (2, 99, "card")], "request_id long, billing_record_id long, "
                                                                 "payment_method string")
    out = {r.request_id: r for r in wr.apply_payments(t["billing_records"], req).collect()}
    assert out[1].reason == "billing record is already 'paid'" and out[1].payment_method == "cash"
    assert out[2].reason == "billing record not found"


def test_upsert_semantics(spark):
    old = spark.createDataFrame([(1, "a", dt.datetime(2020, 1, 1)), (2, "b", dt.datetime(2020, 1, 1))],
                                "id long, v string, created_at timestamp")
    new = spark.createDataFrame([(2, "B", dt.datetime(2021, 1, 1)), (3, "c", dt.datetime(2021, 1, 1))],
                                "id long, v string, created_at timestamp")
    once = up.upsert(old, new, ["id"], created_col="created_at")
    twice = up.upsert(once, new, ["id"], created_col="created_at")
    a = sorted(tuple(r) for r in once.collect())
    assert a == sorted(tuple(r) for r in twice.collect())          # idempotent
    assert a == [(1, "a", dt.datetime(2020, 1, 1)), (2, "B", dt.datetime(2020, 1, 1)), (3, "c", dt.datetime(2021, 1, 1))]
    with pytest.raises(up.DuplicateKeyError):                      # T7
        up.upsert(old, new.unionByName(new), ["id"])


def test_upsert_rewrites_only_touched_partitions(spark):
    import os
    root = tempfile.mkdtemp(prefix="vt-", dir="/tmp")
    rows = spark.range(400).select(F.col("id"), F.col("id").cast("string").alias("v"))
    assert up.upsert_table(spark, root, rows, ["id"], partitions=16) == 400
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{root}/rows") for f in fs if f.endswith(".parquet")}
    before = files()
    assert up.upsert_table(spark, root, spark.createDataFrame([(7, "new"), (1_000, "more")], "id long, v string"), ["id"], partitions=16) == 2
    after = files()
    assert 14 <= sum(before.get(f) == t for f, t in after.items()) < 16
    got = {r.id: r.v for r in up.read_table(spark, root).collect()}
    assert len(got) == 401 and got[7] == "new" and got[8] == "8" and got[1_000] == "more"
    assert up.upsert_table(spark, root, rows.limit(0), ["id"], partitions=16) == 0 and up.read_table(spark, root).count() == 401


def test_a_torn_overwrite_is_completed(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="torn-", dir="/tmp")
    rows = spark.range(50).select(F.col("id"), F.lit("a").alias("v"))
    up.upsert_table(spark, root, rows, ["id"], partitions=4)
    with monkeypatch.context() as m:
        def dies(staged, root):
            import shutil
            shutil.rmtree(f"{root}/rows/_part=1")  # half of the overwrite: a partition is gone, its rows are staged
            raise RuntimeError("lost")
        m.setattr(up, "_overwrite", dies)
        with pytest.raises(RuntimeError):
            up.upsert_table(spark, root, rows.withColumn("v", F.lit("b")), ["id"], partitions=4)
    assert {tuple(r) for r in up.read_table(spark, root).collect()} == {(i, "b") for i in range(50)}
    # a crash before the stage was complete leaves the table as it was
    spark.createDataFrame([(1, "x", 0)], "id long, v string, _part int").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/stage/0")
    assert {tuple(r) for r in up.read_table(spark, root).collect()} == {(i, "b") for i in range(50)}


def test_pipeline_status_and_totals(spark):
    runs = spark.createDataFrame([
        ("r1", "a", "success", dt.datetime(2024, 1, 1), None, None, 5, None),
        ("r2", "a", "failed", dt.datetime(2024, 1, 2), None, None, 0, "boom"),
        ("r3", "b", "success", dt.datetime(2024, 1, 1), None, None, 7, None)], up.RUN_SCHEMA)
    st = {r.job_name: r.status for r in up.pipeline_status(runs).collect()}
    assert st == {"a": "failed", "b": "success"}
    tot = up.pipeline_totals(up.pipeline_status(runs)).collect()[0]
    assert tot.rows_processed == 7 and tot.jobs == 2 and tot.all_success is False


def test_run_all_logs_and_continues(spark):
    t = seed.tables(spark)
    out = tempfile.mkdtemp(prefix="runs-", dir="/tmp")
    log, failed = up.run_all(spark, t, out, as_of=seed.AS_OF)
    assert failed == []
    st = {r.job_name: r for r in up.pipeline_status(log).collect()}
    assert st["revenue_analytics"].rows_processed == 1 and st["patient_analytics"].rows_processed == 3


def test_a_failed_job_is_logged_and_the_rest_goes_on(spark):
    t = seed.tables(spark)
    out = tempfile.mkdtemp(prefix="runs-", dir="/tmp")

    def fails(t, as_of=None):
        raise ValueError("x" * 5_000)

    registry = dict(up.job_registry(), clinical_summaries=(fails, ["patient_id"]))
    log, failed = up.run_all(spark, t, out, as_of=seed.AS_OF, names=["clinical_summaries", "revenue_analytics"], registry=registry)
    assert failed == ["clinical_summaries"]
    assert sorted((r.job_name, r.status) for r in log.collect()) == [("clinical_summaries", "failed"), ("clinical_summaries", "running"), ("revenue_analytics", "running"), ("revenue_analytics", "success")]
    st = {r.job_name: r for r in up.pipeline_status(log).collect()}
    assert st["clinical_summaries"].status == "failed" and len(st["clinical_summaries"].error_message) == up.ERROR_LIMIT
    assert st["revenue_analytics"].rows_processed == up.read_table(spark, f"{out}/revenue_analytics").count()
    assert up.pipeline_totals(up.pipeline_status(log)).first().all_success is False


def test_half_even_rounding_and_pagination(spark):
    # T3: 1/16 = 6.25 % rounds to 6.2 as Python's round does
    df = spark.createDataFrame([(1, 16), (1, 3)], "n long, d long")
    got = [r.x for r in df.select(ratio_1dp_half_even(F.col("n"), F.col("d")).alias("x")).collect()]
    assert got == [round(1 / 16 * 100, 1), round(1 / 3 * 100, 1)]
    assert ls.page_params("x", 5) == (1, 20) and ls.page_params(0, 500) == (1, 100)
    assert db.working_days(dt.date(2025, 3, 1), dt.date(2025, 3, 10)) == 8  # Sundays 2nd and 9th


def test_date_to_is_midnight(spark):
    # T9: a record at 10:00 on date_to is outside [from, to]
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 31, 10)), (2, dt.datetime(2024, 1, 31, 0))],
                               "id long, created_at timestamp")
    got = [r.id for r in ls._date_range(df, "created_at", "2024-01-01", "2024-01-31").collect()]
    assert got == [2]
