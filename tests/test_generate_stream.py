"""Synthetic generator invariants and the streaming jobs against batch twins."""
import tempfile

from pyspark.sql import functions as F

from clinlytics.operators import jobs
from clinlytics.operators import writes as wr
from clinlytics.sources.generate import generate_clinic
from clinlytics.streaming import jobs as sj


def test_generated_clinic_is_consistent(spark):
    t = generate_clinic(spark, n_patients=300, n_doctors=7)
    assert wr.duplicate_phones(t["patients"]).count() == 0
    assert wr.double_bookings(t["appointments"]).count() == 0
    assert t["visits"].count() == t["appointments"].where("status = 'completed'").count()
    # totals equal the sum of items; generation is deterministic
    tot = wr.recalculate_totals(t["billing_records"], t["billing_items"])
    assert tot.where(~F.col("unchanged")).count() == 0
    again = generate_clinic(spark, n_patients=300, n_doctors=7)
    a = sorted(tuple(r) for r in jobs.daily_revenue(t).collect())
    assert a == sorted(tuple(r) for r in jobs.daily_revenue(again).collect()) and len(a) > 0
    audit = wr.audit_constraints(t).groupBy("rule").count().collect()
    assert audit == []


def test_stream_refresh_equals_batch(spark):
    t = generate_clinic(spark, n_patients=200, n_doctors=5)
    root = tempfile.mkdtemp(prefix="ss1-", dir="/tmp")
    t["billing_records"].repartition(3).write.parquet(f"{root}/src")
    t["billing_records"] = spark.read.parquet(f"{root}/src")
    out = sj.refresh_daily_revenue(spark, t, f"{root}/src", f"{root}/table", f"{root}/ck", files_per_trigger=1)
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in jobs.daily_revenue(t).collect())


def test_stream_status_events_equals_batch(spark):
    import datetime as dt
    t = generate_clinic(spark, n_patients=50, n_doctors=3)
    ev = spark.createDataFrame(
        [(i % 40, i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i),
          ["in_progress", "completed", "cancelled"][i % 3], ["doctor", "front_desk", "admin"][(i // 3) % 3])
         for i in range(300)],
        "appointment_id long, event_id long, ts timestamp_ntz, to_status string, role string")
    root = tempfile.mkdtemp(prefix="ss2-", dir="/tmp")
    ev.repartition(3).write.parquet(f"{root}/events")
    stream = spark.readStream.schema(ev.schema).parquet(f"{root}/events")
    got = sj.status_event_stream(spark, t["appointments"], stream, f"{root}/out", f"{root}/ck")
    want = wr.validate_transitions(t["appointments"], ev)
    cols = ["event_id", "accepted", "from_status", "reason"]
    assert sorted(tuple(r) for r in got.select(cols).collect()) == sorted(tuple(r) for r in want.select(cols).collect())
