"""Late events, crashed writes, restarted streams, reverted summaries and phone conflicts."""
import datetime as dt
import tempfile

from pyspark.sql import functions as F

from clinlytics.operators import upsert as up
from clinlytics.operators import writes as wr
from clinlytics.plans import sqlfiles  # noqa: F401 - the package imports without the corpus operators
from clinlytics.streaming import jobs as sj
from tests import seed


def _dir(name):
    return tempfile.mkdtemp(prefix=f"{name}-", dir="/tmp")


def test_late_events_come_out_as_rejects(spark):
    appointments = spark.createDataFrame([(1, "scheduled")], "id long, status string")
    start = dt.datetime(2024, 1, 10)
    events = [(1, 1, start, "in_progress", "doctor"), (1, 2, start + dt.timedelta(hours=1), "completed", "doctor"), (1, 3, start + dt.timedelta(hours=2), "cancelled", "admin"),
              (1, 3, start + dt.timedelta(hours=2), "cancelled", "admin"), (1, 4, start + dt.timedelta(hours=3), "no_show", "admin"), (1, 5, start - dt.timedelta(days=3), "cancelled", "admin")]
    root = _dir("late")
    schema = "appointment_id long, event_id long, ts timestamp_ntz, to_status string, role string"
    for i, e in enumerate(events):
        spark.createDataFrame([e], schema).coalesce(1).write.parquet(f"{root}/events/slice={i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/events/slice=*")
    got = {r.event_id: r for r in sj.status_event_stream(spark, appointments, stream, f"{root}/out", f"{root}/ck").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert got[2].accepted and (got[5].accepted, got[5].reason) == (False, sj.LATE)


def test_a_reverted_summary_is_ingested_again(spark):
    root = _dir("revert")
    head = "PATIENT: A Bee | Age: 1\n\n"
    one, two = "VISIT 1 [2024-01-01]\nDr. X, Y\nDiagnosis: d", "VISIT 2 [2024-02-01]\nDr. X, Y\nDiagnosis: e"
    texts = [head + one + "\n\n" + two, head + two, head + one + "\n\n" + two]
    for i, text in enumerate(texts):
        df = spark.createDataFrame([(1, text, 2)], "patient_id long, summary_text string, visit_count int")
        df.withColumn("summary_hash", F.sha2("summary_text", 256)).coalesce(1).write.mode("append").parquet(f"{root}/src")
        out = sj.ingest_summaries(spark, f"{root}/src", f"{root}/store", f"{root}/ck")
    got = {r.chunk_id: r.document for r in out.collect()}
    assert got["1_visit_1"].endswith("Diagnosis: d") and got["1_visit_2"].endswith("Diagnosis: e")


def test_no_phone_is_ever_held_twice(spark):
    t = seed.tables(spark)
    held = {r.id: r.phone for r in t["patients"].collect()}
    a, b, c = sorted(held)[:3]
    changes = spark.createDataFrame([(1, a, "9111111111", True), (2, b, "9111111111", True), (3, c, held[a], True)], "change_id long, id long, phone string, set_phone boolean")
    after, rejected = wr.update_patients(t["patients"], changes)
    now = {r.id: r.phone for r in after.collect()}
    assert now[a] == "9111111111" and sorted(r.id for r in rejected.collect()) == [b, c]
    assert len(set(now.values())) == len(now)


def test_run_log_is_written(spark, small):
    root = _dir("runs")
    runs, failed = up.run_all(spark, small, root, names=["revenue_analytics"])
    assert failed == [] and spark.read.parquet(f"{root}/_runs").count() == 2
    last = up.pipeline_status(spark.read.parquet(f"{root}/_runs").where("status <> 'running'")).first()
    assert last.rows_processed == up.read_table(spark, f"{root}/revenue_analytics").count() > 0
