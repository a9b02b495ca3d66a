"""Registered streaming queries. Each runs its stream to completion
(availableNow) over several runs from one checkpoint, with rows that arrive
late, change or vanish in between, and returns the resulting table; because
each equals its batch twin, the batch oracle checks it."""
from __future__ import annotations

from pyspark.sql import functions as F

from clinlytics.operators import jobs
from clinlytics.plans.catalog_jobs import ORACLES as JOB_ORACLES
from clinlytics.plans.catalog_rag import _RAG_CTES
from clinlytics.plans.catalog_writes import ORACLES as WRITE_ORACLES
from clinlytics.plans.catalog_writes import status_events
from clinlytics.plans.oracle_base import with_clinic
from clinlytics.sources.driver import clinic_tables
from clinlytics.streaming import jobs as sj

#: a micro-batch takes whatever a run's slice holds
_ALL_FILES = 1_000_000


def _refresh(spark, sf_dir):
    """Invoices first with moved or missing payment dates, then corrected, with older versions among them."""
    t = clinic_tables(spark, sf_dir)
    root = sj.scratch_root(spark, "revenue")
    now = t["billing_records"]
    fifth, seventh, version = F.col("id") % 5 == 0, F.col("id") % 7 == 0, lambda n: F.lit(n).cast("bigint")
    moved = F.when(fifth, F.date_sub("payment_date", 40)).when(~seventh, F.col("payment_date"))
    stale = F.date_add(F.coalesce("payment_date", "created_date"), 3)
    first = now.withColumn("payment_date", moved).withColumn("version", version(1))
    then = (now.where(fifth | seventh).withColumn("version", version(2))
            .unionByName(now.where("id % 3 = 0").withColumn("payment_date", stale).withColumn("version", version(0))))
    out = None
    for i, rows in enumerate((first, then)):
        rows.write.parquet(f"{root}/changes/slice={i}")
        out = sj.refresh_daily_revenue(spark, t, f"{root}/changes/slice=*", f"{root}/log", f"{root}/checkpoint", _ALL_FILES, version="version")
    return out


def _status(spark, sf_dir):
    """The events in three runs, in event-time order."""
    t = clinic_tables(spark, sf_dir)
    root = sj.scratch_root(spark, "status")
    raw = t.driver("events")
    cuts = raw.select(F.expr("percentile_approx(ts, array(0.33, 0.66))")).first()[0] or [None, None]
    part = F.when(F.col("ts") <= F.lit(cuts[0]), 0).when(F.col("ts") <= F.lit(cuts[1]), 1).otherwise(2)
    out = None
    for i in range(3):
        raw.where(part == i).write.parquet(f"{root}/events/slice={i}")
        stream = spark.readStream.schema(raw.schema).parquet(f"{root}/events/slice=*")
        out = sj.status_event_stream(spark, t["appointments"], status_events(t, stream), f"{root}/out", f"{root}/checkpoint")
    return out


def _ingest(spark, sf_dir):
    """Summaries with a visit too many for every fourth patient, then all of them without it."""
    t = clinic_tables(spark, sf_dir)
    root = sj.scratch_root(spark, "ingest")
    now = jobs.clinical_summaries(t).repartition(4, "patient_id")
    more = F.concat("summary_text", F.lit("\n\nVISIT 9999 [2020-01-01]\nDr. None, Nowhere\nDiagnosis: withdrawn"))
    fourth = F.col("patient_id") % 4 == 0
    first = now.withColumn("summary_text", F.when(fourth, more).otherwise(F.col("summary_text"))).withColumn("summary_hash", F.sha2("summary_text", 256))
    store = None
    for i, rows in enumerate((first, now)):
        rows.write.parquet(f"{root}/summaries/slice={i}")
        store = sj.ingest_summaries(spark, f"{root}/summaries/slice=*", f"{root}/store", f"{root}/checkpoint", _ALL_FILES)
    vector = F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")
    return store.select("chunk_id", "patient_id", "document", F.md5(vector).alias("embedding_md5"))


QUERIES = {
    "stream_refresh_revenue": _refresh,
    "stream_status_events": _status,
    "stream_ingest_summaries": _ingest,
}

ORACLES = {
    "stream_refresh_revenue": JOB_ORACLES["daily_revenue"],
    "stream_status_events": WRITE_ORACLES["validate_transitions"],
    "stream_ingest_summaries": with_clinic("""
        SELECT c.chunk_id, c.patient_id, c.document, v.embedding_md5 FROM chunks c JOIN (
          SELECT p.chunk_id, md5(string_agg(CAST(coalesce(x, 0) AS VARCHAR), ',' ORDER BY i)) AS embedding_md5
          FROM (SELECT chunk_id, unnest(range(64)) AS i FROM chunks) p LEFT JOIN cvec ON cvec.chunk_id = p.chunk_id AND cvec.b = p.i
          GROUP BY p.chunk_id) v ON v.chunk_id = c.chunk_id""", _RAG_CTES),
}
