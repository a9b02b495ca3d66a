"""Registered queries and oracles: upserts over two generations of a table,
pipeline run status and totals."""
from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from clinlytics.operators import jobs
from clinlytics.operators import upsert as up
from clinlytics.plans.catalog_jobs import _DAILY_REVENUE, _DAY_COUNTS, _INVOICE_PARTS, _OPERATIONAL
from clinlytics.plans.catalog_jobs import ORACLES as JOB_ORACLES
from clinlytics.plans.catalog_rag import _RAG_CTES, _store
from clinlytics.plans.oracle_base import with_clinic
from clinlytics.session import ensure_checkpoint_dir
from clinlytics.sources.driver import clinic_tables

# Generation boundaries of the two-run scenarios.
REVENUE_OLD_BEFORE, REVENUE_NEW_FROM = "1998-01-01", "1997-01-01"
STORE_OLD_BEFORE, STORE_NEW_FROM = "1998-01-01", "1996-01-01"
TS_OLD, TS_NEW = dt.datetime(1998, 1, 1), dt.datetime(2001, 7, 15)


def _upsert_daily_revenue(t):
    full = jobs.daily_revenue(t)
    old = full.where(F.col("date") < F.lit(REVENUE_OLD_BEFORE).cast("date")).withColumn("generation", F.lit(1))
    new = full.where(F.col("date") >= F.lit(REVENUE_NEW_FROM).cast("date")).withColumn("generation", F.lit(2))
    return up.upsert(old, new, ["date", "department_id"])


def _upsert_embeddings(t):
    store = _store(t).select("chunk_id", "patient_id", "visit_date", "embedding")
    old = store.where(F.col("visit_date") < STORE_OLD_BEFORE).withColumns(
        {"created_at": F.lit(TS_OLD), "updated_at": F.lit(TS_OLD)})
    new = store.where(F.col("visit_date") >= STORE_NEW_FROM).withColumns(
        {"created_at": F.lit(TS_NEW), "updated_at": F.lit(TS_NEW)})
    return up.upsert(old, new, ["chunk_id"], created_col="created_at").drop("embedding")


def _withdrawn(t, as_of=None):
    raise RuntimeError("no rows today")


def _measured_runs(t):
    """All jobs run for real, twice the first one, and one that fails; the log they leave, read back."""
    root = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    registry = dict(up.job_registry(), daily_report=(_withdrawn, ["date"]))
    names = [up.JOB_ORDER[0], *up.JOB_ORDER, "daily_report"]
    log, _ = up.run_all(t.spark, t, root, names=names, registry=registry)
    return log


def _run_status(t):
    return up.pipeline_status(_measured_runs(t)).select("job_name", "status", "rows_processed", "error_message",
                                                        (F.col("completed_at") >= F.col("started_at")).alias("ended"))


def _run_events(t):
    return _measured_runs(t).groupBy("job_name", "status").agg(F.count(F.lit(1)).alias("runs"), F.sum("rows_processed").alias("rows_processed"))


def _q(fn):
    def run(spark, sf_dir):
        return fn(clinic_tables(spark, sf_dir))
    return run


QUERIES = {
    "upsert_daily_revenue": _q(_upsert_daily_revenue),
    "upsert_embeddings": _q(_upsert_embeddings),
    "pipeline_status": _q(lambda t: up.pipeline_status(up.nightly_run_log(t))),
    "pipeline_totals": _q(lambda t: up.pipeline_totals(up.pipeline_status(up.nightly_run_log(t)))),
    "run_status": _q(_run_status),
    "run_events": _q(_run_events),
}

_RUN_CTES = _INVOICE_PARTS.strip() + ",\n" + _DAY_COUNTS.strip() + f""",
dr AS ({_DAILY_REVENUE}),
om AS ({_OPERATIONAL}),
runs0 AS (
  SELECT 'revenue_analytics' AS job_name, date, COUNT(*) AS n FROM dr WHERE date < DATE '2001-07-15' GROUP BY date
  UNION ALL
  SELECT 'operational_metrics', date, COUNT(*) FROM om WHERE date < DATE '2001-07-15' GROUP BY date),
runs AS (
  SELECT job_name || ':' || CAST(date AS VARCHAR) AS run_id, job_name, 'success' AS status,
    CAST(date + 1 AS TIMESTAMP) + INTERVAL 2 HOUR AS started_at,
    CAST(date + 1 AS TIMESTAMP) + INTERVAL 2 HOUR + to_seconds(n) AS completed_at,
    CAST(n AS DECIMAL(10,2)) AS duration_seconds, n AS rows_processed, CAST(NULL AS VARCHAR) AS error_message
  FROM runs0),
latest AS (SELECT * FROM runs QUALIFY ROW_NUMBER() OVER (PARTITION BY job_name ORDER BY started_at DESC, run_id DESC) = 1)
"""

_JOB_ROWS = " UNION ALL ".join(f"SELECT '{job}' AS job_name, (SELECT COUNT(*) FROM ({JOB_ORACLES[name]})) AS n" for job, name in (
    ("revenue_analytics", "daily_revenue"), ("clinical_summaries", "clinical_summaries"),
    ("patient_analytics", "patient_profiles"), ("operational_metrics", "operational_metrics")))

ORACLES = {
    "run_status": f"""SELECT job_name, 'success' AS status, n AS rows_processed, CAST(NULL AS VARCHAR) AS error_message, true AS ended FROM ({_JOB_ROWS})
        UNION ALL SELECT 'daily_report', 'failed', 0, 'no rows today', true""",
    "run_events": f"""WITH done AS ({_JOB_ROWS}), times AS (SELECT job_name, n, CASE job_name WHEN 'revenue_analytics' THEN 2 ELSE 1 END AS k FROM done)
        SELECT job_name, 'running' AS status, k AS runs, 0 AS rows_processed FROM times UNION ALL SELECT job_name, 'success', k, k * n FROM times
        UNION ALL SELECT 'daily_report', 'running', 1, 0 UNION ALL SELECT 'daily_report', 'failed', 1, 0""",
    "upsert_daily_revenue": with_clinic(
        f"SELECT *, CASE WHEN date >= DATE '{REVENUE_NEW_FROM}' THEN 2 ELSE 1 END AS generation FROM ({_DAILY_REVENUE})", _INVOICE_PARTS),
    "upsert_embeddings": with_clinic(f"""
        SELECT chunk_id, patient_id, visit_date,
          CASE WHEN visit_date < '{STORE_OLD_BEFORE}' THEN TIMESTAMP '{TS_OLD}' ELSE TIMESTAMP '{TS_NEW}' END AS created_at,
          CASE WHEN visit_date >= '{STORE_NEW_FROM}' THEN TIMESTAMP '{TS_NEW}' ELSE TIMESTAMP '{TS_OLD}' END AS updated_at
        FROM chunk_meta""", _RAG_CTES),
    "pipeline_status": with_clinic("SELECT * FROM latest", _RUN_CTES),
    "pipeline_totals": with_clinic(
        "SELECT CAST(COALESCE(SUM(rows_processed), 0) AS BIGINT) AS rows_processed, COUNT(*) AS jobs, "
        "COALESCE(bool_and(status = 'success'), true) AS all_success FROM latest", _RUN_CTES),
}
