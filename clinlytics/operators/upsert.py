"""Keyed upsert, hash-partitioned tables, job registry and run log.

``upsert`` is INSERT ... ON CONFLICT (keys) DO UPDATE as a plan: new rows
replace old rows with the same key, unmatched old rows stay (nothing is
deleted unless asked), ``created_at`` survives an update.

``upsert_table`` keeps a Parquet table partitioned by a hash of its key and
rewrites only the partitions that the new rows fall into (Spark's dynamic
partition overwrite). The merged partitions are written aside first, so an
overwrite that dies half-way is completed by the next reader or writer.
"""
from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinlytics.functions.core import as_of_lit


class DuplicateKeyError(ValueError):
    """The new rows hold a key more than once (ON CONFLICT would raise)."""


def check_unique(df: DataFrame, keys: list[str]) -> None:
    dup = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise DuplicateKeyError(f"duplicate key {dict((k, dup[0][k]) for k in keys)} in upsert input")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], delete_missing: bool = False,
           created_col: str | None = None, check: bool = True) -> DataFrame:
    """Rows of ``new`` plus the rows of ``old`` whose key is not in ``new``.

    With ``created_col`` the old value of that column is kept for updated
    keys (a full outer join on the keys instead of anti join + union).
    """
    if check:
        check_unique(new, keys)
    cols = new.columns
    if created_col is None:
        if delete_missing:
            return new
        kept = old.select(*cols).join(new.select(*keys), keys, "left_anti")
        return kept.unionByName(new)
    o = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in cols if c not in keys])
    j = new.withColumn("_in_new", F.lit(True)).join(o, keys, "full_outer" if not delete_missing else "left")
    out = []
    for c in cols:
        if c in keys:
            out.append(F.col(c))
        elif c == created_col:
            out.append(F.coalesce(F.col(f"_old_{c}"), F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_in_new"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c))
    return j.select(*out)


# ------------------------------------------------- hash-partitioned tables ----
#: partitions of a table; a table keeps the number it was made with
PARTITIONS = 64
PARTITION = "_part"


def _path(spark: SparkSession, *parts: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path("/".join(x.rstrip("/") for x in parts))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, *parts: str) -> bool:
    fs, p = _path(spark, *parts)
    return fs.exists(p)


def _names(spark: SparkSession, *parts: str) -> list[str]:
    fs, p = _path(spark, *parts)
    return sorted(st.getPath().getName() for st in fs.listStatus(p)) if fs.exists(p) else []


def _overwrite(staged: DataFrame, root: str) -> None:
    """Replace the partitions that ``staged`` holds; all others stay as they are. A large partition is written by several tasks."""
    staged.hint("rebalance", PARTITION).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION).parquet(f"{root}/rows")


def _complete(spark: SparkSession, root: str) -> None:
    """Repeat the overwrites that were staged in full but not marked as done, oldest first."""
    for name in _names(spark, root, "stage"):
        if _exists(spark, root, "stage", name, "_SUCCESS") and not _exists(spark, root, "done", name):
            _overwrite(spark.read.parquet(f"{root}/stage/{name}"), root)
            _mark(spark, root, name)


def _mark(spark: SparkSession, root: str, name: str) -> None:
    fs, p = _path(spark, root, "done", name)
    fs.create(p, True).close()
    fs, p = _path(spark, root, "stage", name)
    fs.delete(p, True)


def create_table(spark: SparkSession, root: str, schema: T.StructType) -> bool:
    """Make an empty table; False if there is one."""
    if _exists(spark, root, "schema", "_SUCCESS"):
        return False
    fields = [f for f in schema.fields if f.name != PARTITION]
    spark.createDataFrame([(T.StructType(fields).json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root.rstrip('/')}/schema")
    return True


def _rows(spark: SparkSession, root: str) -> DataFrame | None:
    if not _exists(spark, root, "schema", "_SUCCESS"):
        return None
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{root}/schema").first()[0])).add(PARTITION, T.IntegerType())
    return spark.read.schema(schema).parquet(f"{root}/rows") if _exists(spark, root, "rows") else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of the table at ``root``; None before it is made."""
    root = root.rstrip("/")
    _complete(spark, root)
    rows = _rows(spark, root)
    return None if rows is None else rows.drop(PARTITION)


def clear_table(spark: SparkSession, root: str) -> int:
    """Remove all rows of a table; returns how many there were."""
    rows = read_table(spark, root)
    n = 0 if rows is None else rows.count()
    fs, p = _path(spark, root, "rows")
    fs.delete(p, True)
    return n


def upsert_table(spark: SparkSession, root: str, new: DataFrame, keys: list[str], partitions: int = PARTITIONS,
                 check: bool = True, created_col: str | None = None) -> int:
    """Upsert ``new`` into the table at ``root``; returns the number of rows that came in.

    Reads and writes only the partitions that hold a key of ``new``. The new
    rows are computed once, and counted and checked where they are written.
    """
    root = root.rstrip("/")
    _complete(spark, root)
    incoming, rows = Observation(), f"{root}/incoming/{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64(*keys), F.lit(partitions)).cast("int")
    new.withColumn(PARTITION, part).observe(incoming, F.count(F.lit(1)).alias("rows")).write.parquet(rows)
    new = spark.read.parquet(rows)
    if check:
        check_unique(new, keys)
    fs, p = _path(spark, rows)
    name = f"{time.time_ns():020d}"
    if create_table(spark, root, new.schema) or not _exists(spark, root, "rows"):
        fs.mkdirs(_path(spark, root, "stage")[1])
        fs.rename(p, _path(spark, root, "stage", name)[1])  # nothing to merge with: the new rows are the staged ones
    else:
        touched = [r[0] for r in new.select(PARTITION).distinct().collect()]  # PARTITIONS rows at most
        old = _rows(spark, root).where(F.col(PARTITION).isin(touched) if touched else F.lit(False))
        upsert(old, new, keys, check=False, created_col=created_col).write.parquet(f"{root}/stage/{name}")
        fs.delete(p, True)
    _overwrite(spark.read.parquet(f"{root}/stage/{name}"), root)
    _mark(spark, root, name)
    return incoming.get["rows"]


# ------------------------------------------------------- jobs and runs ----
# The job registry order and the error-text limit of the run log.
JOB_ORDER = ("revenue_analytics", "clinical_summaries", "patient_analytics", "operational_metrics")
ERROR_LIMIT = 2000
RUN_SCHEMA = ("run_id string, job_name string, status string, started_at timestamp, completed_at timestamp, "
              "duration_seconds decimal(10,2), rows_processed bigint, error_message string")


def job_registry() -> dict[str, tuple[Callable, list[str]]]:
    """name -> (job function over clinic tables, upsert keys)."""
    from clinlytics.operators import jobs
    return {
        "revenue_analytics": (jobs.daily_revenue, ["date", "department_id"]),
        "clinical_summaries": (jobs.clinical_summaries, ["patient_id"]),
        "patient_analytics": (jobs.patient_profiles, ["patient_id"]),
        "operational_metrics": (jobs.operational_metrics, ["date", "doctor_id"]),
    }


def _log(spark: SparkSession, out_root: str, **row) -> None:
    """Append one row to the run log."""
    cols = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
    error = F.substring(F.col("error_message"), 1, ERROR_LIMIT)  # cut where it is written
    spark.createDataFrame([tuple(row.get(c) for c in cols)], RUN_SCHEMA).withColumn("error_message", error).coalesce(1) \
        .write.mode("append").parquet(f"{out_root.rstrip('/')}/_runs")


#: partitions of the tables that the jobs write
JOB_PARTITIONS = 8


def run_job(spark: SparkSession, t, name: str, out_root: str, as_of=None, registry=None) -> str:
    """Run one job and upsert its output; logs that it runs, then how it ended. Returns the last status."""
    from decimal import Decimal
    fn, keys = (registry or job_registry())[name]
    now = lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    run = {"run_id": uuid.uuid4().hex, "job_name": name, "started_at": now()}
    _log(spark, out_root, **run, status="running", rows_processed=0)
    t0 = time.perf_counter()
    try:
        rows = upsert_table(spark, f"{out_root.rstrip('/')}/{name}", fn(t, as_of=as_of), keys, JOB_PARTITIONS)
        status, err = "success", None
    except Exception as e:  # noqa: BLE001 - the run log records any failure
        rows, status, err = 0, "failed", str(e)
    secs = Decimal(str(round(time.perf_counter() - t0, 2)))
    _log(spark, out_root, **run, status=status, completed_at=now(), duration_seconds=secs, rows_processed=rows, error_message=err)
    return status


def run_all(spark: SparkSession, t, out_root: str, as_of=None, names=None, registry=None) -> tuple[DataFrame, list[str]]:
    """Run jobs in registry order, continue after a failure; returns the run log and the failed job names."""
    failed = [name for name in names or JOB_ORDER if run_job(spark, t, name, out_root, as_of, registry) == "failed"]
    return run_log(spark, out_root), failed


def run_log(spark: SparkSession, out_root: str) -> DataFrame:
    """Every row that the runs below ``out_root`` logged: one when a run starts, one when it ends."""
    return spark.read.schema(RUN_SCHEMA).parquet(f"{out_root.rstrip('/')}/_runs")


def pipeline_status(runs: DataFrame) -> DataFrame:
    """Latest run per job (DISTINCT ON job ORDER BY started_at DESC), by how it ended or that it still runs."""
    order = F.struct("started_at", "run_id", F.col("completed_at").isNotNull())
    latest = runs.groupBy("job_name").agg(F.max_by(F.struct(*runs.columns), order).alias("_r"))
    return latest.select("_r.*")


def pipeline_totals(status: DataFrame) -> DataFrame:
    """Rows processed, number of jobs and whether all succeeded."""
    return status.agg(
        F.coalesce(F.sum("rows_processed"), F.lit(0)).cast("bigint").alias("rows_processed"),
        F.count(F.lit(1)).alias("jobs"),
        F.coalesce(F.bool_and(F.col("status") == "success"), F.lit(True)).alias("all_success"),
    )


def nightly_run_log(t, as_of=None) -> DataFrame:
    """The run log a nightly incremental refresh leaves: for each day with
    data, one run of revenue_analytics (rows = department-days refreshed)
    and one of operational_metrics (rows = doctor-days), started at 02:00 the
    next night; days after ``as_of`` have not run yet."""
    from clinlytics.operators import jobs
    asof = as_of_lit(as_of)
    rev = jobs.daily_revenue(t).groupBy("date").agg(F.count(F.lit(1)).alias("rows_processed")) \
        .withColumn("job_name", F.lit("revenue_analytics"))
    ops = jobs.operational_metrics(t).groupBy("date").agg(F.count(F.lit(1)).alias("rows_processed")) \
        .withColumn("job_name", F.lit("operational_metrics"))
    runs = rev.unionByName(ops).where(F.col("date") < asof)
    start = F.to_timestamp(F.concat(F.date_add("date", 1).cast("string"), F.lit(" 02:00:00")))
    return runs.select(
        F.concat(F.col("job_name"), F.lit(":"), F.col("date").cast("string")).alias("run_id"),
        "job_name", F.lit("success").alias("status"), start.alias("started_at"),
        (start + F.make_interval(secs=F.col("rows_processed").cast("decimal(18,6)"))).alias("completed_at"),
        F.col("rows_processed").cast("decimal(10,2)").alias("duration_seconds"),
        "rows_processed", F.lit(None).cast("string").alias("error_message"))
