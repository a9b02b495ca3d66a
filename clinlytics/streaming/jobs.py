"""Structured Streaming forms of the nightly refresh, the appointment status
workflow and summary ingestion.

* ``refresh_daily_revenue``: versions of billing records arrive as files. The
  state of an invoice is what it adds to its (payment date, department); a
  change comes out as one row that takes the old contribution back and one that
  adds the new one, so old and new date are refreshed and emptied days vanish.
* ``status_event_stream``: status events are applied per appointment; the state
  is the status and the last event's place, and the ids seen, one row each in
  the state of Spark's own deduplication; in a query that goes on running, a
  timer drops them some time after a final status. No watermark drops events: one that comes behind its place is
  rejected as late.
* ``ingest_summaries``: summaries arrive as files. The state of a patient (hash,
  block numbers) lets only changed summaries through and marks the blocks that
  a shorter one no longer has, so no stale chunk stays in the store.

All three keep their state in the RocksDB state store, keys hashed to a fixed
number of groups (``state.GROUPS``) so that a state access serves many keys,
and append what changed to a Parquet log (the file sink commits each
micro-batch once); ``read_*`` gives the table. A micro-batch reads the state of
the groups its rows fall into, never the log. Every query runs with ``trigger(availableNow=True)`` from
a checkpoint in the shared folder, so a restarted job resumes where it stopped.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinlytics.functions.core import money
from clinlytics.operators import jobs, writes
from clinlytics.operators.writes import LATE  # noqa: F401 - the reason of late events, for callers
from clinlytics.session import ensure_checkpoint_dir, ship_package
from clinlytics.streaming import state
from clinlytics.streaming.state import StatusMachine

# The process that opens the state on the driver gets no shipped files, so the processors travel by value.
for _module in (state, writes):
    cloudpickle.register_pickle_by_value(_module)

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: how long after a final status an appointment keeps the ids of its events, where timers run
RETAIN_MS = 30 * 24 * 3600 * 1000


def scratch_root(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def _run(spark: SparkSession, rows: DataFrame, out_dir: str, checkpoint: str) -> DataFrame:
    """Append everything that is available to the log at ``out_dir``; the state lies in the RocksDB store."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        q = (rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start(out_dir))
        q.awaitTermination()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(rows.schema).parquet(out_dir)


def _grouped(rows: DataFrame, key: str, function: Callable, schema: str) -> DataFrame:
    """``function`` on each group of keys with its state; rows carry the key as a string."""
    group = F.pmod(F.xxhash64(key), F.lit(state.GROUPS)).cast("int").alias("group")
    return rows.withColumn(key, F.col(key).cast("string")).withColumn("group", group).groupBy("group") \
        .applyInPandasWithState(function, schema, "held string", "append", "NoTimeout")


def _arrival() -> Column:
    """When a row's file was written, in microseconds: orders versions that carry no order of their own."""
    return F.unix_micros(F.col("_metadata.file_modification_time"))


# ------------------------------------------------------------------ SS1 ----
_PARTS = [*(f"{c}_cents" for c in jobs.CATEGORIES), "total_cents", "paid", "pending"]


def invoice_contributions(t, records: DataFrame) -> DataFrame:
    """What each version of a billing record adds to its (payment date, department), in cents.

    A record without items, visit, appointment or department adds nothing (null date).
    """
    cents = (F.col("amount") * 100).cast("bigint")
    per_invoice = t["billing_items"].groupBy(F.col("billing_record_id").alias("id")).agg(
        *[F.sum(F.when(F.col("category") == c, cents)).alias(f"{c}_cents") for c in jobs.CATEGORIES], F.sum(cents).alias("total_cents"))
    v = t["visits"].select(F.col("id").alias("visit_id"), "appointment_id")
    a = t["appointments"].select(F.col("id").alias("appointment_id"), F.col("department_id").cast("bigint").alias("department_id"))
    d = t["departments"].select(F.col("id").cast("bigint").alias("department_id"), F.col("name").alias("department_name"))
    j = records.join(per_invoice, "id", "left").join(v, "visit_id", "left").join(a, "appointment_id", "left").join(d, "department_id", "left")
    counts = F.col("total_cents").isNotNull() & F.col("department_name").isNotNull()
    return j.select("id", "version", F.when(counts, F.col("payment_date")).alias("payment_date"), "department_id", "department_name",
                    *_PARTS[:-2], (F.col("status") == "paid").cast("bigint").alias("paid"), (F.col("status") == "pending").cast("bigint").alias("pending"))


def refresh_daily_revenue(spark: SparkSession, t, source_dir: str, out_root: str, checkpoint: str,
                          files_per_trigger: int = 1, version: str | None = None) -> DataFrame:
    """Incrementally maintain daily revenue from a folder of versions of billing records.

    ``version`` names a whole-number column that orders the versions of a record; without it they count by the time of their file.
    """
    schema = t["billing_records"].schema
    if version and version not in schema.names:
        schema = schema.add(version, "long")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
    records = source.select("id", "visit_id", "status", "payment_date", (F.col(version) if version else _arrival()).alias("version"))
    kinds = "payment_date date, department_id bigint, department_name string, " + ", ".join(f"{c} bigint" for c in _PARTS)
    parts = F.struct("payment_date", "department_id", "department_name", *_PARTS)
    versions = invoice_contributions(t, records).select("id", "version", F.to_json(parts, {"ignoreNullFields": "false"}).alias("contribution"))
    changes = _grouped(versions, "id", state.invoice_groups, "sign bigint, contribution string").select("sign", F.from_json("contribution", kinds).alias("c"))
    deltas = changes.where("c.payment_date IS NOT NULL").select(
        *[f"c.{c}" for c in ("payment_date", "department_id", "department_name")],
        *[(F.col("sign") * F.coalesce(f"c.{c}", F.lit(0))).alias(c) for c in _PARTS], F.col("sign").alias("invoices"))
    return read_daily_revenue(_run(spark, deltas, out_root, checkpoint), t)


def read_daily_revenue(deltas: DataFrame, t) -> DataFrame:
    """The daily revenue table of a log of changes: a partial aggregate; days without an invoice are gone."""
    sums = deltas.groupBy(F.col("payment_date").alias("date"), "department_id", "department_name").agg(*[F.sum(c).alias(c) for c in [*_PARTS, "invoices"]])
    kind = t["departments"].schema["id"].dataType
    return sums.where(F.col("invoices") > 0).select(
        "date", F.col("department_id").cast(kind).alias("department_id"), "department_name",
        *[money(F.col(f"{c}_cents").cast("decimal(20,2)") / 100).alias(f"{c}_revenue") for c in (*jobs.CATEGORIES, "total")],
        F.col("paid").alias("paid_count"), F.col("pending").alias("pending_count"))


# ------------------------------------------------------------------ SS2 ----
OUTCOME_SCHEMA = ("event_id long, appointment_id long, ts timestamp_ntz, role string, from_status string, "
                  "to_status string, accepted boolean, reason string")


def status_outcomes(appointments: DataFrame, events_stream: DataFrame, retain_ms: int | None = None) -> DataFrame:
    """The outcome of every event of a stream of appointment_id, event_id, ts, to_status, role.

    With ``retain_ms`` (RETAIN_MS is usual) the state has processing-time timers: for queries that go on running, as
    Spark always plans another batch for them.
    """
    cur = appointments.select(F.col("id").alias("appointment_id"), F.col("status").alias("status0"))
    place = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0))
    ev = events_stream.select(F.col("appointment_id").cast("bigint"), F.col("event_id").cast("bigint"), F.col("ts").cast("timestamp_ntz"), "to_status", "role", place.alias("at"))
    if retain_ms is not None:
        rows = ev.join(cur, "appointment_id", "left").groupBy("appointment_id")
        return rows.transformWithState(StatusMachine(retain_ms), OUTCOME_SCHEMA, "append", "processingtime")
    # a repeated id comes out once: the first by place in a micro-batch, then none that an earlier one had
    first = ev.repartition("appointment_id").mapInArrow(state.earliest_events, ev.schema)
    fresh = first.dropDuplicates(["appointment_id", "event_id"])
    text = lambda c: F.col(c).cast("string")  # noqa: E731 - nullable numbers and times pass pandas as text
    rows = fresh.join(cur, "appointment_id", "left").withColumns({"event_id": text("event_id"), "ts": text("ts")})
    kinds = [x.split() for x in OUTCOME_SCHEMA.split(", ")]
    out = _grouped(rows, "appointment_id", state.status_groups, ", ".join(f"{c} {'boolean' if k == 'boolean' else 'string'}" for c, k in kinds))
    return out.select(*[F.col(c).cast(k) for c, k in kinds])


def status_event_stream(spark: SparkSession, appointments: DataFrame, events_stream: DataFrame, out_dir: str,
                        checkpoint: str) -> DataFrame:
    """Every available event comes out once, late ones as rejects; repeated ids come out once."""
    return _run(spark, status_outcomes(appointments, events_stream), out_dir, checkpoint)


# ------------------------------------------------------------------ SS3 ----
def ingest_summaries(spark: SparkSession, source_dir: str, store_root: str, checkpoint: str,
                     files_per_trigger: int = 1, embedder=None) -> DataFrame:
    """Incremental ingestion: only changed summaries are embedded and stored; blocks that are gone leave the store."""
    from clinlytics.operators import retrieval as rg
    schema = "patient_id long, summary_text string, visit_count int, summary_hash string"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
    versions = source.select("patient_id", "summary_text", F.coalesce("summary_hash", F.sha2("summary_text", 256), F.lit("")).alias("summary_hash"), _arrival().alias("version"))
    rows = versions.select("patient_id", "summary_text", "summary_hash", "version", F.array_join(rg.block_numbers(F.col("summary_text")), ",").alias("blocks"))
    changed = _grouped(rows, "patient_id", state.summary_groups, "patient_id string, summary_text string, summary_hash string, generation bigint, gone string")
    gone = F.when(F.col("gone") != "", F.split("gone", ",").cast("array<int>")).otherwise(F.array().cast("array<int>"))
    changed = changed.withColumn("patient_id", F.col("patient_id").cast("bigint")).withColumn("gone", gone)
    ship_package(spark)  # the embedder's worker code
    full = rg.chunk_summaries(changed, keep=("summary_hash", "generation"), gone="gone").withColumns(
        {"deleted": F.col("document").isNull(), "written_at": F.current_timestamp()})
    return read_store(_run(spark, rg.embed_chunks(full, embedder), store_root, checkpoint))


def read_store(log: DataFrame) -> DataFrame:
    """The chunks of a store's log: per chunk the row of the newest generation (a partial aggregate), without those gone."""
    rest = [c for c in log.columns if c not in ("chunk_id", "written_at")]
    last = log.groupBy("chunk_id").agg(F.max_by(F.struct(*rest, "written_at"), "generation").alias("r"), F.min("written_at").alias("created_at"))
    return last.where(~F.col("r.deleted")).select("chunk_id", *[F.col(f"r.{c}") for c in rest if c not in ("generation", "deleted")],
                                                  "created_at", F.col("r.written_at").alias("updated_at"))
