"""Schemas of the analytics tables and idempotent creation (SK5, SK6)."""
from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from clinlytics.operators import upsert as up

# Analytics table layouts and their keys.
ANALYTICS_TABLES = {
    "daily_revenue": ("date date, department_id int, department_name string, consultation_revenue decimal(12,2), "
                      "test_revenue decimal(12,2), procedure_revenue decimal(12,2), other_revenue decimal(12,2), "
                      "total_revenue decimal(12,2), paid_count bigint, pending_count bigint",
                      ["date", "department_id"]),
    "operational_metrics": ("date date, doctor_id bigint, department_id int, department_name string, "
                            "doctor_name string, total_slots int, booked_slots bigint, completed bigint, "
                            "cancelled bigint, no_show bigint, utilization_rate decimal(5,2), "
                            "completion_rate decimal(5,2), no_show_rate decimal(5,2)", ["date", "doctor_id"]),
    "patient_clinical_summaries": ("patient_id bigint, summary_text string, visit_count int, summary_hash string",
                                   ["patient_id"]),
    "patient_profiles": ("patient_id bigint, full_name string, age int, gender string, blood_group string, total_visits bigint, total_appointments bigint, "
                         "no_show_count bigint, no_show_rate decimal(5,2), first_visit date, last_visit date, avg_days_between_visits decimal(10,1), "
                         "primary_department string, primary_doctor string, total_billed decimal(12,2), total_paid decimal(12,2), outstanding decimal(12,2), "
                         "risk_flags array<string>", ["patient_id"]),
    "clinical_embeddings": ("chunk_id string, patient_id bigint, document string, patient_name string, visit_date string, department string, doctor_name string, "
                            "diagnosis_codes string, has_followup boolean, embedding array<float>, created_at timestamp, updated_at timestamp", ["chunk_id"]),
    "pipeline_runs": (up.RUN_SCHEMA, ["run_id", "status"]),
}


def create_if_missing(spark: SparkSession, root: str, name: str) -> bool:
    """Make an empty table when there is none (True if made)."""
    return up.create_table(spark, f"{root.rstrip('/')}/{name}", T.StructType.fromDDL(ANALYTICS_TABLES[name][0]))


def clear_table(spark: SparkSession, path: str) -> int:
    """Empty a table; returns the number of rows it had."""
    return up.clear_table(spark, path)
