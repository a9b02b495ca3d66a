"""Registered queries and their DuckDB oracles: the analytics jobs (J1-J4)."""
from __future__ import annotations

from pyspark.sql import functions as F

from clinlytics.operators import jobs
from clinlytics.plans.oracle_base import with_clinic
from clinlytics.plans.sqlfiles import daily_revenue_sql
from clinlytics.sources.driver import clinic_tables

AS_OF_SQL = "DATE '2001-07-15'"


def _q(fn, flatten_flags: bool = False):
    def run(spark, sf_dir):
        df = fn(clinic_tables(spark, sf_dir))
        if flatten_flags:
            df = df.withColumn("risk_flags", F.array_join("risk_flags", ","))
        return df
    run.__name__ = fn.__name__
    return run


def _risk_flags_exploded(t):
    p = jobs.patient_profiles(t)
    return p.select("patient_id", F.explode("risk_flags").alias("risk_flag"))


QUERIES = {
    "daily_revenue": _q(jobs.daily_revenue),
    "daily_revenue_sql": _q(daily_revenue_sql),
    "operational_metrics": _q(jobs.operational_metrics),
    "patient_profiles": _q(jobs.patient_profiles, flatten_flags=True),
    "risk_flags": _q(_risk_flags_exploded),
    "visit_gaps": _q(jobs.visit_gaps),
    "primary_department": _q(jobs.primary_department),
    "primary_doctor": _q(jobs.primary_doctor),
    "visit_rows": _q(jobs.visit_rows),
    "clinical_summaries": _q(jobs.clinical_summaries),
}

def _percent(part: str, whole: str) -> str:
    """Exact percentage with two decimals, half up, in integers; NULL for a whole of 0."""
    return f"CAST(((20000 * {part} + {whole}) // NULLIF(2 * {whole}, 0)) / 100.0 AS DECIMAL(5,2))"


# Sums per invoice and category first; invoices are counted on their own.
_DAILY_REVENUE = """
SELECT m.date, m.department_id, n.name AS department_name, consultation_revenue, test_revenue, procedure_revenue,
  other_revenue, total_revenue, paid_count, pending_count
FROM (SELECT date, department_id,
        """ + ", ".join(f"CAST(sum(s * (category = '{k}')::INTEGER) AS DECIMAL(12,2)) AS {k}_revenue"
                        for k in ("consultation", "test", "procedure", "other")) + """,
        CAST(sum(s) AS DECIMAL(12,2)) AS total_revenue
      FROM invoice_parts GROUP BY date, department_id) m
JOIN (SELECT date, department_id, sum((status = 'paid')::INTEGER)::BIGINT AS paid_count,
        sum((status = 'pending')::INTEGER)::BIGINT AS pending_count
      FROM (SELECT DISTINCT date, department_id, invoice, status FROM invoice_parts) GROUP BY date, department_id) k
  USING (date, department_id)
JOIN departments n ON n.id = m.department_id
"""

_INVOICE_PARTS = """
invoice_parts AS (
  SELECT r.payment_date AS date, home.department_id, r.id AS invoice, r.status, i.category, i.s
  FROM (SELECT billing_record_id, category, sum(amount) AS s FROM billing_items GROUP BY ALL) i
  JOIN billing_records r ON r.id = i.billing_record_id
  JOIN (SELECT v.id AS visit_id, a.department_id FROM visits v JOIN appointments a ON a.id = v.appointment_id) home USING (visit_id)
  WHERE r.payment_date IS NOT NULL)
"""

# A histogram of statuses per doctor-day, then exact integer percentages.
_OPERATIONAL = f"""
SELECT date, doctor_id, department_id, n.name AS department_name, names.full_name AS doctor_name, 16 AS total_slots,
  booked AS booked_slots, completed, cancelled, no_show, {_percent('booked', '16')} AS utilization_rate,
  {_percent('completed', '(booked - cancelled)')} AS completion_rate, {_percent('no_show', 'booked')} AS no_show_rate
FROM day_counts JOIN departments n ON n.id = department_id
JOIN (SELECT d.id AS doctor_id, u.full_name FROM doctors d, users u WHERE u.id = d.user_id) names USING (doctor_id)
"""

_DAY_COUNTS = """
status_counts AS (
  SELECT appointment_date AS date, doctor_id, department_id, patient_id, status, count(*) AS n FROM appointments GROUP BY ALL),
day_counts AS (
  SELECT date, doctor_id, department_id, sum(n)::BIGINT AS booked,
    """ + ", ".join(f"sum(CASE status WHEN '{k}' THEN n ELSE 0 END)::BIGINT AS {k}" for k in ("completed", "cancelled", "no_show")) + """
  FROM status_counts GROUP BY date, doctor_id, department_id)
"""

# One (patient, doctor) pre-aggregate serves visits, department and doctor; the mean gap telescopes to span / (n - 1).
_PROFILE_CTES = _DAY_COUNTS + """,
pairs AS (
  SELECT patient_id, doctor_id, count(*) AS n, min(created_date) AS lo, max(created_date) AS hi FROM visits GROUP BY patient_id, doctor_id),
named_pairs AS (
  SELECT pairs.*, dep.name AS dep_name, u.full_name AS doc_name
  FROM pairs JOIN doctors d ON d.id = doctor_id JOIN departments dep ON dep.id = d.department_id JOIN users u ON u.id = d.user_id),
seen AS (
  SELECT patient_id, sum(n)::BIGINT AS total_visits, min(lo) AS first_visit_date, max(hi) AS last_visit_date,
    CASE WHEN sum(n) > 1 THEN CAST(((200 * (max(hi) - min(lo)) + sum(n) - 1) // (2 * (sum(n) - 1))) / 100.0 AS DECIMAL(10,2)) END AS visit_frequency_days
  FROM pairs GROUP BY patient_id),
money AS (
  SELECT patient_id, sum(s) AS billed, sum(s * (status = 'paid')::INTEGER) AS paid, sum(s * (status <> 'paid')::INTEGER) AS owed
  FROM (SELECT patient_id, status, sum(total_amount) AS s FROM billing_records WHERE status IN ('paid', 'pending', 'partially_paid') GROUP BY ALL)
  GROUP BY patient_id),
kept AS (
  SELECT patient_id, sum(n)::BIGINT AS asked, sum(CASE status WHEN 'no_show' THEN n ELSE 0 END)::BIGINT AS missed FROM status_counts GROUP BY patient_id),
""" + ",\n".join(f"""{cte} AS (
  SELECT patient_id, best.name AS {out}, -best.k AS visit_count
  FROM (SELECT patient_id, min({{'k': -n, 'name': {name}}}) AS best
        FROM (SELECT patient_id, {name}, sum(n)::BIGINT AS n FROM named_pairs GROUP BY patient_id, {name}) GROUP BY patient_id))"""
                 for cte, out, name in (("primary_dept", "primary_department", "dep_name"), ("primary_doc", "primary_doctor", "doc_name"))) + """,
figures AS (
  SELECT id AS patient_id, concat(first_name, ' ', last_name) AS full_name,
    (CASE WHEN date_of_birth <= DATE '2001-07-15' THEN 2001 - year(date_of_birth) - (strftime(date_of_birth, '%m%d') > '0715')::INTEGER
      ELSE 2001 - year(date_of_birth) + (strftime(date_of_birth, '%m%d') < '0715')::INTEGER END)::INTEGER AS age, gender, blood_group, phone,
    ifnull(total_visits, 0) AS total_visits, first_visit_date, last_visit_date, visit_frequency_days,
    ifnull(billed, 0)::DECIMAL(12,2) AS total_billed, ifnull(paid, 0)::DECIMAL(12,2) AS total_paid, ifnull(owed, 0)::DECIMAL(12,2) AS outstanding_balance,
    ifnull(asked, 0) AS total_appointments, ifnull(missed, 0) AS no_show_count,
    ifnull(""" + _percent("missed", "asked") + """, 0)::DECIMAL(5,2) AS no_show_rate, primary_department, primary_doctor
  FROM (SELECT *, id AS patient_id FROM patients WHERE is_active)
  LEFT JOIN seen USING (patient_id) LEFT JOIN money USING (patient_id) LEFT JOIN kept USING (patient_id)
  LEFT JOIN (SELECT patient_id, primary_department FROM primary_dept) USING (patient_id)
  LEFT JOIN (SELECT patient_id, primary_doctor FROM primary_doc) USING (patient_id)),
-- Fixed values: the risk rules and their order.
rules AS (
  SELECT patient_id, 1 AS o, 'high_no_show_rate' AS flag FROM figures WHERE no_show_rate > 30
  UNION ALL SELECT patient_id, 2, 'infrequent_visits' FROM figures WHERE visit_frequency_days > 180
  UNION ALL SELECT patient_id, 3, 'high_outstanding_balance' FROM figures WHERE outstanding_balance > 5000
  UNION ALL SELECT patient_id, 4, 'no_visit_in_year' FROM figures WHERE date_diff('day', last_visit_date, """ + AS_OF_SQL + """) > 365),
profiles AS (
  SELECT f.*, ifnull(risk_flags, '') AS risk_flags
  FROM figures f LEFT JOIN (SELECT patient_id, string_agg(flag, ',' ORDER BY o) AS risk_flags FROM rules GROUP BY patient_id) USING (patient_id))
"""

# Item texts are put together per invoice before any join.
_VISIT_ROWS_CTES = """
item_texts AS (
  SELECT billing_record_id, string_agg(concat(description, ' (INR ', amount, ')'), ', ' ORDER BY item_no) AS said FROM billing_items GROUP BY billing_record_id),
bills AS (
  SELECT r.visit_id, r.total_amount, r.status, r.payment_method, i.said FROM billing_records r LEFT JOIN item_texts i ON i.billing_record_id = r.id),
staff AS (
  SELECT d.id AS doctor_id, u.full_name AS doctor_name, dep.name AS department_name FROM doctors d, users u, departments dep WHERE u.id = d.user_id AND dep.id = d.department_id),
visit_rows AS (
  SELECT v.patient_id, concat(who.first_name, ' ', who.last_name) AS full_name,
    (CASE WHEN who.date_of_birth <= DATE '2001-07-15' THEN 2001 - year(who.date_of_birth) - (strftime(who.date_of_birth, '%m%d') > '0715')::INTEGER
      ELSE 2001 - year(who.date_of_birth) + (strftime(who.date_of_birth, '%m%d') < '0715')::INTEGER END)::INTEGER AS age, who.gender, who.blood_group, who.phone,
    v.id AS visit_id, v.created_date AS visit_date, staff.doctor_name, staff.department_name, v.symptoms, v.diagnosis, v.diagnosis_code,
    v.prescription, v.follow_up_date, v.follow_up_notes, b.total_amount AS billing_amount, b.status AS billing_status, b.payment_method,
    ifnull(b.said, '') AS line_items
  FROM visits v JOIN staff USING (doctor_id) JOIN (FROM patients WHERE is_active) who ON who.id = v.patient_id LEFT JOIN bills b ON b.visit_id = v.id)
"""

_SUMMARY_CTES = _VISIT_ROWS_CTES + """,
blocks AS (
  SELECT patient_id, full_name, age, gender, blood_group, visit_date, visit_id,
    'PATIENT: ' || full_name || ' | Age: ' || CAST(age AS VARCHAR)
      || ' | Gender: ' || upper(substr(gender, 1, 1)) || lower(substr(gender, 2))
      || ' | Blood Group: ' || COALESCE(NULLIF(blood_group, ''), 'Unknown') AS header,
    ROW_NUMBER() OVER (PARTITION BY patient_id ORDER BY visit_date, visit_id) AS rn,
    concat_ws(chr(10),
      'VISIT ' || CAST(ROW_NUMBER() OVER (PARTITION BY patient_id ORDER BY visit_date, visit_id) AS VARCHAR)
        || ' [' || strftime(visit_date, '%Y-%m-%d') || ']',
      doctor_name || ', ' || department_name,
      CASE WHEN symptoms <> '' THEN 'Symptoms: ' || symptoms END,
      'Diagnosis: ' || diagnosis || CASE WHEN diagnosis_code <> '' THEN ' (ICD-10: ' || diagnosis_code || ')' ELSE '' END,
      CASE WHEN prescription <> '' THEN 'Prescription: ' || prescription END,
      CASE WHEN line_items <> '' THEN 'Tests/Procedures: ' || line_items END,
      CASE WHEN billing_amount <> 0 THEN 'Billing: INR ' || CAST(billing_amount AS VARCHAR) || ' ('
           || COALESCE(NULLIF(billing_status, ''), 'unknown')
           || CASE WHEN payment_method <> '' THEN ' via ' || payment_method ELSE '' END || ')' END,
      CASE WHEN follow_up_date IS NOT NULL THEN 'Follow-up: ' || strftime(follow_up_date, '%Y-%m-%d') END,
      CASE WHEN follow_up_date IS NOT NULL AND follow_up_notes <> '' THEN 'Follow-up Notes: ' || follow_up_notes END
    ) AS block
  FROM visit_rows),
summaries AS (
  SELECT patient_id,
    rtrim(ANY_VALUE(header) || chr(10) || chr(10) || STRING_AGG(block, chr(10) || chr(10) ORDER BY visit_date, visit_id),
      ' ' || chr(9) || chr(10) || chr(13)) AS summary_text,
    CAST(COUNT(*) AS INTEGER) AS visit_count
  FROM blocks GROUP BY patient_id)
"""

ORACLES = {
    "daily_revenue": with_clinic(_DAILY_REVENUE, _INVOICE_PARTS),
    "daily_revenue_sql": with_clinic(_DAILY_REVENUE, _INVOICE_PARTS),
    "operational_metrics": with_clinic(_OPERATIONAL, _DAY_COUNTS),
    "patient_profiles": with_clinic("SELECT * FROM profiles", _PROFILE_CTES),
    "risk_flags": with_clinic(
        "SELECT patient_id, unnest(string_split(risk_flags, ',')) AS risk_flag FROM profiles WHERE risk_flags <> ''",
        _PROFILE_CTES),
    "visit_gaps": with_clinic("""
        SELECT id AS visit_id, patient_id, created_date AS visit_date,
          LAG(created_date) OVER w AS previous_visit_date,
          CAST(created_date - LAG(created_date) OVER w AS INTEGER) AS gap_days
        FROM visits WINDOW w AS (PARTITION BY patient_id ORDER BY created_date, id)"""),
    "primary_department": with_clinic("SELECT * FROM primary_dept", _PROFILE_CTES),
    "primary_doctor": with_clinic("SELECT * FROM primary_doc", _PROFILE_CTES),
    "visit_rows": with_clinic("SELECT * FROM visit_rows", _VISIT_ROWS_CTES),
    "clinical_summaries": with_clinic(
        "SELECT patient_id, summary_text, visit_count, sha256(summary_text) AS summary_hash FROM summaries",
        _SUMMARY_CTES),
}
