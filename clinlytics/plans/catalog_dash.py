"""Registered queries and oracles: dashboard, lists, details, pagination."""
from __future__ import annotations

from pyspark.sql import functions as F

from clinlytics.operators import dashboard as db
from clinlytics.operators import lists as ls
from clinlytics.plans.oracle_base import DOCUMENTS_CATALOGUE, with_clinic
from clinlytics.sources.driver import clinic_tables
from clinlytics.sources.files import catalogue_files, documents_catalogue, list_documents

AS_OF = "DATE '2001-07-15'"
MONTH_START = "DATE '2001-07-01'"

# Parameters of the registered forms (each scans its whole tables).
PERIOD = "90days"
APPT_STATUS = "scheduled"
VISITS_FROM, VISITS_TO = "1996-01-01", "1997-12-31"
BILL_STATUS, BILL_FROM, BILL_TO = "pending", "1995-01-01", "1998-12-31"
PAGE_BILL = dict(status="paid", page=3, per_page=50)
SEARCH = "build"
PAGE_PAT = dict(page=2, per_page=25)


def _q(fn):
    def run(spark, sf_dir):
        return fn(clinic_tables(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


QUERIES = {
    "dashboard_summary": _q(db.dashboard_summary),
    "revenue_series": _q(lambda t: db.revenue_series(t, period=PERIOD)),
    "revenue_summary": _q(lambda t: db.revenue_summary(t, period=PERIOD)),
    "department_stats": _q(db.department_stats),
    "doctor_utilization": _q(db.doctor_utilization),
    "available_slots": _q(db.available_slots),
    "doctor_schedule": _q(db.doctor_schedule),
    "revenue_chart": _q(lambda t: db.revenue_chart(db.revenue_series(t, period=PERIOD))),
    "catalogue_files": lambda spark, sf_dir: catalogue_files(spark, f"{sf_dir.rstrip('/')}/*.parquet")
    .drop("file_path", "uploaded_at"),
    "list_documents": lambda spark, sf_dir: list_documents(
        documents_catalogue(clinic_tables(spark, sf_dir).driver("documents"))),
    "list_departments": _q(ls.list_departments),
    "list_doctors": _q(ls.list_doctors),
    "list_appointments": _q(lambda t: ls.list_appointments(t, status=APPT_STATUS)),
    "list_visits": _q(lambda t: ls.list_visits(t, date_from=VISITS_FROM, date_to=VISITS_TO)),
    "list_billing": _q(lambda t: ls.list_billing(t, BILL_STATUS, BILL_FROM, BILL_TO)),
    "page_billing": _q(lambda t: ls.page_billing(t, **PAGE_BILL)),
    "page_billing_pending": _q(lambda t: ls.pending_total(ls.page_billing(t, **PAGE_BILL))),
    "page_patients": _q(lambda t: ls.page_patients(t, SEARCH, **PAGE_PAT)),
    "search_patients": _q(lambda t: ls.search_patients(t, SEARCH)),
    "patient_visit_history": _q(ls.patient_visit_history),
    "lookup_patients": _q(lambda t: ls.lookup_patients(
        t, t.driver("orders").select(F.col("o_custkey").alias("id")))),
    "appointment_detail": _q(ls.appointment_detail),
    "visit_detail": _q(ls.visit_detail),
    "doctor_detail": _q(ls.doctor_detail),
    "patient_detail": _q(ls.patient_detail),
    "invoice_detail": _q(lambda t: ls.invoice_detail(t, items_as_text=True)),
}

_PY_AGE = (f"CAST(year({AS_OF}) - year(p.date_of_birth) - CASE WHEN month({AS_OF}) < month(p.date_of_birth) "
           f"OR (month({AS_OF}) = month(p.date_of_birth) AND day({AS_OF}) < day(p.date_of_birth)) "
           f"THEN 1 ELSE 0 END AS INTEGER)")

_DETAIL_CTES = f"""
appointment_detail AS (
  SELECT a.id, a.patient_id, p.first_name || ' ' || p.last_name AS patient_name, p.phone AS patient_phone,
    a.doctor_id, u.full_name AS doctor_name, a.department_id, d.name AS department_name,
    a.appointment_date, a.appointment_time, a.status
  FROM appointments a JOIN patients p ON p.id = a.patient_id JOIN doctors doc ON doc.id = a.doctor_id
  JOIN users u ON u.id = doc.user_id JOIN departments d ON d.id = a.department_id),
visit_detail AS (
  SELECT v.id, v.appointment_id, v.patient_id, p.first_name || ' ' || p.last_name AS patient_name,
    v.doctor_id, u.full_name AS doctor_name, d.name AS department_name, v.symptoms, v.diagnosis,
    v.diagnosis_code, v.prescription, v.follow_up_notes, v.follow_up_date, v.created_date AS created_at
  FROM visits v JOIN patients p ON p.id = v.patient_id JOIN doctors doc ON doc.id = v.doctor_id
  JOIN users u ON u.id = doc.user_id JOIN departments d ON d.id = doc.department_id),
doctor_detail AS (
  SELECT doc.id, doc.user_id, u.full_name, u.email, doc.department_id, d.name AS department_name, doc.is_active
  FROM doctors doc JOIN users u ON u.id = doc.user_id JOIN departments d ON d.id = doc.department_id),
patient_detail AS (
  SELECT p.id, p.first_name, p.last_name, p.first_name || ' ' || p.last_name AS full_name, p.date_of_birth,
    {_PY_AGE} AS age, p.gender, p.phone, p.blood_group, p.is_active, p.created_at
  FROM patients p),
invoice_detail AS (
  SELECT br.id, br.visit_id, br.patient_id, p.first_name || ' ' || p.last_name AS patient_name, br.total_amount,
    br.status, br.payment_method, br.payment_date,
    COALESCE((SELECT string_agg(CAST(i.item_no AS VARCHAR) || '|' || i.description || '|' || i.category || '|'
                                || CAST(i.amount AS VARCHAR), ';' ORDER BY i.item_no, i.description, i.category, i.amount)
              FROM billing_items i WHERE i.billing_record_id = br.id), '') AS items,
    br.created_date AS created_at
  FROM billing_records br JOIN patients p ON p.id = br.patient_id)
"""

_SLOTS = """
slots AS (SELECT i, lpad(CAST(9 + i // 2 AS VARCHAR), 2, '0') || ':' || CASE WHEN i % 2 = 0 THEN '00' ELSE '30' END AS slot
          FROM range(16) r(i))
"""

ORACLES = {
    "dashboard_summary": with_clinic(f"""
      SELECT {AS_OF} AS date, a.*, b.*, c.* FROM
      (SELECT COUNT(*) AS appointments_total,
              COUNT(*) FILTER (WHERE status = 'scheduled') AS appointments_scheduled,
              COUNT(*) FILTER (WHERE status = 'in_progress') AS appointments_in_progress,
              COUNT(*) FILTER (WHERE status = 'completed') AS appointments_completed,
              COUNT(*) FILTER (WHERE status = 'cancelled') AS appointments_cancelled
       FROM appointments WHERE appointment_date = {AS_OF}) a,
      (SELECT CAST(COALESCE(SUM(total_amount) FILTER (WHERE payment_date = {AS_OF} AND status = 'paid'), 0)
                   AS DECIMAL(12,2)) AS revenue_today,
              COUNT(*) FILTER (WHERE status = 'pending') AS pending_count,
              CAST(COALESCE(SUM(total_amount) FILTER (WHERE status = 'pending'), 0) AS DECIMAL(12,2)) AS pending_amount
       FROM billing_records) b,
      (SELECT COUNT(*) AS patients_active, COUNT(*) FILTER (WHERE created_at >= {MONTH_START}) AS patients_new_this_month
       FROM patients WHERE is_active) c"""),
    "revenue_series": with_clinic(f"""
      SELECT cal.d AS date,
        CAST(COALESCE(SUM(i.amount) FILTER (WHERE i.category = 'consultation'), 0) AS DECIMAL(12,2)) AS consultation,
        CAST(COALESCE(SUM(i.amount) FILTER (WHERE i.category = 'test'), 0) AS DECIMAL(12,2)) AS test,
        CAST(COALESCE(SUM(i.amount) FILTER (WHERE i.category = 'procedure'), 0) AS DECIMAL(12,2)) AS procedure,
        CAST(COALESCE(SUM(i.amount) FILTER (WHERE i.category = 'other'), 0) AS DECIMAL(12,2)) AS other,
        CAST(COALESCE(SUM(i.amount), 0) AS DECIMAL(12,2)) AS total
      FROM (SELECT CAST(g AS DATE) AS d FROM generate_series({AS_OF} - INTERVAL 90 DAY, {AS_OF} - INTERVAL 1 DAY,
            INTERVAL 1 DAY) t(g)) cal
      LEFT JOIN billing_records br ON br.payment_date = cal.d AND br.status = 'paid'
      LEFT JOIN billing_items i ON i.billing_record_id = br.id
      GROUP BY cal.d"""),
    "revenue_summary": with_clinic(f"""
      SELECT '90days' AS period, CAST({AS_OF} - INTERVAL 90 DAY AS DATE) AS start_date, {AS_OF} AS end_date,
        CAST(COALESCE(SUM(i.amount), 0) AS DECIMAL(12,2)) AS total,
        CAST(COALESCE(SUM(i.amount) FILTER (WHERE i.category = 'consultation'), 0) AS DECIMAL(12,2)) AS consultation,
        CAST(COALESCE(SUM(i.amount) FILTER (WHERE i.category IN ('test', 'procedure')), 0) AS DECIMAL(12,2))
          AS tests_and_procedures
      FROM billing_records br JOIN billing_items i ON i.billing_record_id = br.id
      WHERE br.status = 'paid' AND br.payment_date >= {AS_OF} - INTERVAL 90 DAY AND br.payment_date < {AS_OF}"""),
    "revenue_chart": with_clinic(f"""
      SELECT strftime(cal.d, '%m-%d') AS label, cal.d AS date,
        CAST(COALESCE(SUM(i.amount) FILTER (WHERE i.category = 'consultation'), 0) AS DECIMAL(12,2)) AS consultation,
        CAST(COALESCE(SUM(i.amount) FILTER (WHERE i.category = 'test'), 0) AS DECIMAL(12,2))
          + CAST(COALESCE(SUM(i.amount) FILTER (WHERE i.category = 'procedure'), 0) AS DECIMAL(12,2))
          AS tests_and_procedures
      FROM (SELECT CAST(g AS DATE) AS d FROM generate_series({AS_OF} - INTERVAL 90 DAY, {AS_OF} - INTERVAL 1 DAY,
            INTERVAL 1 DAY) t(g)) cal
      LEFT JOIN billing_records br ON br.payment_date = cal.d AND br.status = 'paid'
      LEFT JOIN billing_items i ON i.billing_record_id = br.id
      GROUP BY cal.d"""),
    "department_stats": with_clinic(f"""
      SELECT d.id AS department_id, d.name AS department_name, d.consultation_fee,
        COALESCE(a.n, 0) AS monthly_appointments, COALESCE(a.c, 0) AS monthly_completed,
        CASE WHEN COALESCE(a.n, 0) > 0 THEN round_even(CAST(a.c AS DOUBLE) / a.n * 100, 1) ELSE 0.0 END
          AS completion_rate,
        CAST(COALESCE(r.rev, 0) AS DECIMAL(12,2)) AS monthly_revenue
      FROM departments d
      LEFT JOIN (SELECT department_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE status = 'completed') AS c
                 FROM appointments WHERE appointment_date >= {MONTH_START} GROUP BY department_id) a
        ON a.department_id = d.id
      LEFT JOIN (SELECT ap.department_id, SUM(br.total_amount) AS rev FROM billing_records br
                 JOIN visits v ON v.id = br.visit_id JOIN appointments ap ON ap.id = v.appointment_id
                 WHERE br.status = 'paid' AND br.payment_date >= {MONTH_START} GROUP BY ap.department_id) r
        ON r.department_id = d.id
      WHERE d.is_active"""),
    "doctor_utilization": with_clinic(f"""
      SELECT doc.id AS doctor_id, u.full_name AS doctor_name, d.name AS department,
        COALESCE(a.n, 0) AS monthly_appointments, COALESCE(a.c, 0) AS monthly_completed,
        CASE WHEN wd.slots > 0 THEN round_even(CAST(COALESCE(a.n, 0) AS DOUBLE) / wd.slots * 100, 1) ELSE 0.0 END
          AS utilization_rate,
        CAST(COALESCE(r.rev, 0) AS DECIMAL(12,2)) AS monthly_revenue
      FROM doctors doc JOIN users u ON u.id = doc.user_id JOIN departments d ON d.id = doc.department_id
      CROSS JOIN (SELECT 16 * COUNT(*) AS slots FROM generate_series({MONTH_START}, {AS_OF}, INTERVAL 1 DAY) g(x)
                  WHERE isodow(x) < 7) wd
      LEFT JOIN (SELECT doctor_id, COUNT(*) FILTER (WHERE status NOT IN ('cancelled', 'no_show')) AS n,
                        COUNT(*) FILTER (WHERE status = 'completed') AS c
                 FROM appointments WHERE appointment_date >= {MONTH_START} GROUP BY doctor_id) a ON a.doctor_id = doc.id
      LEFT JOIN (SELECT v.doctor_id, SUM(br.total_amount) AS rev FROM billing_records br
                 JOIN visits v ON v.id = br.visit_id
                 WHERE br.status = 'paid' AND br.payment_date >= {MONTH_START} GROUP BY v.doctor_id) r
        ON r.doctor_id = doc.id
      WHERE doc.is_active"""),
    "available_slots": with_clinic("""
      SELECT q.doctor_id, q.date, s.slot FROM
        (SELECT DISTINCT a.doctor_id, a.appointment_date AS date FROM appointments a
         JOIN doctors d ON d.id = a.doctor_id WHERE d.is_active) q
      CROSS JOIN slots s
      WHERE NOT EXISTS (SELECT 1 FROM appointments b WHERE b.doctor_id = q.doctor_id AND b.appointment_date = q.date
                        AND b.appointment_time = s.slot AND b.status NOT IN ('cancelled', 'no_show'))""",
                                 _SLOTS),
    "doctor_schedule": with_clinic("""
      SELECT *, ROW_NUMBER() OVER (PARTITION BY doctor_id, appointment_date ORDER BY appointment_time, id) AS slot_no
      FROM appointment_detail""", _DETAIL_CTES),
    "list_documents": f"SELECT * EXCLUDE (accepted) FROM ({DOCUMENTS_CATALOGUE}) WHERE accepted",
    "list_departments": with_clinic(
        "SELECT id, name, consultation_fee, is_active FROM departments WHERE is_active ORDER BY name, id"),
    "list_doctors": with_clinic("SELECT * FROM doctor_detail WHERE is_active", _DETAIL_CTES),
    "list_appointments": with_clinic(
        f"SELECT * FROM appointment_detail WHERE status = '{APPT_STATUS}'", _DETAIL_CTES),
    "list_visits": with_clinic(
        f"SELECT * FROM visit_detail WHERE CAST(created_at AS TIMESTAMP) >= TIMESTAMP '{VISITS_FROM} 00:00:00' "
        f"AND CAST(created_at AS TIMESTAMP) <= TIMESTAMP '{VISITS_TO} 00:00:00'", _DETAIL_CTES),
    "list_billing": with_clinic(
        f"SELECT * FROM invoice_detail WHERE status = '{BILL_STATUS}' "
        f"AND CAST(created_at AS TIMESTAMP) >= TIMESTAMP '{BILL_FROM} 00:00:00' "
        f"AND CAST(created_at AS TIMESTAMP) <= TIMESTAMP '{BILL_TO} 00:00:00'", _DETAIL_CTES),
    "page_billing": with_clinic(
        f"""SELECT b.*, t.total, 3 AS page, 50 AS per_page, CAST(ceil(t.total / 50) AS BIGINT) AS pages
            FROM (SELECT * FROM invoice_detail WHERE status = 'paid' ORDER BY created_at DESC, id DESC
                  LIMIT 50 OFFSET 100) b,
                 (SELECT COUNT(*) AS total FROM invoice_detail WHERE status = 'paid') t""", _DETAIL_CTES),
    "page_patients": with_clinic(
        f"""SELECT b.*, t.total, 2 AS page, 25 AS per_page, CAST(ceil(t.total / 25) AS BIGINT) AS pages
            FROM (SELECT * FROM matched ORDER BY last_name, first_name, id LIMIT 25 OFFSET 25) b,
                 (SELECT COUNT(*) AS total FROM matched) t""",
        _DETAIL_CTES + f""", matched AS (SELECT * FROM patient_detail WHERE is_active AND
              (first_name ILIKE '%{SEARCH}%' OR last_name ILIKE '%{SEARCH}%' OR phone ILIKE '%{SEARCH}%'))"""),
    "search_patients": with_clinic(
        f"""SELECT * FROM patient_detail WHERE is_active AND
              (first_name ILIKE '%{SEARCH}%' OR last_name ILIKE '%{SEARCH}%' OR phone ILIKE '%{SEARCH}%')""",
        _DETAIL_CTES),
    "patient_visit_history": with_clinic("""
      SELECT v.*, ROW_NUMBER() OVER (PARTITION BY v.patient_id ORDER BY v.created_at DESC, v.id DESC) AS ordinal,
        CAST(ceil(ROW_NUMBER() OVER (PARTITION BY v.patient_id ORDER BY v.created_at DESC, v.id DESC) / 20) AS BIGINT)
          AS page
      FROM visit_detail v JOIN patients p ON p.id = v.patient_id WHERE p.is_active""", _DETAIL_CTES),
    "lookup_patients": with_clinic("""
      SELECT q.id, p.first_name, p.last_name, p.full_name, p.date_of_birth, p.age, p.gender, p.phone,
        p.blood_group, p.is_active, p.created_at, p.id IS NOT NULL AS found
      FROM (SELECT DISTINCT o_custkey AS id FROM orders) q
      LEFT JOIN (SELECT * FROM patient_detail WHERE is_active) p ON p.id = q.id""", _DETAIL_CTES),
    "appointment_detail": with_clinic("SELECT * FROM appointment_detail", _DETAIL_CTES),
    "visit_detail": with_clinic("SELECT * FROM visit_detail", _DETAIL_CTES),
    "doctor_detail": with_clinic("SELECT * FROM doctor_detail", _DETAIL_CTES),
    "patient_detail": with_clinic("SELECT * FROM patient_detail", _DETAIL_CTES),
    "invoice_detail": with_clinic("SELECT * FROM invoice_detail", _DETAIL_CTES),
}
ORACLES["page_billing_pending"] = f"""SELECT count(*) FILTER (status = 'pending') AS pending_invoices, CAST(coalesce(sum(total_amount) FILTER (status = 'pending'), 0) AS DECIMAL(12,2)) AS pending_total,
    count(*) AS invoices FROM ({ORACLES['page_billing']})"""
