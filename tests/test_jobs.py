"""Analytics jobs on the golden seed and on the trap cases."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from clinlytics.functions.core import age_years, sql_age_years
from clinlytics.operators import jobs
from tests import seed


def test_seed_daily_revenue(spark):
    t = seed.tables(spark)
    rows = jobs.daily_revenue(t).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.consultation_revenue == Decimal("500.00") and r.test_revenue == Decimal("200.00")
    assert r.total_revenue == Decimal("700.00") and r.paid_count == 1 and r.pending_count == 0
    assert r.department_name == "Cardiology" and r.date == seed.AS_OF


def test_seed_clinical_summary_text(spark):
    t = seed.tables(spark)
    rows = jobs.clinical_summaries(t, as_of=seed.AS_OF).collect()
    assert len(rows) == 1
    text = rows[0].summary_text
    follow = (seed.AS_OF + dt.timedelta(days=14)).isoformat()
    expected = "\n".join([
        "PATIENT: Ramesh Nayak | Age: 49 | Gender: Male | Blood Group: B+",
        "",
        f"VISIT 1 [{seed.AS_OF.isoformat()}]",
        "Dr. Rajesh Mohanty, Cardiology",
        "Symptoms: Chest pain and shortness of breath",
        "Diagnosis: Stable angina - recommend stress test and medication adjustment (ICD-10: I20.9)",
        "Prescription: Tab. Metoprolol 25mg BD, Tab. Aspirin 75mg OD",
        "Tests/Procedures: Cardiology Consultation (INR 500.00), ECG (INR 200.00)",
        "Billing: INR 700.00 (paid via cash)",
        f"Follow-up: {follow}",
        "Follow-up Notes: Review after stress test results",
    ])
    assert text == expected
    import hashlib
    assert rows[0].summary_hash == hashlib.sha256(text.encode()).hexdigest()
    assert rows[0].visit_count == 1


def test_zero_invoice_hides_billing_and_notes_need_date(spark):
    # T11, T12: a 0.00 invoice prints no Billing line; notes without a date print nothing
    rows = seed.seed_rows()
    v = list(rows["visits"][0])
    v[8] = None  # follow_up_date
    t = seed.tables(spark, {
        "visits": [tuple(v)],
        "billing_records": [(1, 1, 1, Decimal("0.00"), "paid", "cash", seed.AS_OF, seed.AS_OF)],
        "billing_items": [],
    })
    text = jobs.clinical_summaries(t, as_of=seed.AS_OF).collect()[0].summary_text
    assert "Billing:" not in text and "Tests/Procedures:" not in text
    assert "Follow-up" not in text


def test_age_on_leap_birthdays(spark):
    # T2: born 2004-02-29 is 20 on 2025-02-28 and 21 on 2025-03-01
    df = spark.createDataFrame([(dt.date(2004, 2, 29), dt.date(2025, 2, 28)), (dt.date(2004, 2, 29), dt.date(2025, 3, 1)),
                                (dt.date(2002, 3, 1), dt.date(2001, 7, 15))], "dob date, d date")
    out = df.select(age_years(F.col("dob"), F.col("d")).alias("py"),
                    sql_age_years(F.col("dob"), F.col("d")).alias("sql")).collect()
    assert [r.py for r in out] == [20, 21, -1]
    assert [r.sql for r in out] == [20, 21, 0]


def test_visit_gap_same_day_and_first(spark):
    # T6: two visits on one day give gap 0; the first visit has no gap
    rows = seed.seed_rows()
    base = rows["visits"][0]
    d0 = dt.date(2024, 1, 1)
    visits = [(i, i, 1, 1) + base[4:10] + (d,) for i, d in
              [(1, d0), (2, d0), (3, d0 + dt.timedelta(days=10))]]
    t = seed.tables(spark, {"visits": visits})
    gaps = {r.visit_id: r.gap_days for r in jobs.visit_gaps(t).collect()}
    assert gaps[1] is None and gaps[2] == 0 and gaps[3] == 10
    vs = jobs.visit_stats(t).collect()[0]
    assert vs.visit_frequency_days == Decimal("5.00") and vs.total_visits == 3


def test_visit_gaps_cross_month_slices(spark):
    rows = seed.seed_rows()
    base = rows["visits"][0]
    dates = [dt.date(2024, 1, 30), dt.date(2024, 3, 2), dt.date(2024, 3, 5), dt.date(2024, 7, 1)]
    visits = [(i + 1, i + 1, 1, 1) + base[4:10] + (d,) for i, d in enumerate(dates)]
    t = seed.tables(spark, {"visits": visits})
    gaps = sorted((r.visit_date, r.gap_days) for r in jobs.visit_gaps(t).collect())
    assert [g for _, g in gaps] == [None, 32, 3, 118]


def test_primary_department_tie_breaks_by_name(spark):
    # T5: one visit in each department -> the alphabetically first wins
    rows = seed.seed_rows()
    base = rows["visits"][0]
    visits = [(1, 1, 1, 1) + base[4:], (2, 2, 1, 2) + base[4:]]
    t = seed.tables(spark, {"visits": visits})
    r = jobs.primary_department(t).collect()[0]
    assert r.primary_department == "Cardiology" and r.visit_count == 1


def test_rates_exact_decimal(spark):
    t = seed.tables(spark)
    r = jobs.operational_metrics(t).where("doctor_id = 1").collect()[0]
    assert r.booked_slots == 2 and r.utilization_rate == Decimal("12.50")
    assert r.completion_rate == Decimal("50.00") and r.no_show_rate == Decimal("0.00")


def test_risk_flags_strict_and_never_visited(spark):
    t = seed.tables(spark)
    prof = {r.patient_id: r for r in jobs.patient_profiles(t, as_of=seed.AS_OF).collect()}
    assert list(prof[1].risk_flags) == []
    # never visited: last_visit_date NULL -> not flagged
    assert list(prof[2].risk_flags) == [] and prof[2].total_visits == 0
