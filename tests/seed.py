"""The golden seed clinic (FIXTURES.md §1) as DataFrames."""
import datetime as dt
from decimal import Decimal

from clinlytics.sources.driver import ClinicTables

AS_OF = dt.date(2025, 3, 10)

SCHEMAS = {
    "departments": "id int, name string, consultation_fee decimal(10,2), is_active boolean",
    "users": "id bigint, email string, full_name string, role string, is_active boolean",
    "doctors": "id bigint, user_id bigint, department_id int, is_active boolean",
    "patients": ("id bigint, first_name string, last_name string, date_of_birth date, gender string, "
                 "phone string, blood_group string, is_active boolean, created_at date"),
    "appointments": ("id bigint, patient_id bigint, doctor_id bigint, department_id int, appointment_date date, "
                     "appointment_time string, status string"),
    "visits": ("id bigint, appointment_id bigint, patient_id bigint, doctor_id bigint, symptoms string, "
               "diagnosis string, diagnosis_code string, prescription string, follow_up_date date, "
               "follow_up_notes string, created_date date"),
    "billing_items": "billing_record_id bigint, item_no int, description string, category string, amount decimal(10,2)",
    "billing_records": ("id bigint, visit_id bigint, patient_id bigint, total_amount decimal(10,2), status string, "
                        "payment_method string, payment_date date, created_date date"),
}


def seed_rows(as_of=AS_OF):
    return {
        "departments": [(1, "Cardiology", Decimal("500.00"), True), (2, "Gastroenterology", Decimal("500.00"), True),
                        (3, "Hepatology", Decimal("600.00"), True), (4, "General Medicine", Decimal("300.00"), True)],
        "users": [(1, "admin@clinic", "Admin User", "admin", True),
                  (2, "rajesh@clinic", "Dr. Rajesh Mohanty", "doctor", True),
                  (3, "priya@clinic", "Dr. Priya Patel", "doctor", True),
                  (4, "anita@clinic", "Anita Das", "front_desk", True)],
        "doctors": [(1, 2, 1, True), (2, 3, 2, True)],
        "patients": [(1, "Ramesh", "Nayak", dt.date(1975, 4, 12), "male", "9876543210", "B+", True, as_of),
                     (2, "Priya", "Sahoo", dt.date(1990, 8, 22), "female", "9876543211", "O+", True, as_of),
                     (3, "Bikram", "Das", dt.date(1965, 1, 5), "male", "9876543212", "A+", True, as_of)],
        "appointments": [(1, 1, 1, 1, as_of, "09:00", "completed"), (2, 2, 2, 2, as_of, "10:00", "scheduled"),
                         (3, 3, 1, 1, as_of, "11:00", "scheduled")],
        "visits": [(1, 1, 1, 1, "Chest pain and shortness of breath",
                    "Stable angina - recommend stress test and medication adjustment", "I20.9",
                    "Tab. Metoprolol 25mg BD, Tab. Aspirin 75mg OD", as_of + dt.timedelta(days=14),
                    "Review after stress test results", as_of)],
        "billing_items": [(1, 0, "Cardiology Consultation", "consultation", Decimal("500.00")),
                          (1, 1, "ECG", "test", Decimal("200.00"))],
        "billing_records": [(1, 1, 1, Decimal("700.00"), "paid", "cash", as_of, as_of)],
    }


def tables(spark, overrides=None, as_of=AS_OF):
    rows = seed_rows(as_of)
    rows.update(overrides or {})
    t = ClinicTables(spark, "/root/testdata/sf0.001")
    for name, schema in SCHEMAS.items():
        t[name] = spark.createDataFrame(rows[name], schema)
    return t
