"""Synthetic clinic data at any size, generated in parallel.

Every random choice is a hash of (row key, purpose), so the output does not
depend on partitioning or task retries. Phones are a bijection of the
patient id (unique by construction) and each appointment k gets the slot
(doctor = k mod D, slot and day from k div D), so no slot is double-booked.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from clinlytics.sources.driver import ClinicTables

# Weights of the generated distributions (percent).
APPOINTMENT_STATUS_WEIGHTS = (("scheduled", 20), ("completed", 60), ("cancelled", 10), ("no_show", 10))
BLOOD_GROUP_WEIGHTS = (("A+", 28), ("A-", 6), ("B+", 23), ("B-", 5), ("O+", 30), ("O-", 3), ("AB+", 8), ("AB-", 2))
GENDER_WEIGHTS = (("male", 52), ("female", 48))
PAYMENT_WEIGHTS = (("cash", 50), ("card", 15), ("upi", 30), ("insurance", 5))
DEPARTMENTS = (("Cardiology", 500), ("Gastroenterology", 500), ("Hepatology", 600), ("General Medicine", 300))


def _u(key: Column, purpose: str, seed: int) -> Column:
    """Uniform integer 0..9999 from a key and a purpose."""
    return F.pmod(F.xxhash64(key, F.lit(purpose), F.lit(seed)), F.lit(10000))


def weighted(key: Column, purpose: str, choices, seed: int) -> Column:
    total = sum(w for _, w in choices)
    u = _u(key, purpose, seed) * total / 10000
    out, acc = None, 0
    for value, w in choices:
        acc += w
        out = F.when(u < acc, F.lit(value)) if out is None else out.when(u < acc, F.lit(value))
    return out.otherwise(F.lit(choices[-1][0]))


def generate_clinic(spark: SparkSession, n_patients: int, n_doctors: int = 20, start=dt.date(2024, 1, 1),
                    seed: int = 42) -> ClinicTables:
    t = ClinicTables(spark, "")
    t["departments"] = spark.createDataFrame(
        [(i + 1, n, float(f), True) for i, (n, f) in enumerate(DEPARTMENTS)],
        "id int, name string, consultation_fee double, is_active boolean") \
        .withColumn("consultation_fee", F.col("consultation_fee").cast("decimal(10,2)"))
    docs = spark.range(1, n_doctors + 1).select(F.col("id"))
    t["users"] = docs.select("id", F.concat(F.lit("doctor"), F.col("id").cast("string"), F.lit("@clinic")).alias("email"),
                             F.concat(F.lit("Dr. Doctor "), F.col("id").cast("string")).alias("full_name"),
                             F.lit("doctor").alias("role"), F.lit(True).alias("is_active"))
    t["doctors"] = docs.select("id", F.col("id").alias("user_id"),
                               (F.pmod(F.col("id") - 1, F.lit(len(DEPARTMENTS))) + 1).cast("int").alias("department_id"),
                               F.lit(True).alias("is_active"))
    p = spark.range(1, n_patients + 1)
    pid = F.col("id")
    t["patients"] = p.select(
        pid, F.concat(F.lit("First"), pid.cast("string")).alias("first_name"),
        F.concat(F.lit("Last"), pid.cast("string")).alias("last_name"),
        F.date_sub(F.lit(start), (_u(pid, "age", seed) * 3 + 6570).cast("int")).alias("date_of_birth"),
        weighted(pid, "gender", GENDER_WEIGHTS, seed).alias("gender"),
        F.concat(F.lit("9"), F.lpad(pid.cast("string"), 9, "0")).alias("phone"),
        weighted(pid, "blood", BLOOD_GROUP_WEIGHTS, seed).alias("blood_group"),
        (_u(pid, "active", seed) >= 200).alias("is_active"),
        F.date_add(F.lit(start), F.pmod(_u(pid, "created", seed), F.lit(365)).cast("int")).alias("created_at"))
    # 1..4 appointments per patient; appointment key k = patient * 4 + j is unique
    a = p.select(F.col("id").alias("patient_id"),
                 F.explode(F.sequence(F.lit(0), F.pmod(_u(pid, "n_appts", seed), F.lit(4)))).alias("j"))
    k = F.col("patient_id") * 4 + F.col("j")
    rest = F.floor(k / n_doctors)
    a = a.select(k.alias("id"), "patient_id", (F.pmod(k, F.lit(n_doctors)) + 1).alias("doctor_id"),
                 F.date_add(F.lit(start), F.floor(rest / 16).cast("int")).alias("appointment_date"),
                 F.concat(F.lpad((F.lit(9) + F.floor(F.pmod(rest, F.lit(16)) / 2)).cast("string"), 2, "0"),
                          F.when(F.pmod(rest, F.lit(2)) == 0, ":00").otherwise(":30")).alias("appointment_time"),
                 weighted(k, "status", APPOINTMENT_STATUS_WEIGHTS, seed).alias("status"))
    a = a.join(F.broadcast(t["doctors"].select(F.col("id").alias("doctor_id"), "department_id")), "doctor_id")
    t["appointments"] = a.select("id", "patient_id", "doctor_id", "department_id", "appointment_date",
                                 "appointment_time", "status")
    v = t["appointments"].where(F.col("status") == "completed")
    vid = F.col("id")
    t["visits"] = v.select(
        vid, vid.alias("appointment_id"), "patient_id", "doctor_id",
        F.concat(F.lit("symptom "), F.pmod(_u(vid, "sym", seed), F.lit(12)).cast("string")).alias("symptoms"),
        F.concat(F.lit("diagnosis "), F.pmod(_u(vid, "dx", seed), F.lit(18)).cast("string")).alias("diagnosis"),
        F.concat(F.lit("K"), (F.pmod(_u(vid, "dx", seed), F.lit(18)) + 20).cast("string"), F.lit(".0"))
        .alias("diagnosis_code"),
        F.concat(F.lit("Tab. "), F.pmod(_u(vid, "rx", seed), F.lit(10)).cast("string")).alias("prescription"),
        F.when(_u(vid, "fu", seed) >= 5000, F.date_add("appointment_date", 14)).alias("follow_up_date"),
        F.when(_u(vid, "fu", seed) >= 7500, F.lit("review")).alias("follow_up_notes"),
        F.col("appointment_date").alias("created_date"))
    dep = F.broadcast(t["departments"].select(F.col("id").alias("department_id"), "name", "consultation_fee"))
    cons = v.join(dep, "department_id").select(
        F.col("id").alias("billing_record_id"), F.lit(0).alias("item_no"),
        F.concat(F.col("name"), F.lit(" Consultation")).alias("description"), F.lit("consultation").alias("category"),
        F.col("consultation_fee").alias("amount"))
    n_tests = F.when(_u(vid, "tests", seed) >= 4000, F.pmod(_u(vid, "ntests", seed), F.lit(3)) + 1).otherwise(0)
    tests = v.select(F.col("id").alias("billing_record_id"), F.explode(F.sequence(F.lit(1), n_tests)).alias("item_no")) \
        .where(F.col("item_no") >= 1)
    tk = F.col("billing_record_id") * 10 + F.col("item_no")
    tests = tests.select("billing_record_id", F.col("item_no").cast("int"),
                         F.concat(F.lit("Test "), F.pmod(_u(tk, "test", seed), F.lit(14)).cast("string")).alias("description"),
                         F.lit("test").alias("category"),
                         ((F.pmod(_u(tk, "price", seed), F.lit(20)) + 1) * 100).cast("decimal(10,2)").alias("amount"))
    t["billing_items"] = cons.unionByName(tests)
    tot = t["billing_items"].groupBy(F.col("billing_record_id").alias("id")).agg(
        F.sum("amount").cast("decimal(10,2)").alias("total_amount"))
    st = weighted(vid, "bill", (("paid", 60), ("pending", 30), ("partially_paid", 10)), seed)
    b = v.select(vid, vid.alias("visit_id"), "patient_id", st.alias("status"), "appointment_date").join(tot, "id")
    paid = F.col("status") == "paid"
    t["billing_records"] = b.select(
        "id", "visit_id", "patient_id", "total_amount", "status",
        F.when(paid, weighted(vid, "method", PAYMENT_WEIGHTS, seed)).alias("payment_method"),
        F.when(paid, F.col("appointment_date")).alias("payment_date"), F.col("appointment_date").alias("created_date"))
    return t
