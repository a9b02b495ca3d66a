"""The four analytics jobs: daily revenue, operational metrics, patient
profiles and clinical summaries.

Each job is a pure function ``f(tables, as_of=None, **params) -> DataFrame``
over the clinic tables. Plans aggregate before they join, so fact rows are
reduced map-side and only one row per group crosses the shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinlytics.functions.core import (as_of_lit, capitalize, money, pct, sql_age_years,
                                       strip_ws, truthy_text)

# The item categories and risk rules of the analytics jobs.
CATEGORIES = ("consultation", "test", "procedure", "other")
RISK_DEFAULTS = {
    "no_show_rate_gt": 30,
    "visit_gap_days_gt": 180,
    "outstanding_gt": 5000,
    "inactive_days": 365,
}
SLOTS_PER_DAY = 16


def _dim(df: DataFrame) -> DataFrame:
    """Departments: a clinic has a handful (5 rows here), a proven bound."""
    return F.broadcast(df)


# ---------------------------------------------------------------- J1 ----
def daily_revenue(t, as_of=None) -> DataFrame:
    """Revenue per (payment date, department) with per-category sums.

    Items are first summed per invoice (partial aggregation on the item
    scan), so the joins carry one row per invoice, and the per-day count of
    distinct invoices becomes a plain conditional count.
    """
    amt, cat = F.col("amount"), F.col("category")
    per_invoice = t["billing_items"].groupBy("billing_record_id").agg(
        *[F.sum(F.when(cat == c, amt)).alias(f"_{c}") for c in CATEGORIES],
        F.sum(amt).alias("_total"),
    )
    br = (t["billing_records"].where(F.col("payment_date").isNotNull())
          .select(F.col("id").alias("billing_record_id"), "visit_id", "status", "payment_date"))
    v = t["visits"].select(F.col("id").alias("visit_id"), "appointment_id")
    a = t["appointments"].select(F.col("id").alias("appointment_id"), "department_id")
    d = t["departments"].select(F.col("id").alias("department_id"), F.col("name").alias("department_name"))
    j = (per_invoice.join(br, "billing_record_id").join(v, "visit_id")
         .join(a, "appointment_id").join(_dim(d), "department_id"))
    st = F.col("status")
    return j.groupBy(F.col("payment_date").alias("date"), "department_id", "department_name").agg(
        *[money(F.sum(f"_{c}")).alias(f"{c}_revenue") for c in CATEGORIES],
        money(F.sum("_total")).alias("total_revenue"),
        F.count_if(st == "paid").alias("paid_count"),
        F.count_if(st == "pending").alias("pending_count"),
    )


# ---------------------------------------------------------------- J2 ----
def operational_metrics(t, as_of=None, slots_per_day: int = SLOTS_PER_DAY) -> DataFrame:
    """Appointment funnel per (date, doctor); department from the appointment."""
    st = F.col("status")
    per_day = t["appointments"].groupBy(
        F.col("appointment_date").alias("date"), "doctor_id", "department_id").agg(
        F.count(F.lit(1)).alias("booked_slots"),
        F.count_if(st == "completed").alias("completed"),
        F.count_if(st == "cancelled").alias("cancelled"),
        F.count_if(st == "no_show").alias("no_show"),
        F.count_if(st != "cancelled").alias("_not_cancelled"),
    )
    doc = t["doctors"].select(F.col("id").alias("doctor_id"), "user_id")
    u = t["users"].select(F.col("id").alias("user_id"), F.col("full_name").alias("doctor_name"))
    d = t["departments"].select(F.col("id").alias("department_id"), F.col("name").alias("department_name"))
    j = per_day.join(doc, "doctor_id").join(u, "user_id").join(_dim(d), "department_id")
    return j.select(
        "date", "doctor_id", "department_id", "department_name", "doctor_name",
        F.lit(slots_per_day).alias("total_slots"),
        "booked_slots", "completed", "cancelled", "no_show",
        pct(F.col("booked_slots"), F.lit(slots_per_day)).alias("utilization_rate"),
        pct(F.col("completed"), F.col("_not_cancelled")).alias("completion_rate"),
        pct(F.col("no_show"), F.col("booked_slots")).alias("no_show_rate"),
    )


# ---------------------------------------------------------------- J3 ----
def visit_stats(t) -> DataFrame:
    """Per patient: visit count, first/last visit, mean gap between visits.

    The mean of consecutive day gaps telescopes to (last - first) / (n - 1),
    so no per-patient window (and no per-patient sort) is needed: the whole
    thing is a partial aggregate, safe for a patient with millions of visits.
    """
    v = t["visits"]
    s = v.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("total_visits"),
        F.min("created_date").alias("first_visit_date"),
        F.max("created_date").alias("last_visit_date"),
    )
    span = F.datediff("last_visit_date", "first_visit_date").cast("decimal(20,0)")
    gaps = (F.col("total_visits") - 1).cast("decimal(20,0)")
    return s.withColumn(
        "visit_frequency_days",
        F.when(F.col("total_visits") > 1, F.round(span / gaps, 2)).cast("decimal(10,2)"))


def visit_gaps(t) -> DataFrame:
    """Days since the previous visit of the same patient (LAG), per visit.

    Visits are cut into (patient, month) slices so a very active patient is
    spread over many tasks; the predecessor of a slice's first visit is the
    last visit of the patient's previous non-empty slice, found by a second,
    much smaller window over one row per slice.
    """
    from pyspark.sql import Window
    v = t["visits"].select("id", "patient_id", "created_date").withColumn(
        "_slice", F.trunc("created_date", "month"))
    w_in = Window.partitionBy("patient_id", "_slice").orderBy("created_date", "id")
    v = v.withColumn("_prev_in", F.lag("created_date").over(w_in))
    slices = v.groupBy("patient_id", "_slice").agg(F.max("created_date").alias("_slice_last"))
    w_sl = Window.partitionBy("patient_id").orderBy("_slice")
    slices = slices.withColumn("_prev_slice_last", F.lag("_slice_last").over(w_sl)).drop("_slice_last")
    j = v.join(slices, ["patient_id", "_slice"])
    prev = F.coalesce(F.col("_prev_in"), F.col("_prev_slice_last"))
    return j.select(
        F.col("id").alias("visit_id"), "patient_id", F.col("created_date").alias("visit_date"),
        prev.alias("previous_visit_date"),
        F.datediff(F.col("created_date"), prev).alias("gap_days"),
    )


def billing_stats(t) -> DataFrame:
    b = t["billing_records"]
    amt, st = F.col("total_amount"), F.col("status")
    return b.groupBy("patient_id").agg(
        money(F.sum(amt)).alias("total_billed"),
        money(F.sum(F.when(st == "paid", amt).otherwise(0))).alias("total_paid"),
        money(F.sum(F.when(st.isin("pending", "partially_paid"), amt).otherwise(0))).alias("outstanding_balance"),
    )


def appointment_stats(t) -> DataFrame:
    a = t["appointments"]
    s = a.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("total_appointments"),
        F.count_if(F.col("status") == "no_show").alias("no_show_count"),
    )
    return s.withColumn("no_show_rate", pct(F.col("no_show_count"), F.col("total_appointments")))


def _most_frequent(pairs: DataFrame, value: str) -> DataFrame:
    """Per patient, the value seen most often; ties go to the smaller value.

    Two partial aggregates (count per pair, then min of (-count, value)),
    no window, so a patient with huge history never forms one sorted group.
    """
    counts = pairs.groupBy("patient_id", value).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy("patient_id").agg(
        F.min(F.struct((-F.col("_n")).alias("neg_n"), F.col(value).alias("v"))).alias("_best"))
    return best.select("patient_id", F.col("_best.v").alias(value), (-F.col("_best.neg_n")).alias("visit_count"))


def primary_department(t) -> DataFrame:
    """Most visited department per patient (department of the visit's doctor)."""
    v = t["visits"].select("patient_id", "doctor_id")
    doc = t["doctors"].select(F.col("id").alias("doctor_id"), "department_id")
    d = t["departments"].select(F.col("id").alias("department_id"), F.col("name").alias("primary_department"))
    pairs = v.join(doc, "doctor_id").join(_dim(d), "department_id")
    return _most_frequent(pairs, "primary_department")


def primary_doctor(t) -> DataFrame:
    """Most seen doctor (by name) per patient."""
    v = t["visits"].select("patient_id", "doctor_id")
    doc = t["doctors"].select(F.col("id").alias("doctor_id"), "user_id")
    u = t["users"].select(F.col("id").alias("user_id"), F.col("full_name").alias("primary_doctor"))
    pairs = v.join(doc, "doctor_id").join(u, "user_id")
    return _most_frequent(pairs, "primary_doctor")


def risk_flag_array(rules: dict | None = None, as_of=None):
    r = {**RISK_DEFAULTS, **(rules or {})}
    asof = as_of_lit(as_of)
    return F.array_compact(F.array(
        F.when(F.coalesce(F.col("no_show_rate"), F.lit(0)) > r["no_show_rate_gt"], F.lit("high_no_show_rate")),
        F.when(F.coalesce(F.col("visit_frequency_days"), F.lit(0)) > r["visit_gap_days_gt"],
               F.lit("infrequent_visits")),
        F.when(F.coalesce(F.col("outstanding_balance"), F.lit(0)) > r["outstanding_gt"],
               F.lit("high_outstanding_balance")),
        F.when(F.col("last_visit_date") < F.date_sub(asof, r["inactive_days"]), F.lit("no_visit_in_year")),
    ))


def patient_profiles(t, as_of=None, rules: dict | None = None) -> DataFrame:
    """One row per active patient with visit, billing and appointment stats.

    All five per-patient aggregates are hash-partitioned on patient_id, so
    the left joins reuse that partitioning: only the patients side shuffles.
    """
    p = t["patients"].where(F.col("is_active"))
    asof = as_of_lit(as_of)
    j = (p.join(visit_stats(t), p.id == F.col("patient_id"), "left").drop("patient_id")
         .join(billing_stats(t).withColumnRenamed("patient_id", "_b"), F.col("id") == F.col("_b"), "left")
         .join(appointment_stats(t).withColumnRenamed("patient_id", "_a"), F.col("id") == F.col("_a"), "left")
         .join(primary_department(t).select(F.col("patient_id").alias("_d"), "primary_department"),
               F.col("id") == F.col("_d"), "left")
         .join(primary_doctor(t).select(F.col("patient_id").alias("_o"), "primary_doctor"),
               F.col("id") == F.col("_o"), "left"))
    zero = F.lit(0)
    return j.select(
        F.col("id").alias("patient_id"),
        F.concat(F.col("first_name"), F.lit(" "), F.col("last_name")).alias("full_name"),
        sql_age_years("date_of_birth", asof).alias("age"),
        "gender", "blood_group", "phone",
        F.coalesce("total_visits", zero.cast("bigint")).alias("total_visits"),
        "first_visit_date", "last_visit_date", "visit_frequency_days",
        money(F.col("total_billed")).alias("total_billed"),
        money(F.col("total_paid")).alias("total_paid"),
        money(F.col("outstanding_balance")).alias("outstanding_balance"),
        F.coalesce("total_appointments", zero.cast("bigint")).alias("total_appointments"),
        F.coalesce("no_show_count", zero.cast("bigint")).alias("no_show_count"),
        F.coalesce("no_show_rate", zero.cast("decimal(5,2)")).alias("no_show_rate"),
        "primary_department", "primary_doctor",
        risk_flag_array(rules, as_of).alias("risk_flags"),
    )


# ---------------------------------------------------------------- J4 ----
def line_items_text(t) -> DataFrame:
    """Per invoice: 'desc (INR 500.00), desc (INR 200.00)' in item order."""
    items = t["billing_items"].select(
        "billing_record_id", "item_no",
        F.concat(F.col("description"), F.lit(" (INR "), F.col("amount").cast("string"), F.lit(")")).alias("_txt"))
    return items.groupBy("billing_record_id").agg(
        F.expr("listagg(_txt, ', ') WITHIN GROUP (ORDER BY item_no)").alias("line_items"))


def visit_rows(t, as_of=None) -> DataFrame:
    """One row per visit of an active patient with everything its text needs."""
    asof = as_of_lit(as_of)
    p = t["patients"].where(F.col("is_active")).select(
        F.col("id").alias("patient_id"),
        F.concat(F.col("first_name"), F.lit(" "), F.col("last_name")).alias("full_name"),
        sql_age_years("date_of_birth", asof).alias("age"), "gender", "blood_group", "phone")
    v = t["visits"].select(
        F.col("id").alias("visit_id"), "patient_id", "doctor_id", F.col("created_date").alias("visit_date"),
        "symptoms", "diagnosis", "diagnosis_code", "prescription", "follow_up_date", "follow_up_notes")
    doc = t["doctors"].select(F.col("id").alias("doctor_id"), "user_id", "department_id")
    u = t["users"].select(F.col("id").alias("user_id"), F.col("full_name").alias("doctor_name"))
    d = t["departments"].select(F.col("id").alias("department_id"), F.col("name").alias("department_name"))
    br = t["billing_records"].select(
        F.col("id").alias("billing_record_id"), "visit_id", F.col("total_amount").alias("billing_amount"),
        F.col("status").alias("billing_status"), "payment_method")
    li = line_items_text(t)
    # invoices join on visit_id first, patients last: the patient_id
    # partitioning of that join is reused by the per-patient aggregation
    j = (v.join(br.join(li, "billing_record_id", "left"), "visit_id", "left")
         .join(doc, "doctor_id").join(u, "user_id").join(_dim(d), "department_id")
         .join(p, "patient_id"))
    return j.select(
        "patient_id", "full_name", "age", "gender", "blood_group", "phone", "visit_id", "visit_date",
        "doctor_name", "department_name", "symptoms", "diagnosis", "diagnosis_code", "prescription",
        "follow_up_date", "follow_up_notes", "billing_amount", "billing_status", "payment_method",
        F.coalesce(F.col("line_items"), F.lit("")).alias("line_items"))


def _py_str(c):
    """How a Python f-string prints an optional value: None -> 'None'."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def visit_block(rows: DataFrame) -> DataFrame:
    """The text lines of one visit (without its 'VISIT i [date]' line)."""
    c = F.col
    amount_truthy = c("billing_amount").isNotNull() & (c("billing_amount") != 0)
    method = c("payment_method")
    lines = F.array_compact(F.array(
        F.concat(_py_str(c("doctor_name")), F.lit(", "), _py_str(c("department_name"))),
        F.when(truthy_text(c("symptoms")), F.concat(F.lit("Symptoms: "), c("symptoms"))),
        F.concat(F.lit("Diagnosis: "), _py_str(c("diagnosis")),
                 F.when(truthy_text(c("diagnosis_code")),
                        F.concat(F.lit(" (ICD-10: "), c("diagnosis_code"), F.lit(")"))).otherwise(F.lit(""))),
        F.when(truthy_text(c("prescription")), F.concat(F.lit("Prescription: "), c("prescription"))),
        F.when(truthy_text(c("line_items")), F.concat(F.lit("Tests/Procedures: "), c("line_items"))),
        F.when(amount_truthy, F.concat(
            F.lit("Billing: INR "), c("billing_amount").cast("string"), F.lit(" ("),
            F.coalesce(F.nullif(c("billing_status"), F.lit("")), F.lit("unknown")),
            F.when(truthy_text(method), F.concat(F.lit(" via "), method)).otherwise(F.lit("")),
            F.lit(")"))),
        F.when(c("follow_up_date").isNotNull(),
               F.concat(F.lit("Follow-up: "), F.date_format("follow_up_date", "yyyy-MM-dd"))),
        F.when(c("follow_up_date").isNotNull() & truthy_text(c("follow_up_notes")),
               F.concat(F.lit("Follow-up Notes: "), c("follow_up_notes"))),
    ))
    return rows.withColumn("_block", F.array_join(lines, "\n"))


def clinical_summaries(t, as_of=None) -> DataFrame:
    """One text summary per active patient with at least one visit.

    Visit blocks are built per visit in parallel; the per-patient step only
    orders (date, visit id, block) structs and numbers them inside the array.
    """
    rows = visit_block(visit_rows(t, as_of))
    header = F.concat(
        F.lit("PATIENT: "), _py_str(F.col("full_name")),
        F.lit(" | Age: "), _py_str(F.col("age")),
        F.lit(" | Gender: "), _py_str(capitalize(F.col("gender"))),
        F.lit(" | Blood Group: "), F.coalesce(F.nullif(F.col("blood_group"), F.lit("")), F.lit("Unknown")))
    per_patient = rows.groupBy("patient_id").agg(
        F.first(header).alias("_header"),
        F.sort_array(F.collect_list(F.struct("visit_date", "visit_id", "_block"))).alias("_visits"),
        F.count(F.lit(1)).alias("visit_count"),
    )
    numbered = F.transform(
        F.col("_visits"),
        lambda x, i: F.concat(F.lit("VISIT "), (i + 1).cast("string"), F.lit(" ["),
                              F.date_format(x["visit_date"], "yyyy-MM-dd"), F.lit("]\n"), x["_block"]))
    text = strip_ws(F.concat(F.col("_header"), F.lit("\n\n"), F.array_join(numbered, "\n\n")))
    return per_patient.select(
        "patient_id", text.alias("summary_text"), F.col("visit_count").cast("int").alias("visit_count"),
    ).withColumn("summary_hash", F.sha2(F.col("summary_text"), 256))
