"""Dashboard read models: today's snapshot, revenue series, department and
doctor stats for the month, free slots and doctor schedules.

The reference issues one query per department/doctor (N+1); here each is
one grouped aggregate left-joined to the dimension.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinlytics.functions.core import DEFAULT_AS_OF, as_of_lit, money, ratio_1dp_half_even
from clinlytics.operators.jobs import SLOTS_PER_DAY

# Reporting periods (days) and the fallback for unknown ones.
PERIOD_DAYS = {"7days": 7, "30days": 30, "90days": 90}
DEFAULT_PERIOD_DAYS = 30
# Clinic hours, 30-minute slots from 09:00 to 16:30.
FIRST_SLOT_HOUR = 9
SLOT_MINUTES = 30
LIVE_BOOKING_EXCLUDED = ("cancelled", "no_show")


def _as_date(as_of) -> dt.date:
    if as_of is None:
        return DEFAULT_AS_OF
    return dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of


def one_row(frames: list[DataFrame]) -> DataFrame:
    """Place single-row aggregates side by side as scalar subqueries (no
    join; Spark merges subqueries over the same table into one scan)."""
    spark = frames[0].sparkSession
    subs = [f.select(F.struct(*f.columns)).scalar().alias(f"_s{i}") for i, f in enumerate(frames)]
    return spark.range(1).select(*subs).select(*[f"_s{i}.*" for i in range(len(frames))])


def dashboard_summary(t, as_of=None) -> DataFrame:
    """Today's appointments by status, today's paid revenue, pending
    invoices, active patients and patients registered this month."""
    day = _as_date(as_of)
    asof = as_of_lit(day)
    st = F.col("status")
    appts = t["appointments"].where(F.col("appointment_date") == asof).agg(
        F.count(F.lit(1)).alias("appointments_total"),
        *[F.count_if(st == s).alias(f"appointments_{s}")
          for s in ("scheduled", "in_progress", "completed", "cancelled")])
    br = t["billing_records"]
    money_agg = br.agg(
        money(F.sum(F.when((F.col("payment_date") == asof) & (st == "paid"), F.col("total_amount"))))
        .alias("revenue_today"),
        F.count_if(st == "pending").alias("pending_count"),
        money(F.sum(F.when(st == "pending", F.col("total_amount")))).alias("pending_amount"))
    first = F.trunc(asof, "month")
    pats = t["patients"].where(F.col("is_active")).agg(
        F.count(F.lit(1)).alias("patients_active"),
        F.count_if(F.col("created_at") >= first).alias("patients_new_this_month"))
    return one_row([appts, money_agg, pats]).select(asof.alias("date"), "*")


def _period_days(period: str) -> int:
    return PERIOD_DAYS.get(period, DEFAULT_PERIOD_DAYS)


def revenue_series(t, as_of=None, period: str = "30days") -> DataFrame:
    """Paid item revenue per day and category over ``days`` days ending
    yesterday, zero-filled; 'total' includes every category."""
    days = _period_days(period)
    day = _as_date(as_of)
    start = day - dt.timedelta(days=days)
    br = (t["billing_records"]
          .where((F.col("status") == "paid") & (F.col("payment_date") >= F.lit(start))
                 & (F.col("payment_date") < F.lit(day)))
          .select(F.col("id").alias("billing_record_id"), F.col("payment_date").alias("date")))
    items = t["billing_items"].select("billing_record_id", "category", "amount")
    cats = ["consultation", "test", "procedure", "other"]
    cat, amt = F.col("category"), F.col("amount")
    per_day = items.join(br, "billing_record_id").groupBy("date").agg(
        *[F.sum(F.when(cat == c, amt)).alias(c) for c in cats], F.sum(amt).alias("total"))
    calendar = t.spark.range(days).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"))
    # The calendar has ``days`` rows (a request parameter): a bounded broadcast.
    j = per_day.join(F.broadcast(calendar), "date", "right")
    return j.select("date", *[money(F.col(c)).alias(c) for c in cats + ["total"]])


def revenue_summary(t, as_of=None, period: str = "30days") -> DataFrame:
    """Period totals of the revenue series (tests = test + procedure)."""
    days = _period_days(period)
    day = _as_date(as_of)
    s = revenue_series(t, as_of, period)
    return s.agg(
        money(F.sum("total")).alias("total"),
        money(F.sum("consultation")).alias("consultation"),
        money(F.sum(F.col("test") + F.col("procedure"))).alias("tests_and_procedures"),
    ).select(F.lit(period).alias("period"), F.lit(day - dt.timedelta(days=days)).alias("start_date"),
             F.lit(day).alias("end_date"), "*")


def _paid_since(t, first) -> DataFrame:
    br = t["billing_records"]
    return br.where((F.col("status") == "paid") & (F.col("payment_date") >= first)).select(
        "visit_id", "total_amount")


def department_stats(t, as_of=None) -> DataFrame:
    """Per active department this month: appointments (no upper date
    bound), completed, completion rate (1 dp, half-even), paid revenue."""
    first = F.trunc(as_of_lit(as_of), "month")
    a = t["appointments"].where(F.col("appointment_date") >= first).groupBy("department_id").agg(
        F.count(F.lit(1)).alias("monthly_appointments"),
        F.count_if(F.col("status") == "completed").alias("monthly_completed"))
    v = t["visits"].select(F.col("id").alias("visit_id"), "appointment_id")
    ap = t["appointments"].select(F.col("id").alias("appointment_id"), "department_id")
    rev = (_paid_since(t, first).join(v, "visit_id").join(ap, "appointment_id")
           .groupBy("department_id").agg(F.sum("total_amount").alias("_rev")))
    d = t["departments"].where(F.col("is_active")).select(
        F.col("id").alias("department_id"), F.col("name").alias("department_name"), "consultation_fee")
    j = d.join(a, "department_id", "left").join(rev, "department_id", "left")
    n = F.coalesce(F.col("monthly_appointments"), F.lit(0).cast("bigint"))
    c = F.coalesce(F.col("monthly_completed"), F.lit(0).cast("bigint"))
    return j.select(
        "department_id", "department_name", "consultation_fee",
        n.alias("monthly_appointments"), c.alias("monthly_completed"),
        ratio_1dp_half_even(c, n).alias("completion_rate"),
        money(F.col("_rev")).alias("monthly_revenue"))


def working_days(first: dt.date, last: dt.date) -> int:
    """Mondays to Saturdays from ``first`` to ``last`` inclusive."""
    n = (last - first).days + 1
    return sum(1 for i in range(max(n, 0)) if (first + dt.timedelta(days=i)).weekday() < 6)


def doctor_utilization(t, as_of=None) -> DataFrame:
    """Per active doctor this month: live appointments, completed,
    utilisation of Mon-Sat slots (1 dp, half-even) and paid revenue."""
    day = _as_date(as_of)
    first_d = day.replace(day=1)
    first = F.lit(first_d)
    total_slots = working_days(first_d, day) * SLOTS_PER_DAY
    st = F.col("status")
    a = t["appointments"].where(F.col("appointment_date") >= first).groupBy("doctor_id").agg(
        F.count_if(~st.isin(*LIVE_BOOKING_EXCLUDED)).alias("monthly_appointments"),
        F.count_if(st == "completed").alias("monthly_completed"))
    v = t["visits"].select(F.col("id").alias("visit_id"), "doctor_id")
    rev = _paid_since(t, first).join(v, "visit_id").groupBy("doctor_id").agg(
        F.sum("total_amount").alias("_rev"))
    doc = t["doctors"].where(F.col("is_active")).select(
        F.col("id").alias("doctor_id"), "user_id", "department_id")
    u = t["users"].select(F.col("id").alias("user_id"), F.col("full_name").alias("doctor_name"))
    d = t["departments"].select(F.col("id").alias("department_id"), F.col("name").alias("department"))
    j = (doc.join(u, "user_id").join(F.broadcast(d), "department_id")
         .join(a, "doctor_id", "left").join(rev, "doctor_id", "left"))
    n = F.coalesce(F.col("monthly_appointments"), F.lit(0).cast("bigint"))
    return j.select(
        "doctor_id", "doctor_name", "department",
        n.alias("monthly_appointments"),
        F.coalesce(F.col("monthly_completed"), F.lit(0).cast("bigint")).alias("monthly_completed"),
        ratio_1dp_half_even(n, F.lit(total_slots)).alias("utilization_rate"),
        money(F.col("_rev")).alias("monthly_revenue"),
    ).orderBy(F.col("monthly_revenue").desc(), F.col("doctor_id"))


def slot_times() -> F.Column:
    """The 16 half-hour slot labels 'HH:mm' from 09:00 to 16:30."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(SLOTS_PER_DAY - 1)),
        lambda i: F.concat(F.lpad((F.lit(FIRST_SLOT_HOUR) + F.floor(i * SLOT_MINUTES / 60)).cast("string"), 2, "0"),
                           F.lit(":"), F.lpad(((i * SLOT_MINUTES) % 60).cast("string"), 2, "0")))


def available_slots(t, requests: DataFrame | None = None) -> DataFrame:
    """Free slots per requested (doctor_id, date) of an active doctor.

    Without explicit requests every (doctor, day) that has bookings is
    asked for. Live bookings are one small set per doctor-day (a partial
    aggregate of at most 16 slot labels); the free slots are what it leaves.
    """
    slots = slot_times()
    live = ~F.col("status").isin(*LIVE_BOOKING_EXCLUDED) & F.array_contains(slots, F.col("appointment_time"))
    days = t["appointments"].groupBy("doctor_id", F.col("appointment_date").alias("date")) \
        .agg(F.collect_set(F.when(live, F.col("appointment_time"))).alias("_booked"))
    if requests is not None:
        days = requests.select("doctor_id", "date").distinct().join(days, ["doctor_id", "date"], "left")
    active = t["doctors"].where(F.col("is_active")).select(F.col("id").alias("doctor_id"))
    free = F.array_except(slots, F.coalesce(F.col("_booked"), F.array().cast("array<string>")))
    return days.join(active, "doctor_id", "left_semi").select("doctor_id", "date", F.explode(free).alias("slot"))


def doctor_schedule(t, day=None) -> DataFrame:
    """Appointments with patient/doctor/department details for every
    (doctor, date), or for one date, numbered in time order."""
    from pyspark.sql import Window
    from clinlytics.operators.lists import appointment_detail
    a = appointment_detail(t)
    if day is not None:
        a = a.where(F.col("appointment_date") == as_of_lit(day))
    # A doctor-day holds at most a few dozen bookings, so this window is bounded.
    w = Window.partitionBy("doctor_id", "appointment_date").orderBy("appointment_time", "id")
    return a.withColumn("slot_no", F.row_number().over(w))


def revenue_chart(series: DataFrame) -> DataFrame:
    """Chart points of the revenue series: 'MM-dd' label, consultation, and
    tests & procedures together."""
    return series.select(F.date_format("date", "MM-dd").alias("label"), "date",
                         F.col("consultation").alias("consultation"),
                         (F.col("test") + F.col("procedure")).alias("tests_and_procedures"))


def today_schedule_for(schedule: DataFrame, doctor_name: str, day=None) -> DataFrame:
    """A doctor's list for one day, picked by the doctor's display name."""
    d = schedule.where(F.col("doctor_name") == doctor_name)
    if day is not None:
        d = d.where(F.col("appointment_date") == as_of_lit(day))
    return d.orderBy("appointment_time", "id")
