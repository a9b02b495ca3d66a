"""Batch forms of the row-at-a-time writes.

Each operator takes a table of requests and returns one outcome row per
request (accepted flag and the first failed rule). Per-request checks run
first; "first request wins" among the still-valid requests is then decided
by a min aggregate per key (partial, so a hot key never forms one sorted
group), joined back to the requests.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlytics.functions.core import as_of_lit

# Allowed enum values of the operational tables.
GENDERS = ("male", "female", "other")
BLOOD_GROUPS = ("A+", "A-", "B+", "B-", "O+", "O-", "AB+", "AB-")
APPOINTMENT_STATUSES = ("scheduled", "in_progress", "completed", "cancelled", "no_show")
BILLING_STATUSES = ("pending", "paid", "partially_paid", "waived")
ITEM_CATEGORIES = ("consultation", "test", "procedure", "other")
PAYMENT_METHODS = ("cash", "card", "upi", "insurance")
ROLES = ("admin", "doctor", "front_desk")
# Status transitions and who may make them.
TRANSITIONS = (
    # (from, to, roles allowed)
    ("scheduled", "in_progress", ("doctor",)),
    ("scheduled", "cancelled", ("front_desk", "admin")),
    ("scheduled", "no_show", ("front_desk", "admin")),
    ("in_progress", "completed", ("doctor",)),
)
# Next actions offered per (status, role).
NEXT_ACTIONS = (
    ("scheduled", "doctor", "Start Consultation", "in_progress"),
    ("scheduled", "front_desk", "Mark No Show", "no_show"),
    ("scheduled", "front_desk", "Cancel", "cancelled"),
    ("scheduled", "admin", "Mark No Show", "no_show"),
    ("scheduled", "admin", "Cancel", "cancelled"),
    ("in_progress", "doctor", "Write Visit Notes", None),
)
LIVE_EXCLUDED = ("cancelled", "no_show")
#: statuses that no transition leaves
FINAL_STATUSES = ("completed", "cancelled", "no_show")
# Why a status event is rejected.
NOT_FOUND = "appointment not found"
NO_TRANSITION = "cannot transition from '{}' to '{}'"
DOCTORS_ONLY = "only doctors can transition to '{}'"
DESK_ONLY = "only front desk or admin can transition to '{}'"
# Fixed value: the reason given for an event that comes after a later one was applied.
LATE = "late"
_ROLES_OF = {(f, t): roles for f, t, roles in TRANSITIONS}


def transition_reason(status: str | None, to: str, role: str) -> str | None:
    """Why an event is rejected in a known status; null if it is accepted. The rule for one event (streams);
    ``validate_transitions`` is the same rule for tables."""
    if status is None:
        return NOT_FOUND
    roles = _ROLES_OF.get((status, to))
    if roles is None:
        return NO_TRANSITION.format(status, to)
    if role not in roles:
        return (DOCTORS_ONLY if to in ("in_progress", "completed") else DESK_ONLY).format(to)
    return None


def first_failure(*checks: tuple[Column, str]) -> Column:
    """Reason of the first failed check (ok-condition, reason), else NULL."""
    out = F.lit(None).cast("string")
    for ok, reason in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)).otherwise(out)
    return out


def _first_wins(df: DataFrame, key: list[str], order: list[str], valid: str = "_ok") -> DataFrame:
    """Mark ``_winner`` = the valid row with the smallest ``order`` per key."""
    o = F.struct(*[F.col(c) for c in order])
    win = df.where(F.col(valid)).groupBy(*key).agg(F.min(o).alias("_win"))
    j = df.join(win, key, "left")
    return j.withColumn("_winner", F.col(valid) & (o == F.col("_win"))).drop("_win")


def _outcome(df: DataFrame, reason: Column, *keep: str) -> DataFrame:
    return df.select(*keep, reason.isNull().alias("accepted"), reason.alias("reason"))


# ------------------------------------------------------------ patients ----
def phone_ok(phone: Column) -> Column:
    """Length 10..20 and, without spaces and dashes, digits after leading '+'."""
    cleaned = F.regexp_replace(phone, "[ -]", "")
    return (F.length(phone).between(10, 20)) & cleaned.rlike(r"^\+*[0-9]+$")


def patient_checks(p: DataFrame) -> list[tuple[Column, str]]:
    c = F.col
    return [
        (c("first_name").isNotNull() & F.length("first_name").between(1, 100), "first_name length must be 1..100"),
        (c("last_name").isNotNull() & F.length("last_name").between(1, 100), "last_name length must be 1..100"),
        (c("date_of_birth").isNotNull(), "date_of_birth is required"),
        (c("gender").isin(*GENDERS), "gender must be male, female or other"),
        (c("phone").isNotNull() & phone_ok(c("phone")), "phone must be 10..20 digits"),
        (c("blood_group").isNull() | c("blood_group").isin(*BLOOD_GROUPS), "invalid blood group"),
    ]


def register_patients(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """requests: request_id, request_time, first_name, last_name,
    date_of_birth, gender, phone, blood_group. A phone must not exist in
    ``existing`` nor in an earlier valid request of the batch."""
    r = requests.withColumn("_reason", first_failure(*patient_checks(requests)))
    taken = existing.select(F.col("phone").alias("_p")).distinct().withColumn("_taken", F.lit(True))
    r = r.join(taken, r.phone == taken._p, "left").drop("_p")
    r = r.withColumn("_reason", F.coalesce("_reason", F.when(F.col("_taken"), F.lit("phone already registered"))))
    r = r.withColumn("_ok", F.col("_reason").isNull())
    r = _first_wins(r, ["phone"], ["request_time", "request_id"])
    reason = F.coalesce(F.col("_reason"), F.when(~F.col("_winner"), F.lit("duplicate phone in batch")))
    return _outcome(r, reason, "request_id", "phone")


def duplicate_phones(patients: DataFrame) -> DataFrame:
    """Each patient whose phone is held by more than one patient, with the
    number of holders. One row per member (a partial count joined back), so
    a phone shared by millions never becomes one list in one task."""
    n = patients.groupBy("phone").agg(F.count(F.lit(1)).alias("patients")).where(F.col("patients") > 1)
    return patients.select("phone", F.col("id").alias("patient_id")).join(n, "phone")


# -------------------------------------------------------- appointments ----
def book_appointments(t, requests: DataFrame, existing: DataFrame, as_of=None) -> DataFrame:
    """requests: request_id, patient_id, doctor_id, department_id,
    appointment_date, appointment_time. Patient, doctor and department must
    be active, the doctor in that department, the date not in the past, the
    slot free of live bookings and unused by any booking (unique over all
    statuses), and the first valid request per slot wins."""
    c = F.col
    pats = t["patients"].where(c("is_active")).select(c("id").alias("patient_id"), F.lit(True).alias("_pa"))
    docs = t["doctors"].where(c("is_active")).select(c("id").alias("doctor_id"), c("department_id").alias("_doc_dep"))
    deps = F.broadcast(t["departments"].where(c("is_active")).select(
        c("id").alias("department_id"), F.lit(True).alias("_da")))  # departments: a handful of rows
    slot = ["doctor_id", "appointment_date", "appointment_time"]
    live = existing.where(~c("status").isin(*LIVE_EXCLUDED)).select(*slot).distinct() \
        .withColumn("_live", F.lit(True))
    used = existing.select(*slot).distinct().withColumn("_used", F.lit(True))
    r = (requests.join(pats, "patient_id", "left").join(docs, "doctor_id", "left")
         .join(deps, "department_id", "left").join(live, slot, "left").join(used, slot, "left"))
    reason = first_failure(
        (c("_pa").isNotNull(), "patient not found"),
        (c("_doc_dep").isNotNull(), "doctor not found"),
        (c("_da").isNotNull(), "department not found"),
        (c("_doc_dep") == c("department_id"), "doctor does not belong to department"),
        (c("appointment_date") >= as_of_lit(as_of), "date is in the past"),
        (c("_live").isNull(), "slot already booked"),
        (c("_used").isNull(), "slot already booked (unique)"),
    )
    r = r.withColumn("_reason", reason).withColumn("_ok", c("_reason").isNull())
    r = _first_wins(r, slot, ["request_id"])
    final = F.coalesce(c("_reason"), F.when(~c("_winner"), F.lit("slot already booked in batch")))
    return _outcome(r, final, "request_id", *slot)


def reschedule_appointments(appointments: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: request_id, appointment_id, appointment_date, appointment_time.
    Only scheduled appointments move; the new slot must be unused by others."""
    c = F.col
    cur = appointments.select(c("id").alias("appointment_id"), "doctor_id", c("status").alias("_status"))
    slot = ["doctor_id", "appointment_date", "appointment_time"]
    used = appointments.select(*slot, c("id").alias("_holder"))
    r = requests.join(cur, "appointment_id", "left")
    r = r.join(used, slot, "left").withColumn(
        "_clash", c("_holder").isNotNull() & (c("_holder") != c("appointment_id")))
    r = r.groupBy(*requests.columns, "doctor_id", "_status").agg(F.max("_clash").alias("_clash"))
    reason = first_failure(
        (c("_status").isNotNull(), "appointment not found"),
        (c("_status") == "scheduled", "only scheduled appointments can be rescheduled"),
        (~F.coalesce(c("_clash"), F.lit(False)), "slot already booked"),
    )
    r = r.withColumn("_reason", reason).withColumn("_ok", c("_reason").isNull())
    r = _first_wins(r, slot, ["request_id"])
    final = F.coalesce(c("_reason"), F.when(~c("_winner"), F.lit("slot already booked in batch")))
    return _outcome(r, final, "request_id", "appointment_id", *slot)


def double_bookings(appointments: DataFrame) -> DataFrame:
    """Each appointment in a (doctor, date, time) slot booked more than
    once, with the slot's number of bookings (one row per member)."""
    slot = ["doctor_id", "appointment_date", "appointment_time"]
    n = appointments.groupBy(*slot).agg(F.count(F.lit(1)).alias("bookings")).where(F.col("bookings") > 1)
    return appointments.select(*slot, F.col("id").alias("appointment_id")).join(n, slot)


def transition_rules(spark) -> DataFrame:
    rows = [(f, t_, r) for f, t_, roles in TRANSITIONS for r in roles]
    return spark.createDataFrame(rows, "from_status string, to_status string, role string")


def next_actions(spark, appointments: DataFrame) -> DataFrame:
    """Actions offered per appointment and role (from its current status)."""
    rules = spark.createDataFrame(list(NEXT_ACTIONS), "status string, role string, action string, "
                                                     "target_status string")
    # The rule table has six rows: a proven broadcast bound.
    return appointments.select(F.col("id").alias("appointment_id"), "status").join(F.broadcast(rules), "status")


def validate_transitions(appointments: DataFrame, events: DataFrame) -> DataFrame:
    """Apply status events (appointment_id, event_id, ts, to_status, role)
    in (ts, event_id) order to each appointment's current status.

    Only three outcomes are possible per appointment, so no per-appointment
    fold is needed: the first event valid from 'scheduled' moves it on; if
    that went to 'in_progress', the first later valid 'completed' event
    finishes it; every other event is rejected with the rule it breaks in
    the state it found. Both "first" steps are min aggregates.
    """
    c = F.col
    cur = appointments.select(c("id").alias("appointment_id"), c("status").alias("status0"))
    e = events.join(cur, "appointment_id", "left").withColumn("_o", F.struct("ts", "event_id"))
    doctor_start = (c("to_status") == "in_progress") & (c("role") == "doctor")
    desk_stop = c("to_status").isin("cancelled", "no_show") & c("role").isin("front_desk", "admin")
    from_s = doctor_start | desk_stop
    from_p = (c("to_status") == "completed") & (c("role") == "doctor")
    s1 = e.where((c("status0") == "scheduled") & from_s).groupBy("appointment_id").agg(
        F.min(F.struct("_o", "to_status")).alias("_s1"))
    e = e.join(s1, "appointment_id", "left")
    p_start = F.when(c("status0") == "in_progress", F.struct(F.lit(None).cast("timestamp").alias("ts"),
                                                             F.lit(None).cast("bigint").alias("event_id")))
    e = e.withColumn("_p_from", F.when(c("_s1.to_status") == "in_progress", c("_s1._o")).otherwise(p_start))
    p1 = e.where(from_p & c("_p_from").isNotNull() & ((c("_o") > c("_p_from")) | c("_p_from.ts").isNull())) \
        .groupBy("appointment_id").agg(F.min("_o").alias("_p1"))
    e = e.join(p1, "appointment_id", "left")
    # state the event found
    after_s1 = c("_s1").isNotNull() & (c("_o") > c("_s1._o"))
    after_p1 = c("_p1").isNotNull() & (c("_o") > c("_p1"))
    state = (F.when(c("status0").isNull(), F.lit(None))
             .when(after_p1, F.lit("completed"))
             .when(after_s1, c("_s1.to_status"))
             .otherwise(c("status0")))
    e = e.withColumn("from_status", state)
    accepted = ((c("_s1").isNotNull() & (c("_o") == c("_s1._o")))
                | (c("_p1").isNotNull() & (c("_o") == c("_p1"))))
    valid_pairs = F.array(*[F.lit(f"{f}>{t_}") for f, t_, _ in TRANSITIONS])
    pair = F.concat(c("from_status"), F.lit(">"), c("to_status"))
    said = lambda text, *args: F.format_string(text.replace("{}", "%s"), *args)
    reason = (F.when(accepted, F.lit(None)).when(c("status0").isNull(), F.lit(NOT_FOUND))
              .when(~F.array_contains(valid_pairs, pair), said(NO_TRANSITION, c("from_status"), c("to_status")))
              .when(c("to_status").isin("in_progress", "completed"), said(DOCTORS_ONLY, c("to_status")))
              .otherwise(said(DESK_ONLY, c("to_status"))))
    return e.select("event_id", "appointment_id", "ts", "role", "from_status", "to_status",
                    accepted.alias("accepted"), reason.alias("reason"))


def apply_transitions(appointments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Appointments with the status after their accepted events."""
    last = outcomes.where("accepted").groupBy("appointment_id").agg(
        F.max(F.struct("ts", "event_id", "to_status")).alias("_l"))
    j = appointments.join(last.withColumnRenamed("appointment_id", "id"), "id", "left")
    return j.withColumn("status", F.coalesce(F.col("_l.to_status"), F.col("status"))).drop("_l")


# -------------------------------------------------------------- visits ----
def create_visits(t, appointments: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: request_id, appointment_id (+ visit fields). Accepted when
    the appointment exists, is in_progress and has no visit yet (first
    request per appointment wins); a request with a diagnosis column must
    fill it. Each accepted request yields a visit, a pending invoice with the
    department's fee and its consultation item (``visit_tables``)."""
    c = F.col
    a = appointments.select(c("id").alias("appointment_id"), "patient_id", "doctor_id", "department_id",
                            c("status").alias("_status"))
    has_visit = t["visits"].select("appointment_id").distinct().withColumn("_has", F.lit(True))
    dep = F.broadcast(t["departments"].select(c("id").alias("department_id"), c("name").alias("_dep_name"),
                                              "consultation_fee"))  # departments: a handful of rows
    r = requests.join(a, "appointment_id", "left").join(has_visit, "appointment_id", "left") \
        .join(dep, "department_id", "left")
    filled = [(F.coalesce(F.length("diagnosis") > 0, F.lit(False)), "diagnosis is required")] if "diagnosis" in requests.columns else []
    reason = first_failure(
        *filled,
        (c("_status").isNotNull(), "appointment not found"),
        (c("_status") == "in_progress", "appointment must be in_progress"),
        (c("_has").isNull(), "visit already exists"),
    )
    r = r.withColumn("_reason", reason).withColumn("_ok", c("_reason").isNull())
    r = _first_wins(r, ["appointment_id"], ["request_id"])
    final = F.coalesce(c("_reason"), F.when(~c("_winner"), F.lit("visit already exists")))
    ok = final.isNull()
    return r.select(
        "request_id", "appointment_id", ok.alias("accepted"), final.alias("reason"),
        F.when(ok, c("appointment_id")).alias("visit_id"),
        F.when(ok, c("patient_id")).alias("patient_id"),
        F.when(ok, c("doctor_id")).alias("doctor_id"),
        F.when(ok, F.lit("completed")).alias("appointment_status"),
        F.when(ok, c("consultation_fee")).alias("invoice_total"),
        F.when(ok, F.lit("pending")).alias("invoice_status"),
        F.when(ok, F.concat(c("_dep_name"), F.lit(" Consultation"))).alias("item_description"))


VISIT_FIELDS = ("symptoms", "diagnosis", "diagnosis_code", "prescription", "follow_up_date", "follow_up_notes")


def visit_tables(outcomes: DataFrame, requests: DataFrame, as_of=None) -> dict[str, DataFrame]:
    """The rows that the accepted requests of ``create_visits`` add: visits with all their fields, invoices and
    consultation items, and the appointments that are completed with them."""
    c, day = F.col, as_of_lit(as_of)
    ok = outcomes.where("accepted")
    fields = requests.select("request_id", *[f for f in VISIT_FIELDS if f in requests.columns])
    for f in VISIT_FIELDS:
        if f not in fields.columns:
            fields = fields.withColumn(f, F.lit(None).cast("date" if f.endswith("date") else "string"))
    return {
        "visits": ok.join(fields, "request_id").select(c("visit_id").alias("id"), "appointment_id", "patient_id", "doctor_id", *VISIT_FIELDS, day.alias("created_date")),
        "billing_records": ok.select(c("visit_id").alias("id"), "visit_id", "patient_id", c("invoice_total").alias("total_amount"), c("invoice_status").alias("status"),
                                     F.lit(None).cast("string").alias("payment_method"), F.lit(None).cast("date").alias("payment_date"), day.alias("created_date")),
        "billing_items": ok.select(c("visit_id").alias("billing_record_id"), F.lit(0).alias("item_no"), c("item_description").alias("description"),
                                   F.lit("consultation").alias("category"), c("invoice_total").alias("amount")),
        "appointments": ok.select(c("appointment_id").alias("id"), c("appointment_status").alias("status")),
    }


# ------------------------------------------------------------- billing ----
# Fixed value: longest item description.
DESCRIPTION_MAX = 255


def _item_field_reason(kind: Column) -> Column:
    """The first field of an item request that breaks its rule; an update checks the fields it sets."""
    c = F.col
    given = lambda f: (kind == "add") | c(f).isNotNull()
    long = F.length("description").between(1, DESCRIPTION_MAX)
    return (F.when(kind == "remove", F.lit(None).cast("string"))
            .when(given("description") & ~F.coalesce(long, F.lit(False)), F.lit("description must have 1 to 255 characters"))
            .when(given("category") & ~F.coalesce(c("category").isin(*ITEM_CATEGORIES), F.lit(False)), F.lit("invalid category"))
            .when(given("amount") & c("amount").isNull(), F.lit("amount is required")))


def apply_item_changes(records: DataFrame, items: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes: request_id, kind (add/update/remove), billing_record_id,
    item_no, description, category, amount, applied in the order of request_id.

    Adds need a pending or partially paid invoice; removals may not touch an
    item that is the consultation by then; what comes after a removal finds no
    item; an update sets the fields that are not null. Every request has the
    outcome a sequential run would give it: the category a removal meets is
    the last one set before it, the first removal that passes ends the item,
    and each field's last accepted value stays (partial aggregates per item).
    Only items that are removed while an update may change their category need
    an order within the item. Returns (outcomes, items after the changes)."""
    c, item = F.col, ["billing_record_id", "item_no"]
    from pyspark.sql import Window
    st = records.select(c("id").alias("billing_record_id"), c("status").alias("_inv_status"))
    cur = items.select("billing_record_id", "item_no", c("category").alias("_cur_cat"))
    r = changes.join(st, "billing_record_id", "left").join(cur, item, "left")
    bad = _item_field_reason(c("kind"))
    reason = (F.when(bad.isNotNull(), bad)
              .when(c("_inv_status").isNull(), F.lit("billing record not found"))
              .when((c("kind") == "add") & ~c("_inv_status").isin("pending", "partially_paid"),
                    F.concat(F.lit("cannot add items to a billing record with status '"), c("_inv_status"),
                             F.lit("'")))
              .when((c("kind") != "add") & c("_cur_cat").isNull(), F.lit("line item not found")))
    r = r.withColumn("_bad", reason)
    removal, recategorised = c("_bad").isNull() & (c("kind") == "remove"), c("_bad").isNull() & (c("kind") == "update") & c("category").isNotNull()
    facts = r.where(c("kind") != "add").groupBy(*item).agg(F.min(F.when(removal, c("request_id"))).alias("_remove"), F.min(F.when(recategorised, c("request_id"))).alias("_recat"))
    r = r.join(facts, item, "left")
    # items with both: the category that each removal meets
    tangled = c("_remove").isNotNull() & c("_recat").isNotNull()
    before = Window.partitionBy(*item).orderBy("request_id").rowsBetween(Window.unboundedPreceding, -1)
    met = r.where(tangled & (removal | recategorised)).withColumn("_met", F.coalesce(F.last(F.when(recategorised, c("category")), ignorenulls=True).over(before), c("_cur_cat")))
    met = met.where(c("kind") == "remove").select("request_id", "billing_record_id", "item_no", "_met")
    r = r.join(met, ["request_id", *item], "left").withColumn("_met", F.coalesce("_met", "_cur_cat"))
    gone = r.where(removal & (c("_met") != "consultation")).groupBy(*item).agg(F.min("request_id").alias("_gone"))
    r = r.join(gone, item, "left")
    reason = (F.when(c("_bad").isNotNull(), c("_bad"))
              .when((c("kind") != "add") & (c("request_id") > c("_gone")), F.lit("line item not found"))
              .when((c("kind") == "remove") & (c("_met") == "consultation"), F.lit("cannot remove consultation fee")))
    out = r.select("request_id", "kind", "billing_record_id", "item_no",
                   reason.isNull().alias("accepted"), reason.alias("reason"),
                   "description", "category", "amount")
    ok = out.where("accepted")
    removed = gone.select(*item)
    # per field the last accepted value
    upd = ok.where(c("kind") == "update").groupBy(*item).agg(
        *[F.max_by(f, F.when(c(f).isNotNull(), c("request_id"))).alias(n) for f, n in (("description", "_d"), ("category", "_c"), ("amount", "_a"))])
    kept = items.join(removed, item, "left_anti").join(upd, item, "left")
    kept = kept.select(
        "billing_record_id", "item_no",
        F.coalesce(c("_d"), c("description")).alias("description"),
        F.coalesce(c("_c"), c("category")).alias("category"),
        F.coalesce(c("_a"), c("amount")).cast("decimal(10,2)").alias("amount"))
    # new items numbered after the invoice's current maximum
    base = items.groupBy("billing_record_id").agg(F.max("item_no").alias("_max"))
    adds = ok.where(c("kind") == "add").join(base, "billing_record_id", "left")
    # adds per invoice are few (one request row each); the window is per invoice
    w = Window.partitionBy("billing_record_id").orderBy("request_id")
    adds = adds.select(
        "billing_record_id",
        (F.coalesce(c("_max"), F.lit(-1)) + F.row_number().over(w)).cast("int").alias("item_no"),
        "description", "category", c("amount").cast("decimal(10,2)").alias("amount"))
    return out, kept.unionByName(adds)


def recalculate_totals(records: DataFrame, items: DataFrame) -> DataFrame:
    """Each invoice's total recomputed from its items (0.00 with none)."""
    sums = items.groupBy(F.col("billing_record_id").alias("id")).agg(F.sum("amount").alias("_s"))
    j = records.select("id", F.col("total_amount").alias("stored_total")).join(sums, "id", "left")
    total = F.coalesce(F.col("_s"), F.lit(0)).cast("decimal(10,2)")
    return j.select("id", "stored_total", total.alias("total_amount"),
                    (total == F.col("stored_total")).alias("unchanged"))


def apply_payments(records: DataFrame, requests: DataFrame, as_of=None) -> DataFrame:
    """requests: request_id, billing_record_id, payment_method and, if there are any, notes.
    Paid or waived invoices are rejected; others become paid on ``as_of``. Of
    several payments of an invoice the first valid one counts."""
    c = F.col
    st = records.select(c("id").alias("billing_record_id"), c("status").alias("_status"),
                        c("payment_method").alias("_method"), c("payment_date").alias("_date"))
    r = requests.join(st, "billing_record_id", "left")
    reason = (F.when(~F.coalesce(c("payment_method").isin(*PAYMENT_METHODS), F.lit(False)), F.lit("invalid payment method"))
              .when(c("_status").isNull(), F.lit("billing record not found"))
              .when(c("_status").isin("paid", "waived"),
                    F.concat(F.lit("billing record is already '"), c("_status"), F.lit("'"))))
    r = r.withColumn("_reason", reason).withColumn("_ok", c("_reason").isNull())
    r = _first_wins(r, ["billing_record_id"], ["request_id"])
    reason = F.coalesce(c("_reason"), F.when(~c("_winner"), F.lit("billing record is already 'paid'")))
    ok = reason.isNull()
    notes = [F.when(ok, c("notes")).alias("notes")] if "notes" in requests.columns else []
    return r.select(
        "request_id", "billing_record_id", ok.alias("accepted"), reason.alias("reason"),
        F.when(ok, F.lit("paid")).otherwise(c("_status")).alias("status"),
        F.when(ok, c("payment_method")).otherwise(c("_method")).alias("payment_method"),
        F.when(ok, as_of_lit(as_of)).otherwise(c("_date")).alias("payment_date"), *notes)


# ------------------------------------------------------ generic updates ----
def apply_updates(base: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Sparse updates: ``changes`` has ``key`` and, per allowed column,
    ``<col>`` and ``set_<col>`` (True to write the value, even NULL).
    Columns outside ``allowed`` are ignored. Last change per key wins by
    ``change_id`` when present."""
    cols = [col for col in allowed if col in changes.columns and f"set_{col}" in changes.columns]
    ch = changes
    if "change_id" in changes.columns:
        latest = changes.groupBy(key).agg(F.max("change_id").alias("change_id"))
        ch = changes.join(latest, [key, "change_id"])
    ch = ch.select(key, *[F.col(col).alias(f"_new_{col}") for col in cols],
                   *[F.col(f"set_{col}").alias(f"_set_{col}") for col in cols])
    j = base.join(ch, key, "left")
    out = [F.when(F.coalesce(F.col(f"_set_{col}"), F.lit(False)), F.col(f"_new_{col}"))
           .otherwise(F.col(col)).cast(dict(base.dtypes)[col]).alias(col) if col in cols else F.col(col)
           for col in base.columns]
    return j.select(*out)


def soft_delete(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Set is_active = false for the given ids (rows are kept)."""
    hit = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn("_del", F.lit(True))
    return base.join(hit, key, "left").withColumn(
        "is_active", F.when(F.col("_del"), F.lit(False)).otherwise(F.col("is_active"))).drop("_del")


def remove_rows(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Delete rows by key (document metadata removal)."""
    return base.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_anti")


# --------------------------------------------------------------- audit ----
# Foreign keys (table, column, referenced table) and unique columns.
FOREIGN_KEYS = (
    ("appointments", "patient_id", "patients"), ("appointments", "doctor_id", "doctors"),
    ("appointments", "department_id", "departments"), ("visits", "appointment_id", "appointments"),
    ("visits", "patient_id", "patients"), ("visits", "doctor_id", "doctors"),
    ("billing_records", "visit_id", "visits"), ("billing_records", "patient_id", "patients"),
    ("billing_items", "billing_record_id", "billing_records"), ("doctors", "user_id", "users"),
    ("doctors", "department_id", "departments"),
)
UNIQUE_COLUMNS = (("users", "email"), ("departments", "name"), ("doctors", "user_id"), ("visits", "appointment_id"),
                  ("billing_records", "visit_id"))


#: rows of the larger side that a task of a key rule gets; a referenced table of at most so many rows is broadcast
AUDIT_ROWS, AUDIT_BROADCAST = 250_000, 100_000


def audit_constraints(t) -> DataFrame:
    """One row per violation: (table_name, row_id, rule, value).

    The key rules deal their rows to as many partitions as the counted rows ask
    for, so a task's sort buffers and hash maps do not grow with the tables.
    """
    c = F.col
    tables = {table for table, *_ in (*FOREIGN_KEYS, *UNIQUE_COLUMNS)} | {ref for *_, ref in FOREIGN_KEYS}
    held = {table: t[table].count() for table in sorted(tables)}
    parts = lambda *names: max(1, -(-max(held[n] for n in names) // AUDIT_ROWS))

    def stack(df: DataFrame, table: str, checks: list[tuple[str, Column, Column]]) -> DataFrame:
        arr = F.array(*[F.when(~F.coalesce(ok, F.lit(False)),
                               F.struct(F.lit(rule).alias("rule"), val.cast("string").alias("value")))
                        for rule, ok, val in checks])
        return df.select(F.lit(table).alias("table_name"), c("id").cast("bigint").alias("row_id"),
                         F.explode(F.array_compact(arr)).alias("v")) \
            .select("table_name", "row_id", "v.rule", "v.value")

    p = t["patients"]
    out = stack(p, "patients", [
        ("first_name_length", c("first_name").isNotNull() & F.length("first_name").between(1, 100), c("first_name")),
        ("last_name_length", c("last_name").isNotNull() & F.length("last_name").between(1, 100), c("last_name")),
        ("gender_enum", c("gender").isin(*GENDERS), c("gender")),
        ("blood_group_enum", c("blood_group").isNull() | c("blood_group").isin(*BLOOD_GROUPS), c("blood_group")),
        ("phone_format", c("phone").isNotNull() & phone_ok(c("phone")), c("phone")),
    ])
    dup_phone = duplicate_phones(p).select("phone").distinct()
    out = out.unionByName(p.join(dup_phone, "phone", "left_semi").select(
        F.lit("patients").alias("table_name"), c("id").alias("row_id"), F.lit("phone_unique").alias("rule"),
        c("phone").alias("value")))
    a = t["appointments"]
    out = out.unionByName(stack(a, "appointments", [
        ("status_enum", c("status").isin(*APPOINTMENT_STATUSES), c("status")),
    ]))
    slot = ["doctor_id", "appointment_date", "appointment_time"]
    dealt = a.repartition(parts("appointments"), *slot)
    dup_slot = double_bookings(dealt).select(*slot).distinct()
    out = out.unionByName(dealt.join(dup_slot, slot, "left_semi").select(
        F.lit("appointments").alias("table_name"), c("id").alias("row_id"), F.lit("slot_unique").alias("rule"),
        F.concat_ws(" ", c("doctor_id").cast("string"), c("appointment_date").cast("string"),
                    c("appointment_time")).alias("value")))
    for table, fk, ref in FOREIGN_KEYS:
        rows = t[table].select((c("billing_record_id") if table == "billing_items" else c("id")).alias("row_id"), c(fk).alias("_fk"))
        rows, keys = rows.where("_fk is not null"), t[ref].select(c("id").alias("_fk"))
        if held[ref] <= AUDIT_BROADCAST:
            keys = F.broadcast(keys)
        else:
            rows, keys = (x.repartition(parts(table, ref), "_fk") for x in (rows, keys))
        out = out.unionByName(rows.join(keys, "_fk", "left_anti").select(
            F.lit(table).alias("table_name"), "row_id", F.lit(f"fk_{fk}").alias("rule"), c("_fk").cast("string").alias("value")))
    for table, col in UNIQUE_COLUMNS:
        dealt = t[table].select("id", col).repartition(parts(table), col)
        many = dealt.groupBy(col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(col)
        out = out.unionByName(dealt.join(many, col, "left_semi").select(
            F.lit(table).alias("table_name"), c("id").alias("row_id"), F.lit(f"{col}_unique").alias("rule"),
            c(col).cast("string").alias("value")))
    br = t["billing_records"]
    out = out.unionByName(stack(br, "billing_records", [
        ("status_enum", c("status").isin(*BILLING_STATUSES), c("status")),
        ("payment_method_enum", c("payment_method").isNull() | c("payment_method").isin(*PAYMENT_METHODS),
         c("payment_method")),
    ]))
    # An item's row id is its invoice; its number stands before the value.
    it = t["billing_items"].withColumn("id", c("billing_record_id"))
    out = out.unionByName(stack(it, "billing_items", [
        ("category_enum", c("category").isin(*ITEM_CATEGORIES), F.concat_ws(":", c("item_no").cast("string"), c("category"))),
        ("amount_positive", c("amount") > 0, F.concat_ws(":", c("item_no").cast("string"), c("amount").cast("string"))),
    ]))
    d = t["departments"]
    out = out.unionByName(stack(d, "departments", [
        ("fee_positive", c("consultation_fee") > 0, c("consultation_fee")),
    ]))
    return out


def update_patients(patients: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply sparse patient changes (only allowed columns). A new phone is
    accepted when no other patient held it before the batch and no earlier
    change (by change_id, else id) asks for it, so no phone is ever held
    twice. Returns (patients after, rejected change ids with reason)."""
    allowed = ["first_name", "last_name", "date_of_birth", "gender", "phone", "blood_group", "is_active"]
    if "phone" not in changes.columns or "set_phone" not in changes.columns:
        return apply_updates(patients, changes, "id", allowed), changes.limit(0).select("id", F.lit(None).cast("string").alias("reason"))
    order = "change_id" if "change_id" in changes.columns else "id"
    final = changes.join(changes.groupBy("id").agg(F.max(order).alias(order)), ["id", order]) if order != "id" else changes
    asked = final.where(F.coalesce(F.col("set_phone"), F.lit(False)) & F.col("phone").isNotNull()).select("id", "phone", F.col(order).alias("_order"))
    held = patients.groupBy("phone").agg(F.min("id").alias("_holder"), F.max("id").alias("_holder2"))
    first = asked.groupBy("phone").agg(F.min(F.struct("_order", "id")).alias("_first"))
    clash = (asked.join(held, "phone", "left").join(first, "phone")
             .where((F.col("_holder") != F.col("id")) | (F.col("_holder2") != F.col("id")) | (F.col("_first.id") != F.col("id")))
             .select("id").distinct())
    rejected = changes.join(clash, "id", "left_semi").select("id", F.lit("phone already registered").alias("reason"))
    return apply_updates(patients, changes.join(clash, "id", "left_anti"), "id", allowed), rejected


def create_departments(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """requests: request_id, name, consultation_fee. Names are unique
    (first request wins), fees positive with at most two decimals."""
    c = F.col
    taken = existing.select(c("name").alias("_n")).distinct().withColumn("_t", F.lit(True))
    r = requests.join(taken, requests.name == taken._n, "left").drop("_n")
    fee = c("consultation_fee")
    reason = first_failure(
        (c("name").isNotNull() & (F.length(c("name")) > 0), "name is required"),
        (fee > 0, "consultation fee must be positive"),
        (fee == F.round(fee, 2), "consultation fee has more than two decimals"),
        (c("_t").isNull(), "department already exists"))
    r = r.withColumn("_reason", reason).withColumn("_ok", c("_reason").isNull())
    r = _first_wins(r, ["name"], ["request_id"])
    final = F.coalesce(c("_reason"), F.when(~c("_winner"), F.lit("department already exists")))
    return _outcome(r, final, "request_id", "name")


def register_staff(requests: DataFrame, users: DataFrame) -> DataFrame:
    """requests: request_id, email, full_name, role. Role must be valid and
    the email new (first request wins)."""
    c = F.col
    taken = users.select(c("email").alias("_e")).distinct().withColumn("_t", F.lit(True))
    r = requests.join(taken, requests.email == taken._e, "left").drop("_e")
    reason = first_failure(
        (c("role").isin(*ROLES), "invalid role"),
        (c("_t").isNull(), "user with this email already exists"))
    r = r.withColumn("_reason", reason).withColumn("_ok", c("_reason").isNull())
    r = _first_wins(r, ["email"], ["request_id"])
    final = F.coalesce(c("_reason"), F.when(~c("_winner"), F.lit("user with this email already exists")))
    return _outcome(r, final, "request_id", "email")


def apply_field_changes(base: DataFrame, changes: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Sparse changes in the order of change_id: every field keeps its last value among the changes that set it
    (``set_<field>``, also to NULL), by partial aggregates per key."""
    last = changes.groupBy(key).agg(*[F.max_by(F.struct(F.col(f).alias("v")), F.when(F.coalesce(F.col(f"set_{f}"), F.lit(False)), F.col("change_id"))).alias(f"_{f}") for f in fields])
    kinds = dict(base.dtypes)
    j = base.join(last, key, "left")
    return j.select(*[F.when(F.col(f"_{x}").isNotNull(), F.col(f"_{x}.v")).otherwise(F.col(x)).cast(kinds[x]).alias(x) if x in fields else F.col(x) for x in base.columns])


def update_visits(visits: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes: change_id, id, and of VISIT_FIELDS any with their ``set_`` columns. A change must name a visit and may
    not empty the diagnosis. Returns (visits after, outcome per change)."""
    fields = [f for f in VISIT_FIELDS if f in changes.columns]
    r = changes.join(visits.select("id", F.lit(True).alias("_known")), "id", "left")
    checks = [(F.col("_known"), "visit not found")]
    if "diagnosis" in fields:
        checks.insert(0, (~F.coalesce("set_diagnosis", F.lit(False)) | (F.length("diagnosis") > 0), "diagnosis is required"))
    r = r.withColumn("_reason", first_failure(*checks))
    after = apply_field_changes(visits, r.where(F.col("_reason").isNull()), fields)
    return after, _outcome(r, F.col("_reason"), "change_id", "id")


def update_doctors(doctors: DataFrame, departments: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes: change_id, id, department_id, is_active with their ``set_`` columns; a new department must exist.
    Returns (doctors after, outcome per change)."""
    r = changes.join(doctors.select("id", F.lit(True).alias("_known")), "id", "left")
    r = r.join(departments.select(F.col("id").alias("department_id"), F.lit(True).alias("_dep")), "department_id", "left")
    r = r.withColumn("_reason", first_failure((F.col("_known"), "doctor not found"), (~F.coalesce("set_department_id", F.lit(False)) | F.col("_dep"), "department not found")))
    after = apply_field_changes(doctors, r.where(F.col("_reason").isNull()), ["department_id", "is_active"])
    return after, _outcome(r, F.col("_reason"), "change_id", "id")


def create_doctors(requests: DataFrame, users: DataFrame, departments: DataFrame) -> DataFrame:
    """requests: request_id, email, full_name, department_id. A doctor comes with a user of their own: the email must be
    new (first request wins) and the department exist and be active."""
    c = F.col
    taken = users.select("email").distinct().withColumn("_t", F.lit(True))
    dep = departments.select(c("id").alias("department_id"), c("is_active").alias("_open"))
    r = requests.join(taken, "email", "left").join(dep, "department_id", "left")
    reason = first_failure(
        (F.length("full_name") > 0, "full name is required"), (F.length("email") > 0, "email is required"), (c("_open").isNotNull(), "department not found"),
        (c("_open"), "department is not active"), (c("_t").isNull(), "user with this email already exists"))
    r = r.withColumn("_reason", reason).withColumn("_ok", c("_reason").isNull())
    r = _first_wins(r, ["email"], ["request_id"])
    final = F.coalesce(c("_reason"), F.when(~c("_winner"), F.lit("user with this email already exists")))
    return _outcome(r, final, "request_id", "email", "full_name", "department_id")
