"""Registered queries and oracles: batch writes, constraint audit.

Request tables are derived from the driver data: registrations replay the
patients registered from 2000-07-01 against those registered before;
bookings ask for every appointment again, against the book of those that
are no longer scheduled; every appointment asks to move by a day; patient
updates come from ``orders`` (the key as change id); status events come
from ``events`` (user_id -> appointment id, event_type -> target status,
props.k -> acting role); item changes and payments are derived per invoice.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from clinlytics.operators import writes as wr
from clinlytics.plans.oracle_base import DOCUMENTS_CATALOGUE, with_clinic
from clinlytics.sources.driver import clinic_tables
from clinlytics.sources.files import documents_catalogue

REGISTRATION_CUTOFF = "2000-07-01"
BOOKING_AS_OF = "1998-01-01"
# Fixed values (fixture mapping): event type -> target status, props.k % 3 -> role.
EVENT_TARGET = {"view": "in_progress", "click": "completed", "purchase": "cancelled", "signup": "no_show"}
ROLE_BY_K = ("doctor", "front_desk", "admin")


def registration_requests(t):
    p = t["patients"]
    return p.where(F.col("created_at") >= F.lit(REGISTRATION_CUTOFF).cast("date")).select(
        F.col("id").alias("request_id"), F.col("created_at").alias("request_time"), "first_name", "last_name",
        "date_of_birth", "gender", "phone", "blood_group")


def _registered_before(t):
    return t["patients"].where(F.col("created_at") < F.lit(REGISTRATION_CUTOFF).cast("date"))


def booking_requests(t):
    return t["appointments"].select(F.col("id").alias("request_id"), "patient_id", "doctor_id", "department_id",
                                    "appointment_date", "appointment_time")


def booked(t):
    """The book: all appointments that were held, called off or missed."""
    return t["appointments"].where(F.col("status") != "scheduled")


def move_requests(t):
    return t["appointments"].select(F.col("id").alias("request_id"), F.col("id").alias("appointment_id"),
                                    F.date_add("appointment_date", 1).alias("appointment_date"), "appointment_time")


def patient_changes(t):
    """One sparse change per order: a new phone (finished orders) or blood group (most and least urgent ones)."""
    c = F.col
    urgent = c("o_orderpriority") == "1-URGENT"
    return t.driver("orders").select(
        c("o_custkey").alias("id"), c("o_orderkey").alias("change_id"),
        F.concat(F.lit("9"), F.lpad((c("o_orderkey") % 3000).cast("string"), 9, "0")).alias("phone"),
        (c("o_orderstatus") == "F").alias("set_phone"),
        F.when(urgent, "AB-").alias("blood_group"), (urgent | (c("o_orderpriority") == "5-LOW")).alias("set_blood_group"))


def _update_patients(t):
    after, rejected = wr.update_patients(t["patients"], patient_changes(t))
    return after.select("id", "phone", "blood_group", "is_active").join(rejected.distinct(), "id", "left")


def _remove_documents(t):
    """The catalogue without the documents that the labels call toxic."""
    listed = documents_catalogue(t.driver("documents"))
    return wr.remove_rows(listed, t.driver("labels").where("toxic = 1").select("doc_id"), "document_id") \
        .select("document_id", "file_name", "file_size_bytes")


def status_events(t, events=None):
    """Status-change events from the ``events`` table (or a stream of it)."""
    e = t.driver("events") if events is None else events
    et = F.col("event_type")
    target = F.lit("scheduled")
    for k, v in reversed(list(EVENT_TARGET.items())):
        target = F.when(et == k, F.lit(v)).otherwise(target)
    k = F.get_json_object("props", "$.k").cast("int") % 3
    role = F.when(k == 0, ROLE_BY_K[0]).when(k == 1, ROLE_BY_K[1]).otherwise(ROLE_BY_K[2])
    return e.select(F.col("user_id").alias("appointment_id"), "event_id", "ts", target.alias("to_status"),
                    role.alias("role"))


def _transitions(t):
    return wr.validate_transitions(t["appointments"], status_events(t))


def _create_visits(t):
    appts = wr.apply_transitions(t["appointments"], _transitions(t))
    req = status_events(t).select(F.col("appointment_id").alias("request_id"), "appointment_id").distinct()
    return wr.create_visits(t, appts, req)


def item_changes(t):
    c = F.col
    br = t["billing_records"]
    it = t["billing_items"]
    add = br.select((c("id") * 10 + 1).alias("request_id"), F.lit("add").alias("kind"),
                    c("id").alias("billing_record_id"), F.lit(None).cast("int").alias("item_no"),
                    F.lit("Lab panel").alias("description"), F.lit("test").alias("category"),
                    (c("total_amount") / 10).cast("decimal(10,2)").alias("amount"))
    rm_other = it.where(c("category") == "other").select(
        ((c("billing_record_id") * 1000 + c("item_no")) * 10 + 2).alias("request_id"), F.lit("remove").alias("kind"),
        "billing_record_id", "item_no", F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("category"), F.lit(None).cast("decimal(10,2)").alias("amount"))
    paid = br.where(c("status") == "paid").select(c("id").alias("billing_record_id"))
    rm_consult = it.where(c("category") == "consultation").join(paid, "billing_record_id", "left_semi").select(
        ((c("billing_record_id") * 1000 + c("item_no")) * 10 + 3).alias("request_id"), F.lit("remove").alias("kind"),
        "billing_record_id", "item_no", F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("category"), F.lit(None).cast("decimal(10,2)").alias("amount"))
    upd = it.where(c("category") == "procedure").select(
        ((c("billing_record_id") * 1000 + c("item_no")) * 10 + 4).alias("request_id"), F.lit("update").alias("kind"),
        "billing_record_id", "item_no", "description", "category",
        (c("amount") * F.lit(1.1).cast("decimal(3,1)")).cast("decimal(10,2)").alias("amount"))
    return add.unionByName(rm_other).unionByName(rm_consult).unionByName(upd)


def payment_requests(t):
    return t["billing_records"].select(F.col("id").alias("request_id"), F.col("id").alias("billing_record_id"),
                                       F.coalesce("payment_method", F.lit("card")).alias("payment_method"))


def department_requests(t):
    """A department per nation and, again, per region; every fifth nation asks for a fee of 0."""
    c = F.col
    n = t.driver("nation").select((c("n_nationkey") + 100).cast("long").alias("request_id"), c("n_name").alias("name"), ((c("n_nationkey") % 5) * 100).cast("decimal(10,3)").alias("consultation_fee"))
    r = t.driver("region").select(c("r_regionkey").cast("long").alias("request_id"), c("r_name").alias("name"), F.lit(250).cast("decimal(10,3)").alias("consultation_fee"))
    return n.unionByName(r)


def staff_requests(t):
    """An account per customer, two customers to an email; every fourth asks for a role that there is not."""
    c = F.col
    role = F.element_at(F.array(*[F.lit(x) for x in (*wr.ROLES, "nurse")]), (c("c_custkey") % 4 + 1).cast("int"))
    email = F.concat(F.lit("dr."), F.floor(c("c_custkey") / 2).cast("string"))
    return t.driver("customer").select(c("c_custkey").cast("long").alias("request_id"), email.alias("email"), c("c_name").alias("full_name"), role.alias("role"))


def doctor_requests(t):
    """A doctor per customer; departments 5 and 6 do not exist."""
    return staff_requests(t).withColumn("department_id", (F.col("request_id") % 7).cast("int")).drop("role")


def visit_changes(t):
    """A change per invoice item, in their order: procedures revise the diagnosis, tests the prescription, others the notes."""
    c = F.col
    return t["billing_items"].select(
        c("billing_record_id").alias("id"), c("item_no").alias("change_id"),
        F.when(c("item_no") % 3 != 0, F.concat(F.lit("revised "), c("item_no").cast("string"))).otherwise("").alias("diagnosis"), (c("category") == "procedure").alias("set_diagnosis"),
        c("description").alias("prescription"), (c("category") == "test").alias("set_prescription"),
        F.when(c("amount") >= 100, F.lit("call")).alias("follow_up_notes"), (c("category") == "other").alias("set_follow_up_notes"))


def _update_visits(t):
    after, outcome = wr.update_visits(t["visits"], visit_changes(t))
    refused = outcome.groupBy("id").agg(F.count_if(~F.col("accepted")).alias("refused"))
    return after.select("id", "diagnosis", "prescription", "follow_up_notes").join(refused, "id", "left")


def _update_doctors(t):
    """Every nation's key names a doctor who moves to a department (5 does not exist) or is closed."""
    c = F.col
    changes = t.driver("nation").select(c("n_nationkey").cast("long").alias("change_id"), (c("n_nationkey") % 12).cast("long").alias("id"), (c("n_nationkey") % 6).cast("int").alias("department_id"),
                                        (c("n_regionkey") != 2).alias("set_department_id"), F.lit(False).alias("is_active"), (c("n_regionkey") == 2).alias("set_is_active"))
    after, outcome = wr.update_doctors(t["doctors"], t["departments"], changes)
    return after.select("id", "department_id", "is_active").join(outcome.groupBy("id").agg(F.count_if(~c("accepted")).alias("refused")), "id", "full_outer")


def _q(fn):
    def run(spark, sf_dir):
        return fn(clinic_tables(spark, sf_dir))
    return run


QUERIES = {
    "register_patients": _q(lambda t: wr.register_patients(registration_requests(t), _registered_before(t))),
    "duplicate_phones": _q(lambda t: wr.duplicate_phones(t["patients"])),
    "book_appointments": _q(lambda t: wr.book_appointments(
        t, booking_requests(t), booked(t), as_of=BOOKING_AS_OF)),
    "reschedule_appointments": _q(lambda t: wr.reschedule_appointments(t["appointments"], move_requests(t))),
    "update_patients": _q(_update_patients),
    "remove_documents": _q(_remove_documents),
    "double_bookings": _q(lambda t: wr.double_bookings(t["appointments"])),
    "validate_transitions": _q(_transitions),
    "next_actions": _q(lambda t: wr.next_actions(t.spark, t["appointments"])),
    "create_visits": _q(_create_visits),
    "apply_item_changes": _q(lambda t: wr.apply_item_changes(t["billing_records"], t["billing_items"],
                                                             item_changes(t))[0]),
    "recalculate_totals": _q(lambda t: wr.recalculate_totals(
        t["billing_records"], wr.apply_item_changes(t["billing_records"], t["billing_items"], item_changes(t))[1])),
    "apply_payments": _q(lambda t: wr.apply_payments(t["billing_records"], payment_requests(t))),
    "audit_constraints": _q(wr.audit_constraints),
    "create_departments": _q(lambda t: wr.create_departments(department_requests(t), t["departments"])),
    "register_staff": _q(lambda t: wr.register_staff(staff_requests(t), t["users"])),
    "create_doctors": _q(lambda t: wr.create_doctors(doctor_requests(t), t["users"], t["departments"])),
    "update_visits": _q(_update_visits),
    "update_doctors": _q(_update_doctors),
}

_EVENT_CTES = """
ev AS (
  SELECT e.event_id, e.user_id AS appointment_id, e.ts,
    CASE e.event_type WHEN 'view' THEN 'in_progress' WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'cancelled'
      WHEN 'signup' THEN 'no_show' ELSE 'scheduled' END AS to_status,
    CASE CAST(json_extract_string(e.props, '$.k') AS INTEGER) % 3 WHEN 0 THEN 'doctor' WHEN 1 THEN 'front_desk'
      ELSE 'admin' END AS role,
    ROW_NUMBER() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS n
  FROM events e),
rules AS (
  SELECT * FROM (VALUES ('scheduled', 'in_progress', 'doctor'), ('scheduled', 'cancelled', 'front_desk'),
    ('scheduled', 'cancelled', 'admin'), ('scheduled', 'no_show', 'front_desk'), ('scheduled', 'no_show', 'admin'),
    ('in_progress', 'completed', 'doctor')) r(f, t, role)),
walk(appointment_id, n, state) AS (
  SELECT a.id, CAST(0 AS BIGINT), a.status FROM appointments a WHERE a.id IN (SELECT appointment_id FROM ev)
  UNION ALL
  SELECT w.appointment_id, w.n + 1,
    CASE WHEN r.t IS NOT NULL THEN e.to_status ELSE w.state END
  FROM walk w JOIN ev e ON e.appointment_id = w.appointment_id AND e.n = w.n + 1
  LEFT JOIN rules r ON r.f = w.state AND r.t = e.to_status AND r.role = e.role),
outcomes AS (
  SELECT e.event_id, e.appointment_id, e.ts, e.role, w.state AS from_status, e.to_status,
    COALESCE(w.state IS NOT NULL AND EXISTS (SELECT 1 FROM rules r WHERE r.f = w.state AND r.t = e.to_status
                                            AND r.role = e.role), false) AS accepted
  FROM ev e LEFT JOIN walk w ON w.appointment_id = e.appointment_id AND w.n = e.n - 1),
final_state AS (SELECT appointment_id, arg_max(state, n) AS status FROM walk GROUP BY appointment_id)
"""

_REASON = """
  CASE WHEN accepted THEN NULL
       WHEN from_status IS NULL THEN 'appointment not found'
       WHEN NOT EXISTS (SELECT 1 FROM rules r WHERE r.f = from_status AND r.t = to_status)
         THEN 'cannot transition from ''' || from_status || ''' to ''' || to_status || ''''
       WHEN to_status IN ('in_progress', 'completed') THEN 'only doctors can transition to ''' || to_status || ''''
       ELSE 'only front desk or admin can transition to ''' || to_status || '''' END
"""

_ITEM_CTES = """
br_st AS (SELECT id AS billing_record_id, status FROM billing_records),
changes AS (
  SELECT id * 10 + 1 AS request_id, 'add' AS kind, id AS billing_record_id, CAST(NULL AS INTEGER) AS item_no,
    'Lab panel' AS description, 'test' AS category, CAST(total_amount / 10 AS DECIMAL(10,2)) AS amount
  FROM billing_records
  UNION ALL
  SELECT (billing_record_id * 1000 + item_no) * 10 + 2, 'remove', billing_record_id, item_no, NULL, NULL, NULL
  FROM billing_items WHERE category = 'other'
  UNION ALL
  SELECT (i.billing_record_id * 1000 + i.item_no) * 10 + 3, 'remove', i.billing_record_id, i.item_no, NULL, NULL, NULL
  FROM billing_items i JOIN billing_records b ON b.id = i.billing_record_id
  WHERE i.category = 'consultation' AND b.status = 'paid'
  UNION ALL
  SELECT (billing_record_id * 1000 + item_no) * 10 + 4, 'update', billing_record_id, item_no, description, category,
    CAST(amount * CAST(1.1 AS DECIMAL(3,1)) AS DECIMAL(10,2))
  FROM billing_items WHERE category = 'procedure'),
item_out AS (
  SELECT c.request_id, c.kind, c.billing_record_id, c.item_no,
    CASE WHEN s.status IS NULL THEN 'billing record not found'
         WHEN c.kind = 'add' AND s.status NOT IN ('pending', 'partially_paid')
           THEN 'cannot add items to a billing record with status ''' || s.status || ''''
         WHEN c.kind <> 'add' AND i.category IS NULL THEN 'line item not found'
         WHEN c.kind = 'remove' AND i.category = 'consultation' THEN 'cannot remove consultation fee' END AS reason,
    c.description, c.category, c.amount
  FROM changes c LEFT JOIN br_st s ON s.billing_record_id = c.billing_record_id
  LEFT JOIN billing_items i ON i.billing_record_id = c.billing_record_id AND i.item_no = c.item_no),
items_after AS (
  SELECT i.billing_record_id, COALESCE(u.amount, i.amount) AS amount
  FROM billing_items i
  LEFT JOIN (SELECT * FROM item_out WHERE reason IS NULL AND kind = 'update') u
    ON u.billing_record_id = i.billing_record_id AND u.item_no = i.item_no
  WHERE NOT EXISTS (SELECT 1 FROM item_out r WHERE r.reason IS NULL AND r.kind = 'remove'
                    AND r.billing_record_id = i.billing_record_id AND r.item_no = i.item_no)
  UNION ALL
  SELECT billing_record_id, amount FROM item_out WHERE reason IS NULL AND kind = 'add')
"""

_PHONE_OK = ("(length(phone) BETWEEN 10 AND 20 AND "
             "regexp_matches(regexp_replace(phone, '[ -]', '', 'g'), '^\\+*[0-9]+$'))")

_KEY_RULES = "\n".join(
    [f"UNION ALL SELECT '{a}', {'billing_record_id' if a == 'billing_items' else 'id'}, 'fk_{k}', CAST({k} AS VARCHAR) FROM {a} x "
     f"WHERE {k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {b} y WHERE y.id = x.{k})" for a, k, b in wr.FOREIGN_KEYS]
    + [f"UNION ALL SELECT '{a}', id, '{k}_unique', CAST({k} AS VARCHAR) FROM {a} QUALIFY count(*) OVER (PARTITION BY {k}) > 1"
       for a, k in wr.UNIQUE_COLUMNS])

ORACLES = {
    "register_patients": with_clinic(f"""
      SELECT r.request_id, r.phone, r.reason IS NULL AS accepted, r.reason FROM (
        SELECT q.request_id, q.phone,
          COALESCE(q.reason0, CASE WHEN q.reason0 IS NULL AND ROW_NUMBER() OVER (
              PARTITION BY q.phone, q.reason0 IS NULL ORDER BY q.request_time, q.request_id) > 1
            THEN 'duplicate phone in batch' END) AS reason
        FROM (
          SELECT p.id AS request_id, p.created_at AS request_time, p.phone,
            CASE WHEN p.first_name IS NULL OR length(p.first_name) NOT BETWEEN 1 AND 100
                   THEN 'first_name length must be 1..100'
                 WHEN p.last_name IS NULL OR length(p.last_name) NOT BETWEEN 1 AND 100
                   THEN 'last_name length must be 1..100'
                 WHEN p.date_of_birth IS NULL THEN 'date_of_birth is required'
                 WHEN p.gender IS NULL OR p.gender NOT IN ('male', 'female', 'other')
                   THEN 'gender must be male, female or other'
                 WHEN p.phone IS NULL OR NOT {_PHONE_OK} THEN 'phone must be 10..20 digits'
                 WHEN p.blood_group IS NOT NULL AND p.blood_group NOT IN ('A+','A-','B+','B-','O+','O-','AB+','AB-')
                   THEN 'invalid blood group'
                 WHEN p.phone IN (SELECT phone FROM patients WHERE created_at < DATE '{REGISTRATION_CUTOFF}')
                   THEN 'phone already registered' END AS reason0
          FROM patients p WHERE p.created_at >= DATE '{REGISTRATION_CUTOFF}') q) r"""),
    "duplicate_phones": with_clinic("""
      SELECT p.phone, p.id AS patient_id, d.patients FROM patients p
      JOIN (SELECT phone, COUNT(*) AS patients FROM patients GROUP BY phone HAVING COUNT(*) > 1) d
        ON d.phone = p.phone"""),
    "book_appointments": with_clinic(f"""
      SELECT request_id, doctor_id, appointment_date, appointment_time, reason IS NULL AS accepted, reason FROM (
        SELECT q.*, COALESCE(q.reason0, CASE WHEN ROW_NUMBER() OVER (
            PARTITION BY q.doctor_id, q.appointment_date, q.appointment_time, q.reason0 IS NULL
            ORDER BY q.request_id) > 1 THEN 'slot already booked in batch' END) AS reason
        FROM (
          SELECT a.id AS request_id, a.doctor_id, a.appointment_date, a.appointment_time,
            CASE WHEN p.id IS NULL THEN 'patient not found'
                 WHEN d.id IS NULL THEN 'doctor not found'
                 WHEN dep.id IS NULL THEN 'department not found'
                 WHEN d.department_id <> a.department_id THEN 'doctor does not belong to department'
                 WHEN a.appointment_date < DATE '{BOOKING_AS_OF}' THEN 'date is in the past'
                 WHEN h.live THEN 'slot already booked'
                 WHEN h.doctor_id IS NOT NULL THEN 'slot already booked (unique)' END AS reason0
          FROM appointments a
          LEFT JOIN (SELECT doctor_id, appointment_date, appointment_time, bool_or(status NOT IN ('cancelled', 'no_show')) AS live
                     FROM appointments WHERE status <> 'scheduled' GROUP BY ALL) h
            ON h.doctor_id = a.doctor_id AND h.appointment_date = a.appointment_date AND h.appointment_time = a.appointment_time
          LEFT JOIN (SELECT id FROM patients WHERE is_active) p ON p.id = a.patient_id
          LEFT JOIN (SELECT id, department_id FROM doctors WHERE is_active) d ON d.id = a.doctor_id
          LEFT JOIN (SELECT id FROM departments WHERE is_active) dep ON dep.id = a.department_id) q) r"""),
    "reschedule_appointments": with_clinic("""
      SELECT request_id, appointment_id, doctor_id, appointment_date, appointment_time, reason IS NULL AS accepted, reason FROM (
        SELECT q.*, COALESCE(q.reason0, CASE WHEN ROW_NUMBER() OVER (
            PARTITION BY doctor_id, appointment_date, appointment_time, reason0 IS NULL ORDER BY request_id) > 1
            THEN 'slot already booked in batch' END) AS reason
        FROM (
          SELECT a.id AS request_id, a.id AS appointment_id, a.doctor_id, a.appointment_date + 1 AS appointment_date,
            a.appointment_time,
            CASE WHEN a.status <> 'scheduled' THEN 'only scheduled appointments can be rescheduled'
                 WHEN EXISTS (SELECT 1 FROM appointments b WHERE b.doctor_id = a.doctor_id
                              AND b.appointment_date = a.appointment_date + 1
                              AND b.appointment_time = a.appointment_time) THEN 'slot already booked' END AS reason0
          FROM appointments a) q)"""),
    "remove_documents": f"""
      SELECT document_id, file_name, file_size_bytes FROM ({DOCUMENTS_CATALOGUE})
      WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "update_patients": with_clinic("""
      SELECT p.id, CASE WHEN r.id IS NULL AND f.set_phone THEN f.phone ELSE p.phone END AS phone,
        CASE WHEN r.id IS NULL AND f.set_group THEN f.blood_group ELSE p.blood_group END AS blood_group, p.is_active,
        CASE WHEN r.id IS NOT NULL THEN 'phone already registered' END AS reason
      FROM patients p LEFT JOIN last_change f ON f.id = p.id LEFT JOIN refused r ON r.id = p.id""", """
      last_change AS (
        SELECT o_custkey AS id, o_orderkey AS change_id, o_orderstatus = 'F' AS set_phone,
          '9' || lpad(CAST(o_orderkey % 3000 AS VARCHAR), 9, '0') AS phone,
          o_orderpriority IN ('1-URGENT', '5-LOW') AS set_group,
          CASE WHEN o_orderpriority = '1-URGENT' THEN 'AB-' END AS blood_group
        FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
      refused AS (
        SELECT id FROM (
          SELECT id, phone, row_number() OVER (PARTITION BY phone ORDER BY change_id) AS turn FROM last_change WHERE set_phone) a
        WHERE turn > 1 OR EXISTS (SELECT 1 FROM patients p WHERE p.phone = a.phone AND p.id <> a.id))"""),
    "create_departments": with_clinic("""
      SELECT request_id, name, reason IS NULL AS accepted, reason FROM (
        SELECT r.request_id, r.name, CASE WHEN r.fee <= 0 THEN 'consultation fee must be positive'
            WHEN EXISTS (SELECT 1 FROM departments d WHERE d.name = r.name) THEN 'department already exists'
            WHEN row_number() OVER (PARTITION BY r.name, r.fee > 0 ORDER BY r.request_id) > 1 THEN 'department already exists' END AS reason
        FROM (SELECT CAST(n_nationkey + 100 AS BIGINT) AS request_id, n_name AS name, (n_nationkey % 5) * 100 AS fee FROM nation
              UNION ALL SELECT CAST(r_regionkey AS BIGINT), r_name, 250 FROM region) r)"""),
    "register_staff": with_clinic("""
      SELECT request_id, email, reason IS NULL AS accepted, reason FROM (
        SELECT r.request_id, r.email, CASE WHEN r.role = 'nurse' THEN 'invalid role'
            WHEN EXISTS (SELECT 1 FROM users u WHERE u.email = r.email) THEN 'user with this email already exists'
            WHEN row_number() OVER (PARTITION BY r.email, r.role = 'nurse' ORDER BY r.request_id) > 1 THEN 'user with this email already exists' END AS reason
        FROM (SELECT CAST(c_custkey AS BIGINT) AS request_id, 'dr.' || CAST(c_custkey // 2 AS VARCHAR) AS email,
                CASE c_custkey % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'doctor' WHEN 2 THEN 'front_desk' ELSE 'nurse' END AS role FROM customer) r)"""),
    "create_doctors": with_clinic("""
      SELECT request_id, email, full_name, department_id, reason IS NULL AS accepted, reason FROM (
        SELECT r.*, CASE WHEN r.department_id > 4 THEN 'department not found'
            WHEN EXISTS (SELECT 1 FROM users u WHERE u.email = r.email) THEN 'user with this email already exists'
            WHEN row_number() OVER (PARTITION BY r.email, r.department_id > 4 ORDER BY r.request_id) > 1 THEN 'user with this email already exists' END AS reason
        FROM (SELECT CAST(c_custkey AS BIGINT) AS request_id, 'dr.' || CAST(c_custkey // 2 AS VARCHAR) AS email, c_name AS full_name,
                CAST(c_custkey % 7 AS INTEGER) AS department_id FROM customer) r)"""),
    "update_visits": with_clinic("""
      SELECT v.id, coalesce(c.diagnosis, v.diagnosis) AS diagnosis, coalesce(c.prescription, v.prescription) AS prescription,
        CASE WHEN c.notes_no IS NOT NULL THEN c.notes ELSE v.follow_up_notes END AS follow_up_notes, c.refused
      FROM visits v LEFT JOIN (
        SELECT billing_record_id AS id, count(*) FILTER (category = 'procedure' AND item_no % 3 = 0) AS refused,
          arg_max('revised ' || CAST(item_no AS VARCHAR), item_no) FILTER (category = 'procedure' AND item_no % 3 <> 0) AS diagnosis,
          arg_max(description, item_no) FILTER (category = 'test') AS prescription, max(item_no) FILTER (category = 'other') AS notes_no,
          CASE WHEN arg_max(amount, item_no) FILTER (category = 'other') >= 100 THEN 'call' END AS notes
        FROM billing_items GROUP BY billing_record_id) c ON c.id = v.id"""),
    "update_doctors": with_clinic("""
      SELECT coalesce(d.id, c.id) AS id, CASE WHEN d.id IS NOT NULL THEN coalesce(c.dep, d.department_id) END AS department_id,
        CASE WHEN d.id IS NOT NULL THEN d.is_active AND NOT coalesce(c.closed, false) END AS is_active, c.refused
      FROM doctors d FULL OUTER JOIN c ON c.id = d.id""", """
      ch AS (SELECT n_nationkey AS change_id, CAST(n_nationkey % 12 AS BIGINT) AS id, CAST(n_nationkey % 6 AS INTEGER) AS dep, n_regionkey = 2 AS closes,
          CASE WHEN n_nationkey % 12 NOT IN (SELECT id FROM doctors) OR (n_regionkey <> 2 AND n_nationkey % 6 = 5) THEN 1 ELSE 0 END AS bad FROM nation),
      c AS (SELECT id, sum(bad)::BIGINT AS refused, arg_max(dep, change_id) FILTER (bad = 0 AND NOT closes) AS dep, coalesce(bool_or(closes) FILTER (bad = 0), false) AS closed FROM ch GROUP BY id)"""),
    "double_bookings": with_clinic("""
      SELECT a.doctor_id, a.appointment_date, a.appointment_time, a.id AS appointment_id, d.bookings
      FROM appointments a
      JOIN (SELECT doctor_id, appointment_date, appointment_time, COUNT(*) AS bookings FROM appointments
            GROUP BY ALL HAVING COUNT(*) > 1) d USING (doctor_id, appointment_date, appointment_time)"""),
    "validate_transitions": with_clinic(
        f"SELECT event_id, appointment_id, ts, role, from_status, to_status, accepted, {_REASON} AS reason "
        "FROM outcomes", _EVENT_CTES, recursive=True),
    "next_actions": with_clinic("""
      SELECT r.status, a.id AS appointment_id, r.role, r.action, r.target_status
      FROM appointments a JOIN (VALUES ('scheduled', 'doctor', 'Start Consultation', 'in_progress'),
        ('scheduled', 'front_desk', 'Mark No Show', 'no_show'), ('scheduled', 'front_desk', 'Cancel', 'cancelled'),
        ('scheduled', 'admin', 'Mark No Show', 'no_show'), ('scheduled', 'admin', 'Cancel', 'cancelled'),
        ('in_progress', 'doctor', 'Write Visit Notes', NULL)) r(status, role, action, target_status)
        ON r.status = a.status"""),
    "create_visits": with_clinic("""
      SELECT q.appointment_id AS request_id, q.appointment_id, reason IS NULL AS accepted, reason,
        CASE WHEN reason IS NULL THEN q.appointment_id END AS visit_id,
        CASE WHEN reason IS NULL THEN a.patient_id END AS patient_id,
        CASE WHEN reason IS NULL THEN a.doctor_id END AS doctor_id,
        CASE WHEN reason IS NULL THEN 'completed' END AS appointment_status,
        CASE WHEN reason IS NULL THEN d.consultation_fee END AS invoice_total,
        CASE WHEN reason IS NULL THEN 'pending' END AS invoice_status,
        CASE WHEN reason IS NULL THEN d.name || ' Consultation' END AS item_description
      FROM (
        SELECT r.appointment_id, CASE WHEN f.status IS NULL THEN 'appointment not found'
               WHEN f.status <> 'in_progress' THEN 'appointment must be in_progress'
               WHEN EXISTS (SELECT 1 FROM visits v WHERE v.appointment_id = r.appointment_id)
                 THEN 'visit already exists' END AS reason
        FROM (SELECT DISTINCT appointment_id FROM ev) r LEFT JOIN final_state f ON f.appointment_id = r.appointment_id
      ) q LEFT JOIN appointments a ON a.id = q.appointment_id LEFT JOIN departments d ON d.id = a.department_id""",
        _EVENT_CTES, recursive=True),
    "apply_item_changes": with_clinic(
        "SELECT request_id, kind, billing_record_id, item_no, reason IS NULL AS accepted, reason, description, "
        "category, amount FROM item_out", _ITEM_CTES),
    "recalculate_totals": with_clinic("""
      SELECT b.id, b.total_amount AS stored_total, CAST(COALESCE(s.t, 0) AS DECIMAL(10,2)) AS total_amount,
        CAST(COALESCE(s.t, 0) AS DECIMAL(10,2)) = b.total_amount AS unchanged
      FROM billing_records b LEFT JOIN (SELECT billing_record_id, SUM(amount) AS t FROM items_after GROUP BY 1) s
        ON s.billing_record_id = b.id""", _ITEM_CTES),
    "apply_payments": with_clinic("""
      SELECT id AS request_id, id AS billing_record_id, status NOT IN ('paid', 'waived') AS accepted,
        CASE WHEN status IN ('paid', 'waived') THEN 'billing record is already ''' || status || '''' END AS reason,
        CASE WHEN status IN ('paid', 'waived') THEN status ELSE 'paid' END AS status,
        CASE WHEN status IN ('paid', 'waived') THEN payment_method ELSE COALESCE(payment_method, 'card') END
          AS payment_method,
        CASE WHEN status IN ('paid', 'waived') THEN payment_date ELSE DATE '2001-07-15' END AS payment_date
      FROM billing_records"""),
    "audit_constraints": with_clinic(f"""
      SELECT 'patients' AS table_name, id AS row_id, rule, value FROM (
        SELECT id, 'first_name_length' AS rule, first_name AS value FROM patients
          WHERE first_name IS NULL OR length(first_name) NOT BETWEEN 1 AND 100
        UNION ALL SELECT id, 'last_name_length', last_name FROM patients
          WHERE last_name IS NULL OR length(last_name) NOT BETWEEN 1 AND 100
        UNION ALL SELECT id, 'gender_enum', gender FROM patients
          WHERE gender IS NULL OR gender NOT IN ('male', 'female', 'other')
        UNION ALL SELECT id, 'blood_group_enum', blood_group FROM patients
          WHERE blood_group IS NOT NULL AND blood_group NOT IN ('A+','A-','B+','B-','O+','O-','AB+','AB-')
        UNION ALL SELECT id, 'phone_format', phone FROM patients WHERE phone IS NULL OR NOT {_PHONE_OK}
        UNION ALL SELECT id, 'phone_unique', phone FROM patients
          WHERE phone IN (SELECT phone FROM patients GROUP BY phone HAVING COUNT(*) > 1))
      UNION ALL
      SELECT 'appointments', id, 'status_enum', status FROM appointments
        WHERE status IS NULL OR status NOT IN ('scheduled','in_progress','completed','cancelled','no_show')
      UNION ALL
      SELECT 'appointments', a.id, 'slot_unique',
        CAST(a.doctor_id AS VARCHAR) || ' ' || CAST(a.appointment_date AS VARCHAR) || ' ' || a.appointment_time
      FROM appointments a JOIN (SELECT doctor_id, appointment_date, appointment_time FROM appointments
                                GROUP BY ALL HAVING COUNT(*) > 1) d USING (doctor_id, appointment_date, appointment_time)
      {_KEY_RULES}
      UNION ALL
      SELECT 'billing_records', id, 'status_enum', status FROM billing_records
        WHERE status IS NULL OR status NOT IN ('pending', 'paid', 'partially_paid', 'waived')
      UNION ALL
      SELECT 'billing_records', id, 'payment_method_enum', payment_method FROM billing_records
        WHERE payment_method IS NOT NULL AND payment_method NOT IN ('cash', 'card', 'upi', 'insurance')
      UNION ALL
      SELECT 'billing_items', billing_record_id, 'category_enum', concat_ws(':', item_no, category) FROM billing_items
        WHERE category IS NULL OR category NOT IN ('consultation', 'test', 'procedure', 'other')
      UNION ALL
      SELECT 'billing_items', billing_record_id, 'amount_positive', concat_ws(':', item_no, amount)
        FROM billing_items WHERE amount IS NULL OR amount <= 0
      UNION ALL
      SELECT 'departments', id, 'fee_positive', CAST(consultation_fee AS VARCHAR) FROM departments
        WHERE consultation_fee IS NULL OR consultation_fee <= 0"""),
}
