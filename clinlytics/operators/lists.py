"""Lists, searches, pagination and denormalised detail views.

Each detail view is the analytic form of a model's ``to_dict``: a fact
table joined to its dimensions with an explicit column list (no hidden
columns such as password hashes or file paths ever reach the output).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinlytics.functions.core import age_years, as_of_lit, money

# Pagination defaults and bounds.
DEFAULT_PAGE, DEFAULT_PER_PAGE, MAX_PER_PAGE = 1, 20, 100


def page_params(page, per_page) -> tuple[int, int]:
    """page >= 1, per_page clamped to 1..100; unparsable input -> (1, 20)."""
    try:
        p = max(1, int(page if page is not None else DEFAULT_PAGE))
        n = min(MAX_PER_PAGE, max(1, int(per_page if per_page is not None else DEFAULT_PER_PAGE)))
    except (TypeError, ValueError):
        return DEFAULT_PAGE, DEFAULT_PER_PAGE
    return p, n


def paginate(df: DataFrame, order: list[Column], page=1, per_page=20) -> DataFrame:
    """One page of ``df`` in ``order`` plus total, page, per_page, pages.

    The page is a top-(offset+n) sort (TakeOrderedAndProject), the total one
    partial count; an out-of-range page yields no rows.
    """
    p, n = page_params(page, per_page)
    rows = df.orderBy(*order).offset((p - 1) * n).limit(n)
    out = rows.withColumn("total", df.agg(F.count(F.lit(1))).scalar())  # scalar subquery, no join
    return out.withColumns({
        "page": F.lit(p), "per_page": F.lit(n),
        "pages": F.ceil(F.col("total") / F.lit(n)).cast("bigint"),
    })


def ordinal_within(df: DataFrame, key: str, ts: str, tie: str, descending: bool = False,
                   slice_unit: str = "month") -> DataFrame:
    """Add ``ordinal`` = 1-based position of each row within its ``key``.

    Rows are numbered inside (key, month) slices, then offset by the number
    of rows in the key's earlier slices; the second window sees one row per
    slice, so a key with a huge history is still spread over many tasks.
    """
    d = df.withColumn("_slice", F.trunc(F.col(ts).cast("date"), slice_unit))
    o = [F.col(ts).desc(), F.col(tie).desc()] if descending else [F.col(ts), F.col(tie)]
    d = d.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_slice").orderBy(*o)))
    sl = d.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    so = F.col("_slice").desc() if descending else F.col("_slice")
    w = Window.partitionBy(key).orderBy(so).rowsBetween(Window.unboundedPreceding, -1)
    sl = sl.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return d.join(sl, [key, "_slice"]).withColumn("ordinal", F.col("_rn") + F.col("_before")) \
        .drop("_slice", "_rn", "_before")


# ------------------------------------------------------------ details ----
def _patient_names(t) -> DataFrame:
    return t["patients"].select(
        F.col("id").alias("patient_id"),
        F.concat(F.col("first_name"), F.lit(" "), F.col("last_name")).alias("patient_name"),
        F.col("phone").alias("patient_phone"))


def _doctor_names(t) -> DataFrame:
    doc = t["doctors"].select(F.col("id").alias("doctor_id"), "user_id", F.col("department_id").alias("_doc_dep"))
    u = t["users"].select(F.col("id").alias("user_id"), F.col("full_name").alias("doctor_name"))
    return doc.join(u, "user_id").drop("user_id")


def _dep(t, alias="department_name") -> DataFrame:
    # departments: a handful of rows, a proven broadcast bound.
    return F.broadcast(t["departments"].select(F.col("id").alias("department_id"), F.col("name").alias(alias)))


def appointment_detail(t) -> DataFrame:
    a = t["appointments"]
    j = a.join(_patient_names(t), "patient_id").join(_doctor_names(t), "doctor_id").join(_dep(t), "department_id")
    return j.select("id", "patient_id", "patient_name", "patient_phone", "doctor_id", "doctor_name",
                    "department_id", "department_name", "appointment_date", "appointment_time", "status")


def visit_detail(t) -> DataFrame:
    v = t["visits"]
    j = (v.join(_patient_names(t).drop("patient_phone"), "patient_id").join(_doctor_names(t), "doctor_id")
         .join(_dep(t), F.col("_doc_dep") == F.col("department_id")))
    return j.select("id", "appointment_id", "patient_id", "patient_name", "doctor_id", "doctor_name",
                    "department_name", "symptoms", "diagnosis", "diagnosis_code", "prescription",
                    "follow_up_notes", "follow_up_date", F.col("created_date").alias("created_at"))


def doctor_detail(t) -> DataFrame:
    doc = t["doctors"]
    u = t["users"].select(F.col("id").alias("user_id"), "full_name", "email")
    j = doc.join(u, "user_id").join(_dep(t), "department_id")
    return j.select("id", "user_id", "full_name", "email", "department_id", "department_name", "is_active")


def patient_detail(t, as_of=None) -> DataFrame:
    p = t["patients"]
    return p.select(
        "id", "first_name", "last_name",
        F.concat(F.col("first_name"), F.lit(" "), F.col("last_name")).alias("full_name"),
        "date_of_birth", age_years("date_of_birth", as_of_lit(as_of)).alias("age"),
        "gender", "phone", "blood_group", "is_active", "created_at")


def invoice_items(t) -> DataFrame:
    """Items per invoice as one ordered array of structs."""
    it = t["billing_items"]
    return it.groupBy("billing_record_id").agg(
        F.sort_array(F.collect_list(F.struct("item_no", "description", "category", "amount"))).alias("items"))


def invoice_detail(t, items_as_text: bool = False, records: DataFrame | None = None) -> DataFrame:
    """All invoices, or those of ``records`` (rows of billing_records); only their items are gathered."""
    items = t["billing_items"]
    if records is not None:
        items = items.join(records.select(F.col("id").alias("billing_record_id")), "billing_record_id", "left_semi")
    j = ((t["billing_records"] if records is None else records).join(_patient_names(t).drop("patient_phone"), "patient_id")
         .join(invoice_items({"billing_items": items}).withColumnRenamed("billing_record_id", "id"), "id", "left"))
    return _invoice_columns(j, items_as_text)


def _invoice_columns(j: DataFrame, items_as_text: bool) -> DataFrame:
    items = F.coalesce(F.col("items"), F.array().cast(
        "array<struct<item_no:int,description:string,category:string,amount:decimal(10,2)>>"))
    if items_as_text:
        items = F.array_join(F.transform(items, lambda x: F.concat_ws(
            "|", x["item_no"].cast("string"), x["description"], x["category"], x["amount"].cast("string"))), ";")
    return j.select("id", "visit_id", "patient_id", "patient_name", "total_amount", "status", "payment_method",
                    "payment_date", items.alias("items"), F.col("created_date").alias("created_at"))


# -------------------------------------------------------------- lists ----
def list_departments(t) -> DataFrame:
    return t["departments"].where(F.col("is_active")).select(
        "id", "name", "consultation_fee", "is_active").orderBy("name", "id")


def list_doctors(t, department_id: int | None = None) -> DataFrame:
    d = doctor_detail(t).where(F.col("is_active"))
    if department_id:
        d = d.where(F.col("department_id") == department_id)
    return d


def list_appointments(t, appointment_date=None, doctor_id=None, patient_id=None, status=None) -> DataFrame:
    """Optional AND-ed equality filters; a falsy value means 'no filter'."""
    a = appointment_detail(t)
    if appointment_date:
        a = a.where(F.col("appointment_date") == as_of_lit(appointment_date))
    if doctor_id:
        a = a.where(F.col("doctor_id") == doctor_id)
    if patient_id:
        a = a.where(F.col("patient_id") == patient_id)
    if status:
        a = a.where(F.col("status") == status)
    return a.orderBy("appointment_date", "appointment_time", "id")


def _date_range(df: DataFrame, col: str, date_from=None, date_to=None) -> DataFrame:
    """``col >= from AND col <= to`` with ``to`` at midnight (rest of that day excluded)."""
    ts = F.col(col).cast("timestamp")
    if date_from:
        df = df.where(ts >= F.to_timestamp(F.lit(date_from), "yyyy-MM-dd"))
    if date_to:
        df = df.where(ts <= F.to_timestamp(F.lit(date_to), "yyyy-MM-dd"))
    return df


def list_visits(t, patient_id=None, doctor_id=None, date_from=None, date_to=None) -> DataFrame:
    v = visit_detail(t)
    if patient_id:
        v = v.where(F.col("patient_id") == patient_id)
    if doctor_id:
        v = v.where(F.col("doctor_id") == doctor_id)
    return _date_range(v, "created_at", date_from, date_to).orderBy(F.col("created_at").desc(), F.col("id").desc())


def list_billing(t, status=None, date_from=None, date_to=None) -> DataFrame:
    b = t["billing_records"]
    if status:
        b = b.where(F.col("status") == status)
    return invoice_detail(t, items_as_text=True, records=_date_range(b, "created_date", date_from, date_to))


def page_billing(t, status=None, date_from=None, date_to=None, page=1, per_page=20) -> DataFrame:
    """The invoices are paged first; names and items are joined to the page's
    rows only (at most MAX_PER_PAGE, hence the broadcasts)."""
    br = t["billing_records"]
    if status:
        br = br.where(F.col("status") == status)
    br = _date_range(br, "created_date", date_from, date_to)
    order = [F.col("created_date").desc(), F.col("id").desc()]
    rows = paginate(br, order, page, per_page)
    extra = ["total", "page", "per_page", "pages"]
    ids = F.broadcast(rows.select(F.col("id").alias("billing_record_id")))
    items = invoice_items({"billing_items": t["billing_items"].join(ids, "billing_record_id", "left_semi")})
    patients = _patient_names(t).drop("patient_phone").join(
        F.broadcast(rows.select("patient_id").distinct()), "patient_id", "left_semi")
    j = rows.join(patients, "patient_id", "left").join(items.withColumnRenamed("billing_record_id", "id"), "id", "left")
    numbers = rows.select("id", *extra)
    return (_invoice_columns(j, items_as_text=True).join(F.broadcast(numbers), "id")
            .orderBy(F.col("created_at").desc(), F.col("id").desc()))


def pending_total(billing: DataFrame) -> DataFrame:
    """What is still to be paid of the invoices of a (page of a) billing list."""
    pending = F.col("status") == "pending"
    return billing.agg(F.count_if(pending).alias("pending_invoices"), money(F.sum(F.when(pending, F.col("total_amount")))).alias("pending_total"), F.count(F.lit(1)).alias("invoices"))


def search_patients(t, search: str | None = None, as_of=None) -> DataFrame:
    """Active patients whose first name, last name or phone contains
    ``search`` case-insensitively (``%``/``_`` in it stay wildcards)."""
    p = patient_detail(t, as_of).where(F.col("is_active"))
    if search:
        pat = f"%{search}%"
        p = p.where(F.col("first_name").ilike(pat) | F.col("last_name").ilike(pat) | F.col("phone").ilike(pat))
    return p


def page_patients(t, search=None, page=1, per_page=20, as_of=None) -> DataFrame:
    p = search_patients(t, search, as_of)
    return paginate(p, [F.col("last_name").asc_nulls_last(), F.col("first_name").asc_nulls_last(),
                        F.col("id")], page, per_page)


def patient_visit_history(t, per_page: int = 20) -> DataFrame:
    """Every active patient's visits newest first, with visit ordinal and
    page number (the batch form of the per-patient paginated history)."""
    _, n = page_params(1, per_page)
    active = t["patients"].where(F.col("is_active")).select(F.col("id").alias("patient_id"))
    v = visit_detail(t).join(active, "patient_id", "left_semi")
    v = ordinal_within(v, "patient_id", "created_at", "id", descending=True)
    return v.withColumn("page", F.ceil(F.col("ordinal") / F.lit(n)).cast("bigint"))


def lookup_patients(t, ids: DataFrame, as_of=None) -> DataFrame:
    """Batch point lookup: each requested id with its active patient row
    (NULLs and found = false when missing or inactive)."""
    p = patient_detail(t, as_of).where(F.col("is_active"))
    req = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    j = req.join(p.withColumn("found", F.lit(True)), "id", "left")
    return j.withColumn("found", F.coalesce(F.col("found"), F.lit(False)))
