"""Smaller operators: SQL files, DDL, input checks, updates, staff, departments, auto-ingest."""
import datetime as dt
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from clinlytics.functions.core import blank_to_null, parse_date
from clinlytics.operators import jobs
from clinlytics.operators import lists as ls
from clinlytics.operators import retrieval as rg
from clinlytics.operators import upsert as up
from clinlytics.operators import writes as wr
from clinlytics.plans.sqlfiles import daily_revenue_sql
from clinlytics.sources import schemas
from tests import seed


def test_sql_file_equals_dataframe_job(spark):
    t = seed.tables(spark)
    a = sorted(tuple(r) for r in daily_revenue_sql(t).collect())
    assert a == sorted(tuple(r) for r in jobs.daily_revenue(t).collect())
    assert daily_revenue_sql(t, since=seed.AS_OF + dt.timedelta(days=1)).count() == 0


def test_create_and_clear_tables(spark):
    root = tempfile.mkdtemp(prefix="ddl-", dir="/tmp")
    assert schemas.create_if_missing(spark, root, "daily_revenue") is True
    assert schemas.create_if_missing(spark, root, "daily_revenue") is False
    up.upsert_table(spark, f"{root}/daily_revenue", jobs.daily_revenue(seed.tables(spark)), ["date", "department_id"])
    assert up.read_table(spark, f"{root}/daily_revenue").count() == 1
    assert schemas.clear_table(spark, f"{root}/daily_revenue") == 1
    assert up.read_table(spark, f"{root}/daily_revenue").count() == 0


def test_input_helpers(spark):
    df = spark.createDataFrame([("  x ",), ("   ",), ("2024-02-30",), ("2024-02-29",), ("24-1-1",)], "s string")
    out = df.select(blank_to_null(F.col("s")).alias("b"), parse_date(F.col("s")).alias("d")).collect()
    assert [r.b for r in out[:2]] == ["x", None]
    assert [r.d for r in out[2:]] == [None, dt.date(2024, 2, 29), None]
    q = spark.createDataFrame([("a", "  hi "), ("b", " "), ("c", "x" * 501)], "query_id string, query string")
    got = {r.query_id: (r.query, r.reason) for r in rg.validate_queries(q).collect()}
    assert got["a"] == ("hi", None) and got["b"][1] == "Query is required" and got["c"][1].startswith("Query too long")


def test_update_patients_rechecks_phone(spark):
    t = seed.tables(spark)
    ch = spark.createDataFrame([(1, "9876543211", True, "Rameshwar", True), (3, "9000000000", True, None, False)],
                               "id long, phone string, set_phone boolean, first_name string, set_first_name boolean")
    after, rejected = wr.update_patients(t["patients"], ch)
    assert [r.id for r in rejected.collect()] == [1]  # 1 would take patient 2's phone
    rows = {r.id: r for r in after.collect()}
    assert rows[1].phone == "9876543210" and rows[1].first_name == "Ramesh"
    assert rows[3].phone == "9000000000" and rows[3].first_name == "Bikram"


def test_departments_and_staff(spark):
    t = seed.tables(spark)
    deps = spark.createDataFrame([(1, "Cardiology", Decimal("1.00")), (2, "Oncology", Decimal("0.00")),
                                  (3, "Dermatology", Decimal("250.50")), (4, "Dermatology", Decimal("100.00"))],
                                 "request_id long, name string, consultation_fee decimal(10,3)")
    got = {r.request_id: r.reason for r in wr.create_departments(deps, t["departments"]).collect()}
    assert got == {1: "department already exists", 2: "consultation fee must be positive", 3: None,
                   4: "department already exists"}
    staff = spark.createDataFrame([(1, "anita@clinic", "A", "front_desk"), (2, "new@clinic", "B", "nurse"),
                                   (3, "new@clinic", "C", "admin")], "request_id long, email string, full_name string, "
                                                                     "role string")
    got = {r.request_id: r.reason for r in wr.register_staff(staff, t["users"]).collect()}
    assert got == {1: "user with this email already exists", 2: "invalid role", 3: None}


def test_store_auto_ingest(spark):
    t = seed.tables(spark)
    root = tempfile.mkdtemp(prefix="store-", dir="/tmp")
    s = rg.ensure_store(spark, f"{root}/s", jobs.clinical_summaries(t, as_of=seed.AS_OF))
    assert [r.chunk_id for r in s.collect()] == ["1_visit_1"]
    st = rg.store_status(s).collect()[0]
    assert st.chunks == 1 and st.ready


def test_upsert_into_a_table_is_idempotent_and_merges(spark):
    root = tempfile.mkdtemp(prefix="klog-", dir="/tmp")
    e0 = spark.createDataFrame([(1, "a", dt.datetime(2020, 1, 1)), (2, "b", dt.datetime(2020, 1, 1))],
                               "id long, v string, created_at timestamp")
    e1 = spark.createDataFrame([(2, "B", dt.datetime(2021, 1, 1))], "id long, v string, created_at timestamp")
    for rows, n in ((e0, 2), (e1, 1), (e1, 1)):  # the last one again
        assert up.upsert_table(spark, root, rows, ["id"], created_col="created_at") == n
    got = sorted(tuple(r) for r in up.read_table(spark, root).collect())
    assert got == [(1, "a", dt.datetime(2020, 1, 1)), (2, "B", dt.datetime(2020, 1, 1))]


def test_reschedule_only_scheduled_and_free_slot(spark):
    t = seed.tables(spark)
    req = spark.createDataFrame([
        (1, 2, seed.AS_OF, "16:00"),   # scheduled, free slot -> ok
        (2, 1, seed.AS_OF, "16:30"),   # completed -> rejected
        (3, 3, seed.AS_OF, "09:00"),   # doctor 1 already holds 09:00
    ], "request_id long, appointment_id long, appointment_date date, appointment_time string")
    got = {r.request_id: r.reason for r in wr.reschedule_appointments(t["appointments"], req).collect()}
    assert got == {1: None, 2: "only scheduled appointments can be rescheduled", 3: "slot already booked"}


def test_sparse_updates_soft_delete_remove(spark):
    t = seed.tables(spark)
    ch = spark.createDataFrame([(2, 1, "Cardio", True, Decimal("900.00"), False),
                                (2, 2, None, False, Decimal("650.00"), True)],
                               "id int, change_id int, name string, set_name boolean, consultation_fee decimal(10,2), "
                               "set_consultation_fee boolean")
    d = {r.id: r for r in wr.apply_updates(t["departments"], ch, "id", ["name", "consultation_fee"]).collect()}
    assert d[2].name == "Gastroenterology" and d[2].consultation_fee == Decimal("650.00")  # latest change wins
    gone = spark.createDataFrame([(3,)], "id int")
    assert {r.id: r.is_active for r in wr.soft_delete(t["departments"], gone).collect()}[3] is False
    assert sorted(r.id for r in wr.remove_rows(t["departments"], gone).collect()) == [1, 2, 4]


def test_plugged_in_model_embedder(spark):
    from clinlytics.functions.vectors import model_embedder

    def fake_model(texts):
        return [[float(len(s)), float(s.count("a")), 1.0] for s in texts]

    t = seed.tables(spark)
    store = rg.build_store(jobs.clinical_summaries(t, as_of=seed.AS_OF), embedder=model_embedder(fake_model, 3))
    vec = store.collect()[0].embedding
    assert len(vec) == 3 and vec[2] == 1.0
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, qvec array<double>")
    top = rg.vector_topk(q, store, top_k=1).collect()
    assert top[0].chunk_id == "1_visit_1" and top[0].rank == 1


def test_a_billing_list_gathers_the_items_of_its_invoices_only(spark):
    from tests import seed
    t = seed.tables(spark)
    records, items = t["billing_records"], t["billing_items"]
    t["billing_records"] = records.unionByName(records.withColumns({"id": F.col("id") + 10, "status": F.lit("pending")}))
    t["billing_items"] = items.unionByName(items.withColumn("billing_record_id", F.col("billing_record_id") + 10))
    out = ls.list_billing(t, "pending")
    whole = ls.invoice_detail(t, items_as_text=True).where("status = 'pending'")
    assert out.collect() == whole.collect() and out.first()["id"] == 11 and out.first()["items"] and out.count() == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("LeftSemi") > plan.index("collect_list")


def test_tables_are_derived_when_a_query_reads_them(spark, tmp_path):
    import os

    from clinlytics.sources.driver import clinic_table_path, clinic_tables
    rows = [(i, f"Customer#{i}", "BUILDING") for i in range(1, 41)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    t = clinic_tables(spark, str(tmp_path))
    assert t["patients"].count() == 40 and t["patients"].where("not is_active").count() == 2
    local = t.root.replace("file:", "")
    assert os.listdir(local) == ["patients"] and clinic_table_path(spark, str(tmp_path), "patients") == f"{t.root}/patients"
    again = clinic_tables(spark, str(tmp_path))
    assert again.root == t.root and again["patients"] is t["patients"]
