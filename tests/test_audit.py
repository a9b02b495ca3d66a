"""The audit's key rules on broken rows (the given data breaks few of them)."""
from pyspark.sql import functions as F

from clinlytics.operators.writes import FOREIGN_KEYS, UNIQUE_COLUMNS, audit_constraints
from clinlytics.sources.driver import clinic_tables

SF = "/root/testdata/sf0.001"


def _found(t):
    return {(r.table_name, r.rule) for r in audit_constraints(t).select("table_name", "rule").distinct().collect()}


def test_dangling_keys_are_reported_once_per_rule(spark):
    base = clinic_tables(spark, SF)
    t = {n: base[n] for n in ("departments", "users", "doctors", "patients", "appointments", "visits", "billing_items", "billing_records")}
    for name, col, _ in FOREIGN_KEYS:
        t[name] = t[name].withColumn(col, F.col(col) + 10_000_000)
    assert {(a, f"fk_{k}") for a, k, _ in FOREIGN_KEYS} <= _found(t)


def test_repeated_unique_values_are_reported(spark):
    base = clinic_tables(spark, SF)
    t = {n: base[n] for n in ("departments", "users", "doctors", "patients", "appointments", "visits", "billing_items", "billing_records")}
    for name in {a for a, _ in UNIQUE_COLUMNS}:
        t[name] = t[name].unionByName(t[name])
    assert {(a, f"{k}_unique") for a, k in UNIQUE_COLUMNS} <= _found(t)


def test_key_rules_deal_rows_by_their_number(spark, monkeypatch):
    from clinlytics.operators import writes
    base = clinic_tables(spark, SF)
    t = {n: base[n] for n in ("departments", "users", "doctors", "patients", "appointments", "visits", "billing_items", "billing_records")}
    before = sorted(map(tuple, audit_constraints(t).collect()))
    monkeypatch.setattr(writes, "AUDIT_ROWS", 100)
    monkeypatch.setattr(writes, "AUDIT_BROADCAST", 0)
    out = audit_constraints(t)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert f", {-(-t['appointments'].count() // 100)}" in plan and sorted(map(tuple, out.collect())) == before
