"""Requests that depend on each other, against a run that applies them one by one."""
import datetime as dt
import random
from decimal import Decimal

from clinlytics.operators import writes as wr

ITEMS = "billing_record_id long, item_no int, description string, category string, amount decimal(10,2)"
CHANGES = "request_id long, kind string, billing_record_id long, item_no int, description string, category string, amount decimal(10,2)"


def _sequential(status, items, changes):
    now, out = {(b, n): [d, c, a] for b, n, d, c, a in items}, {}
    nos = {b: max((n for x, n, *_ in items if x == b), default=-1) for b in status}
    for r, kind, b, n, d, c, a in sorted(changes):
        fields = kind != "remove"
        given = lambda v: kind == "add" or v is not None
        if fields and given(d) and not (d and len(d) <= 255):
            why = "description must have 1 to 255 characters"
        elif fields and given(c) and c not in wr.ITEM_CATEGORIES:
            why = "invalid category"
        elif kind == "add" and a is None:
            why = "amount is required"
        elif b not in status:
            why = "billing record not found"
        elif kind == "add":
            why = None if status[b] in ("pending", "partially_paid") else f"cannot add items to a billing record with status '{status[b]}'"
            if why is None:
                nos[b] += 1
                now[b, nos[b]] = [d, c, a]
        elif (b, n) not in now or n > max((m for x, m, *_ in items if x == b), default=-1):
            why = "line item not found"
        elif kind == "remove":
            why = "cannot remove consultation fee" if now[b, n][1] == "consultation" else None
            if why is None:
                del now[b, n]
        else:
            why = None
            now[b, n] = [new if new is not None else old for new, old in zip((d, c, a), now[b, n])]
        out[r] = why
    return out, sorted((b, n, *v) for (b, n), v in now.items())


def test_item_changes_equal_a_sequential_run(spark):
    rng = random.Random(6)
    money = lambda: Decimal(rng.randrange(1, 9_999)) / 100
    status = {b: rng.choice(["pending", "partially_paid", "paid"]) for b in range(8)}
    items = [(b, n, f"item {n}", rng.choice(wr.ITEM_CATEGORIES), money()) for b in status for n in range(3)]
    changes = []
    for r in range(260):
        kind = rng.choice(["add", "update", "update", "remove"])
        b, n = rng.choice([0, 0, *range(9)]), rng.randrange(4)  # one invoice with many, one unknown
        d = rng.choice([None, "", "x" * 256, f"text {r}", f"text {r}"]) if kind != "remove" else None
        c = rng.choice([None, "consultation", "test", "other", "magic"]) if kind != "remove" else None
        changes.append((r, kind, b, n if kind != "add" else None, d, c, rng.choice([None, money(), money()]) if kind != "remove" else None))
    rng.shuffle(changes)
    records = spark.createDataFrame(list(status.items()), "id long, status string")
    out, after = wr.apply_item_changes(records, spark.createDataFrame(items, ITEMS), spark.createDataFrame(changes, CHANGES))
    want, left = _sequential(status, items, changes)
    assert {r.request_id: r.reason for r in out.collect()} == want and len(set(want.values())) == 8
    assert sorted(tuple(r) for r in after.collect()) == left


def test_payments_check_their_method_and_pay_once(spark):
    records = spark.createDataFrame([(1, "pending", None, None), (2, "paid", "cash", dt.date(2024, 1, 1)), (3, "partially_paid", None, None)], "id long, status string, payment_method string, payment_date date")
    asked = [(1, 1, "gold", "a"), (2, 1, "upi", "b"), (3, 1, "card", "c"), (4, 2, "card", "d"), (5, 9, "card", "e"), (6, 3, None, "f")]
    got = {r.request_id: (r.reason, r.payment_method, r.notes) for r in wr.apply_payments(records, spark.createDataFrame(asked, "request_id long, billing_record_id long, payment_method string, notes string")).collect()}
    assert got == {1: ("invalid payment method", None, None), 2: (None, "upi", "b"), 3: ("billing record is already 'paid'", None, None),
                   4: ("billing record is already 'paid'", "cash", None), 5: ("billing record not found", None, None), 6: ("invalid payment method", None, None)}


def test_created_visits_keep_their_fields(spark, small):
    free = small["appointments"].join(small["visits"].select("appointment_id"), small["appointments"].id == small["visits"].appointment_id, "left_anti")
    ids = [r.id for r in free.orderBy("id").limit(3).collect()]
    asked = spark.createDataFrame([(1, ids[0], "cough", "flu", dt.date(2024, 2, 1)), (2, ids[1], None, "", None), (3, ids[2], None, "cold", None), (4, ids[2], "late", "x", None)],
                                  "request_id long, appointment_id long, symptoms string, diagnosis string, follow_up_date date")
    appointments = small["appointments"].selectExpr("id", "patient_id", "doctor_id", "department_id", "'in_progress' AS status")
    out = wr.create_visits(small, appointments, asked)
    assert {r.request_id: r.reason for r in out.collect()} == {1: None, 2: "diagnosis is required", 3: None, 4: "visit already exists"}
    made = {k: sorted(df.collect()) for k, df in wr.visit_tables(out, asked, dt.date(2024, 1, 2)).items()}
    assert [(r.symptoms, r.diagnosis, r.follow_up_date, r.created_date) for r in made["visits"]] == [("cough", "flu", dt.date(2024, 2, 1), dt.date(2024, 1, 2)), (None, "cold", None, dt.date(2024, 1, 2))]
    assert [r.id for r in made["appointments"]] == [ids[0], ids[2]] and all(r.status == "completed" for r in made["appointments"])
    assert [(r.billing_record_id, r.amount) for r in made["billing_items"]] == [(r.id, r.total_amount) for r in made["billing_records"]]
    for name, df in wr.visit_tables(out, asked).items():
        assert set(df.columns) <= set(small[name].columns)
