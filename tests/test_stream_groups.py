"""The streams' state is kept per group of keys: one function call serves many keys."""
import datetime as dt
import tempfile
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from clinlytics.operators import writes as wr
from clinlytics.streaming import jobs as sj
from clinlytics.streaming import state as st


class _State(SimpleNamespace):
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_one_call_serves_many_invoices():
    state, calls = _State(), lambda s, rows: next(st.invoice_groups((0,), iter([pd.DataFrame(rows, columns=["id", "version", "contribution"])]), s))
    c = lambda d, n: f'{{"payment_date":"{d}","total_cents":{n}}}'
    first = calls(state, [(str(i), 1, c("2024-01-01", i)) for i in range(500)] + [(None, 1, c("2024-01-01", 7))])
    assert len(first) == 501 and set(first["sign"]) == {1}
    then = calls(state, [("3", 2, c("2024-01-02", 3)), ("4", 0, c("2024-01-09", 4)), ("5", 2, c("2024-01-01", 5)), ("6", 1, c("2024-01-05", 6)), ("6", 1, c("2024-01-04", 6))])
    assert list(then.itertuples(index=False, name=None)) == [(-1, c("2024-01-01", 3)), (1, c("2024-01-02", 3)), (-1, c("2024-01-01", 6)), (1, c("2024-01-05", 6))]


def test_one_call_serves_many_patients():
    state, names = _State(), ["patient_id", "version", "summary_hash", "blocks", "summary_text"]
    step = lambda *rows: list(next(st.summary_groups((0,), iter([pd.DataFrame(list(rows), columns=names)]), state)).itertuples(index=False, name=None))
    assert step(("1", 1, "a", "1,2,3", "x"), ("2", 1, "b", "", None)) == [("1", "x", "a", 1, ""), ("2", None, "b", 1, "")]
    assert step(("1", 2, "c", "1,3", "y"), ("1", 1, "a", "1,2,3", "x"), ("2", 2, "b", "", None)) == [("1", "y", "c", 2, "2")]
    assert step(("1", 1, "a", "1,2,3", "x")) == []


def test_an_id_that_comes_again_with_other_content_counts_by_its_first_place(spark):
    start, root = dt.datetime(2024, 1, 1), tempfile.mkdtemp(prefix="again-", dir="/tmp")
    schema = "appointment_id long, event_id long, ts timestamp_ntz, to_status string, role string"
    hour = lambda h: start + dt.timedelta(hours=h)
    batches = [[(1, 7, hour(2), "cancelled", "admin"), (1, 7, hour(1), "in_progress", "doctor"), (2, None, hour(5), "no_show", "admin"), (2, None, hour(4), "cancelled", "doctor"), (None, 9, hour(1), "completed", "doctor")],
               [(1, 7, hour(9), "completed", "doctor"), (1, 8, hour(8), "completed", "doctor"), (2, 10, hour(3), "cancelled", "admin")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{root}/events/slice={i}")
        stream = spark.readStream.schema(schema).parquet(f"{root}/events/slice=*")
        out = sj.status_event_stream(spark, spark.createDataFrame([(1, "scheduled"), (2, "scheduled"), (2, "scheduled")], "id long, status string"), stream, f"{root}/out", f"{root}/ck")
    assert sorted(out.select(F.coalesce("appointment_id", F.lit(0)), F.coalesce("event_id", F.lit(0)), "from_status", "accepted", "reason").collect()) == [
        (0, 9, None, False, wr.NOT_FOUND), (1, 7, "scheduled", True, None), (1, 8, "in_progress", True, None),
        (2, 0, "scheduled", False, wr.DESK_ONLY.format("cancelled")), (2, 10, "scheduled", False, wr.LATE)]
    assert {r.ts for r in out.where("event_id = 7").collect()} == {hour(1)} and out.schema["ts"].dataType.simpleString() == "timestamp_ntz"
