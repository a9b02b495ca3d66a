"""Skew-safe operators equal their plain per-key forms when one key is hot."""
import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from clinlytics.operators import jobs
from clinlytics.operators.lists import ordinal_within
from tests import seed


def _hot_visits(spark):
    base = seed.seed_rows()["visits"][0]
    rows = []
    for i in range(600):
        pid = 1 if i % 3 == 0 else 2 + i % 50          # patient 1 holds a third of all visits
        d = dt.date(2020, 1, 1) + dt.timedelta(days=(i * 7) % 900)
        rows.append((i + 1, i + 1, pid, 1) + base[4:10] + (d,))
    return seed.tables(spark, {"visits": rows})


def test_sliced_lag_equals_plain_lag(spark):
    t = _hot_visits(spark)
    mine = {r.visit_id: r.gap_days for r in jobs.visit_gaps(t).collect()}
    w = Window.partitionBy("patient_id").orderBy("created_date", "id")
    plain = t["visits"].select("id", F.datediff("created_date", F.lag("created_date").over(w)).alias("g"))
    assert mine == {r.id: r.g for r in plain.collect()}


def test_sliced_ordinal_equals_row_number(spark):
    t = _hot_visits(spark)
    v = t["visits"].select("id", "patient_id", F.col("created_date").alias("created_at"))
    mine = {r.id: r.ordinal for r in ordinal_within(v, "patient_id", "created_at", "id", descending=True).collect()}
    w = Window.partitionBy("patient_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    plain = {r.id: r.n for r in v.select("id", F.row_number().over(w).alias("n")).collect()}
    assert mine == plain


def test_mean_gap_by_telescoping_equals_lag_average(spark):
    t = _hot_visits(spark)
    stats = {r.patient_id: r.visit_frequency_days for r in jobs.visit_stats(t).collect()}
    gaps = jobs.visit_gaps(t).groupBy("patient_id").agg(F.round(F.avg("gap_days"), 2).alias("a")).collect()
    for r in gaps:
        want = None if r.a is None else round(r.a, 2)
        got = None if stats[r.patient_id] is None else float(stats[r.patient_id])
        assert got == want
