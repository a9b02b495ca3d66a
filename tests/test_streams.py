"""Keyed state of the streams: moved and vanished rows, late and repeated events, shrinking summaries, timers."""
import datetime as dt
import random
import tempfile

from pyspark.sql import Row
from pyspark.sql import functions as F

from clinlytics.operators import jobs
from clinlytics.operators import retrieval as rg
from clinlytics.operators import writes as wr
from clinlytics.streaming import jobs as sj
from clinlytics.streaming.state import StatusMachine
from tests import seed

EVENTS = "appointment_id long, event_id long, ts timestamp_ntz, to_status string, role string"


def _dir(name):
    return tempfile.mkdtemp(prefix=f"{name}-", dir="/tmp")


def test_a_moved_payment_date_refreshes_both_days(spark):
    t = seed.tables(spark)
    root, now = _dir("moved"), t["billing_records"]
    paid = now.where("payment_date IS NOT NULL")
    versions = [(1, 0), (2, -7), (3, None), (2, 5), (4, 2), (4, 2)]  # version 2 comes again behind 3
    for i, (version, days) in enumerate(versions):
        date = F.date_add("payment_date", days) if days is not None else F.lit(None).cast("date")
        row = paid.withColumn("payment_date", date).withColumn("version", F.lit(version).cast("long"))
        row.write.parquet(f"{root}/src/slice={i}")
        if i in (1, 2, 5):
            out = sj.refresh_daily_revenue(spark, t, f"{root}/src/slice=*", f"{root}/log", f"{root}/ck", 100, version="version")
            best = max(versions[:i + 1], key=lambda v: v[0])
            t["billing_records"] = paid.withColumn("payment_date", F.date_add("payment_date", best[1]) if best[1] is not None else F.lit(None).cast("date"))
            want = sorted(tuple(r) for r in jobs.daily_revenue(t).collect())
            assert sorted(tuple(r) for r in out.collect()) == want and (len(want) == 0) == (best[1] is None)
            assert out.schema.simpleString().replace("bigint", "int") == jobs.daily_revenue(t).schema.simpleString().replace("bigint", "int")


def _fold(events, status, batch_of):
    """The outcome of each event, one at a time in the order of the batches."""
    now, last, seen, out = dict(status), {}, set(), {}
    for _, _, a, i, ts, to, role in sorted((batch_of[k], (e[2], e[1]), *e) for k, e in enumerate(events)):
        if (a, i) in seen:
            continue
        seen.add((a, i))
        late = a in last and (ts, i) < last[a]
        reason = wr.LATE if late else wr.transition_reason(now.get(a), to, role)
        out[i] = (a, now.get(a), reason is None, reason)
        if reason is None:
            now[a] = to
        if not late:
            last[a] = (ts, i)
    return out


def test_events_in_any_order_equal_a_sequential_fold(spark):
    rng, start = random.Random(4), dt.datetime(2024, 1, 1)
    status = {a: rng.choice(["scheduled", "scheduled", "in_progress", "completed"]) for a in range(12)}
    events = []
    for i in range(160):
        to, role = rng.choice([("in_progress", "doctor"), ("completed", "doctor"), ("cancelled", "admin"), ("no_show", "front_desk"), ("completed", "admin")])
        events.append((rng.choice([0, 0, 0, *range(14)]), i, start + dt.timedelta(minutes=rng.randrange(50)), to, role))
    events += events[:20]  # again
    batch_of = [rng.randrange(3) for _ in events]
    root, out = _dir("fold"), None
    for b in range(3):
        spark.createDataFrame([e for e, k in zip(events, batch_of) if k == b], EVENTS).repartition(3).write.parquet(f"{root}/events/slice={b}")
        stream = spark.readStream.schema(EVENTS).parquet(f"{root}/events/slice=*")
        out = sj.status_event_stream(spark, spark.createDataFrame(list(status.items()), "id long, status string"), stream, f"{root}/out", f"{root}/ck")
    got = out.collect()
    assert {r.event_id: (r.appointment_id, r.from_status, r.accepted, r.reason) for r in got} == _fold(events, status, batch_of)
    assert len(got) == len({r.event_id for r in got})


class _Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class _Map(dict):
    containsKey, updateValue = dict.__contains__, dict.__setitem__


class _Handle:
    def __init__(self):
        self.timers, self.map = [], _Map()

    def getValueState(self, *_):
        return _Value()

    def getMapState(self, *_):
        return self.map

    def registerTimer(self, at):
        self.timers.append(at)


class _Times:
    def getCurrentProcessingTimeInMs(self):
        return 1_000


def test_a_finished_appointment_drops_its_ids():
    row = lambda i, to, role="doctor": Row(event_id=i, ts=None, at=i, to_status=to, role=role, status0="scheduled")
    handle, machine = _Handle(), StatusMachine(retain_ms=500)
    machine.init(handle)
    step = lambda *rows: [(r.event_id, r.reason) for r in machine.handleInputRows((7,), iter(rows), _Times())]
    assert step(row(1, "in_progress")) == [(1, None)] and handle.timers == [] and set(handle.map) == {(1,)}
    assert step(row(2, "completed"), row(1, "in_progress")) == [(2, None)] and handle.timers == [1_500]
    assert step(row(3, "cancelled", "admin"))[0][1].startswith("cannot") and handle.timers == [1_500]
    assert list(machine.handleExpiredTimer((7,), _Times(), None)) == [] and not handle.map
    assert step(row(1, "in_progress")) == [(1, wr.LATE)]


def test_a_shrinking_summary_leaves_no_stale_chunk(spark):
    root, head = _dir("shrink"), "PATIENT: A Bee | Age: 1\n\n"
    visit = lambda i: f"VISIT {i} [2024-0{i}-01]\nDr. X, Y\nDiagnosis: d{i}"
    texts = [head + "\n\n".join(map(visit, (1, 2, 3))), head + visit(1), head + visit(1), " ", head + "\n\n".join(map(visit, (1, 2))), None]
    for i, text in enumerate(texts):
        df = spark.createDataFrame([(1, text, 2), (2, head + visit(5), 1)], "patient_id long, summary_text string, visit_count int")
        df.withColumn("summary_hash", F.sha2("summary_text", 256)).coalesce(1).write.parquet(f"{root}/src/slice={i}")
        if i == 2:
            continue  # an unchanged summary together with the next one
        out = sj.ingest_summaries(spark, f"{root}/src/slice=*", f"{root}/store", f"{root}/ck", 100)
        got = {r.chunk_id: (r.document, list(r.embedding), r.doctor_name) for r in out.collect()}
        want = {r.chunk_id: (r.document, list(r.embedding), r.doctor_name) for r in rg.build_store(df).collect()}
        assert got == want and len(got) == {0: 4, 1: 2, 3: 1, 4: 3, 5: 1}[i]
    log = spark.read.parquet(f"{root}/store")
    assert log.where("patient_id = 2").count() == 1  # never written again
