"""Stateful functions of the streams.

The keys of a stream are hashed to a fixed number of groups. A function sees the
new rows of one group at a time and reads and writes that group's state, one row
in the state store, so a call and a state access serve many keys; a group grows
with the keys only by their number over ``GROUPS``. What is kept of a key is a
status, a contribution or a list of block numbers. ``StatusMachine`` is the form
for queries that go on running: a state per appointment, with the ids seen, one
state row each, which a timer drops once the appointment is done.
"""
from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clinlytics.operators.writes import LATE, FINAL_STATUSES, transition_reason


class StatusMachine(StatefulProcessor):
    """Applies status events to one appointment in the order (ts, event_id).

    Every event comes out once. One that comes behind the last applied place is
    a reject (late); an id seen before is left out. With ``retain_ms``, a timer
    drops the ids so long after a final status; from then on a repeated id
    comes out once more, as a late reject. Timers need a query that goes on
    running; without them the ids stay.
    """

    def __init__(self, retain_ms: int | None = None) -> None:
        self.retain_ms = retain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string, at bigint, event_id bigint")
        self.seen = handle.getMapState("seen", "event_id bigint", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events = sorted(((r.at, r.event_id, r.ts, r.to_status, r.role, r.status0) for r in rows), key=lambda e: e[:2])
        if self.now.exists():
            status, at, last = self.now.get()
            fresh = False
        else:
            status, at, last, fresh = next((e[5] for e in events if e[5] is not None), None), None, None, True
        was_final, known = status in FINAL_STATUSES, set()
        for place, event_id, ts, to_status, role, _ in events:
            if event_id in known or not fresh and self.seen.containsKey((event_id,)):
                continue
            known.add(event_id)
            self.seen.updateValue((event_id,), (place,))
            late = at is not None and (place, event_id) < (at, last)
            reason = LATE if late else transition_reason(status, to_status, role)
            yield Row(event_id=event_id, appointment_id=key[0], ts=ts, role=role, from_status=status, to_status=to_status,
                      accepted=reason is None, reason=reason)
            if reason is None:
                status = to_status
            if not late:
                at, last = place, event_id
        self.now.update((status, at, last))
        if self.retain_ms is not None and status in FINAL_STATUSES and (fresh or not was_final):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retain_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


# ---------------------------------------------------------------- groups ----
#: groups that the keys of a stream are hashed to; a function call and a state row serve one group of keys
GROUPS = 4_096


def _held(state) -> dict:
    """The state of a group: key -> what is kept of it."""
    return {key: kept for key, *kept in json.loads(state.get[0])} if state.exists else {}


def _hold(state, held: dict) -> None:
    state.update((json.dumps([[key, *kept] for key, kept in held.items()]),))


def _columns(batches: Iterator[pd.DataFrame], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[n].tolist() for n in names), strict=True)


def status_groups(group, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Applies status events to the appointments of one group; none comes from an earlier batch.

    The state of an appointment is its status and the place of its last event.
    """
    held, events = _held(state), {}
    for appointment, *event in _columns(batches, "appointment_id", "at", "event_id", "to_status", "role", "status0", "ts"):
        events.setdefault(appointment, []).append(event)
    out = []
    for appointment, own in events.items():
        own = [(at, None if i is None else int(i), *rest) for at, i, *rest in own]
        own.sort(key=lambda e: (e[0], e[1] is not None, e[1] or 0))
        status, at, last = held.get(appointment) or (next((e[4] for e in own if e[4] is not None), None), None, None)
        known = set()
        for place, event_id, to_status, role, _, ts in own:
            if event_id in known:  # the appointment is in its table more than once
                continue
            known.add(event_id)
            late = at is not None and (place, event_id is not None, event_id or 0) < (at, last is not None, last or 0)
            reason = LATE if late else transition_reason(status, to_status, role)
            out.append((None if event_id is None else str(event_id), appointment, ts, role, status, to_status, reason is None, reason))
            if reason is None:
                status = to_status
            if not late:
                at, last = place, event_id
        held[appointment] = (status, at, last)
    _hold(state, held)
    yield pd.DataFrame(out, columns=["event_id", "appointment_id", "ts", "role", "from_status", "to_status", "accepted", "reason"])


def earliest_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the events of a micro-batch's partition with the same id, the first by place (each appointment is in one partition)."""
    parts = [b for b in batches if b.num_rows]
    if parts:
        rows = pa.Table.from_batches(parts).sort_by([(c, "ascending") for c in ("appointment_id", "event_id", "at")])
        ids = rows.select(["appointment_id", "event_id"]).to_pandas(integer_object_nulls=True).fillna("")
        yield from rows.filter(pa.array(~ids.duplicated().to_numpy())).to_batches()


def _invoice_order(content: str) -> str:
    """Decides between versions of the same number."""
    own = json.loads(content)
    date, *rest = own.values()
    return str((dt.date.fromisoformat(date) if date else None, *rest))


def invoice_groups(group, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Turns versions of the invoices of one group into what they take from and add to their (date, department).

    The state of an invoice is the contribution that counts now. An older
    version than that changes nothing; of several in one batch the newest counts.
    """
    held, newest, out = _held(state), {}, []
    for key, version, content in _columns(batches, "id", "version", "contribution"):
        best = newest.get(key)
        if best is None or version > best[0] or version == best[0] and content != best[1] and _invoice_order(content) > _invoice_order(best[1]):
            newest[key] = version, content
    for key, (version, content) in newest.items():
        old = held.get(key)
        if old is not None and old[0] > version:
            continue
        held[key] = version, content
        if old is not None and old[1] == content:
            continue
        if old is not None:
            out.append((-1, old[1]))
        out.append((1, content))
    _hold(state, held)
    yield pd.DataFrame(out, columns=["sign", "contribution"])


def summary_groups(group, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Lets the summaries of one group of patients pass when their hash is new, with the blocks that they no longer have.

    The state of a patient is the hash, the version, the number of changes so
    far and the block numbers in the store. Of several summaries in one batch
    the newest counts.
    """
    held, newest, out = _held(state), {}, []
    for key, version, digest, blocks, text in _columns(batches, "patient_id", "version", "summary_hash", "blocks", "summary_text"):
        if key not in newest or (version, digest) > newest[key][:2]:
            newest[key] = version, digest, blocks, text
    for key, (version, digest, blocks, text) in newest.items():
        old = held.get(key)
        if old is not None and (old[0] == digest or old[1] > version):
            continue
        generation = (old[2] if old is not None else 0) + 1
        held[key] = digest, version, generation, blocks
        now = set(blocks.split(","))
        gone = [b for b in (old[3].split(",") if old is not None else ()) if b and b not in now]
        out.append((key, text, digest, generation, ",".join(gone)))
    _hold(state, held)
    yield pd.DataFrame(out, columns=["patient_id", "summary_text", "summary_hash", "generation", "gone"])
