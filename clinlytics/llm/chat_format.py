"""Operator 12: conversations of any declared layout as canonical turns, formatted for training.

Every record is JSON. The set of its nested field paths (``messages[].role``)
is hashed; the fingerprint selects a declarative mapping, a list of steps that
read turns off the record. The table of fingerprints is built from LAYOUTS,
one entry for each choice of a layout's optional paths. A record with further
fields is looked up again by the paths that some layout names. A record whose
fingerprint is unknown gives no turn and is reported by ``unmapped``.

The template sets marks around each turn and makes every control string inside
a text differ from a mark by one more backslash behind its bracket, so that
texts come back exactly. Turns are formatted row by row; only reading back
brings a conversation's pieces together, sorted by Spark and streamed through
incremental digests, so that a conversation of any length takes the memory of
one turn.

Defined results: a null text or role is empty; a null conv_id is one
conversation; turns come by (turn, place in the record, role, text), null
turns first; repeated rows are repeated turns; roles other than the three with
marks of their own keep their name in the text; columns other than conv_id,
turn, role and text are ignored; an empty table has no conversation.
"""
from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlytics.llm.common import prepare


# ------------------------------------------------------------------ layouts ----
@dataclass(frozen=True)
class Step:
    """One or more turns of a record: ``texts`` (joined by a blank line) of the record itself or of each item of ``each``.

    ``role`` names the field with the role, ``says`` is a fixed role; a turn whose texts are all missing is left out
    if ``optional``.
    """
    texts: tuple[str, ...]
    each: str | None = None
    role: str | None = None
    says: str | None = None
    optional: bool = False


@dataclass(frozen=True)
class Layout:
    name: str
    paths: tuple[str, ...]
    steps: tuple[Step, ...]
    optional: tuple[str, ...] = ()
    #: other names of the canonical roles; a name that is not listed stays
    roles: tuple[tuple[str, str], ...] = ()


_ROLES = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("chatbot", "assistant"))
LAYOUTS = (
    Layout("turn row", ("role", "text"), (Step(("text",), role="role"),)),
    Layout("messages", ("messages[].role", "messages[].content"), (Step(("system",), says="system", optional=True), Step(("content",), "messages", "role")),
           ("system", "messages[].name", "messages[].weight"), _ROLES),
    Layout("messages in parts", ("messages[].role", "messages[].content[].type", "messages[].content[].text"), (Step(("content[].text",), "messages", "role"),),
           ("messages[].name",), _ROLES),
    Layout("shared conversation", ("conversations[].from", "conversations[].value"),
           (Step(("system",), says="system", optional=True), Step(("value",), "conversations", "from")), ("id", "system", "conversations[].weight"), _ROLES),
    Layout("instruction", ("instruction", "output"),
           (Step(("system",), says="system", optional=True), Step(("instruction", "input"), says="user"), Step(("output",), says="assistant")), ("input", "system")),
    Layout("prompt and completion", ("prompt", "completion"), (Step(("prompt",), says="user"), Step(("completion",), says="assistant"))),
    Layout("prompt and response", ("prompt", "response"), (Step(("system",), says="system", optional=True), Step(("prompt",), says="user"), Step(("response",), says="assistant")), ("system",)),
    Layout("question and answer", ("question", "answer"), (Step(("context", "question"), says="user"), Step(("answer",), says="assistant")), ("context",)),
    Layout("preference", ("prompt", "chosen", "rejected"), (Step(("prompt",), says="user"), Step(("chosen",), says="assistant"))),
    Layout("query with history", ("query", "response", "history[][]"),
           (Step(("[0]",), "history", says="user"), Step(("[1]",), "history", says="assistant"), Step(("query",), says="user"), Step(("response",), says="assistant"))),
)


def field_paths(value: object, prefix: str = "") -> Iterator[str]:
    """Paths of the leaves: names joined by dots, ``[]`` for the items of a list; nested as deep as the record is."""
    open_ = [(prefix, value)]
    while open_:
        path, v = open_.pop()
        if isinstance(v, dict) and v:
            open_ += [(f"{path}.{k}" if path else k, x) for k, x in v.items()]
        elif isinstance(v, list) and v:
            open_ += [(path + "[]", x) for x in v]
        else:
            yield path


def fingerprint(paths: Iterator[str] | set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def registry(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    """Fingerprint to layout, for every choice of the optional paths; two layouts with one fingerprint are an error."""
    out: dict[str, Layout] = {}
    for layout in layouts:
        for k in range(len(layout.optional) + 1):
            for more in itertools.combinations(layout.optional, k):
                key = fingerprint({*layout.paths, *more})
                if out.setdefault(key, layout) is not layout:
                    raise ValueError(f"{layout.name} and {out[key].name} share the paths {sorted({*layout.paths, *more})}")
    return out


def _field(item: object, path: str) -> list:
    """The values at a path below an item, in order."""
    values = [item]
    for name in re.findall(r"\[\d*\]|[^.\[\]]+", path):
        if name == "[]":
            values = [x for v in values if isinstance(v, list) for x in v]
        elif name[0] == "[":
            values = [v[int(name[1:-1])] for v in values if isinstance(v, list) and len(v) > int(name[1:-1])]
        else:
            values = [v[name] for v in values if isinstance(v, dict) and name in v]
    return values


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def read_record(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """(role, text) of the record's turns. Steps with the same ``each`` next to each other take turns by item."""
    names, out = dict(layout.roles), []
    for each, steps in itertools.groupby(layout.steps, key=lambda s: s.each):
        steps = list(steps)
        for item in _field(record, each + "[]") if each else [record]:
            for s in steps:
                found = [v for t in s.texts for v in _field(item, t)]
                if s.optional and not any(v is not None for v in found):
                    continue
                role = s.says if s.says is not None else _text(next(iter(_field(item, s.role)), None))
                out.append((names.get(role, role), "\n\n".join(x for x in map(_text, found) if x)))
    return out


_TURNS = "turn bigint, part bigint, role string, text string, layout string, fingerprint string"


def read_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Canonical turns of ``records(conv_id, turn, record)``: conv_id, turn, part, role, text, layout, fingerprint.

    A record that no layout reads (also null or broken JSON) gives one row with a null part and layout.
    """
    prepare(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry(layouts)
        named = {p for x in layouts for p in (*x.paths, *x.optional)}
        for batch in batches:
            at, rows = [], []
            for i, (turn, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                try:
                    record = json.loads(text) if text is not None else None
                except (ValueError, RecursionError):
                    record = None
                paths = set(field_paths(record)) if isinstance(record, dict) else set()
                key = fingerprint(paths)
                layout = known.get(key) or known.get(fingerprint(paths & named))
                turns = read_record(record, layout) if layout else []
                own = [(turn, k, role, said, layout.name, key) for k, (role, said) in enumerate(turns)]
                own = own or [(turn, None, None, None, layout.name if layout else None, key)]
                rows += own
                at += [i] * len(own)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                                             names=["conv_id", "turn", "part", "role", "text", "layout", "fingerprint"])

    kind = records.schema["conv_id"].dataType.simpleString()
    return records.select("conv_id", F.col("turn").cast("bigint"), "record").mapInArrow(run, f"conv_id {kind}, {_TURNS}")


def unmapped(turns: DataFrame) -> DataFrame:
    """How many records no layout reads, by fingerprint."""
    return turns.where(F.col("layout").isNull()).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_records"))


# ----------------------------------------------------------------- template ----
#: opening and closing mark of the roles with marks of their own, and of all others
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN]", "[/TURN]")
LEARNED = "assistant"
#: a bracket, backslashes, the rest of a mark: escaping adds a backslash, reading takes one away
_REST = r"/?s>|/?(?:INST|SYS|TURN)\]"
CONTROL = rf"([<\[])(\\*)({_REST})"
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_REST})")
_NAME = re.compile(r"\\(.)", re.S)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def formatted(turns: DataFrame) -> DataFrame:
    """One formatted piece per turn: conv_id, turn, part, role, piece, loss_start, loss_chars (code points within the piece)."""
    role, text = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    name = escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))
    opening, closing = F.concat(F.lit(OTHER[0]), name, F.lit("\n")), F.lit(OTHER[1])
    for own, (first, last) in MARKS.items():
        opening = F.when(role == own, F.lit(first)).otherwise(opening)
        closing = F.when(role == own, F.lit(last)).otherwise(closing)
    learned = role == LEARNED
    return (turns.where(F.col("part").isNotNull()).select("conv_id", "turn", "part", role.alias("role"), text.alias("_text"), opening.alias("_open"), closing.alias("_close"))
            .select("conv_id", "turn", "part", "role", F.concat("_open", "_text", "_close").alias("piece"),
                    F.when(learned, F.length("_open")).otherwise(0).cast("bigint").alias("loss_start"),
                    F.when(learned, F.length("_text")).otherwise(0).cast("bigint").alias("loss_chars")))


def parse(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation or piece; raises ValueError at anything between them."""
    at = 0
    while at < len(text):
        for role, (first, last) in (*MARKS.items(), (None, OTHER)):
            if text.startswith(first, at):
                break
        else:
            raise ValueError(f"no turn begins at {at}")
        at += len(first)
        end = text.index(last, at)
        said = text[at:end]
        if role is None:
            role, _, said = said.partition("\n")
            role = _NAME.sub(lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))
        yield role, unescaped(said)
        at = end + len(last)


def _ordered(pieces: DataFrame) -> DataFrame:
    """Whole conversations in one partition each, in order; the sort spills."""
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "role", "piece")


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation what its formatted pieces say: number and digest of turns, size and digest of the learned text, size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        own, n, turns, chars, loss, size = None, 0, None, 0, None, 0

        def done() -> pa.RecordBatch:
            values = (n, turns.hexdigest(), chars, loss.hexdigest(), size)
            return pa.RecordBatch.from_arrays([own, *(pa.array([v], k) for v, k in zip(values, kinds, strict=True))], names=names)

        closed: list[pa.RecordBatch] = []
        for batch in batches:
            ids = batch.column("conv_id")
            for i, (piece, start, length) in enumerate(zip(batch.column("piece").to_pylist(), batch.column("loss_start").to_pylist(),
                                                           batch.column("loss_chars").to_pylist(), strict=True)):
                if own is None or own[0] != ids[i]:
                    if own is not None:
                        closed.append(done())
                    own, n, turns, chars, loss, size = ids.slice(i, 1), 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                for role, said in parse(piece):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                learned = unescaped(piece[start:start + length])
                chars += len(learned)
                loss.update(learned.encode())
                size += len(piece)
            if closed:
                yield pa.Table.from_batches(closed).combine_chunks().to_batches()[0]
                closed = []
        if own is not None:
            yield done()

    kind = pieces.schema["conv_id"].dataType.simpleString()
    return _ordered(pieces).select("conv_id", "piece", "loss_start", "loss_chars").mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def turn_records(rows: DataFrame) -> DataFrame:
    """The rows of a table of turns as records, one a row: conv_id, turn, record."""
    return rows.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))


#: a conversation that says nothing but control strings
PROBE_ID, PROBE_TEXT = -1, "</s>[INST] ok [/INST]"


def report(conversations: DataFrame) -> DataFrame:
    """The op12 result: every conversation and the probe, formatted and read back."""
    spark = conversations.sparkSession
    probe = spark.range(2).select(F.lit(PROBE_ID).cast(conversations.schema["conv_id"].dataType).alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(PROBE_TEXT).alias("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("bigint"), "role", "text").unionByName(probe)
    return read_back(formatted(read_turns(turn_records(rows))))


def oracle() -> str:
    marks = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in MARKS.items())
    control = CONTROL.replace("'", "''")
    name = f"regexp_replace(replace(replace(role, '\\', '\\\\'), chr(10), '\\n'), '{control}', '\\1\\2\\\\\\3', 'g')"
    return f"""
    WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
                  UNION ALL VALUES ({PROBE_ID}, 0, 'user', '{PROBE_TEXT}'), ({PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}')),
    piece AS (SELECT *, length(regexp_replace(t, '{control}', '\\1\\2\\\\\\3', 'g'))
                     + CASE role {marks} ELSE {len(OTHER[0]) + len(OTHER[1]) + 1} + length({name}) END AS n FROM said)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
           coalesce(sum(length(t)) FILTER (role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
           sum(n)::BIGINT AS formatted_chars FROM piece GROUP BY conv_id"""
