"""Operator 2: personal data, found by pattern and by what discloses it.

Base spans (email, ip, card, phone) are protected entities. A term standing
near mentions of an entity discloses it as far as it leaves little to learn:
with df counted in documents, and PRIOR further documents in which the term
stands without the entity (so that one meeting is weak evidence),

    p(e|t) = df(t,e) / (df(t) + PRIOR),    bits left = -log2 p(e|t).

A term that leaves GENERALISE_BITS or less is generalised to its kind of word,
one that leaves REMOVE_BITS or less is removed, wherever it stands: also far
from the entity and in documents without it. Only documents that hold the term
count, so documents about other things change nothing; an entity of every
document has no information to disclose.

Scale: a document with an entity counts (entity, term) pairs, added up in the
tasks; document frequencies are one count of all words. The places of the
disclosing terms come from passes over all whole texts, each with the sorted
digests of at most TERMS_A_PASS terms on the executors; all terms have their
pass, and a found word is joined with its term by name.

Defined results: null and empty texts have no spans; every row (repeated ids
and rows too) gives one row and counts as one document; extra columns are
ignored.
"""
from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinlytics.llm.common import map_text, prepare, shared, written

KINDS = ("email", "ip", "card", "phone")
#: words on each side of a mention that count as its context
CONTEXT = 8
#: further documents in which every term is taken to stand without the entity
PRIOR = 1
#: bits that a term may leave of an entity, at most: p(e|t) of 1/2 and 3/4
GENERALISE_BITS, REMOVE_BITS = 1.0, 0.4151
#: terms whose digests (8 bytes each) go to the executors for one pass over the texts
TERMS_A_PASS = 1 << 22
#: different keys that a task counts before it hands its counts on
COUNTED = 200_000

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")
_DIGITS16 = re.compile(r"[0-9][ 0-9-]{14}")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each '@' with the run of local characters before it, after the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All base spans by kind as listed, then start."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", s, e) for s, e in emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    if _DIGITS16.search(text):
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def entity_key(kind: str, value: str) -> str:
    """A digest, so that the statistics hold no personal data themselves."""
    return hashlib.sha256(f"{kind}:{value.lower()}".encode()).hexdigest()[:32]


def covered(spans: list[Span]) -> list[tuple[int, int]]:
    """The stretches under any span, disjoint and in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def open_words(text: str, spans: list[Span]) -> Iterator[re.Match]:
    """The words of a text that no span touches."""
    under, i = covered(spans), 0
    for m in _WORD.finditer(text):
        while i < len(under) and under[i][1] <= m.start():
            i += 1
        if i == len(under) or m.end() <= under[i][0]:
            yield m


def context_terms(text: str, spans: list[Span]) -> set[tuple[str, str]]:
    """(entity, term) of the words within CONTEXT words of each mention."""
    words = [(m.start(), m[0].lower()) for m in open_words(text, spans)]
    starts = [s for s, _ in words]
    out: set[tuple[str, str]] = set()
    for kind, start, end in spans:
        key, at = entity_key(kind, text[start:end]), bisect_left(starts, start)
        out.update((key, term) for _, term in words[max(0, at - CONTEXT):at + CONTEXT])
    return out


def _counts(seen: Counter, names: list[str]) -> pa.RecordBatch:
    """Keys (tuples of strings) and counts of a task."""
    keys = zip(*seen, strict=True) if seen else [[]] * (len(names) - 1)
    return pa.RecordBatch.from_arrays([*(pa.array(list(k), pa.string()) for k in keys), pa.array(list(seen.values()), pa.int64())], names=names)


def contexts(docs: DataFrame) -> DataFrame:
    """(entity, term, df): documents with the term near a mention; with the entity at all where term is null."""
    names = ["entity", "term", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and (spans := base_spans(text)):
                    seen.update(context_terms(text, spans))
                    seen.update({(entity_key(k, text[s:e]), None) for k, s, e in spans})
                    if len(seen) > COUNTED:
                        yield _counts(seen, names)
                        seen = Counter()
        yield _counts(seen, names)

    return docs.select("text").mapInArrow(run, "entity string, term string, n bigint").groupBy("entity", "term").agg(F.sum("n").alias("df"))


def text_key(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode())).view(np.int64))


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df_t) of all words of all documents, lower-cased; tasks add up before the shuffle."""
    names = ["term", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(set(map(str.lower, set(_WORD.findall(text)))))
                    if len(seen) > COUNTED:
                        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=names)
                        seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=names)

    return docs.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("df_t"))


def disclosures(docs: DataFrame) -> DataFrame:
    """(entity, term, bits): pairs that leave GENERALISE_BITS or less."""
    found = written(contexts(docs))
    total = docs.count()
    known = found.where(F.col("term").isNull() & (F.col("df") < total)).select("entity")
    pairs = found.where(F.col("term").isNotNull()).join(known, "entity", "left_semi").join(term_frequencies(docs), "term")
    bits = -F.log2(F.col("df") / (F.col("df_t") + PRIOR))
    return pairs.select("entity", "term", bits.alias("bits")).where(F.col("bits") <= GENERALISE_BITS)


class Known(dict):
    """By word as written: lower-cased if its digest is among the sorted ones, else ''."""

    def __init__(self, digests: bytes) -> None:
        self.digests = array("Q")
        self.digests.frombytes(digests)

    def __missing__(self, word: str) -> str:
        if len(self) > COUNTED:
            self.clear()
        low = word.lower()
        digest = xxhash.xxh64_intdigest(low.encode(), 42)
        at = bisect_left(self.digests, digest)
        self[word] = out = low if at < len(self.digests) and self.digests[at] == digest else ""
        return out


def _digests(terms: DataFrame) -> Broadcast:
    """The sorted digests of at most about TERMS_A_PASS terms; Spark's xxhash64 is the plain one with seed 42."""
    own = terms.select(F.xxhash64("term").alias("digest")).toArrow()["digest"].to_numpy().view(np.uint64)
    return shared(terms.sparkSession, np.sort(own).tobytes())


def places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text_key, term, start, end) of every occurrence of ``terms(term)`` outside of base spans."""
    def of(share: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Known(share.value)
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if text and any([known[word] for word in set(_WORD.findall(text))]):
                        key = text_key(text)
                        rows += [(doc, key, low, m.start(), m.end()) for m in open_words(text, base_spans(text)) if (low := known[m[0]])]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                                 names=["doc_id", "text_key", "term", "start", "end"])

        return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, text_key bigint, term string, start bigint, end bigint")

    passes = max(1, -(-terms.count() // TERMS_A_PASS))
    out = None
    for i in range(passes):
        own = of(_digests(terms.where(F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(passes)) == i)))
        out = own if out is None else out.unionByName(own)
    return out


def added_spans(docs: DataFrame) -> DataFrame:
    """One row per document with disclosing terms: (doc_id, text_key, added).

    ``added`` lists ``disclosing:start:end:action``; a document's own words
    bound its length.
    """
    terms = written(disclosures(docs).groupBy("term").agg(F.min("bits").alias("bits")))
    hit = (places(docs, terms).join(terms, "term")
           .groupBy("doc_id", "text_key", "start", "end").agg(F.min("bits").alias("bits")))
    item = F.struct("start", "end", (F.col("bits") <= REMOVE_BITS).alias("remove"))
    return written(hit.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(item)).alias("added")))


def detect(docs: DataFrame) -> DataFrame:
    """The op2 result: base counts and digest, and all spans."""
    prepare(docs.sparkSession)

    def make() -> Callable[[list], list[list]]:
        def compute(texts: list) -> list[list]:
            out: list[list] = [[], [], [], [], [], [], []]
            for text in texts:
                spans = base_spans(text) if text else []
                n, base = Counter(k for k, _, _ in spans), joined(spans)
                row = (*(n[k] for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), base, text_key(text or ""))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out
        return compute

    base = map_text(docs, ["doc_id"], "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base string, text_key bigint", make)
    more = F.transform("added", lambda x: F.concat_ws(":", F.lit("disclosing"), x["start"].cast("string"), x["end"].cast("string")))
    added = added_spans(docs).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.array_join(more, ",").alias("_more"), F.size("added").cast("bigint").alias("_n"))
    both = base.join(added, base.doc_id.eqNullSafe(F.col("_id")) & (base.text_key == F.col("_key")), "left")
    spans = F.when(F.col("_more").isNull(), F.col("base")).when(F.col("base") == "", F.col("_more")).otherwise(F.concat_ws(",", "base", "_more"))
    return both.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"),
                       F.coalesce("_n", F.lit(0)).alias("n_disclosing"), F.expr("n_email + n_ip + n_card + n_phone").alias("n_base"))


def _kind_of_word(word: str) -> str:
    return "<NUMBER>" if word.isdigit() else "<NAME>" if word[:1].isupper() else "<TERM>"


def redacted(text: str, added: list[tuple[int, int, bool]]) -> str:
    """The text with entities as placeholders and disclosing terms generalised or removed."""
    spans = [(s, e, f"<{k.upper()}>") for k, s, e in base_spans(text)]
    spans += [(s, e, "" if remove else _kind_of_word(text[s:e])) for s, e, remove in added]
    out, end = [], 0
    for s, e, new in sorted(spans):
        if e <= end:
            continue
        out += [text[end:max(s, end)], new]
        end = e
    return "".join(out) + text[end:]


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with text (and n_chars, if it is there) sanitised; all other columns stay."""
    prepare(docs.sparkSession)
    names = docs.columns
    keyed = docs.select(*names, F.col("doc_id").alias("_llm_id"))
    added = added_spans(docs).withColumnsRenamed({"doc_id": "_added_id", "text_key": "_added_key", "added": "_llm_added"})

    def keys() -> Callable[[list], list[list]]:
        return lambda texts: [[text_key(t or "") for t in texts]]

    keyed = map_text(keyed, [*names, "_llm_id"], "_llm_key bigint", keys)
    both = keyed.join(added, F.col("_llm_id").eqNullSafe(F.col("_added_id")) & (F.col("_llm_key") == F.col("_added_key")), "left")
    packed = F.coalesce(F.to_json("_llm_added"), F.lit("[]"))
    both = both.select(*names, packed.alias("_llm_spans"))
    kept = [f.name for f in both.schema.fields if f.name not in ("text", "_llm_spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json
        for batch in batches:
            new = [redacted(t, [(x["start"], x["end"], x["remove"]) for x in json.loads(a)]) if t else t
                   for t, a in zip(batch.column("text").to_pylist(), batch.column("_llm_spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(new, pa.string())], names=[*kept, "text"])

    schema = both.select(*kept, "text").schema
    out = both.select(*kept, "text", "_llm_spans").mapInArrow(run, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*names)
