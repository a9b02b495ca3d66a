"""Operator 3: secrets, found by pattern and by the cost of guessing them.

Base spans are assignments, access keys and hex runs. Values in a credential
context beyond those (``pwd: ...``, ``password is ...``, ``user:...@host`` in an
address, bearer tokens) are priced by dynamic programming over the whole
value: the cheapest split into ranked words, dates, repeats, keyboard walks
and brute-force characters, in log10 guesses. Values at MIN_GUESSES or above
are reported as ``guess`` spans.

Words are ranked by their counts over all documents, all of them: a word's
rank is one more than the number of words that are more frequent, read off
the histogram of counts. No dictionary goes to the tasks; the substrings of the
distinct values are joined with the ranked words, and each value is priced
with the words found inside it.

Defined results: null and empty texts have no spans; every row (repeated ids
and rows too) gives one row; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinlytics.llm.common import map_text, prepare, word_counts, written
from clinlytics.llm.pii import covered, text_key

KINDS = ("assign", "access", "hex")
#: log10 guesses from which a value in a credential context counts as a secret
MIN_GUESSES = 8.0
#: letters of a word, keys of a keyboard walk and characters of a repeated unit, in one piece of a split
WORD, WALK, UNIT = (3, 24), (3, 64), 16
#: substrings in one Arrow batch
PARTS = 50_000

# Often used passwords, most frequent first.
COMMON_PASSWORDS = (
    "123456 password 12345678 qwerty 123456789 12345 1234 111111 1234567 dragon 123123 baseball abc123 football "
    "monkey letmein 696969 shadow master 666666 qwertyuiop 123321 mustang 1234567890 michael 654321 superman "
    "1qaz2wsx 7777777 121212 000000 qazwsx 123qwe killer trustno1 jordan jennifer zxcvbnm asdfgh hunter buster "
    "soccer harley batman andrew tigger sunshine iloveyou 2000 charlie robert thomas hockey ranger daniel "
    "starwars klaster 112233 george computer michelle jessica pepper 1111 zxcvbn 555555 11111111 131313 freedom "
    "777777 pass maggie 159753 aaaaaa ginger princess joshua cheese amanda summer love ashley nicole chelsea "
    "biteme matthew access yankees 987654321 dallas austin thunder taylor matrix admin welcome login changeme "
    "secret root test guest default example").split()
# Rows of a keyboard.
KEYBOARD_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")

_KEYWORD = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN = re.compile(_KEYWORD + r"""["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("(?<![0-9a-f])[0-9a-f]{24,}+")
_CONTEXT = re.compile(
    r"""\b(?:pwd|pass|passphrase|passcode|pin|credentials?|password|passwd|secret|token|api_?key|private[ _-]?key|auth)\b["']?"""
    r"""(?: *+(?:[:=]|:=|=>) *+| ++(?:is|was|ist|est|es) ++:? *+)["']?([^\s"'<>,;]{6,}+)"""
    r"""|://[^\s/:@]{1,64}+:([^\s/@]{6,}+)@"""
    r"""|\b[Bb]earer ++([A-Za-z0-9._~+/=-]{6,}+)""", re.IGNORECASE | re.ASCII)
_CUE = re.compile(r"pwd|pass|pin|credential|secret|token|api_?key|key|auth|://|bearer", re.IGNORECASE | re.ASCII)
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:1[0-2]|0?[1-9])\1(?:3[01]|[12]\d|0?[1-9])|(?:3[01]|[12]\d|0?[1-9])([-/._]?)(?:1[0-2]|0?[1-9])\2(?:19|20)\d\d|(?:19|20)\d\d)")
_CLASS_BYTES = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))

Span = tuple[str, int, int]

_PLACE = {c: (r, i) for r, row in enumerate(KEYBOARD_ROWS) for i, c in enumerate(row)}
_SPLIT = {"4": "a", "@": "a", "3": "e", "1": "l", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind as listed."""
    out: list[tuple[int, int, int]] = []
    for m in _ASSIGN.finditer(text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                out.append((m.start(), 1, m.end()))
    if b"\x01" * 24 in text.encode().translate(_CLASS_BYTES):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def near_keys(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def brute_force(value: str) -> float:
    """log10 guesses per character of an unstructured span."""
    size = 10 * any(c.isdigit() for c in value) + 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value)
    size += 33 * any(not c.isalnum() for c in value)
    return math.log10(max(size, 10))


def plain(low: str) -> str:
    """Letters for the digits and signs that stand for them."""
    return "".join(_SPLIT.get(c, c) for c in low)


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """log10 guesses of the cheapest segmentation of the whole value, in time linear in its length.

    Pieces: a ranked word (rank, case and letter-for-digit variants), a date, a
    unit repeated as often as it stands there, a keyboard walk, or one
    brute-force character. Every piece after the first also costs its place.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose lower case has two characters
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in value)
    spelt, step, per_char = plain(low), math.log10(2), brute_force(value)
    # again[u][i]: how many characters from i on equal the one u places on
    again = [[0] * (n + 1) for _ in range(UNIT + 1)]
    for u in range(1, min(UNIT, n - 1) + 1):
        row = again[u]
        for i in range(n - u - 1, -1, -1):
            row[i] = row[i + 1] + 1 if value[i] == value[i + u] else 0
    cost = [0.0] + [math.inf] * n
    for i in range(n):
        here = cost[i] + (step if i else 0.0)
        cost[i + 1] = min(cost[i + 1], cost[i] + per_char)
        for j in range(i + WORD[0], min(n, i + WORD[1]) + 1):
            word = low[i:j]
            rank, twist = ranks.get(word), 0.0
            if rank is None and (rank := ranks.get(spelt[i:j])) is not None:
                twist = step * min(4, sum(a != b for a, b in zip(word, spelt[i:j], strict=True)))
            if rank is not None:
                case = 0.0 if value[i:j] == word else step if value[i:j] in (word.upper(), word.capitalize()) else step * (j - i)
                cost[j] = min(cost[j], here + math.log10(rank + 1) + case + twist)
        if (m := _DATE.match(value, i)) is not None:
            cost[m.end()] = min(cost[m.end()], here + math.log10(365 * 120 if m.end() - i > 4 else 120))
        for unit in range(1, min(UNIT, (n - i) // 2) + 1):
            times = 1 + again[unit][i] // unit
            j = i + unit * times
            if times > 1 and j - i >= 3:
                cost[j] = min(cost[j], here + unit * per_char + math.log10(times))
        j, turns = i + 1, 0
        while j < min(n, i + WALK[1]) and (near_keys(low[j - 1], low[j]) or ord(low[j]) - ord(low[j - 1]) in (1, -1)):
            turns += j - i >= 2 and _way(low[j - 2], low[j - 1]) != _way(low[j - 1], low[j])
            j += 1
            if j - i >= WALK[0]:
                cost[j] = min(cost[j], here + math.log10(47 * (j - i)) + turns * math.log10(8))
    return cost[n]


def _way(a: str, b: str) -> tuple[int, int]:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return (q[0] - p[0], q[1] - p[1]) if p and q else (9, ord(b) - ord(a))


def context_values(text: str, base: list[Span]) -> Iterator[tuple[int, int, bool]]:
    """(start, end, open) of the values in a credential context; open ones touch no base span."""
    if not _CUE.search(text):
        return
    under, i = covered(base), 0
    for m in _CONTEXT.finditer(text):
        s, e = m.span(next(k for k in (1, 2, 3) if m[k] is not None))
        while i < len(under) and under[i][1] <= s:
            i += 1
        yield s, e, i == len(under) or e <= under[i][0]


def values(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, end, open, value) of every value in a credential context."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    rows += [(doc, text_key(text), s, e, free, text[s:e]) for s, e, free in context_values(text, base_spans(text))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["doc_id", "text_key", "start", "end", "open", "value"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, text_key bigint, start bigint, end bigint, open boolean, value string")


def substrings(distinct: DataFrame) -> DataFrame:
    """(value, word): the substrings of each value that may be words, as written and as spelt."""
    lengths, letters = range(WORD[0], WORD[1] + 1), re.compile("[a-z]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v for v, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.string())], names=["value", "word"])

        rows: list[tuple[str, str]] = []
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen = set()
                for form in {value.lower(), plain(value.lower())}:
                    for m in letters.finditer(form):
                        run_ = m[0]
                        seen.update(run_[i:i + k] for i in range(len(run_) - WORD[0] + 1) for k in lengths if i + k <= len(run_))
                for word in seen:
                    rows.append((value, word))
                    if len(rows) >= PARTS:
                        yield batch_of(rows)
                        rows = []
        yield batch_of(rows)

    return distinct.select("value").mapInArrow(run, "value string, word string")


def ranked_words(docs: DataFrame) -> DataFrame:
    """(word, rank) of all words of all documents; words of one count share the best rank. Common passwords have at least theirs."""
    spark = docs.sparkSession
    counts = word_counts(docs, f"[a-z]{{{WORD[0]},{WORD[1]}}}", per_document=False)
    counts = written(counts)
    # one row per different count: their number grows with the root of the number of words
    histogram = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    better = F.coalesce(F.sum("words").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.join(histogram.select("n", (better + 1).alias("rank")), "n").select("word", "rank")
    return ranked.unionByName(_common(spark)).groupBy("word").agg(F.min("rank").alias("rank"))


def _common(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, i + 1) for i, w in enumerate(COMMON_PASSWORDS)], "word string, rank bigint")


def priced(found: DataFrame, words: DataFrame) -> DataFrame:
    """(value, cost) of every distinct value, in log10 guesses."""
    distinct = written(found.select("value").distinct())
    # the words inside a value: fewer than 44 for each of its characters
    inside = (substrings(distinct).join(words, "word").groupBy("value")
              .agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("word", "rank")))).alias("ranks")))
    both = distinct.join(inside, "value", "left").select("value", F.coalesce("ranks", F.lit("{}")).alias("ranks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json
        for batch in batches:
            costs = [guess_cost(v, json.loads(r)) for v, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.float64())], names=["value", "cost"])

    return both.mapInArrow(run, "value string, cost double")


def added_spans(docs: DataFrame) -> DataFrame:
    """One row per document with values in a credential context: (doc_id, text_key, guess, max_log10_guesses).

    ``guess`` lists the spans of those that are hard to guess; a document's own values bound its length.
    """
    found = written(values(docs))
    cost = written(priced(found, ranked_words(docs)))
    hard = F.when(F.col("open") & (F.col("cost") >= MIN_GUESSES), F.struct("start", "end"))
    return written(found.join(cost, "value").groupBy("doc_id", "text_key")
                   .agg(F.sort_array(F.collect_set(hard)).alias("guess"), F.max("cost").alias("max_log10_guesses")))


def scan(docs: DataFrame) -> DataFrame:
    """The op3 result: base counts and digest, all spans, and the largest guess cost."""
    prepare(docs.sparkSession)

    def make() -> Callable[[list], list[list]]:
        def compute(texts: list) -> list[list]:
            out: list[list] = [[], [], [], [], [], []]
            for text in texts:
                base = base_spans(text) if text else []
                n, said = Counter(k for k, _, _ in base), ",".join(f"{k}:{s}:{e}" for k, s, e in base)
                row = (*(n[k] for k in KINDS), hashlib.sha256(said.encode()).hexdigest(), said, text_key(text or ""))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out
        return compute

    base = map_text(docs, ["doc_id"], "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base string, text_key bigint", make)
    added = added_spans(docs).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "guess", "max_log10_guesses")
    both = base.join(added, base.doc_id.eqNullSafe(F.col("_id")) & (base.text_key == F.col("_key")), "left")
    # all spans by start, then kind as listed with guesses last: base ones stand in that order already
    place = F.expr("transform(filter(split(base, ','), x -> x <> ''), x -> struct(cast(split(x, ':')[1] AS bigint) AS start, "
                   "CASE split(x, ':')[0] WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END AS kind, x AS said))")
    more = F.expr("transform(coalesce(guess, array()), g -> struct(g.start AS start, 3 AS kind, concat_ws(':', 'guess', g.start, g.end) AS said))")
    every = F.when(F.size("guess") > 0, F.array_join(F.sort_array(F.concat(place, more))["said"], ",")).otherwise(F.col("base"))
    return both.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", every.alias("spans"),
                       F.greatest(F.size("guess"), F.lit(0)).cast("bigint").alias("n_guess"), F.coalesce("max_log10_guesses", F.lit(0.0)).alias("max_log10_guesses"))
