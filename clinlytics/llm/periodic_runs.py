"""Operator 11: periodic runs of words, found by a suffix automaton with link-cut access.

Every word appended to the automaton makes the path from its prefix state to
the root of the suffix-link tree newly coloured with the word's position. The
path falls into segments of one colour, the end of the last earlier
occurrence; the colours stand in a link-cut forest (splay trees over the
preferred paths), so that a whole segment is met at once. A segment of colour
j whose deepest state has length L says that the L words up to j stand again
up to i: with d = i - j, the stretch from j - L + 1 to i has period d, its
smallest one if d <= L, and no word before it prolongs it. The last i of each
(start, period) ends the run.

Only stretches that can hold a run go through the automaton: in a run of
period q every word from the (q + 1)-th on, and every four words from the
(q + 4)-th on, stand at most q places behind their like, for at least
(fold - 1) q places. That test is a necessary condition over whole texts, by
doubling bounds of q; a run met at the edge of a stretch is extended in the
whole text. Memory is bounded by one text: some 600 bytes per word of its longest such stretch.

Defined results: null and empty texts and texts of white space have no words
and no runs; repeated rows and ids give one row each; a null id is no reason to
skip a text; extra columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinlytics.llm.common import prepare

#: a run holds at least so many words and so many periods
LEAST, FOLD = 6, 4
_FAR = np.int64(1) << 60
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Run = tuple[int, int, int]


def repetitions(words: list[int], fold: int = FOLD) -> dict[tuple[int, int], int]:
    """{(start, period): end} of every maximal repetition of ``fold`` periods or more; end is exclusive."""
    length, link, step = [0], [-1], [{}]
    # the link-cut forest over the states; 0, the root state, stands for "none".
    # left: shallower part of a preferred path, right: deeper part, up: parent in
    # the splay tree or above the path; last: colour of a path, kept at its splay root
    left, right, up, last = [0], [0], [0], [-1]
    found: dict[tuple[int, int], int] = {}

    def add(n: int, parent: int, following: dict) -> int:
        length.append(n)
        link.append(parent)
        step.append(following)
        left.append(0)
        right.append(0)
        up.append(0)
        last.append(-1)
        return len(length) - 1

    def rotate(x: int) -> None:
        y = up[x]
        z = up[y]
        if left[y] == x:
            b = right[x]
            left[y], right[x] = b, y
        else:
            b = left[x]
            right[y], left[x] = b, y
        if b:
            up[b] = y
        up[y], up[x] = x, z
        if z and left[z] == y:
            left[z] = x
        elif z and right[z] == y:
            right[z] = x
        else:
            last[x] = last[y]

    def splay(x: int) -> None:
        y = up[x]
        while y and (left[y] == x or right[y] == x):
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                rotate(y if (left[y] == x) == (left[z] == y) else x)
            rotate(x)
            y = up[x]

    tail = 0
    for i, word in enumerate(words):
        state, at = add(i + 1, 0, {}), tail
        while at != -1 and word not in step[at]:
            step[at][word] = state
            at = link[at]
        if at != -1:
            to = step[at][word]
            if length[to] != length[at] + 1:
                copy = add(length[at] + 1, link[to], dict(step[to]))
                splay(to)  # the copy comes right above it, on the same path and with its colour
                above = left[to]
                left[copy], left[to], up[copy] = above, copy, to
                if above:
                    up[above] = copy
                while at != -1 and step[at].get(word) == to:
                    step[at][word] = copy
                    at = link[at]
                link[to] = to = copy
            link[state] = up[state] = to
        tail = below = state
        node = link[state]
        while node:
            splay(node)
            before, deep = last[node], length[node]
            if (i - before) * (fold - 1) <= deep:
                found[before - deep + 1, i - before] = i + 1
            if right[node]:
                last[right[node]] = before  # the deeper rest of the path keeps its colour
            right[node] = below
            below, node = node, up[node]
        last[below] = i
    return found


def _distances(keys: np.ndarray) -> np.ndarray:
    """How far back the same key stands last."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    out = np.full(len(keys), _FAR)
    out[order[same + 1]] = order[same + 1] - order[same]
    return out


def stretches(ids: np.ndarray, least: int = LEAST, fold: int = FOLD) -> list[tuple[int, int]]:
    """Disjoint parts of the text that hold all of its runs."""
    n = len(ids)
    if n < max(least, fold):
        return []
    by_word = _distances(ids)
    # four words at a time by a 64-bit mix: different ones taken for alike only let more through
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for gap, factor in ((1, 0xBF58476D1CE4E5B9), (2, 0x94D049BB133111EB)):
        mixed[gap:] = mixed[gap:] + mixed[:-gap] * np.uint64(factor)
    by_four = _distances(mixed)
    by_four[:3] = _FAR
    out, most = [], 1
    while fold * (low := most // 2 + 1) <= n:
        need, behind = max((fold - 1) * low, least - most), by_word
        if need >= 6 and most > 2:
            need, behind = need - 3, by_four
        edge = np.flatnonzero(np.diff((behind <= most).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        start, end = edge[::2], edge[1::2]
        long = end - start >= need
        out += [(max(0, a - most - 3), b) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        most *= 2
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def runs_of(words: list, least: int = LEAST, fold: int = FOLD) -> list[Run]:
    """(start, length, period) of every run, by start and period."""
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    found: set[Run] = set()
    for a, b in stretches(ids, least, fold):
        part = ids[a:b].tolist()
        for (start, q), end in repetitions(part, fold).items():
            start, end = start + a, end + a
            if start == a:
                while start and ids[start - 1] == ids[start - 1 + q]:
                    start -= 1
            if end == b:
                while end < len(ids) and ids[end] == ids[end - q]:
                    end += 1
            if end - start >= least:
                found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words but those that a run repeats."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def find_runs(docs: DataFrame, words: Callable[[bytes, object], list[bytes]] | None = None, least: int = LEAST, fold: int = FOLD) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_words, runs (start, length, period by start and period), collapsed text.

    ``words(text, doc_id)`` cuts a text's UTF-8 bytes; by default at ASCII white space.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, runs, rest = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or b""
                own = words(text, doc) if words else text.split()
                found = runs_of(own, least, fold)
                n.append(len(own))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                rest.append(collapsed(own, found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(runs, _RUNS), pa.array(rest, pa.string())],
                                             names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(
        run, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(text: bytes, doc_id: object) -> list[bytes]:
    """A text's words; by its id, one text in ten goes round from a place of its own on."""
    words = text.split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def report(docs: DataFrame) -> DataFrame:
    """The op11 result: number of runs, the longest one and the digests."""
    runs = find_runs(docs, planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = runs.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("best"),
                       F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, period, length = -F.col("best")["col2"], -F.col("best")["col3"], F.col("best")["length"]
    return best.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
