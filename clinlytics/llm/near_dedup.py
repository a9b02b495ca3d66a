"""Operator 9: near-duplicate documents by one-permutation MinHash.

Texts are lower-cased (A-Z) and cut at white space; a document's set holds its
distinct 5-word shingles (fewer words: the whole sequence as one). One hash
per shingle fills BINS bins; empty bins take the value of the first filled bin
in an order of their own (optimal densification). BANDS bands of ROWS bins are
the buckets.

1. Equal word sequences form a class; only its smallest id goes on.
2. Each bucket gives a star: every member and the bucket's smallest id. Each
   member's best star edge, by the bins that agree, is confirmed on full sets.
3. Buckets that still span several components are compared inside, in blocks
   of bounded size, on the signatures: first each member's best partner of
   another component, then every remaining pair of different components that
   agrees in ESTIMATE of the bins or more. Nothing is capped.
4. Confirmed links are joined to components.

A pair at the least similarity, 0.75, misses all buckets with probability
(1 - 0.75^4)^32 < 1e-5, and lies below ESTIMATE = 0.68 (standard deviation
0.019 over SKETCH bins) with about 1e-4.

Defined results: null or wordless texts have 0 shingles and are linked with
nothing; rows of one id count as one document (linked if any of their texts
are); a null id has a null component and is kept; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinlytics.llm.common import groups, in_blocks, map_text, prepare, written
from clinlytics.llm.graph import connected_components

SHINGLE = 5
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: bins of the sketch that estimates similarities, one byte each
SKETCH = 512
ESTIMATE = 0.68
#: the first bins of the sketch are compared first, against a lower bar
FIRST, FIRST_ESTIMATE = 128, 0.58
#: rows of a block when a bucket is compared inside
BLOCK = 512
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_RNG = np.random.default_rng(9)
#: for every bin the order in which it asks the others for a value
DONORS = {n: np.stack([_RNG.permutation(n) for _ in range(n)]) for n in (BINS, SKETCH)}


def words(text: str) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only: A-Z, space and \\x09-\\x0D."""
    return text.encode().lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word to 64-bit hash; emptied when it grows beyond a bound."""
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(own: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    if not own:
        return np.zeros(0, dtype=np.uint64)
    if len(own) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(own), 1)], dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, own), dtype=np.uint64, count=len(own))
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE):
        total = mixed(total + h[i:i + n] * _ODD[i])
    return np.unique(total)


def signature(sets: np.ndarray, n: int) -> np.ndarray:
    """One value for each of n bins of the sorted hashes, densified."""
    bins = (sets >> np.uint64(65 - n.bit_length())).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    out = np.zeros(n, dtype=np.uint64)
    out[bins[first]] = sets[first]
    if len(first) < n:
        filled = np.zeros(n, dtype=bool)
        filled[bins[first]] = True
        empty = np.flatnonzero(~filled)
        for width in (16, n):  # few ask long
            ask = DONORS[n][empty, :width]
            hit = filled[ask]
            at = hit.argmax(axis=1)
            rows = np.arange(len(empty))
            found = hit[rows, at]
            out[empty[found]] = out[ask[rows[found], at[found]]]
            empty = empty[~found]
            if not len(empty):
                break
    return out


def buckets(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    total = np.arange(BANDS, dtype=np.uint64) * _ODD[4]
    for i in range(ROWS):
        total = mixed(total + rows[:, i] * _ODD[i])
    return total


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, n_shingles, bands, sketch) of every whole text; seq is null without words."""
    def make() -> Callable[[list], list[list]]:
        hashes = WordHashes()

        def compute(texts: list) -> list[list]:
            out: list[list] = [[], [], [], []]
            for text in texts:
                own = words(text) if text else []
                if own:
                    sets = shingles(own, hashes)
                    row = (xxhash.xxh3_128_digest(b" ".join(own)), len(sets), buckets(signature(sets, BINS)).tobytes(), (signature(sets, SKETCH) & np.uint64(0xFF)).astype(np.uint8).tobytes())
                else:
                    row = (None, 0, None, None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out
        return compute

    return map_text(docs, ["doc_id"], "seq binary, n_shingles bigint, bands binary, sketch binary", make)


def bucket_rows(classes: DataFrame) -> DataFrame:
    """(bucket, rep) for every class and band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int64)
            rep = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(bands), pa.array(rep)], names=["bucket", "rep"])

    return classes.select("rep", "bands").mapInArrow(run, "bucket bigint, rep bigint")


def estimated(edges: DataFrame, sketches: DataFrame) -> DataFrame:
    """``edges(u, v)`` with the share of bins that agree."""
    a = sketches.select(F.col("rep").alias("u"), F.col("sketch").alias("_a"))
    b = sketches.select(F.col("rep").alias("v"), F.col("sketch").alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).mean(axis=1))], names=["u", "v", "est"])

    return edges.join(a, "u").join(b, "v").select("u", "v", "_a", "_b").mapInArrow(run, "u bigint, v bigint, est double")


def confirmed(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """The ``edges(u, v)`` whose full shingle sets meet 100 * intersection >= 75 * union."""
    ids = written(edges.select(F.col("u").alias("doc_id")).union(edges.select("v")).distinct())
    texts = docs.select("doc_id", "text").where("text is not null").join(ids, "doc_id", "left_semi").distinct()
    texts = written(texts)
    both = (edges.join(texts.withColumnsRenamed({"doc_id": "u", "text": "_a"}), "u")
            .join(texts.withColumnsRenamed({"doc_id": "v", "text": "_b"}), "v").select("u", "v", "_a", "_b"))

    def full(text: str) -> set:
        own = words(text)
        return set(zip(*(own[i:] for i in range(SHINGLE)), strict=False)) if len(own) >= SHINGLE else {tuple(own)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, last, sets = [], None, set()
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != last:
                    last, sets = a, full(a)
                other = full(b)
                both = len(sets & other)
                linked.append(bool(last and b) and 100 * both >= 75 * (len(sets) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(linked))

    return written(both.mapInArrow(run, "u bigint, v bigint").distinct())


def inside(members: DataFrame, best_only: bool) -> DataFrame:
    """Pairs (u, v) of different components in one bucket that agree in ESTIMATE of the bins or more.

    A pair that shares several buckets is compared in the first of them only.
    ``members(bucket, rep, component, sketch, bands, size)``; ``best_only`` gives for
    each member its best partner in each block, else every pair.
    """
    dealt = in_blocks(members, "bucket", "size", "rep", BLOCK)

    def decode(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        return (batch.column("rep").to_numpy(), batch.column("component").to_numpy(), (batch.column("side").to_numpy() == batch.column("hi").to_numpy()),
                (batch.column("lo").to_numpy() == batch.column("hi").to_numpy()),
                np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SKETCH),
                np.frombuffer(b"".join(batch.column("bands").to_pylist()), dtype=np.int64).reshape(-1, BANDS), batch.column("bucket").to_numpy())

    def pairs(rep, comp, high, same, sketch, bands, bucket) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = np.arange(len(rep)) if same[0] else np.flatnonzero(~high)
        cols = rows if same[0] else np.flatnonzero(high)
        best = np.full(len(cols), -1.0)
        best_row = np.zeros(len(cols), dtype=np.int64)
        for i in range(0, len(rows), 32):
            part = rows[i:i + 32]
            near = (sketch[part][:, None, :FIRST] == sketch[cols][None, :, :FIRST]).mean(axis=2) >= FIRST_ESTIMATE
            est = np.full(near.shape, -1.0)
            once = part[:, None] < cols[None, :] if same[0] else True
            x, y = np.nonzero(near & once & (comp[part][:, None] != comp[cols][None, :]))
            for k in range(0, len(x), 1 << 13):
                a, b = x[k:k + (1 << 13)], y[k:k + (1 << 13)]
                shared = bands[part[a]] == bands[cols[b]]
                here = bands[part[a], shared.argmax(axis=1)] == bucket[0]
                a, b = a[here], b[here]
                est[a, b] = (sketch[part[a]] == sketch[cols[b]]).mean(axis=1)
            if not best_only:
                x, y = np.nonzero(est >= ESTIMATE)
                yield rep[part[x]], rep[cols[y]]
                continue
            if est.size:
                j = est.argmax(axis=1)
                good = est[np.arange(len(part)), j] >= ESTIMATE
                yield rep[part[good]], rep[cols[j[good]]]
                k = est.argmax(axis=0)
                top = est[k, np.arange(len(cols))]
                better = top > best
                best[better], best_row[better] = top[better], part[k[better]]
        good = best >= ESTIMATE
        yield rep[best_row[good]], rep[cols[good]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in groups(batches, ["bucket", "lo", "hi"], decode):
            if (arrays[1] != arrays[1][0]).any():
                for a, b in pairs(*arrays):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])

    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) over class representatives; nodes without links may be absent."""
    members = bucket_rows(classes)
    size = members.groupBy("bucket").agg(F.min("rep").alias("center"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(members.join(size, "bucket"))
    sketches = classes.select("rep", "sketch")
    star = estimated(members.where("rep <> center").select(F.col("center").alias("u"), F.col("rep").alias("v")).distinct(), sketches).where(F.col("est") >= ESTIMATE)
    star = star.groupBy("v").agg(F.max(F.struct("est", "u")).alias("e")).select("e.u", "v")
    tested = written(star)
    found = confirmed(docs, tested)
    for best_only in (True, False):
        parts = written(connected_components(found))
        component = F.coalesce("component", "rep")
        now = members.select("bucket", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", component.alias("component"))
        now = written(now)
        open_ = now.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi")
        rows = now.join(open_.select("bucket", "size"), "bucket").join(classes.select("rep", "sketch", "bands"), "rep")
        rows = rows.select("bucket", "rep", "component", "sketch", "bands", "size")
        fresh = written(inside(rows, best_only).join(tested, ["u", "v"], "left_anti"))
        found = found.union(confirmed(docs, fresh))
        tested = tested.union(fresh)
    return connected_components(found)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The op9 result, one row per document row: doc_id, n_shingles, component_id, kept."""
    prepare(docs.sparkSession)
    base = written(prints(docs))
    own = base.where("seq is not null and doc_id is not null")
    classes = written(own.groupBy("seq").agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("m"))
                      .select("seq", F.col("m.doc_id").alias("rep"), "m.bands", "m.sketch"))
    same_id = own.select("doc_id", "seq").distinct().join(classes.select("seq", "rep"), "seq").where("doc_id <> rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    parts = links(docs, classes)
    # An id with several texts lies in several classes; it joins them.
    several = own.groupBy("doc_id").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).where("a <> b").select("doc_id")
    parts = written(parts)
    bridged = same_id.join(several.withColumnRenamed("doc_id", "v"), "v", "left_semi")
    parts = connected_components(parts.select(F.col("component").alias("u"), F.col("node").alias("v")).union(bridged.select("u", "v")))
    parts = written(parts)
    out = base.select("doc_id", "seq", "n_shingles").join(classes.select("seq", "rep"), "seq", "left")
    out = out.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates (the smallest id; of its rows the first by text hash)."""
    dropped = written(deduplicate(docs).where("not kept").select(F.col("doc_id").alias("_llm_id")).distinct())
    left = docs.join(dropped, F.col("doc_id") == F.col("_llm_id"), "left_anti")
    w = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    return (left.withColumn("_llm_no", F.row_number().over(w)).where("_llm_no = 1 or doc_id is null").select(*docs.columns))
