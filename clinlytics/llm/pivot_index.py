"""Operator 6: near-duplicate vectors by a pivot-permutation index.

A bounded sample (PIVOT_SAMPLE vectors by hash) gives the pivots: a greedy
choice that skips vectors close to a chosen one, about as many as the square
root of the number of vectors, MAX_PIVOTS at most. Every vector is described by
its NEAREST closest pivots in order and stored in their inverted lists. Two
vectors of one list that share MIN_SHARED pivots or more are a candidate pair;
candidates are verified by the cosine in double precision. A pair is counted in
the list of its smallest shared pivot only, so counts add up. Pivots are
numbered from the rarest, so this is the shortest of the shared lists as far as
the sample tells. The smallest of MIN_SHARED shared pivots is never among a
vector's last MIN_SHARED - 1, so those lists need not hold the vector.

Scale: equal vectors are one entry with a multiplicity. Vectors of floats are
stored as floats and widened where they are compared. The described vectors are
written once; list sizes are counted from that table, and the lists themselves
exist only in the one shuffle that deals them to block pairs, so no task holds
more than two blocks. A task hands on one row per vector (links found, smallest
id of its local group), never pairs. Long lists stay whole: nothing is capped.

Defined results: vectors with a null label, a null, zero or non-finite vector
have 0 links and their own id as component. Vectors of different lengths link
with nothing. Repeated rows of one id count once as a partner; rows of one id
with different vectors add their links and join components. A null id has a
null component and is kept. Extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinlytics.llm.common import groups, in_blocks, prepare, written
from clinlytics.llm.graph import connected_components

COSINE = 0.93
PIVOT_SAMPLE = 8_192
MAX_PIVOTS = 1_024
NEAREST = 10
MIN_SHARED = 2
#: a pivot is no closer than this cosine to another
APART = 0.7
BLOCK = 768


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, label, embedding) rows that can link."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("embedding", lambda x: x != 0)
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    return (vectors.select("vec_id", "label", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
            .where("vec_id is not null and label is not null and embedding is not null").where(~bad).where(~zero).distinct())


def unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.asarray(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The numbers of the NEAREST closest pivots of each row, closest first."""
    k = min(NEAREST, len(table))
    score = x @ table.T
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, axis=1), axis=1, kind="stable"), axis=1)


def choose_pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by vector length, from a bounded sample."""
    total = classes.count()
    want = int(min(MAX_PIVOTS, max(32, 2 ** round(np.log2(max(1.0, total) ** 0.5)))))
    sample = classes.select("embedding").orderBy(F.xxhash64(F.col("embedding").cast("array<double>")), "embedding").limit(PIVOT_SAMPLE).collect()  # bounded
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(len(r[0]), []).append(r[0])
    out = {}
    for dim, rows in by.items():
        x = unit(rows)
        chosen, close = [], np.full(len(x), -1.0)
        for i in range(len(x)):
            if close[i] < APART:
                chosen.append(i)
                close = np.maximum(close, x @ x[i])
                if len(chosen) == want:
                    break
        use = np.bincount(nearest(x, x[chosen]).reshape(-1), minlength=len(chosen))
        out[dim] = x[chosen][np.argsort(use, kind="stable")]
    return out


def described(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(rep, mult, vector, near, lists): near holds the vector's pivots, closest first; lists those that store it."""
    share = classes.sparkSession.sparkContext.broadcast(pivots)
    dtype = number(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, mult, label = (batch.column(i).to_numpy() for i in range(3))
            rows = batch.column(3).to_pylist()
            dims = np.array([len(r) for r in rows])
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                raw = np.asarray([rows[i] for i in own], dtype=dtype)
                table = share.value.get(dim)
                if table is None:  # a length the sample lacks: one list for all of it
                    near = np.zeros((len(own), 1), dtype=np.int16)
                else:
                    near = nearest(unit(raw), table).astype(np.int16)
                stored = np.sort(near, axis=1)[:, :near.shape[1] - min(MIN_SHARED, near.shape[1]) + 1]
                lists = label[own].astype(np.int64)[:, None] * (1 << 26) + dim % (1 << 13) * (1 << 13) + stored
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep[own]), pa.array(mult[own]), pa.array([v.tobytes() for v in raw], pa.binary()),
                     pa.array([v.tobytes() for v in near], pa.binary()), pa.array(list(lists), pa.list_(pa.int64()))],
                    names=["rep", "mult", "vector", "near", "lists"])

    return classes.select("rep", "mult", "label", "embedding").mapInArrow(run, "rep bigint, mult bigint, vector binary, near binary, lists array<bigint>")


def number(classes: DataFrame) -> type:
    return np.float32 if classes.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64


def verified(entries: DataFrame, dtype: type) -> DataFrame:
    """(rep, n, root): links found in a block pair, and the smallest id of the vector's group there."""
    lists = entries.select(F.explode("lists").alias("list"), "rep", "mult", "vector", "near")
    sizes = written(lists.groupBy("list").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    dealt = in_blocks(lists.join(sizes, "list"), "list", "size", "rep", BLOCK)

    def decode(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        lo, hi = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
        as_objects = [np.array(batch.column(c).to_pylist() + [None], dtype=object)[:-1] for c in ("vector", "near")]
        return (batch.column("rep").to_numpy(), batch.column("mult").to_numpy(), batch.column("list").to_numpy(),
                (batch.column("side").to_numpy() == hi) & (lo != hi), *as_objects)

    def compare(rep, mult, key, high, vector, near):
        """Adjacency of one block pair, by verified pairs whose smallest shared pivot is this list's."""
        x = unit(np.frombuffer(b"".join(vector), dtype=dtype).reshape(len(rep), -1))
        own = np.frombuffer(b"".join(near), dtype=np.int16).reshape(len(rep), -1).astype(np.int64)
        pivot = int(key[0] % (1 << 13))
        names, at = np.unique(own, return_inverse=True)
        has = np.zeros((len(rep), len(names)), dtype=np.float32)
        has[np.repeat(np.arange(len(rep)), own.shape[1]), at.reshape(-1)] = 1
        a, b = (np.arange(len(rep)),) * 2 if not high.any() else (np.flatnonzero(~high), np.flatnonzero(high))
        shared = has[a] @ has[b].T
        low = names < pivot
        candidate = (shared >= min(MIN_SHARED, own.shape[1])) & (has[a][:, low] @ has[b][:, low].T == 0)
        i, j = np.nonzero(candidate)
        if len(i) * 4 < len(a) * len(b):
            good = np.zeros(len(i), dtype=bool)
            for s in range(0, len(i), 1 << 16):
                good[s:s + (1 << 16)] = np.einsum("ij,ij->i", x[a[i[s:s + (1 << 16)]]], x[b[j[s:s + (1 << 16)]]]) >= COSINE
            i, j = i[good], j[good]
        else:
            i, j = np.nonzero(candidate & (x[a] @ x[b].T >= COSINE))
        i, j = a[i], b[j]
        other = rep[i] != rep[j]
        return i[other], j[other]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rep, mult, key, high, vector, near in groups(batches, ["list", "lo", "hi"], decode):
            if len(rep) < 2 or (high.all()):
                continue
            i, j = compare(rep, mult, key, high, vector, near)
            if not len(i):
                continue
            n = np.bincount(i, mult[j], len(rep))
            if high.any():  # a pair shows up once; within one block it shows up from both sides
                n += np.bincount(j, mult[i], len(rep))
            root = rep.copy()
            while True:
                new = root.copy()
                np.minimum.at(new, i, root[j])
                np.minimum.at(new, j, root[i])
                if (new == root).all():
                    break
                root = new
            hit = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(n[hit].astype(np.int64)), pa.array(root[hit])], names=["rep", "n", "root"])

    return dealt.mapInArrow(run, "rep bigint, n bigint, root bigint")


def link_vectors(vectors: DataFrame) -> DataFrame:
    """The op6 result, one row per vector row: vec_id, n_links, component_id, kept."""
    prepare(vectors.sparkSession)
    rows = usable(vectors)
    classes = written(rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")))
    entries = written(described(classes, choose_pivots(classes)))
    found = written(verified(entries, number(classes)))
    n = found.groupBy("rep").agg(F.sum("n").alias("n"))
    # All members of a class are one: ids in several classes join them.
    several = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("vec_id")
    member = rows.join(classes, ["label", "embedding"]).select("vec_id", "rep", "mult")
    bridges = member.join(several, "vec_id", "left_semi").select(F.col("rep").alias("u"), F.col("vec_id").alias("v"))
    parts = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")).union(bridges)).withColumnsRenamed({"node": "rep"})
    each = (member.join(n, "rep", "left").join(written(parts), "rep", "left")
            .select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
            .groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("component").alias("component")))
    out = vectors.select("vec_id").join(each, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
