"""Helpers shared by the corpus operators: reading tables, written
intermediate tables in the shared folder, and Arrow-batched text maps."""
from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinlytics.session import apply_required_conf, ensure_checkpoint_dir, ship_package

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32(),
          "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of a given table; the path may be of any file system Spark reads."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: bytes of a batch handed to a Python worker, so that long texts don't add up (one text is never cut): a worker holds a
#: batch as Arrow, as str and as what is made of it, and keeps that memory while later stages of the pipeline run
BATCH_BYTES = 4 << 20
_SENT: list[Broadcast] = []


def prepare(spark: SparkSession) -> None:
    """Session settings, shared folder and the package for Python workers."""
    apply_required_conf(spark)
    if spark.conf.get(_BATCH_CONF, None) != str(BATCH_BYTES):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def shared(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast that ``release`` takes off the executors again."""
    sent = spark.sparkContext.broadcast(value)
    _SENT.append(sent)
    return sent


def release() -> None:
    """Free what was broadcast for results that are written by now; a later use fetches it from the driver again."""
    while _SENT:
        _SENT.pop().unpersist()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` under the session's shared checkpoint folder and reread it.

    Cuts lineage: a lost executor costs a re-read, and the planner knows the
    table's size, so it broadcasts it only below its threshold.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_text(df: DataFrame, keep: list[str], new: str, make: Callable[[], Callable[[list], list[list]]],
             text: str = "text") -> DataFrame:
    """Add columns computed from whole texts, in Arrow batches on the executors.

    ``keep`` columns pass through untouched; ``new`` is a DDL string of the
    added columns; ``make()`` runs once per partition and returns a function
    from the batch's texts (None for null) to one list per added column.
    """
    added = T.StructType.fromDDL(new)
    schema = T.StructType([df.schema[c] for c in keep] + added.fields)
    kinds = [_ARROW[f.dataType.simpleString()] for f in added.fields]
    names = [f.name for f in schema.fields]
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            found = compute(batch.column(width).to_pylist())
            arrays = [batch.column(i) for i in range(width)]
            arrays += [pa.array(v, type=k) for v, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select(*keep, F.col(text).alias("_llm_text")).mapInArrow(run, schema)


def in_blocks(rows: DataFrame, key: str, size: str, member: str, block: int) -> DataFrame:
    """Deal the members of every group to pairs of blocks of about ``block`` rows.

    ``size`` holds the group's number of rows. A group of g blocks becomes the
    g (g + 1) / 2 block pairs (lo, hi); every pair of members meets in exactly
    one of them, and no task holds more than two blocks at a time. ``side`` is
    the row's own block. Rows come out partitioned and sorted by (key, lo, hi).
    """
    parts = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(member), parts).cast("int")
    dealt = rows.withColumn("side", own).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1))).drop(size)
    dealt = dealt.withColumns({"lo": F.least("side", "_other"), "hi": F.greatest("side", "_other")}).drop("_other")
    return dealt.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str],
           decode: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The rows of each run of equal keys in sorted batches, as decoded arrays."""
    held: list[tuple[np.ndarray, ...]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys], axis=1)
        arrays = decode(batch)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        for i in range(len(cuts) - 1):
            if held and (i or tuple(k[0]) != last):
                yield _concatenated(held)
                held = []
            held.append(tuple(a[cuts[i]:cuts[i + 1]] for a in arrays))
        last = tuple(k[-1])
    if held:
        yield _concatenated(held)


def _concatenated(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def word_counts(docs: DataFrame, pattern: str, per_document: bool, keep_in_memory: int = 200_000) -> DataFrame:
    """(word, n) over all whole texts, lower-cased; ``per_document`` counts each
    word once per text. Each task adds up before the shuffle in a table of at
    most ``keep_in_memory`` words (then it is handed on and started anew)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = re.compile(pattern).findall, Counter()

        def handed_on():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    words = find(text.lower())
                    seen.update(set(words) if per_document else words)
                    if len(seen) > keep_in_memory:
                        yield handed_on()
                        seen = Counter()
        yield handed_on()

    part = docs.select("text").mapInArrow(run, "word string, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n"))
