"""Operator 1: quality classification by compression.

Two zstandard dictionaries are built from good and from bad labelled text.
Every whole text is compressed in pieces of PIECE bytes under each dictionary;
the difference of the compressed sizes over their sum, with the plain
compression ratio, is turned into a probability by a logistic calibration
fitted on other labelled rows.

Bounds on the labelled sample (documented parameters): DICTIONARY_DOCS rows of
each label give one excerpt of EXCERPT characters each, CALIBRATION_DOCS rows of
each label, disjoint from those, are compressed whole for the calibration.

Defined results: null and empty texts score 0.0. Rows map one to one. Without
labelled rows of both kinds every non-empty text scores the share of label 1
(0.5 if there is none). Extra columns are ignored; label, lang, source and
doc_id never enter a score.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinlytics.llm.common import map_text, prepare

DICTIONARY_DOCS = 1_500
CALIBRATION_DOCS = 1_500
EXCERPT = 2_000
DICTIONARY_BYTES = 64 * 1024
PIECE = 1_024
LEVEL = 3
THRESHOLD = 0.7


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray | None  # bias first
    center: np.ndarray | None
    scale: np.ndarray | None
    prior: float


def dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary of the texts; raw content where too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY_BYTES:]


def compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in (good, bad):
        own = zstandard.ZstdCompressionDict(content)
        own.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_dict_id=False, write_checksum=False))
    out.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False))
    return out


def sizes(text: bytes, press: list[zstandard.ZstdCompressor]) -> tuple[int, int, int]:
    """Compressed bytes of all pieces under the good and the bad dictionary, and of the plain text."""
    good = bad = 0
    a, b = press[0].compress, press[1].compress
    for i in range(0, len(text), PIECE):
        piece = text[i:i + PIECE]
        good += len(a(piece))
        bad += len(b(piece))
    return good, bad, len(press[2].compress(text))


def features(good: np.ndarray, bad: np.ndarray, plain: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Normalised size difference and compression ratios with their products."""
    diff = (bad - good) / (bad + good + 1.0)
    ratio = good / (n + 16.0)
    worse = bad / (n + 16.0)
    whole = plain / (n + 64.0)
    short = 1.0 / np.sqrt(n + 1.0)
    return np.stack([diff, diff * diff, ratio, ratio * ratio, worse, whole, whole * whole, short, short * diff], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; bias first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * len(x) * 1e-2 * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * len(x) * 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _labelled(labels: DataFrame) -> DataFrame:
    """Labelled ids with their rank by hash within the label."""
    own = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
           .groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("quality").alias("_other"))
           .where(F.col("quality") == F.col("_other")).select("doc_id", "quality"))
    w = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= DICTIONARY_DOCS + CALIBRATION_DOCS)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Dictionaries and calibration from the labelled rows that are not held out."""
    spark = docs.sparkSession
    prepare(spark)
    chosen = _labelled(labels).collect()  # at most 2 * (DICTIONARY_DOCS + CALIBRATION_DOCS) ids
    counts = {r["quality"]: r["count"] for r in labels.where(F.col("quality").isin(0, 1)).where(~held_out()).groupBy("quality").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    if len({r["quality"] for r in chosen}) < 2:
        return Model(b"", b"", None, None, None, prior)
    # Odd ranks feed the dictionaries, even ranks the calibration: small tables serve both.
    ids = F.broadcast(spark.createDataFrame([(r["doc_id"], r["quality"], r["rank"] % 2) for r in chosen], "doc_id bigint, quality int, use int"))
    own = docs.select("doc_id", "text").where(F.length("text") > 0).join(ids, "doc_id")
    start = 1 + F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - EXCERPT + 1))
    pieces = own.where("use = 1").select("quality", F.substring("text", start, F.lit(EXCERPT)).alias("t")).orderBy(F.xxhash64("t"), "t").collect()
    by = [[r["t"].encode() for r in pieces if r["quality"] == q] for q in (1, 0)]
    if not by[0] or not by[1]:
        return Model(b"", b"", None, None, None, prior)
    good, bad = dictionary(by[0]), dictionary(by[1])
    rows = measured(own.where("use = 0"), ["quality"], good, bad).collect()
    if len({r["quality"] for r in rows}) < 2:
        return Model(b"", b"", None, None, None, prior)
    x = features(*(np.array([float(r[c]) for r in rows]) for c in ("good", "bad", "plain", "n_bytes")))
    y = np.array([float(r["quality"]) for r in rows])
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    return Model(good, bad, logistic((x - center) / scale, y, weight), center, scale, prior)


def measured(docs: DataFrame, keep: list[str], good: bytes, bad: bytes) -> DataFrame:
    """Compressed sizes of every whole text: good, bad, plain, n_bytes."""
    share = docs.sparkSession.sparkContext.broadcast((good, bad))

    def make() -> Callable[[list], list[list]]:
        press = compressors(*share.value)

        def compute(texts: list) -> list[list]:
            raw = [t.encode() if t else b"" for t in texts]
            got = [sizes(t, press) if t else (0, 0, 0) for t in raw]
            return [[g for g, _, _ in got], [b for _, b, _ in got], [p for _, _, p in got], [len(t) for t in raw]]
        return compute

    return map_text(docs, keep, "good bigint, bad bigint, plain bigint, n_bytes bigint", make)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: the kept columns, score, predicted and the compressed sizes."""
    prepare(docs.sparkSession)
    keep = keep or ["doc_id"]
    share = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list], list[list]]:
        model = share.value
        press = compressors(model.good, model.bad) if model.weights is not None else None

        def compute(texts: list) -> list[list]:
            raw = [t.encode() if t else b"" for t in texts]
            got = np.array([sizes(t, press) if t and press else (0, 0, 0) for t in raw], dtype=float).reshape(len(raw), 3)
            n = np.array([len(t) for t in raw], dtype=float)
            if press is None:
                p = np.full(len(raw), model.prior)
            else:
                z = (features(got[:, 0], got[:, 1], got[:, 2], n) - model.center) / model.scale @ model.weights[1:] + model.weights[0]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            p = np.where(n > 0, p, 0.0)
            return [p.tolist(), (p >= THRESHOLD).astype(int).tolist(), got[:, 0].astype(int).tolist(), got[:, 1].astype(int).tolist()]
        return compute

    return map_text(docs, keep, "score double, predicted int, good_bytes bigint, bad_bytes bigint", make)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The op1 result: doc_id, held_out, score, predicted and the compressed sizes."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "good_bytes", "bad_bytes")
