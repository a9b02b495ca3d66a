"""Operator 10: language identification by character language models.

One interpolated Kneser-Ney model of order 4 per language. n-gram counts are
taken over every training text on the executors, in pieces of bounded size;
no n-gram is left out, so the continuation counts of the shorter orders are
those of the whole corpus. The models are sorted arrays of packed 64-bit
n-grams with one log-probability row per language, looked up by binary search;
they grow with the number of distinct n-grams (8 bytes each, and 4 per
language), not with the texts. The language with the lowest cross-entropy per
character wins; a fitted temperature turns the margins into a score, and a
text whose best cross-entropy lies far above what its language shows in
training is rejected.

Defined results: null text or a text without a letter gives ``und``, score 0,
rejected. Characters beyond U+FFFF count as one character. Rows are kept one to
one (repeated ids and rows included). An empty training table gives ``und``
everywhere; a language whose texts hold no letter is not learned. Extra columns
are ignored.
"""
from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinlytics.llm.common import map_text, prepare, shared, written

ORDER = 4
DISCOUNT = 0.75
#: n-grams that a task counts at a time, and different ones that it holds before it hands them on
COUNTED, HELD = 1 << 20, 1 << 20
#: a bounded choice of rows for looks at the data (``calibration_rows``); the fit reads all training rows
CALIBRATION_ROWS = 500
#: cross-entropies are rounded to so many a unit for the medians, so that a language has a bounded number of values
STEPS = 10_000
TEMPERATURES = (0.25, 0.5, 1, 2, 4, 8, 16, 32, 64)
#: a text is rejected beyond so many standard deviations of its language's cross-entropy
REJECT_DEVIATIONS = 8.0
#: shorter texts get wider limits: the deviation grows by sqrt(1 + SHORT / length)
SHORT = 200
_BREAK = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def letters(text: str) -> str:
    """Lower-cased text with every run of non-letters as one space."""
    return " " + _BREAK.sub(" ", text.lower()).strip() + " "


def packed(text: str) -> np.ndarray:
    """Order-4 n-grams of a prepared text, 16 bits a character (rarer planes share 0xFFFF)."""
    c = np.minimum(np.frombuffer(("   " + text).encode("utf-32-le"), dtype=np.uint32), 0xFFFF).astype(np.uint64)
    return (c[:-3] << np.uint64(48)) | (c[1:-2] << np.uint64(32)) | (c[2:-1] << np.uint64(16)) | c[3:]


def packed_parts(text: str, step: int = COUNTED) -> Iterator[np.ndarray]:
    """``packed`` of a prepared text, ``step`` n-grams at a time."""
    for i in range(0, len(text), step):
        low = max(0, i - 3)
        yield packed(text[low:i + step])[i - low:]


@dataclass
class Model:
    """Per order: sorted n-grams, log-probabilities by language, and back-off weights of contexts."""
    langs: list[str]
    grams: dict[int, np.ndarray]
    logp: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]
    backoff: dict[int, np.ndarray]
    floor: float


@dataclass
class Fitted:
    """A model on the executors, with what was fitted to it: by language the usual cross-entropy and its deviation."""
    model: Broadcast
    langs: list[str]
    temperature: float
    mean: np.ndarray
    deviation: np.ndarray


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams with their added-up counts."""
    gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return gram, np.bincount(at, np.concatenate([n for _, n in parts]), len(gram)).astype(np.int64)


def ngram_counts(train: DataFrame) -> DataFrame:
    """(lang, gram, n) over all training texts; tasks add up before the shuffle, in tables of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: dict[str, list[np.ndarray]] = {}
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting = 0

        def add_up() -> None:
            for lang, parts in raw.items():
                fresh = np.unique(np.concatenate(parts), return_counts=True)
                held[lang] = _added([held[lang], fresh]) if lang in held else fresh
            raw.clear()

        def handed_on() -> Iterator[pa.RecordBatch]:
            for lang, (gram, n) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(gram), np.int32)), pa.array([lang])).cast(pa.string()),
                     pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text or not _LETTER.search(text):
                    continue
                for part in packed_parts(letters(text)):
                    raw.setdefault(lang, []).append(part)
                    waiting += len(part)
                    if waiting >= COUNTED:
                        add_up()
                        waiting = 0
                        if sum(len(g) for g, _ in held.values()) >= HELD:
                            yield from handed_on()
        add_up()
        yield from handed_on()

    part = train.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated models from (sorted grams, counts) per language."""
    alphabet = len(np.unique(np.concatenate([g & np.uint64(0xFFFF) for g, _ in counts.values()]))) + 1
    raw: dict[int, dict[str, tuple[np.ndarray, np.ndarray]]] = {ORDER: counts}
    for order in (3, 2, 1):  # continuation counts: in how many contexts a shorter n-gram was seen
        keep = np.uint64((1 << 16 * order) - 1)
        raw[order] = {x: np.unique(raw[order + 1][x][0] & keep, return_counts=True) for x in langs}
    grams = {k: np.unique(np.concatenate([raw[k][x][0] for x in langs])) for k in raw}
    contexts = {k: np.unique(grams[k] >> np.uint64(16)) for k in (4, 3, 2)}
    prob, weight = {}, {}
    for order in (1, 2, 3, 4):
        prob[order] = np.zeros((len(grams[order]), len(langs)))
        if order > 1:
            weight[order] = np.ones((len(contexts[order]), len(langs)))
        for j, lang in enumerate(langs):
            gram, n = raw[order][lang]
            seen = np.zeros(len(grams[order]))
            seen[np.searchsorted(grams[order], gram)] = n
            if order == 1:
                total = n.sum()
                prob[1][:, j] = np.maximum(seen - DISCOUNT, 0) / total + DISCOUNT * len(n) / total / alphabet
                continue
            at = np.searchsorted(contexts[order], grams[order] >> np.uint64(16))
            total = np.bincount(at, seen, len(contexts[order]))
            kinds = np.bincount(at, seen > 0, len(contexts[order]))
            known = total > 0
            weight[order][known, j] = DISCOUNT * kinds[known] / total[known]
            lower = prob[order - 1][np.searchsorted(grams[order - 1], grams[order] & np.uint64((1 << 16 * (order - 1)) - 1)), j]
            own = np.divide(np.maximum(seen - DISCOUNT, 0), total[at], out=np.zeros(len(seen)), where=known[at])
            prob[order][:, j] = own + weight[order][at, j] * lower
    return Model(langs, grams, {k: np.log(v).astype(np.float32) for k, v in prob.items()}, contexts,
                 {k: np.log(v).astype(np.float32) for k, v in weight.items()}, -math.log(alphabet * 10))


def log_probabilities(model: Model, gram: np.ndarray) -> np.ndarray:
    """Rows of log-probabilities by language for packed n-grams."""
    out = np.zeros((len(gram), len(model.langs)), dtype=np.float32)
    open_at, rest = np.arange(len(gram)), gram
    for order in (4, 3, 2, 1):
        table = model.grams[order]
        at = np.minimum(np.searchsorted(table, rest), len(table) - 1)
        hit = table[at] == rest
        if order == ORDER and hit.all():
            return model.logp[order][at]
        out[open_at[hit]] += model.logp[order][at[hit]]
        open_at, rest = open_at[~hit], rest[~hit]
        if not len(rest):
            return out
        if order > 1:
            known = model.contexts[order]
            context = rest >> np.uint64(16)
            at = np.minimum(np.searchsorted(known, context), len(known) - 1)
            found = known[at] == context
            out[open_at[found]] += model.backoff[order][at[found]]
            rest = rest & np.uint64((1 << 16 * (order - 1)) - 1)
    out[open_at] += model.floor
    return out


def cross_entropies(model: Model, text: str, step: int = 1 << 18) -> tuple[np.ndarray, int]:
    """Cross-entropy per character by language over the whole text, and its length."""
    prepared, total = letters(text), np.zeros(len(model.langs))
    for gram in packed_parts(prepared, step):
        total += log_probabilities(model, gram).sum(axis=0, dtype=np.float64)
    return -total / len(prepared), len(prepared)


def fit(docs: DataFrame, training: Column) -> Fitted | None:
    """Models from the rows of ``docs(doc_id, text, lang)`` where ``training`` holds."""
    spark = docs.sparkSession
    prepare(spark)
    train = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    rows = written(ngram_counts(train)).orderBy("lang", "gram").toArrow()  # distinct n-grams, not texts
    langs = rows["lang"].combine_chunks().dictionary_encode() if rows.num_rows else None
    if langs is None:
        return None
    gram, n, at = rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy(), langs.indices.to_numpy()
    by = {}
    for j, lang in enumerate(langs.dictionary.to_pylist()):
        own = gram[at == j]
        order = np.argsort(own)  # as unsigned numbers
        by[lang] = (own[order], n[at == j][order])
    return calibrate(shared(spark, kneser_ney(sorted(by), by)), sorted(by), train)


def calibration_rows(train: DataFrame, rows: int | None = None) -> DataFrame:
    """(lang, text): at most ``rows`` different texts with letters of each language, chosen by hash."""
    key = F.xxhash64(F.col("doc_id").cast("string"), "text").alias("key")
    keys = train.where(F.regexp_like("text", F.lit(r"\p{L}"))).select("lang", key).distinct()
    first = keys.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("at") <= (rows or CALIBRATION_ROWS))
    # CALIBRATION_ROWS keys of a language at most, of the languages whose models are sent to all tasks anyway
    return train.select("lang", "text", key).join(F.broadcast(first), ["lang", "key"]).dropDuplicates(["lang", "key"]).select("lang", "text")


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mid): the median of ``value`` over all rows by ``key``, of values rounded to STEPS a unit.

    The rows are counted by value first, so what one task holds is bounded by
    the different values (a cross-entropy's range), not by the rows.
    """
    step = F.round(F.col(value) * STEPS).cast("bigint")
    counts = rows.groupBy(key, step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg((F.percentile("step", 0.5, F.col("n")) / STEPS).alias("mid"))


def calibrate(share: Broadcast, langs: list[str], train: DataFrame) -> Fitted:
    """Fit temperature and rejection limits on all training rows with letters.

    The tasks return a row's own cross-entropy and its loss at each temperature;
    what reaches the driver is a median and a deviation by language and the sums of the losses.
    """
    index = {x: j for j, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = share.value
        for batch in batches:
            out: list[list] = [[], [], []]
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if lang not in index or not _LETTER.search(text):
                    continue
                j, (ce, n) = index[lang], cross_entropies(model, text)
                p = [posterior(ce[None, :], np.array([n]), x)[0, j] for x in TEMPERATURES]
                for column, value in zip(out, (j, float(ce[j]), (-np.log(np.maximum(p, 1e-9))).tolist()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.float64()))], names=["j", "own", "loss"])

    rows = written(train.select("lang", "text").mapInArrow(run, "j int, own double, loss array<double>"))
    mean, dev = np.full(len(langs), np.inf), np.ones(len(langs))
    mid = medians(rows, "j", "own")
    away = medians(rows.join(F.broadcast(mid), "j").select("j", F.abs(F.col("own") - F.col("mid")).alias("away")), "j", "away")  # a row for each language
    for r in mid.join(away.withColumnRenamed("mid", "away"), "j").collect():
        mean[r["j"]], dev[r["j"]] = r["mid"], max(0.05, 1.4826 * r["away"])
    losses = rows.agg(*[F.avg(F.col("loss")[i]) for i in range(len(TEMPERATURES))]).first()
    known = [(x, float(t)) for x, t in zip(losses, TEMPERATURES, strict=True) if x is not None]
    return Fitted(share, langs, min(known)[1] if known else 1.0, mean, dev)


def posterior(ce: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
    z = -(ce * n[:, None]) / temperature
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, fitted: Fitted | None, keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: the kept columns and lang_pred, score, entropy, rejected."""
    prepare(docs.sparkSession)

    def make() -> Callable[[list], list[list]]:
        model = fitted.model.value if fitted is not None else None

        def compute(texts: list) -> list[list]:
            out: list[list] = [[], [], [], []]
            for text in texts:
                if model is None or not text or not _LETTER.search(text):
                    row = ("und", 0.0, None, True)
                else:
                    ce, n = cross_entropies(model, text)
                    j = int(np.argmin(ce))
                    score = float(posterior(ce[None, :], np.array([n]), fitted.temperature)[0, j])
                    limit = fitted.mean[j] + REJECT_DEVIATIONS * fitted.deviation[j] * math.sqrt(1 + SHORT / n)
                    row = (model.langs[j], score, float(ce[j]), bool(ce[j] > limit))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out
        return compute

    return map_text(docs, keep or ["doc_id"], "lang_pred string, score double, entropy double, rejected boolean", make)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """The op10 result: doc_id, held_out, lang_pred, score, entropy, rejected."""
    model = fit(docs, ~held_out())
    out = identify(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")
