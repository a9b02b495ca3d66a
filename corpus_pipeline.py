"""A training-data pipeline over ``documents``: five stages, each a corpus operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet in the session's shared checkpoint folder and
rereads them as the next stage's documents. All stages but the last return the
columns of ``documents``; the last adds domain, n_tokens and copies.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinlytics.llm import decontaminate, lang_id, mixing, near_dedup, pii
from clinlytics.llm.common import DOC_COLUMNS, prepare, release, table, written


def _documents(docs: DataFrame) -> DataFrame:
    """The stage's input; what the stage before it, written by now, had sent to the executors is freed."""
    release()
    return docs.select(*DOC_COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language models reject (no letters, or unlike any learned language)."""
    docs = _documents(docs)
    known = lang_id.identify(docs, lang_id.fit(docs, ~lang_id.held_out()), list(DOC_COLUMNS))
    return known.where(~F.col("rejected")).select(*DOC_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    prepare(spark)
    return near_dedup.keep_one(_documents(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    return decontaminate.clean(_documents(docs), table(spark, sf_dir, "benchmark"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and what discloses it; no document is dropped."""
    return pii.sanitise(_documents(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chooses documents and their number of copies by the target weights."""
    return mixing.mix(_documents(docs))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", remove_personal_data),
    ("mixing", mix_sources),
]

#: trained and per-text Python stages have no SQL form; tests/llm holds the brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
