"""Named SQL files run with ``spark.sql(text, args=...)`` (SC2).

The clinic tables are registered as temporary views of this session; the
text uses named parameter markers (``:name``), bound by Spark, never by
string formatting.
"""
from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession

from clinlytics.sources.driver import CLINIC_TABLES

SQL_DIR = os.path.join(os.path.dirname(os.path.abspath(__file__)), "sql")


def load_sql(name: str) -> str:
    with open(os.path.join(SQL_DIR, f"{name}.sql"), encoding="utf-8") as f:
        return f.read()


def register_views(t) -> None:
    for name in CLINIC_TABLES:
        t[name].createOrReplaceTempView(name)


def run_sql_file(spark: SparkSession, t, name: str, params: dict | None = None) -> DataFrame:
    register_views(t)
    return spark.sql(load_sql(name), args=params or {})


def daily_revenue_sql(t, since=dt.date(1900, 1, 1)) -> DataFrame:
    return run_sql_file(t.spark, t, "daily_revenue", {"since": since})
