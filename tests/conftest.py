import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from clinlytics.session import REQUIRED_CONF, ensure_checkpoint_dir, ship_package
    b = (SparkSession.builder.master("local[*]").appName("clinlytics-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false"))
    for k, v in REQUIRED_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    ship_package(s)
    yield s


@pytest.fixture(scope="session")
def small(spark):
    from clinlytics.sources.driver import clinic_tables
    return clinic_tables(spark, SF_SMALL)
