"""A first upsert writes its rows aside once, and large partitions are written by several tasks."""
import tempfile

from pyspark.sql import functions as F

from clinlytics.operators import upsert as up


def test_a_large_partition_is_written_by_several_tasks(spark):
    root = tempfile.mkdtemp(prefix="rebalance-", dir="/tmp")
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(advisory, "64KB")
    try:
        rows = spark.range(0, 20_000, numPartitions=4).select("id", F.sha2(F.col("id").cast("string"), 512).alias("v"))
        assert up.upsert_table(spark, root, rows, ["id"], partitions=1) == 20_000
    finally:
        spark.conf.unset(advisory)
    files = spark.read.parquet(f"{root}/rows").select(F.input_file_name()).distinct().count()
    assert files > 1 and up.read_table(spark, root).count() == 20_000
    assert up._names(spark, root, "incoming") == [] and up._names(spark, root, "stage") == []
    assert up.upsert_table(spark, root, rows.limit(10).withColumn("v", F.lit("new")), ["id"], partitions=1) == 10
    assert up.read_table(spark, root).where("v = 'new'").count() == 10 and up.read_table(spark, root).count() == 20_000
