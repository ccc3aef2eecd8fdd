import pytest
from pyspark.sql import functions as F

from corvane.session import process_cache, shared_dir, spread, stage, unstage


def test_staged_tables_lie_in_the_shared_folder(spark):
    df = stage(spark.range(5).withColumn("x", F.array(F.lit(1))), "t")
    assert sorted(r["id"] for r in df.collect()) == [0, 1, 2, 3, 4]
    assert all(shared_dir(spark).rstrip("/") in f for f in df.inputFiles())


def test_spread(spark):
    few, many = spark.range(100, numPartitions=1), spark.range(100, numPartitions=16)
    assert spread(few).rdd.getNumPartitions() == 8 and spread(many) is many
    shuffled = spark.range(100).groupBy((F.col("id") % 3).alias("k")).count()
    assert spread(shuffled) is shuffled


def test_process_cache():
    process_cache()["a"] = 1
    assert process_cache()["a"] == 1


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://x"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_unstage(spark):
    import os

    df = stage(spark.range(3), "gone")
    assert df.count() == 3 and os.path.isdir(df._staged_at)
    unstage(df)
    assert not os.path.exists(df._staged_at)
