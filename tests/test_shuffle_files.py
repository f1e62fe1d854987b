import glob
import os
import tempfile
import time

from pyspark.sql import functions as F

from quire.session import FILE_CLEANUP, materialize


def shuffle_files():
    return set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*.data"))


def test_a_materialized_table_leaves_no_shuffle_files(spark):
    assert not os.environ.get("SPARK_LOCAL_DIRS")
    rows = spark.range(20_000).withColumn("key", F.xxhash64("id") % 5_000)
    counted = rows.groupBy("key").count()
    before = shuffle_files()
    counted.collect()
    assert shuffle_files() - before  # without materialize they stay
    before = shuffle_files()
    table = materialize(rows.groupBy("key").agg(F.sum("id")), "sums")
    for _ in range(100):  # files go in the background
        if not shuffle_files() - before:
            break
        time.sleep(0.1)
    assert not shuffle_files() - before
    assert table.count() == counted.count()
    assert spark.conf.get(FILE_CLEANUP, "false") == "false"
