"""Session settings the jobs are designed for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Postings are partitioned by document; joining them on (document, term)
    # then needs no second shuffle.  Hot documents are salted, see skew.py.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # JSON objects with a repeated key keep the last one.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Keyed state of streams with timers; need not fit in memory.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Link payloads must not be broken into 76-character lines.
    "spark.sql.chunkBase64String.enabled": "false",
}

FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "quire", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for tables that cut lineage.

    Only where none is set, and only on a local master, is a scratch folder used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several jobs read, and read it back.

    The table outlives lost executors, unlike a cache, and its readers do not
    repeat the work.  The shuffle files of the write go as soon as it ends: else they
    stay until the driver happens to collect garbage, and a long job fills the disk.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FILE_CLEANUP, before)
    return spark.read.parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for a shuffle whose rows are costly to process.

    A count given in the plan is not coalesced: the work per byte of text is far
    above what the byte-based coalescing assumes.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
