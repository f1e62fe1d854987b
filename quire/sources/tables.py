"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.export import export_file_name, markdown, plain_text

RESPONSE_SCHEMA = "request_id string, attempt int, status int, body string"
PAGE_SCHEMA = "doc_id bigint, page_number int, text string"
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
FORMATS = 4  # files a task of an export may have open
WAVES = 4  # partitions of a spread scan for each core


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Give a bare scan several partitions per core.

    A split need not hold a row group, and with few splits a core the last ones are
    waited for; work on text costs far more than to move it once.  A table with more
    splits is returned as it is, so the largest inputs never pay for this.
    """
    wanted = WAVES * scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= wanted:
        return scan
    return scan.repartition(wanted, key)


def scan_uploads(spark: SparkSession, path: str, mime_types: DataFrame | None = None) -> DataFrame:
    """Files under a path; only metadata is read unless content is selected.

    ``mime_types(path, mime_type)`` is the optional sidecar of declared types.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(
            "path",
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            F.col("length").alias("size_bytes"),
            "content",
        )
    )
    if mime_types is None:
        return files.withColumn("mime_type", F.lit(""))
    return files.join(mime_types, "path", "left").withColumn(
        "mime_type", F.coalesce("mime_type", F.lit(""))
    )


def scan_pages(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Page text of a decoder or an OCR job."""
    return spark.read.schema(PAGE_SCHEMA).format(file_format).load(path)


def scan_request_bodies(spark: SparkSession, path: str) -> DataFrame:
    """One JSON request per line, kept as text so that bad ones stay visible."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def write_requests(requests: DataFrame, path: str) -> None:
    requests.select("request_id", "body").write.mode("errorifexists").json(path)


def scan_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSE_SCHEMA).json(path)


def export_table(
    summaries: DataFrame, s: dict[str, Column], meta: dict[str, Column], *keep: str
) -> DataFrame:
    """(format, file_name, content), two rows per summary from one pass."""
    variants = F.array(
        F.struct(
            F.lit("txt").alias("format"),
            export_file_name(s["title"], "txt").alias("file_name"),
            plain_text(s, meta).alias("content"),
        ),
        F.struct(
            F.lit("md").alias("format"),
            export_file_name(s["title"], "md").alias("file_name"),
            markdown(s, meta).alias("content"),
        ),
    )
    return summaries.select(*keep, F.inline(variants))


def write_exports(exports: DataFrame, path: str) -> None:
    """Exports as a table, partitioned by format only.

    Each format has a file open at a time, so a task need not sort its texts by format
    and hold them for that.
    """
    spark = exports.sparkSession
    before = spark.conf.get(OPEN_FILES)
    spark.conf.set(OPEN_FILES, FORMATS)
    try:
        exports.write.mode("errorifexists").partitionBy("format").parquet(path)
    finally:
        spark.conf.set(OPEN_FILES, before)


def write_export_files(exports: DataFrame, path: str) -> None:
    """One UTF-8 text file per export, for a modest number of them.

    With a doc_id column the file's folder is named after it too, so that exports of
    one title stay apart.
    """
    if "doc_id" in exports.columns:
        name = F.concat_ws("-", F.col("doc_id").cast("string"), "file_name")
        exports = exports.withColumn("file_name", name)
    # The sink ends each row with the line break that ends each export.
    body = F.regexp_replace("content", r"\n\z", "").alias("content")
    exports.select("format", "file_name", body).write.mode("errorifexists").partitionBy(
        "format", "file_name"
    ).text(path)
