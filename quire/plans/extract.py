"""Uploads to document text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.files import validate_uploads
from quire.operators.pages import combine_pages, image_documents
from quire.plans.outcome import (
    EMPTY,
    INTERNAL,
    MESSAGE_BROKEN_IMAGE,
    MESSAGE_BROKEN_PDF,
    MESSAGE_EMPTY_IMAGE,
    MESSAGE_EMPTY_PDF,
    Outcome,
)


def extract_documents(
    uploads: DataFrame, pages: DataFrame, ocr_pages: DataFrame, ocr_images: DataFrame
) -> DataFrame:
    """Every upload with its text or its reason for having none.

    Rejected uploads keep their row; an accepted one that no decoder produced
    anything for is a failed extraction.
    """
    checked = validate_uploads(uploads)
    # Metadata alone tells what is accepted; nothing else is scored or moved.
    accepted = checked.where("error is null").select("doc_id").distinct()
    pages, ocr_pages, ocr_images = (
        t.join(accepted, "doc_id", "left_semi") for t in (pages, ocr_pages, ocr_images)
    )
    pdf = combine_pages(pages, ocr_pages).withColumn("source_type", F.lit("pdf"))
    images = image_documents(ocr_images).withColumn("source_type", F.lit("image"))
    text = pdf.unionByName(images)
    joined = checked.withColumnsRenamed(
        {"error": "_error", "error_code": "_code", "status": "_status"}
    ).join(text, ["doc_id", "source_type"], "left")
    is_pdf = F.col("source_type") == "pdf"
    outcome = (
        Outcome()
        .fail(F.col("text").isNull() & is_pdf, INTERNAL, "EXTRACTION_FAILED", MESSAGE_BROKEN_PDF)
        .fail(F.col("text").isNull(), INTERNAL, "EXTRACTION_FAILED", MESSAGE_BROKEN_IMAGE)
        .fail((F.col("text") == "") & is_pdf, EMPTY, "EMPTY_EXTRACTION", MESSAGE_EMPTY_PDF)
        .fail(F.col("text") == "", EMPTY, "EMPTY_EXTRACTION", MESSAGE_EMPTY_IMAGE)
        .columns()
    )
    bad = F.col("_error").isNotNull()
    return joined.withColumns(
        {
            "success": ~bad & outcome["success"],
            "status": F.when(bad, F.col("_status")).otherwise(outcome["status"]),
            "error_code": F.when(bad, F.col("_code")).otherwise(outcome["error_code"]),
            "error_message": F.when(bad, F.col("_error")).otherwise(outcome["error_message"]),
        }
    ).drop("_error", "_code", "_status")
