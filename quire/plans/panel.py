"""Extract once, summarise by length, save to the history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.files import file_type_label
from quire.plans.attempts import ATTEMPTS, Complete
from quire.plans.extract import extract_documents
from quire.plans.runs import Runs, Stage
from quire.plans.summarize import chunk_requests, document_chunks, summarize_documents
from quire.session import materialize


def extract_once(
    uploads: DataFrame, pages: DataFrame, ocr_pages: DataFrame, ocr_images: DataFrame
) -> DataFrame:
    """Extraction as a stored table, for summaries, questions and the history to share."""
    return materialize(extract_documents(uploads, pages, ocr_pages, ocr_images), "extracted")


def summarize_at_lengths(extracted: DataFrame, lengths: DataFrame) -> DataFrame:
    """First-round requests of (doc_id, length) pairs over stored text.

    The text is read from the extraction table; a new length re-runs only this.
    """
    texts = extracted.where("success").select("doc_id", "text")
    asked = lengths.groupBy("doc_id").agg(F.collect_set("length").alias("_lengths"))
    chunks = document_chunks(texts.join(asked, "doc_id"))
    # Each text is cut once, whatever the number of lengths.
    return chunk_requests(chunks.withColumn("length", F.explode("_lengths")))


def panel_run(
    runs: Runs,
    uploads: DataFrame,
    pages: DataFrame,
    ocr_pages: DataFrame,
    ocr_images: DataFrame,
    length: str,
    complete: Complete,
    created_at: str | None = None,
    attempts: int = ATTEMPTS,
) -> Stage:
    """The whole flow in kept stages: extract, summarise at a length, history entries.

    What is there from an earlier run with the same inputs is not run again: after a
    break-off the flow goes on with the first stage that had not finished, and another
    length starts at the summaries.
    """
    sources = [runs.source(t) for t in (uploads, pages, ocr_pages, ocr_images)]
    extracted = runs.stage("extract", extract_documents, *sources)

    def summarize(rows: DataFrame, length: str, attempts: int) -> DataFrame:
        texts = rows.where("success").select("doc_id", "text")
        return summarize_documents(texts.withColumn("length", F.lit(length)), complete, attempts)

    summarized = runs.stage("summarize", summarize, extracted, length=length, attempts=attempts)

    def entries(extracted: DataFrame, summarized: DataFrame, created_at: str | None) -> DataFrame:
        return history_entries(extracted, summarized.where("success"), created_at)

    return runs.stage("entries", entries, extracted, summarized, created_at=created_at)


def history_entries(
    extracted: DataFrame, summarized: DataFrame, created_at: str | None = None
) -> DataFrame:
    """summarized(doc_id, length, summary) -> entries ready for the history.

    The id is a hash of what the entry is about, so a rerun writes the same one.
    """
    now = (
        F.lit(created_at)
        if created_at
        else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    )
    facts = extracted.select("doc_id", "file_name", "word_count")
    return summarized.join(facts, "doc_id").select(
        F.sha2(F.concat_ws("|", F.col("doc_id"), "length", F.to_json("summary")), 256).alias("id"),
        now.alias("created_at"),
        "file_name",
        file_type_label(F.col("file_name")).alias("source_type_label"),
        "length",
        F.col("word_count").alias("source_word_count"),
        "summary",
    )
