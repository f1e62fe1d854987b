"""Map and reduce stages of a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.jsonx import normalized_summary
from quire.functions.prompts import (
    DIRECT_TOKENS,
    FINAL_TOKENS,
    SECTION_TOKENS,
    direct_prompt,
    final_prompt,
    known_length,
    section_prompt,
)
from quire.functions.split import summary_chunks
from quire.functions.text import is_blank
from quire.operators.completions import (
    BAD_SHAPE,
    EMPTY,
    HTTP_ERROR,
    NO_SUMMARY,
    TRUNCATED,
    UNREACHABLE,
    first_good_attempt,
    parse_payloads,
    read_completions,
)
from quire.plans.attempts import ATTEMPTS, Complete, in_rounds
from quire.plans.outcome import (
    INTERNAL,
    MESSAGE_BAD_SHAPE,
    MESSAGE_EMPTY_COMPLETION,
    MESSAGE_HTTP_ERROR,
    MESSAGE_HTTP_STATUS,
    MESSAGE_NO_SUMMARY,
    MESSAGE_NOTHING_TO_SUMMARIZE,
    MESSAGE_SUMMARY_FAILED,
    MESSAGE_TRUNCATED,
    MESSAGE_UNREACHABLE,
    UPSTREAM,
    Outcome,
)
from quire.session import materialize

FAILED = "SUMMARIZATION_FAILED"
_COMPLETION_MESSAGES = {
    UNREACHABLE: MESSAGE_UNREACHABLE,
    HTTP_ERROR: MESSAGE_HTTP_ERROR,
    TRUNCATED: MESSAGE_TRUNCATED,
    EMPTY: MESSAGE_EMPTY_COMPLETION,
}


def document_chunks(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text, length) -> one row per chunk, parts numbered.

    The chunk count is the size of the array, so no window is needed.
    """
    return (
        documents.withColumn("_chunks", summary_chunks(F.col("text")))
        .select(
            *[c for c in documents.columns if c != "text"],
            F.size("_chunks").alias("n_chunks"),
            F.posexplode_outer("_chunks").alias("chunk_index", "_chunk"),
        )
        .where(F.col("chunk_index").isNotNull())
        .select("*", "_chunk.*")
        .drop("_chunk")
    )


def map_requests(documents: DataFrame) -> DataFrame:
    """First round: one direct request, or one request per section."""
    return chunk_requests(document_chunks(documents))


def chunk_requests(chunks: DataFrame) -> DataFrame:
    single = F.col("n_chunks") == 1
    length = known_length(F.col("length"))
    part = F.col("chunk_index") + 1
    return chunks.select(
        F.concat_ws(":", F.col("doc_id"), length, F.when(single, "direct").otherwise("section"), part).alias("request_id"),
        "doc_id",
        length.alias("length"),
        "chunk_index",
        "n_chunks",
        F.when(single, direct_prompt(F.col("text"), length))
        .otherwise(section_prompt(F.col("text"), part, F.col("n_chunks")))
        .alias("prompt"),
        F.when(single, DIRECT_TOKENS).otherwise(SECTION_TOKENS).alias("max_tokens"),
        single.alias("json_mode"),
    )


def empty_documents(documents: DataFrame) -> DataFrame:
    """Documents without text: the outcome rows of the first round."""
    outcome = Outcome().fail(F.lit(True), UPSTREAM, FAILED, MESSAGE_NOTHING_TO_SUMMARIZE)
    return documents.where(is_blank(F.col("text"))).select("doc_id").withColumns(outcome.columns())


def section_notes(sections: DataFrame) -> DataFrame:
    """(doc_id, length, chunk_index, content, completion_error[, status]) -> notes per
    document, with error and HTTP status of its first failed section.

    A document has one section per 28 000 to 30 000 characters of one cell.
    """
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "content")))
    failed = F.when(F.col("completion_error").isNotNull(), F.col("chunk_index"))
    status = F.col("status") if "status" in sections.columns else F.lit(None)
    return (
        sections.withColumn("status", status.cast("int"))
        .groupBy("doc_id", "length")
        .agg(
            ordered.alias("_parts"),
            F.min_by("completion_error", failed).alias("section_error"),
            F.min_by("status", failed).alias("section_status"),
        )
        .withColumn(
            "sections",
            F.array_join(
                F.transform(
                    "_parts",
                    lambda p, i: F.concat(
                        F.lit("--- Section "), (i + 1).cast("string"), F.lit(" ---\n"), p["content"]
                    ),
                ),
                "\n\n",
            ),
        )
        .withColumn("n_sections", F.size("_parts"))
        .drop("_parts")
    )


def final_requests(sections: DataFrame) -> DataFrame:
    """Second round: one request per document whose sections all came back."""
    return section_notes(sections).where(F.col("section_error").isNull()).select(
        F.concat_ws(":", F.col("doc_id"), "length", F.lit("final")).alias("request_id"),
        "doc_id",
        "length",
        "n_sections",
        final_prompt(F.col("sections"), F.col("length")).alias("prompt"),
        F.lit(FINAL_TOKENS).alias("max_tokens"),
        F.lit(True).alias("json_mode"),
    )


def failed_sections(sections: DataFrame) -> DataFrame:
    """Outcome rows of documents with a failed section: 502 with its message."""
    message = F.lit(MESSAGE_SUMMARY_FAILED)
    for code, text in _COMPLETION_MESSAGES.items():
        message = F.when(F.col("section_error") == code, text).otherwise(message)
    told = (F.col("section_error") == HTTP_ERROR) & F.col("section_status").isNotNull()
    message = F.when(told, F.format_string(MESSAGE_HTTP_STATUS, "section_status")).otherwise(message)
    outcome = Outcome().fail(F.lit(True), UPSTREAM, FAILED, message)
    return (
        section_notes(sections)
        .where(F.col("section_error").isNotNull())
        .select("doc_id", "section_error", "section_status")
        .withColumns(outcome.columns())
        .drop("section_status")
    )


def read_summaries(responses: DataFrame) -> DataFrame:
    """Each response's summary struct, or the error that rules it out."""
    parsed = parse_payloads(read_completions(responses.withColumn("json_mode", F.lit(True))))
    kind = F.schema_of_variant(F.col("payload"))
    shaped = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
    return (
        parsed.withColumn("summary", normalized_summary(F.col("payload")))
        .withColumn(
            "completion_error",
            F.when(F.col("completion_error").isNotNull(), F.col("completion_error"))
            .when(~shaped, BAD_SHAPE)
            .when(F.col("summary").isNull(), NO_SUMMARY),
        )
        .drop("payload", "content")
    )


def summaries(responses: DataFrame) -> DataFrame:
    """First good attempt per request, with outcome columns."""
    return summary_outcomes(first_good_attempt(read_summaries(responses), "summary"))


def summaries_in_rounds(
    requests: DataFrame, complete: Complete, attempts: int = ATTEMPTS
) -> tuple[DataFrame, DataFrame]:
    """The same for requests that are asked again while they fail, and the rounds' log."""
    rounds = in_rounds(requests, complete, read_summaries, "summary", attempts)
    return summary_outcomes(rounds.results), rounds.log


def summary_outcomes(best: DataFrame) -> DataFrame:
    error = F.col("completion_error")
    outcome = (
        Outcome()
        .fail(error == NO_SUMMARY, UPSTREAM, FAILED, MESSAGE_NO_SUMMARY)
        .fail(error == BAD_SHAPE, UPSTREAM, FAILED, MESSAGE_BAD_SHAPE)
        .fail(error.isNotNull(), INTERNAL, FAILED, MESSAGE_SUMMARY_FAILED)
    )
    return best.withColumns(outcome.columns())


def summarize_documents(
    documents: DataFrame, complete: Complete, attempts: int = ATTEMPTS
) -> DataFrame:
    """documents(doc_id, text, length) -> doc_id, length, summary, outcome columns.

    Short documents take one request; of long ones each section is asked for once, and
    their notes are merged.  A document whose section failed has that outcome.
    """
    first = materialize(map_requests(documents), "requests")
    facts = ["request_id", "doc_id", "length", "chunk_index"]
    answered = read_completions(complete(first.where("not json_mode").withColumn("attempt", F.lit(1))))
    sections = materialize(
        first.where("not json_mode").select(*facts)
        .join(answered.select("request_id", "content", "completion_error", "status", F.lit(True).alias("_came")), "request_id", "left")
        .withColumn("completion_error", F.when(F.col("_came").isNull(), UNREACHABLE).otherwise(F.col("completion_error")))
        .drop("_came"),
        "sections",
    )
    keep = ["request_id", "doc_id", "length", "prompt", "json_mode"]
    whole = first.where("json_mode").select(keep).unionByName(final_requests(sections).select(keep))
    done, _ = summaries_in_rounds(whole, complete, attempts)
    columns = ["doc_id", "length", "summary", "success", "status", "error_code", "error_message"]
    told = whole.select("request_id", "doc_id", "length").join(done, "request_id").select(columns)
    failed = failed_sections(sections)
    lengths = sections.select("doc_id", "length").distinct()
    nothing = failed.join(lengths, "doc_id").withColumn("summary", F.lit(None).cast(done.schema["summary"].dataType))
    return told.unionByName(nothing.select(columns))
