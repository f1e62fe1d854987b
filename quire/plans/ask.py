"""Suggested questions and grounded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.jsonx import clean_questions
from quire.functions.prompts import ANSWER_TOKENS, QUESTION_TOKENS, answer_prompt, questions_prompt
from quire.functions.split import document_sample
from quire.functions.text import is_blank, trim_ws, unit_length
from quire.operators.completions import (
    NO_QUESTIONS,
    first_good_attempt,
    parse_payloads,
    read_completions,
)
from quire.operators.retrieval import TOP_K, pick_chunks
from quire.operators.skew import HOT_ROWS
from quire.plans.attempts import ATTEMPTS, Complete, in_rounds
from quire.plans.outcome import (
    INTERNAL,
    INVALID,
    MESSAGE_ANSWER_FAILED,
    MESSAGE_NO_DOCUMENT,
    MESSAGE_NO_QUESTION,
    MESSAGE_QUESTIONS_FAILED,
    MESSAGE_SHORT_DOCUMENT,
    UPSTREAM,
    Outcome,
)

MIN_DOCUMENT = 80
QUESTION_COUNT = 7
FAILED = "QA_FAILED"


def is_long_enough(text: Column) -> Column:
    return unit_length(trim_ws(text)) >= MIN_DOCUMENT


def check_documents(documents: DataFrame) -> DataFrame:
    """Outcome of the length check for every document."""
    outcome = (
        Outcome()
        .fail(is_blank(F.col("text")), UPSTREAM, FAILED, MESSAGE_NO_DOCUMENT)
        .fail(~is_long_enough(F.col("text")), UPSTREAM, FAILED, MESSAGE_SHORT_DOCUMENT)
    )
    return documents.withColumns(outcome.columns())


def question_requests(documents: DataFrame, count: int = QUESTION_COUNT) -> DataFrame:
    return documents.where(is_long_enough(F.col("text"))).select(
        F.concat_ws(":", F.col("doc_id"), F.lit("questions")).alias("request_id"),
        "doc_id",
        questions_prompt(document_sample(F.col("text")), count).alias("prompt"),
        F.lit(QUESTION_TOKENS).alias("max_tokens"),
        F.lit(True).alias("json_mode"),
    )


def rejected_questions(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """Outcome rows of the questions that answer_requests leaves out: blank ones and
    those about a document that is unknown, blank or too short.

    Only a flag of each document is joined, not its text.
    """
    known = documents.select(
        "doc_id", is_blank(F.col("text")).alias("_blank"), is_long_enough(F.col("text")).alias("_fit")
    )
    outcome = (
        Outcome()
        .fail(is_blank(F.col("question")), INVALID, "INVALID_INPUT", MESSAGE_NO_QUESTION)
        .fail(F.coalesce("_blank", F.lit(True)), UPSTREAM, FAILED, MESSAGE_NO_DOCUMENT)
        .fail(~F.col("_fit"), UPSTREAM, FAILED, MESSAGE_SHORT_DOCUMENT)
    )
    return (
        questions.select("doc_id", "question_id", "question")
        .join(known, "doc_id", "left")
        .withColumns(outcome.columns())
        .where("not success")
        .drop("_blank", "_fit", "question")
    )


def read_questions(responses: DataFrame, count: int = QUESTION_COUNT) -> DataFrame:
    """Each response's usable questions, or the error that rules it out."""
    parsed = parse_payloads(read_completions(responses.withColumn("json_mode", F.lit(True))))
    return parsed.withColumn("questions", clean_questions(F.col("payload"), count)).withColumn(
        "completion_error",
        F.when(F.col("completion_error").isNotNull(), F.col("completion_error")).when(
            F.size("questions") == 0, NO_QUESTIONS
        ),
    ).drop("payload", "content")


def suggested_questions(responses: DataFrame, count: int = QUESTION_COUNT) -> DataFrame:
    """First attempt that yields a usable question, with outcome columns."""
    return question_outcomes(first_good_attempt(read_questions(responses, count), "questions"))


def questions_in_rounds(
    requests: DataFrame, complete: Complete, count: int = QUESTION_COUNT, attempts: int = ATTEMPTS
) -> tuple[DataFrame, DataFrame]:
    """The same for requests that are asked again while they fail, and the rounds' log."""
    rounds = in_rounds(requests, complete, lambda r: read_questions(r, count), "questions", attempts)
    return question_outcomes(rounds.results), rounds.log


def question_outcomes(best: DataFrame) -> DataFrame:
    outcome = Outcome().fail(
        F.col("completion_error").isNotNull(), UPSTREAM, FAILED, MESSAGE_QUESTIONS_FAILED
    )
    return best.withColumns(outcome.columns())


def answer_requests(
    documents: DataFrame, questions: DataFrame, k: int = TOP_K, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One prompt per question with its top excerpts in rank order."""
    fit = documents.where(is_long_enough(F.col("text")))
    excerpts = F.array_join(
        F.transform(
            "picks",
            lambda e: F.concat(
                F.lit("--- Relevant excerpt "), (e["chunk_index"] + 1).cast("string"),
                F.lit(" ---\n"), e["text"],
            ),
        ),
        "\n\n",
    )
    return pick_chunks(fit, questions, k, hot_rows).select(
        F.concat_ws(":", F.col("doc_id"), F.lit("answer"), F.col("question_id")).alias("request_id"),
        "doc_id",
        "question_id",
        answer_prompt(F.col("question"), excerpts).alias("prompt"),
        F.size("picks").alias("sources_used"),
        F.lit(ANSWER_TOKENS).alias("max_tokens"),
        F.lit(False).alias("json_mode"),
    )


def answers(responses: DataFrame) -> DataFrame:
    """Trimmed prose of each single-attempt response, with outcome columns."""
    read = read_completions(responses.withColumn("json_mode", F.lit(False)))
    outcome = Outcome().fail(
        F.col("completion_error").isNotNull(), INTERNAL, FAILED, MESSAGE_ANSWER_FAILED
    )
    return (
        read.withColumns(outcome.columns())
        .withColumn("answer", F.when(F.col("success"), trim_ws(F.col("content"))))
        .drop("content", "json_mode")
    )
