"""Request bodies to checked columns.

A job that has no key for its model service still answers each request: what is wrong
with the request comes first, the rest has the outcome of a missing configuration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.jsonx import strict_json, string_at
from quire.functions.prompts import known_length
from quire.functions.text import is_blank
from quire.plans.outcome import (
    INTERNAL,
    INVALID,
    MESSAGE_NO_QUESTION,
    MESSAGE_NO_TEXT,
    MESSAGE_NO_TEXT_TO_SUMMARIZE,
    MESSAGE_NOT_CONFIGURED,
    MESSAGE_NOT_JSON,
    Outcome,
)

INVALID_INPUT = "INVALID_INPUT"
NOT_CONFIGURED = "CONFIG_ERROR"


def _fields(bodies: DataFrame, *fields: str) -> DataFrame:
    df = bodies.withColumn("_json", strict_json(F.col("body")))
    return df.withColumns({f: string_at(F.col("_json"), f"$.{f}") for f in fields})


def _checked(df: DataFrame, outcome: Outcome, configured: bool) -> DataFrame:
    outcome.fail(F.lit(not configured), INTERNAL, NOT_CONFIGURED, MESSAGE_NOT_CONFIGURED)
    return df.withColumns(outcome.columns()).drop("_json", "body")


def _outcome(no_text: str) -> Outcome:
    return (
        Outcome()
        .fail(F.col("_json").isNull(), INVALID, INVALID_INPUT, MESSAGE_NOT_JSON)
        .fail(is_blank(F.col("text")), INVALID, INVALID_INPUT, no_text)
    )


def summarize_requests(bodies: DataFrame, configured: bool = True) -> DataFrame:
    """body -> text, length, outcome; an unknown length means medium."""
    df = _fields(bodies, "text", "length")
    df = df.withColumn("length", known_length(F.col("length")))
    return _checked(df, _outcome(MESSAGE_NO_TEXT_TO_SUMMARIZE), configured)


def question_requests(bodies: DataFrame, configured: bool = True) -> DataFrame:
    return _checked(_fields(bodies, "text"), _outcome(MESSAGE_NO_TEXT), configured)


def answer_requests(bodies: DataFrame, configured: bool = True) -> DataFrame:
    outcome = _outcome(MESSAGE_NO_TEXT).fail(
        is_blank(F.col("question")), INVALID, INVALID_INPUT, MESSAGE_NO_QUESTION
    )
    return _checked(_fields(bodies, "text", "question"), outcome, configured)
