"""Batch hand-off to a language model and what comes back.

Requests are rows for an external batch job; responses are rows
(request_id, attempt, status, body).  Nothing here calls a model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.jsonx import extract_json
from quire.functions.prompts import DEFAULT_TOKENS, system_message
from quire.functions.text import is_blank

TEMPERATURE = 0.2
BODY_SCHEMA = (
    "choices array<struct<finish_reason:string,message:struct<content:string>>>"
)

# Stable codes for what can go wrong with one completion.
UNREACHABLE = "UNREACHABLE"
HTTP_ERROR = "HTTP_ERROR"
TRUNCATED = "TRUNCATED"
EMPTY = "EMPTY_COMPLETION"
UNPARSEABLE = "UNPARSEABLE"
BAD_SHAPE = "BAD_SHAPE"
NO_SUMMARY = "NO_SUMMARY"
NO_QUESTIONS = "NO_QUESTIONS"


def request_body(
    model: str,
    prompt: Column | None = None,
    max_tokens: Column | None = None,
    json_mode: Column | None = None,
) -> Column:
    """JSON body of a chat completion; response_format only in JSON mode."""
    prompt = F.col("prompt") if prompt is None else prompt
    max_tokens = F.lit(DEFAULT_TOKENS) if max_tokens is None else max_tokens
    json_mode = F.lit(False) if json_mode is None else json_mode

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            max_tokens.alias("max_tokens"),
            F.lit(TEMPERATURE).alias("temperature"),
            F.struct(F.lit(False).alias("enabled")).alias("reasoning"),
            F.array(
                message("system", system_message(json_mode)), message("user", prompt)
            ).alias("messages"),
            F.when(json_mode, F.struct(F.lit("json_object").alias("type"))).alias("response_format"),
        )
    )


def with_request_body(requests: DataFrame, model: str) -> DataFrame:
    return requests.withColumn(
        "body", request_body(model, F.col("prompt"), F.col("max_tokens"), F.col("json_mode"))
    )


def read_completions(responses: DataFrame) -> DataFrame:
    """Add content and completion_error (NULL when usable) to response rows.

    Needs json_mode beside request_id, attempt, status, body.  Prose that was
    cut off is still usable; JSON that was cut off never is.
    """
    first = F.get(F.from_json("body", BODY_SCHEMA)["choices"], F.lit(0))
    return (
        responses.withColumn("_choice", first)
        .withColumn("content", F.coalesce(F.col("_choice.message.content"), F.lit("")))
        .withColumn(
            "completion_error",
            F.when(F.col("status").isNull(), UNREACHABLE)
            .when(~F.col("status").between(200, 299), HTTP_ERROR)
            .when(F.col("json_mode") & (F.col("_choice.finish_reason") == "length"), TRUNCATED)
            .when(is_blank(F.col("content")), EMPTY),
        )
        .drop("_choice", "body")
    )


def parse_payloads(completions: DataFrame) -> DataFrame:
    """Add payload (variant) of usable completions; error UNPARSEABLE if none."""
    usable = F.when(F.col("completion_error").isNull(), F.col("content"))
    return (
        completions.withColumn("_json", extract_json(usable))
        .withColumn("payload", F.try_parse_json("_json"))
        .withColumn(
            "completion_error",
            F.when(
                F.col("completion_error").isNull() & F.col("payload").isNull(), UNPARSEABLE
            ).otherwise(F.col("completion_error")),
        )
        .drop("_json")
    )


def first_good_attempt(
    attempts: DataFrame, value: str, *keep: str, most: int | None = None
) -> DataFrame:
    """Per request the first attempt without an error, else the last error.

    All attempts count, or those numbered up to ``most``.

    min_by combines map-side, so no request's attempts have to meet in a window.
    """
    ok = F.col("completion_error").isNull()
    if most is not None:
        attempts = attempts.where(F.col("attempt") <= most)
    return (
        attempts.groupBy("request_id", *keep)
        .agg(
            F.min_by(value, F.when(ok, F.col("attempt"))).alias(value),
            F.min(F.when(ok, F.col("attempt"))).alias("attempt"),
            F.max_by("completion_error", F.when(~ok, F.col("attempt"))).alias("_last_error"),
        )
        .withColumn("completion_error", F.when(F.col("attempt").isNull(), F.col("_last_error")))
        .drop("_last_error")
    )


def run_completions(requests: DataFrame, complete: Callable[[str], tuple[int, str]]) -> DataFrame:
    """Run a caller's completion function over request bodies, Arrow batch by batch."""
    import pandas as pd

    def call(batches):
        for pdf in batches:
            results = [complete(body) for body in pdf["body"]]
            yield pd.DataFrame(
                {
                    "request_id": pdf["request_id"],
                    "attempt": 1,
                    "json_mode": pdf["json_mode"],
                    "status": [r[0] for r in results],
                    "body": [r[1] for r in results],
                }
            )

    return requests.select("request_id", "json_mode", "body").mapInPandas(
        call, "request_id string, attempt int, json_mode boolean, status int, body string"
    )
