"""Outcome columns: success, status, error_code, error_message beside the data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# HTTP-like status of each kind of failure.
INVALID = 400
TOO_LARGE = 413
EMPTY = 422
INTERNAL = 500
UPSTREAM = 502

# Messages shown to the user.
MESSAGE_NOT_JSON = "Request body must be JSON."
MESSAGE_NO_TEXT_TO_SUMMARIZE = "No document text was provided to summarize."
MESSAGE_NO_TEXT = "No document text was provided."
MESSAGE_NO_QUESTION = "No question was provided."
MESSAGE_EMPTY_PDF = "No readable text could be extracted from this PDF."
MESSAGE_EMPTY_IMAGE = (
    "No text could be detected in this image. Try a clearer photo or a higher-resolution scan."
)
MESSAGE_BROKEN_PDF = (
    "We couldn't extract text from this PDF. It may be corrupted or use an unsupported format."
)
MESSAGE_BROKEN_IMAGE = (
    "We couldn't run OCR on this image. It may be corrupted or use an unsupported format."
)
MESSAGE_NOTHING_TO_SUMMARIZE = "There is no extracted text to summarize."
MESSAGE_NO_DOCUMENT = "There is no document text to work with."
MESSAGE_SHORT_DOCUMENT = "The extracted text is too short to ask questions about."
MESSAGE_SUMMARY_FAILED = "Something went wrong while generating the summary. Please try again."
MESSAGE_ANSWER_FAILED = "Something went wrong while answering the question. Please try again."
MESSAGE_QUESTIONS_FAILED = "Could not generate suggested questions for this document."
MESSAGE_NO_SUMMARY = "The summarizer did not return any summary text."
MESSAGE_BAD_SHAPE = "The summarizer returned an unexpected response shape."
MESSAGE_TRUNCATED = "The AI response was cut off before it could be completed. Please try again."
MESSAGE_EMPTY_COMPLETION = "The AI service returned an empty response."
MESSAGE_UNREACHABLE = "Could not reach the AI service."
MESSAGE_HTTP_ERROR = "The AI service returned an error. Please try again."
MESSAGE_HTTP_STATUS = "The AI service returned an error (status %s). Please try again."

# Own wording: where a service's own message is not told.
MESSAGE_NOT_CONFIGURED = "The AI service is not configured."


class Outcome:
    """First matching failure wins; no match is a success with status 200."""

    def __init__(self) -> None:
        self.rules: list[tuple[Column, int, str, Column]] = []

    def fail(self, when: Column, status: int, code: str, message: str | Column) -> Outcome:
        text = F.lit(message) if isinstance(message, str) else message
        self.rules.append((F.coalesce(when, F.lit(False)), status, code, text))
        return self

    def _case(self, pick, default: Column) -> Column:
        out = default
        for rule in reversed(self.rules):
            out = F.when(rule[0], pick(rule)).otherwise(out)
        return out

    def columns(self) -> dict[str, Column]:
        return {
            "success": self._case(lambda r: F.lit(False), F.lit(True)),
            "status": self._case(lambda r: F.lit(r[1]), F.lit(200)),
            "error_code": self._case(lambda r: F.lit(r[2]), F.lit(None).cast("string")),
            "error_message": self._case(lambda r: r[3], F.lit(None).cast("string")),
        }
