"""Questions asked about a document and their answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_blank, trim_ws


def asked(questions: DataFrame) -> DataFrame:
    """Trimmed questions; blank ones are not asked at all."""
    return questions.where(~is_blank(F.col("question"))).withColumn("question", trim_ws(F.col("question")))


def attach_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Conversation entries with their answer; pending ones have none, failed ones go.

    Answers carry question_id, answer and success.
    """
    return (
        asked(questions)
        .join(answers.select("question_id", "answer", "success"), "question_id", "left")
        .where(F.coalesce("success", F.lit(True)))
        .drop("success")
    )


def mark_asked(suggested: DataFrame, questions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Suggested questions with a flag: was exactly this text asked before?

    Asked texts are made distinct first (map-side), so a question that many
    users repeat meets each suggestion once.
    """
    seen = asked(questions).select(key, "question").distinct().withColumn("_seen", F.lit(True))
    return suggested.join(seen, [key, "question"], "left").select(
        *suggested.columns, F.coalesce("_seen", F.lit(False)).alias("was_asked")
    )
