"""Asking again for what failed.

A round asks for what no earlier round has answered, and nothing else.  Each is written
to the shared folder before the next one is planned, so a completion that came back is
never asked for twice, not even if an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.completions import UNREACHABLE, first_good_attempt
from quire.session import materialize

ATTEMPTS = 2
Complete = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Rounds:
    """results: a row per request, its first good attempt or the error of the last one.
    log: a row per round with what it asked and what failed."""

    results: DataFrame
    log: DataFrame


def in_rounds(
    requests: DataFrame, complete: Complete, judge: Complete, value: str, attempts: int = ATTEMPTS
) -> Rounds:
    """Answer requests(request_id, ...) in up to ``attempts`` rounds.

    ``complete`` turns request rows with their ``attempt`` into response rows; ``judge``
    reads these as (request_id, attempt, ``value``, completion_error).  A request without
    a response counts as unreachable.  Rounds end early when nothing failed; only the
    number of failed requests comes to the driver.
    """
    pending, rounds = requests, []
    for attempt in range(1, attempts + 1):
        asked = pending.withColumn("attempt", F.lit(attempt))
        judged = judge(complete(asked)).select("request_id", "attempt", value, "completion_error", F.lit(True).alias("_came"))
        answered = asked.select("request_id", "attempt").join(judged, ["request_id", "attempt"], "left")
        missing = F.when(F.col("_came").isNull(), UNREACHABLE).otherwise(F.col("completion_error"))
        written = materialize(
            answered.withColumn("completion_error", missing).drop("_came"), f"attempt-{attempt}"
        )
        rounds.append(written)
        good = written.where("completion_error is null").select("request_id")
        if not written.where("completion_error is not null").count():
            break
        pending = pending.join(good, "request_id", "left_anti")
    every = reduce(DataFrame.unionByName, rounds)
    log = every.groupBy("attempt").agg(
        F.count("*").alias("asked"), F.count("completion_error").alias("failed")
    )
    return Rounds(first_good_attempt(every, value), log)
