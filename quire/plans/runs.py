"""Stages that are kept by what went into them.

A stage's folder is named by a fingerprint of its name, its parameters and its inputs.
If the folder holds a finished result it is read, else the stage runs; so a job that
broke off goes on where it stopped, and a changed parameter runs only what depends on it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    rows: DataFrame
    key: str


def content_key(df: DataFrame) -> str:
    """Fingerprint of a table's rows in any order: their number and a sum of hashes.

    One pass that moves nothing; repeated rows count, and so do names and types.
    """
    columns = sorted(df.columns)
    seen = df.agg(
        F.count("*").alias("n"),
        *(F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)),
    ).first()
    types = sorted(df.dtypes)
    return hashlib.sha256(json.dumps([types, *map(str, seen)]).encode()).hexdigest()


class Runs:
    """Stages below one folder; ``ran`` names those that were not found finished."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.ran: list[str] = []

    def source(self, df: DataFrame) -> Stage:
        return Stage(df, content_key(df))

    def stage(self, name: str, build: Callable[..., DataFrame], *inputs: Stage, **params) -> Stage:
        """build(rows of each input, **params), or what it gave before.

        Parameters are part of the name, so they must be plain values.
        """
        facts = [name, params, [i.key for i in inputs]]
        key = hashlib.sha256(json.dumps(facts, sort_keys=True).encode()).hexdigest()
        folder = f"{self.path}/{name}-{key}"
        if not self._finished(folder):
            self.ran.append(name)
            build(*(i.rows for i in inputs), **params).write.mode("overwrite").parquet(f"{folder}/rows")
            # The last thing that is written: what lies there without it is written anew.
            self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{folder}/finished")
        return Stage(self.spark.read.parquet(f"{folder}/rows"), key)

    def _finished(self, folder: str) -> bool:
        try:
            return self.spark.read.parquet(f"{folder}/finished").count() == 1
        except AnalysisException:
            return False
