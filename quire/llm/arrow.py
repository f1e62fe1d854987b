"""Arrow batches in and out of Python tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

ROWS_IN = 1000  # rows of an Arrow batch: texts may be long
ROWS_HELD = 100  # of which as Python objects
ROWS_OUT = 4096

# Bytes after mapping: A-Z to a-z, other ASCII that is no letter or digit to a space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM = bytes(
    LOWER[b] if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32
    for b in range(256)
)


def spaced_words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").translate(LOWER).split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all other characters above ASCII."""
    return text.encode("utf-8", "replace").translate(ALNUM).split() if text else []


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ROWS_IN rows, for the session: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_IN)


def map_rows(
    df: DataFrame,
    make: Callable[[Iterator[tuple]], Iterable[tuple]],
    schema: str,
    rows_out: int = ROWS_OUT,
) -> DataFrame:
    """Stream a partition's rows through `make`, column by column, in Arrow batches.

    `make` gets an iterator over row tuples and yields row tuples of `schema`.
    Nothing but the current batch and what `make` itself keeps is in memory; batches
    are set to ROWS_IN rows for the session.
    """
    columns = df.columns
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Read on the worker: an Arrow schema pickles, a session does not.
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS_HELD):
                    part = batch.slice(at, ROWS_HELD)
                    yield from zip(*(part.column(i).to_pylist() for i in range(len(columns))))

        held: list[tuple] = []
        for row in make(rows()):
            held.append(row)
            if len(held) >= rows_out:
                yield to_batch(held, arrow_schema)
                held = []
        if held:
            yield to_batch(held, arrow_schema)

    arrow_schema = to_arrow_schema(struct(schema))
    return df.mapInArrow(run, schema)


def struct(schema: str) -> StructType:
    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    return parsed


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's longs."""
    return values.astype(np.uint64).view(np.int64)
