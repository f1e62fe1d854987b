"""Salting for keys that hold a large share of one side of a join.

A key is hot if it holds more than one part in SHARES of all rows (and more than
HOT_ROWS of them), so there are fewer than SHARES hot keys whatever the size of
the data, and that list can be broadcast.  A hot key gets as many salts as it has
such parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARES = 2000
HOT_ROWS = 50_000
SALT = "_salt"


def hot_keys(
    df: DataFrame, key: str, hot_rows: int = HOT_ROWS, shares: int = SHARES
) -> DataFrame:
    """(key, _salts) of the hot keys: fewer than ``shares``.  Counts combine map-side."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    part = F.greatest(F.lit(hot_rows), F.ceil(df.select(F.count(F.lit(1))).scalar() / shares))
    return counts.where(F.col("_rows") > part).select(
        key, F.ceil(F.col("_rows") / part).cast("int").alias("_salts")
    )


def hot_list(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> list[tuple]:
    """hot_keys on the driver, so that plans without any need no salt at all."""
    return [tuple(r) for r in hot_keys(df, key, hot_rows).collect()]


def salt_rows(df: DataFrame, hot: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Give each row of the big side one of its key's salts."""
    return (
        df.join(F.broadcast(hot), key, "left")
        .withColumn(
            SALT,
            F.pmod(F.xxhash64(F.col(spread_by)), F.coalesce("_salts", F.lit(1))).cast("int"),
        )
        .drop("_salts")
    )


def copy_per_salt(df: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """Repeat each row of the other side once per salt of its key."""
    return (
        df.join(F.broadcast(hot), key, "left")
        .withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
