"""The most frequent entries of a table of counts, without ordering it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 16  # classes for each doubling of the count


DEALT = 1024  # parts into which rows of equal count are dealt by a hash


def most_frequent(counts: DataFrame, count: str, limit: int, fill: bool = False) -> DataFrame:
    """The rows of the highest classes of `count` that together are at most `limit`.

    Counts fall into classes of a sixteenth of a doubling; only the sizes of the
    classes, a thousand at most, come to the driver.  An ordered limit would instead
    bring `limit` rows of every partition there.  Whole classes are taken, so fewer
    than `limit` rows may come, also none.

    With `fill` the class that would pass the limit gives its highest counts, and of
    the count that would pass it those rows that are first by a hash of the row, so
    that `limit` rows come if there are as many.
    """
    kind = F.floor(F.log2(count) * STEPS).cast("int")
    # What an earlier level leaves open, the next one decides within one of its parts.
    hashed = F.xxhash64(*counts.columns)
    levels = [kind]
    if fill:
        levels += [F.col(count)]
        levels += [F.pmod(F.shiftright(hashed, 10 * i), F.lit(DEALT)) for i in range(6)]
    taken, within, room = F.lit(False), F.col(count) > 0, limit
    for level in levels:
        sizes = counts.filter(within).groupBy(level.alias("level")).count().collect()
        edge = None
        for size in sorted(sizes, key=lambda r: r["level"], reverse=True):
            if size["count"] > room:
                edge = size["level"]
                break
            room -= size["count"]
        if edge is None:
            return counts.filter(taken | within)
        taken = taken | (within & (level > F.lit(edge)))
        within = within & (level == F.lit(edge))
        if not room:
            break
    return counts.filter(taken)
