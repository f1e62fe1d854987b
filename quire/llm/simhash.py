"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits.  For links at `distance` or fewer differing bits it is
cut into distance // 2 + 1 segments, so that at least one segment differs by one
bit at most.  Each segment is indexed as it is and, for each bit that it has set,
with that bit wiped: two segments that differ in one bit meet where the one with
the bit set is wiped, and equal segments meet as they are.  Candidates are found
by an equality join on (segment, value) and verified on the whole fingerprints.

Only distinct fingerprints are joined, so exact copies are one row, and a pair is
emitted once, from the first segment in which it qualifies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quire.llm.arrow import map_rows, spaced_words
from quire.llm.components import components
from quire.llm.joins import without_keys
from quire.session import materialize

BITS = 64
SHINGLE_WORDS = 3
DISTANCE = 2
SEED = 42
BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of the word shingles, repeats included; no words: 0."""
    from xxhash import xxh64_intdigest

    words = spaced_words(text)
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    shingles = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, shingles, BLOCK):
        pairs = zip(starts[at : at + BLOCK].tolist(), last[at : at + BLOCK].tolist())
        hashes = [xxh64_intdigest(line[a:b], seed) for a, b in pairs]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > shingles).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (long) for each row of docs(doc_id, text)."""

    def make(rows: Iterator[tuple]) -> Iterable[tuple]:
        for doc_id, text in rows:
            yield doc_id, fingerprint(text, width, seed)

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_rows(source, make, "doc_id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, bits) of each segment."""
    count = distance // 2 + 1
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def segment_of(fp, shift: int, bits: int):
    """An unsigned part of a fingerprint as a long."""
    moved = F.shiftrightunsigned(fp, shift)
    return moved if bits == BITS else moved.bitwiseAND(F.lit((1 << bits) - 1))


def close_pairs(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) at `distance` or fewer bits."""
    cuts = segments(distance)
    fp = F.col("fp")
    plain = [
        F.struct(F.lit(i).alias("segment"), segment_of(fp, *cut).alias("value"))
        for i, cut in enumerate(cuts)
    ]
    wiped = []
    for i, (shift, bits) in enumerate(cuts):
        value = segment_of(fp, shift, bits)
        for bit in range(bits):
            mask = 1 << bit
            mask = mask - (1 << 64) if mask >= 1 << 63 else mask
            wiped.append(
                F.when(
                    value.bitwiseAND(F.lit(mask)) != 0,
                    F.struct(
                        F.lit(i).alias("segment"),
                        value.bitwiseXOR(F.lit(mask)).alias("value"),
                        F.lit(True).alias("wiped"),
                    ),
                )
            )
    as_is = [
        F.struct(p.getField("segment").alias("segment"), p.getField("value").alias("value"),
                 F.lit(False).alias("wiped"))
        for p in plain
    ]
    index = distinct.select(fp.alias("b"), F.explode(F.array(*plain)).alias("k")).select(
        "b", "k.segment", "k.value"
    )
    probe = (
        distinct.select(
            fp.alias("a"), F.explode(F.array_compact(F.array(*as_is, *wiped))).alias("k")
        )
        .select("a", "k.segment", "k.value", "k.wiped")
    )
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # The segments before this one differ by more than a bit each.
    first = F.lit(True)
    for i, (shift, bits) in enumerate(cuts[:-1]):
        first = first & (
            (F.col("probe.segment") <= i) | (F.bit_count(segment_of(differ, shift, bits)) > 1)
        )
    return (
        probe.alias("probe")
        .join(
            index.alias("index"),
            (F.col("probe.segment") == F.col("index.segment"))
            & (F.col("probe.value") == F.col("index.value"))
            & (F.bit_count(differ) <= distance)
            & (F.col("wiped") | (F.col("a") < F.col("b")))
            & first,
        )
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )


def near_duplicates(
    docs: DataFrame,
    width: int = SHINGLE_WORDS,
    distance: int = DISTANCE,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, fp, component_id for each row of docs(doc_id, text).

    component_id is the smallest doc_id that links lead to, the row's own included.
    Null and empty texts have fingerprint 0 and link like any other.  Rows that
    repeat are kept; a null doc_id takes the smallest of its component, if any.
    """
    prints = materialize(fingerprints(docs, width, seed), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = close_pairs(classes.select("fp"), distance)
    roots = components(links)
    named = (
        classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp", "left").select("doc_id", "fp", "component_id")


def deduplicate(
    docs: DataFrame, width: int = SHINGLE_WORDS, distance: int = DISTANCE
) -> DataFrame:
    """One row of docs per component: that of its smallest doc_id.

    Rows that repeat a doc_id count as copies, so one of them stays.  Rows with a
    null doc_id all stay, as nothing names them.
    """
    groups = materialize(near_duplicates(docs, width, distance), "near-duplicates")
    kept = without_keys(docs, groups.filter("doc_id <> component_id"), "doc_id")
    again = groups.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1")
    if again.isEmpty():
        return kept
    return (
        kept.filter("doc_id is not null")
        .dropDuplicates(["doc_id"])
        .unionByName(kept.filter("doc_id is null"))
    )
