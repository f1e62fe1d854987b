"""Benchmark decontamination by winnowing.

Texts become words; a window of `window` words is shared if it occurs in both a
document and a benchmark item.  Of the hashes of all runs of `gram` words, each
stretch of window - gram + 1 neighbours keeps its smallest, so every shared window
holds a kept run that both sides kept.  Kept runs travel with the words around
them.  Those of documents and items are joined on their hash, each match is
extended to both sides word by word, and spans of `window` words or more are hits.
Items shorter than a window are matched whole, as runs of their own length.

A bitmap of fixed size, 2 MB, says which hashes the benchmark has at all.  It is
broadcast whatever the benchmark's size; a run that passes it is only a candidate
for the join, so a crowded bitmap costs time and never results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quire.llm.arrow import map_rows, plain_words
from quire.llm.hashing import gram_hashes, word_hashes
from quire.llm.joins import without_keys
from quire.session import materialize

WINDOW = 10
GRAM = 5
BITMAP_BITS = 24
BLOCK_BITS = 15  # a bitmap of Spark's covers 2 ** 15 positions


def kept_runs(grams: np.ndarray, neighbours: int) -> np.ndarray:
    """Positions that are the smallest of some stretch of neighbours, all ties kept."""
    count = len(grams)
    if count <= neighbours:
        return np.flatnonzero(grams == grams.min()) if count else np.empty(0, dtype=np.int64)
    windows = count - neighbours + 1
    least = grams[:windows].copy()
    for i in range(1, neighbours):
        np.minimum(least, grams[i : i + windows], out=least)
    # A run is kept if the largest of the minima over its stretches is the run itself.
    padded = np.zeros(count + neighbours - 1, dtype=np.uint64)
    padded[neighbours - 1 : neighbours - 1 + windows] = least
    best = padded[:count].copy()
    for i in range(1, neighbours):
        np.maximum(best, padded[i : i + count], out=best)
    return np.flatnonzero(best == grams)


def runs_of(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the kept runs of a text of at least a window."""
    grams = gram_hashes(word_hashes(words), gram)
    at = kept_runs(grams, window - gram + 1)
    return at, grams[at]


def around(words: list[bytes], at: int, width: int, reach: int) -> tuple[int, str]:
    """How many words stand before the run in what is sent, and the words sent."""
    begin = max(0, at - reach)
    return at - begin, b" ".join(words[begin : at + width + reach]).decode("utf-8", "replace")


def item_runs(items: DataFrame, window: int, gram: int) -> DataFrame:
    """width, hash, lead, span for the kept runs of items, and each item's id.

    An item with fewer words than a window has one run, the whole of it.
    """

    def make(rows: Iterator[tuple]) -> Iterable[tuple]:
        for item_id, text in rows:
            words = plain_words(text)
            if not words:
                continue
            if len(words) < window:
                value = gram_hashes(word_hashes(words), len(words)).view(np.int64)[0]
                yield item_id, len(words), int(value), 0, b" ".join(words).decode(), True
                continue
            at, values = runs_of(words, window, gram)
            for p, value in zip(at.tolist(), values.view(np.int64).tolist()):
                lead, span = around(words, p, gram, window - gram)
                yield item_id, gram, value, lead, span, False

    source = items.select("item_id", F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    return map_rows(
        source, make,
        f"item_id {kind}, width int, hash long, lead int, span string, whole boolean",
    )


def bitmap(runs: DataFrame) -> np.ndarray:
    """The positions of the items' hashes, 2 ** BITMAP_BITS bits packed in bytes."""
    # Spark's bitmaps count positions from 1.
    position = F.shiftrightunsigned("hash", 64 - BITMAP_BITS) + 1
    blocks = (
        runs.select(position.alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        .collect()  # 512 rows of 4 kB at most
    )
    size = 1 << (BLOCK_BITS - 3)
    out = np.zeros(1 << (BITMAP_BITS - 3), dtype=np.uint8)
    for block, bits in blocks:
        start = (block - 1) * size
        out[start : start + size] |= np.frombuffer(bits, dtype=np.uint8)
    return out


def member(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    position = (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
    return (bits[position >> 3] >> (position & 7).astype(np.uint8)) & 1 == 1


def document_runs(
    docs: DataFrame, bits, short: list[int], window: int, gram: int
) -> DataFrame:
    """row_id, doc_id, n_words and the kept runs that the bitmap has, as an array.

    `short` lists the lengths of items below a window; there are window - 1 at most.
    """

    def make(rows: Iterator[tuple]) -> Iterable[tuple]:
        from pyspark import TaskContext

        context = TaskContext.get()
        row_id = (context.partitionId() if context else 0) << 33
        table = bits.value
        for doc_id, text in rows:
            row_id += 1
            words = plain_words(text)
            found = []
            if words:
                hashes = word_hashes(words)
                if len(words) >= window:
                    grams = gram_hashes(hashes, gram)
                    at = kept_runs(grams, window - gram + 1)
                    at = at[member(table, grams[at])]
                    for p, value in zip(at.tolist(), grams[at].view(np.int64).tolist()):
                        found.append((gram, value, p, *around(words, p, gram, window - gram), False))
                for width in short:
                    grams = gram_hashes(hashes, width)
                    if len(grams):
                        at = np.flatnonzero(member(table, grams))
                        for p, value in zip(at.tolist(), grams[at].view(np.int64).tolist()):
                            found.append((width, value, p, *around(words, p, width, 0), True))
            yield row_id, doc_id, len(words), [
                dict(zip(("width", "hash", "at", "lead", "span", "whole"), f)) for f in found
            ]

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_rows(
        source, make,
        "row_id long, doc_id long, n_words long, runs array<struct<width: int, hash: long, "
        "at: int, lead: int, span: string, whole: boolean>>",
    )


def extend(window: int, gram: int):
    """(before, after): equal words next to the run, as columns over d_* and i_*.

    Spans are split once; what is compared are the words left and right of the run.
    """

    def side(name: str) -> tuple[str, str]:
        words = f"split({name}_span, ' ')"
        left = f"reverse(slice({words}, 1, {name}_lead))"
        right = f"slice({words}, {name}_lead + width + 1, {window})"
        return left, right

    (dl, dr), (il, ir) = side("d"), side("i")

    def same(a: str, b: str) -> str:
        # The place of the first word that differs, or the shorter side's length.
        equal = f"zip_with({a}, {b}, (x, y) -> coalesce(x = y, false))"
        return f"if(array_position({equal}, false) > 0, array_position({equal}, false) - 1, size({equal}))"

    return F.expr(same(dl, il)).cast("int"), F.expr(same(dr, ir)).cast("int")


def matches(docs: DataFrame, items: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(documents, hits, runs): documents with row_id, doc_id, n_words; hits with
    row_id, first, last (word positions, last exclusive) and the item side's run, one
    row per matching run and distinct surrounding; runs with the items of each."""
    spark = docs.sparkSession
    runs = materialize(item_runs(items, window, gram), "item-runs")
    short = sorted(r[0] for r in runs.filter("whole").select("width").distinct().collect())
    bits = spark.sparkContext.broadcast(bitmap(runs))
    found = materialize(document_runs(docs, bits, short, window, gram), "document-runs")
    # Items that repeat a passage give equal spans; documents join each span once.
    spans = runs.select("width", "hash", "lead", "span", "whole").distinct()
    candidates = found.select("row_id", F.explode("runs").alias("r")).select(
        "row_id", "r.width", "r.hash", "r.at", F.col("r.lead").alias("d_lead"),
        F.col("r.span").alias("d_span"), "r.whole",
    )
    before, after = extend(window, gram)
    joined = (
        candidates.join(
            spans.withColumnsRenamed({"lead": "i_lead", "span": "i_span"}),
            ["width", "hash", "whole"],
        )
        # The run itself must agree too: hashes only propose.
        .filter(
            F.expr(
                "slice(split(d_span, ' '), d_lead + 1, width) = "
                "slice(split(i_span, ' '), i_lead + 1, width)"
            )
        )
        .withColumn("before", before)
        .withColumn("after", after)
        .filter(F.col("whole") | (F.col("before") + F.col("width") + F.col("after") >= window))
        .select(
            "row_id",
            (F.col("at") - F.col("before")).alias("first"),
            (F.col("at") + F.col("width") + F.col("after")).alias("last"),
            "width", "hash", "whole", F.col("i_lead").alias("lead"), F.col("i_span").alias("span"),
        )
    )
    return found.select("row_id", "doc_id", "n_words"), joined, runs


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """One row per row of docs(doc_id, text) against items(item_id, text):
    doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a shared window is hit.  Null and empty texts
    have no words.  Repeated documents are answered one by one; repeated item_ids
    count once.  Without items nothing is hit.
    """
    documents, found, runs = matches(docs, items, window, gram)
    found = materialize(found, "benchmark-hits")
    # Positions hit: overlapping spans of a document are merged by a running maximum.
    spans = found.select("row_id", "first", "last").distinct()
    covered = merged_length(spans)
    named = (
        found.select("row_id", "width", "hash", "whole", "lead", "span").distinct()
        .join(
            runs.select("item_id", "width", "hash", "whole", "lead", "span").distinct(),
            ["width", "hash", "whole", "lead", "span"],
        )
        .select("row_id", F.col("item_id").cast("string").alias("item"))
        .groupBy("row_id")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select(
            "row_id", F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        )
    )
    hits = covered.join(named, "row_id")
    none = hashlib.sha256(b"").hexdigest()
    return (
        documents.join(hits, "row_id", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def merged_length(spans: DataFrame) -> DataFrame:
    """row_id, n_hit: the length of the union of [first, last) per row_id."""
    from pyspark.sql import Window

    order = Window.partitionBy("row_id").orderBy("first", "last")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        spans.withColumn("reached", F.coalesce(F.max("last").over(past), F.lit(0)))
        .withColumn("new", F.greatest(F.lit(0), F.col("last") - F.greatest("first", "reached")))
        .groupBy("row_id")
        .agg(F.sum("new").alias("n_hit"))
    )


def clean_documents(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """The rows of docs that share no window with items."""
    found = decontaminate(docs, items, window, gram)
    return without_keys(docs, found.filter("contaminated"), "doc_id")
