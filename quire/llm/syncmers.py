"""Document fingerprints from closed syncmers, in built-in functions only.

A text's words (single characters in scripts without spaces) are hashed.  Of the
runs of K words those are anchors whose smallest inner run of S words is their first
or their last: whether a run is an anchor depends on its own words alone, so the
same passage has the same anchors wherever it stands.  The fingerprint is made of
the SKETCH smallest distinct hashes of the anchors; two fingerprints' likeness is
the share of common ones among the smallest of both, an estimate of the share of
common anchors.  A text of fewer than K words has one anchor, the whole of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
S = 2
SKETCH = 64
BLOCK_DOCUMENTS = 1_000
MOST_BLOCKS = 16_384
FIRST = -(1 << 63)

SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
WORDS = f"[{SINGLE}]|[^\\s{SINGLE}]++"


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates `value` once and uses it as `name` in `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def anchors_sql(text: str) -> str:
    """SQL: array of struct(at, hash) of the anchors of a text, in order.

    `at` counts words from 0; hash is an unsigned 32-bit value.
    """
    words = f"transform(regexp_extract_all({text}, r'{WORDS}', 0), w -> xxhash64(w))"
    inner = (
        "if(size(h) < 2, cast(array() as array<bigint>), zip_with("
        "slice(h, 1, size(h) - 1), slice(h, 2, size(h) - 1), (a, b) -> xxhash64(a, b)))"
    )
    # A run of K words holds K - S + 1 inner runs, the first at its own place.
    last = K - S
    middle = ", ".join(f"m[i + {j}]" for j in range(1, last))
    chosen = (
        f"filter(sequence(0, size(h) - {K}), i -> "
        f"least(m[i], m[i + {last}]) <= least({middle}))"
    )
    whole = ", ".join(f"m[i + {j}]" for j in range(last + 1))
    low = "& 4294967295L"
    runs = f"transform({chosen}, i -> named_struct('at', i, 'hash', xxhash64({whole}) {low}))"
    short = f"array(named_struct('at', 0, 'hash', xxhash64(h) {low}))"
    none = "cast(array() as array<struct<at: int, hash: bigint>>)"
    body = (
        f"if(size(h) = 0, {none}, if(size(h) < {K}, {short}, {let(inner, 'm', runs)}))"
    )
    return let(words, "h", body)


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, at, hash: the anchors of docs(doc_id, text), for positional matching."""
    text = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return text.select("doc_id", F.explode(F.expr(anchors_sql("text"))).alias("a")).select(
        "doc_id", "a.at", "a.hash"
    )


def sketch(text: str) -> Column:
    """The SKETCH smallest distinct anchor hashes of a text column, ascending."""
    hashes = f"transform({anchors_sql(text)}, a -> a.hash)"
    return F.expr(f"slice(sort_array(array_distinct({hashes})), 1, {SKETCH})")


def written(sketch_column: str) -> Column:
    """A sketch as text: 8 hexadecimal digits for each hash."""
    return F.expr(f"array_join(transform({sketch_column}, x -> lower(lpad(hex(x), 8, '0'))), '')")


def likeness(a: str, b: str) -> Column:
    """The share of common hashes among the smallest of both; empty ones are equal."""
    union = f"slice(sort_array(array_union({a}, {b})), 1, {SKETCH})"
    common = f"size(array_intersect(array_intersect(u, {a}), {b}))"
    return F.expr(
        f"if(size({a}) = 0 and size({b}) = 0, 1.0D, "
        + let(union, "u", f"cast({common} as double) / size(u)")
        + ")"
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint for each row of docs(doc_id, text); null texts are empty."""
    text = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return text.select("doc_id", sketch("text").alias("s")).select(
        "doc_id", written("s").alias("fingerprint")
    )


def range_blocks(keys: DataFrame, name: str) -> tuple[list[int], list[tuple[int, int]]]:
    """(bounds, greatest): blocks of about BLOCK_DOCUMENTS neighbouring keys.

    A key's block is the number of bounds not above it; greatest has (block, largest
    key) of each block that is not empty, ascending.  Only keys are read, and at most
    MOST_BLOCKS values of each kind come to the driver.
    """
    count = keys.count()
    blocks = max(1, min(MOST_BLOCKS, count // BLOCK_DOCUMENTS))
    bounds: list[int] = []
    if blocks > 1:
        shares = [i / blocks for i in range(1, blocks)]
        found = keys.agg(F.percentile_approx(name, shares, 100 * blocks)).first()[0]
        bounds = sorted(set(found))
    greatest = (
        keys.groupBy(block_of(name, bounds).alias("block")).agg(F.max(name)).collect()
    )
    return bounds, sorted(tuple(r) for r in greatest)


def longs(values: list[int]) -> str:
    # The smallest long has no literal of its own.
    listed = ", ".join(f"{v}L" if v > FIRST else "(-9223372036854775807L - 1L)" for v in values)
    return f"array({listed})" if values else "cast(array() as array<bigint>)"


def block_of(name: str, bounds: list[int], fan: int = 128) -> Column:
    """The number of bounds not above the key, searched in two levels."""
    if len(bounds) <= fan:
        return F.expr(f"size(filter({longs(bounds)}, b -> b <= {name}))")
    coarse = bounds[fan - 1 :: fan]
    at = let(
        f"size(filter({longs(coarse)}, b -> b <= {name}))", "c",
        f"c * {fan} + size(filter(slice({longs(bounds)}, c * {fan} + 1, {fan}), b -> b <= {name}))",
    )
    return F.expr(at)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: each document with the one that
    follows by descending doc_id; after the last comes the first.

    Null ids come last, rows of equal id by text.  Texts are dealt out once, by block
    of neighbouring ids; each block also gets the first document of the next one.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("key", F.coalesce("doc_id", F.lit(FIRST)))
    bounds, greatest = range_blocks(
        docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("key")), "key"
    )
    if not greatest:
        greatest = [(0, FIRST)]
    count = greatest[-1][0] + 1
    largest, guest = [FIRST] * count, [-1] * count
    for (block, key), (above, _) in zip(greatest, greatest[1:] + greatest[:1]):
        largest[block], guest[block] = key, above
    ints = ", ".join(map(str, guest))
    is_guest = f"key = {longs(largest)}[block]"
    placed = (
        rows.withColumn("block", block_of("key", bounds))
        .withColumn("sketch", sketch("text"))
        .withColumn(
            "place",
            F.expr(
                f"if({is_guest}, array(named_struct('block', block, 'guest', false), "
                f"named_struct('block', array({ints})[block], 'guest', true)), "
                "array(named_struct('block', block, 'guest', false)))"
            ),
        )
        .select("doc_id", "key", "text", "sketch", F.explode("place").alias("p"))
        .select("doc_id", "key", "text", "sketch", "p.block", "p.guest")
    )
    order = Window.partitionBy("block").orderBy("guest", F.desc("key"), "text")
    return (
        placed.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_sketch", F.lead("sketch").over(order))
        .filter("not guest")
    )


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next for each row of docs(doc_id, text).

    The edited text has its second half, the last floor(n_chars / 2) code points,
    replaced by as many of the next document's first, or all it has.
    """
    edited = with_next(docs).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        "sketch",
        "next_sketch",
        F.expr(
            "concat(left(text, cast(ceil(char_length(text) / 2) as int)), "
            "left(next_text, char_length(text) div 2))"
        ).alias("edited"),
    )
    return (
        edited.select(
            "doc_id", "n_chars", "sketch", "next_sketch",
            F.sha2("edited", 256).alias("edited_sha256"),
            sketch("edited").alias("edited_sketch"),
        )
        .select(
            "doc_id", "n_chars", "edited_sha256",
            written("sketch").alias("fingerprint"),
            written("edited_sketch").alias("edited_fingerprint"),
            likeness("sketch", "edited_sketch").alias("near_edited"),
            likeness("sketch", "next_sketch").alias("near_next"),
        )
    )
