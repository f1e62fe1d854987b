"""Cutting text at natural boundaries and tokens (C5).

A cut prefers the last blank line in the look-back window, then the last
sentence end, then the hard limit.  That is a greedy alternation, so the whole
scan is one ``regexp_extract_all`` in the JVM.  Where chunks overlap, the regex
yields only the fresh part of each chunk; the overlap is the tail of the
previous part, which is always longer than the overlap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import (
    ASTRAL,
    UNIT_MARK,
    from_unit_view,
    let,
    trim_ws,
    unit_length,
    unit_view,
)

SUMMARY_LIMIT = 30_000
SUMMARY_LOOK_BACK = 2_000

RETRIEVAL_LIMIT = 1_200
RETRIEVAL_LOOK_BACK = 600
RETRIEVAL_OVERLAP = 200
RETRIEVAL_MIN_CHARS = 40

SAMPLE_LIMIT = 6_000
SAMPLE_GAP = "\n\n[…]\n\n"

# English stop words left out of the index.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "can", "did", "do", "does", "for",
    "from", "had", "has", "have", "how", "i", "if", "in", "into", "is", "it", "its", "may",
    "of", "on", "or", "our", "s", "shall", "should", "so", "such", "t", "than", "that", "the",
    "their", "them", "then", "there", "these", "they", "this", "to", "was", "we", "were",
    "what", "when", "where", "which", "who", "whom", "why", "will", "with", "would", "you",
    "your",
)


def _cut(least: int, most: int) -> str:
    return (
        rf"(?:.{{1,{most}}}\z|.{{{least},{most}}}(?=\n\n)"
        rf"|.{{{least},{most}}}[.?!](?= )|.{{{most}}})"
    )


_SUMMARY_CUTS = "(?s)" + _cut(SUMMARY_LIMIT - SUMMARY_LOOK_BACK, SUMMARY_LIMIT)
_RETRIEVAL_CUTS = (
    r"(?s)\A"
    + _cut(RETRIEVAL_LIMIT - RETRIEVAL_LOOK_BACK, RETRIEVAL_LIMIT)
    + r"|(?!\A)"
    + _cut(
        RETRIEVAL_LIMIT - RETRIEVAL_LOOK_BACK - RETRIEVAL_OVERLAP,
        RETRIEVAL_LIMIT - RETRIEVAL_OVERLAP,
    )
)


def _starts(parts: Column) -> Column:
    """Running offsets of consecutive parts: one more than there are parts."""
    return F.aggregate(
        parts,
        F.array(F.lit(0)),
        lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))),
    )


def _parts(text: Column, limit: int, cuts: str) -> Column:
    def split(v: Column) -> Column:
        # A counted repeat over characters of different widths recurses in Java
        # and would overflow the stack, so a text with two-unit characters is
        # cut in a stand-in without them and sliced at the same places.
        stand_in = F.regexp_replace(v, f"{ASTRAL}{UNIT_MARK}", UNIT_MARK * 2)
        sliced = let(
            F.regexp_extract_all(stand_in, F.lit(cuts), F.lit(0)),
            lambda parts: let(
                _starts(parts),
                lambda at: F.transform(
                    parts, lambda p, i: F.substring(v, F.get(at, i) + F.lit(1), F.length(p))
                ),
            ),
        )
        return (
            F.when(F.length(v) == 0, F.array().cast("array<string>"))
            .when(F.length(v) <= limit, F.array(v))
            .when(F.contains(v, F.lit(UNIT_MARK)), sliced)
            .otherwise(F.regexp_extract_all(v, F.lit(cuts), F.lit(0)))
        )

    return let(let(trim_ws(text), unit_view), split)


def summary_chunks(text: Column) -> Column:
    """array<struct<text, start_character, end_character>>, no overlap."""

    def place(parts: Column) -> Column:
        return let(
            _starts(parts),
            lambda at: F.transform(
                parts,
                lambda p, i: F.struct(
                    trim_ws(from_unit_view(p)).alias("text"),
                    F.get(at, i).alias("start_character"),
                    F.get(at, i + 1).alias("end_character"),
                ),
            ),
        )

    chunks = let(_parts(text, SUMMARY_LIMIT, _SUMMARY_CUTS), place)
    return F.filter(chunks, lambda ch: ch["text"] != "")


def retrieval_chunks(text: Column, most: int | None = None) -> Column:
    """array<string> of overlapping chunks, in index order; the first ``most`` if given."""

    def overlap(parts: Column) -> Column:
        return F.transform(
            parts,
            lambda p, i: trim_ws(
                from_unit_view(
                    F.when(i == 0, p).otherwise(
                        F.concat(F.right(F.get(parts, i - 1), F.lit(RETRIEVAL_OVERLAP)), p)
                    )
                )
            ),
        )

    chunks = let(_parts(text, RETRIEVAL_LIMIT, _RETRIEVAL_CUTS), overlap)
    kept = F.filter(
        chunks, lambda ch, i: (i == 0) | (unit_length(ch) > RETRIEVAL_MIN_CHARS)
    )
    return kept if most is None else F.slice(kept, 1, most)


def document_sample(text: Column, limit: int = SAMPLE_LIMIT) -> Column:
    """Head, middle and tail of a long document; short ones whole."""
    quarter = limit // 4

    def sample(view: Column) -> Column:
        n = F.length(view)
        middle = F.floor(n / 2).cast("int") - F.lit(quarter) + F.lit(1)
        return F.when(n <= limit, from_unit_view(view)).otherwise(
            F.concat(
                from_unit_view(F.substring(view, 1, limit // 2)),
                F.lit(SAMPLE_GAP),
                from_unit_view(F.substring(view, middle, F.lit(quarter))),
                F.lit(SAMPLE_GAP),
                from_unit_view(F.right(view, F.lit(quarter))),
            )
        )

    return let(let(trim_ws(text), unit_view), sample)


def raw_tokens(text: Column) -> Column:
    """Lower-case ASCII alphanumeric runs; drop non-terms with is_term()."""
    return F.split(F.lower(text), "[^a-z0-9]+")


def token_runs(text: Column) -> Column:
    """array<string>: each distinct token once per occurrence, "a a a", in sorted order.

    Counting tokens is then a matter of lengths, see run_term() and run_count(), and
    takes no aggregation.
    """
    joined = F.array_join(F.sort_array(raw_tokens(text)), " ")
    return F.regexp_extract_all(joined, F.lit(r"([^ ]+)(?: \1(?![^ ]))*+"), F.lit(0))


def run_term(run: Column) -> Column:
    return F.substring_index(run, " ", 1)


def run_count(run: Column) -> Column:
    return ((F.length(run) + 1) / (F.length(run_term(run)) + 1)).cast("bigint")


def is_term(token: Column) -> Column:
    return (F.length(token) > 1) & ~token.isin(*STOP_WORDS)
