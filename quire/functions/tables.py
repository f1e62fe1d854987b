"""The splitters as SQL table functions, for use with LATERAL.

They are SQL functions, so the optimizer sees through them: a query that calls them
needs no Python worker and is planned as if the expression stood in its place.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quire.functions.split import (
    _RETRIEVAL_CUTS,
    _SUMMARY_CUTS,
    RETRIEVAL_LIMIT,
    RETRIEVAL_MIN_CHARS,
    RETRIEVAL_OVERLAP,
    SUMMARY_LIMIT,
)
from quire.functions.text import ASTRAL, UNIT_MARK, WS_CHARS

HALF = "�"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _trim(x: str) -> str:
    return f"btrim({x}, '{WS_CHARS}')"


def _from_units(x: str) -> str:
    whole = f"regexp_replace(regexp_replace(u, '^{UNIT_MARK}', '{HALF}'), r'{ASTRAL}(?!{UNIT_MARK})', '{HALF}')"
    return _let(x, "u", f"if(contains(u, '{UNIT_MARK}') OR u RLIKE r'{ASTRAL}', replace({whole}, '{UNIT_MARK}', ''), u)")


def _starts(parts: str) -> str:
    return f"aggregate({parts}, array(0), (acc, p) -> concat(acc, array(element_at(acc, -1) + length(p))))"


def _with_parts(limit: int, cuts: str, body: str) -> str:
    """``body`` over the ``parts`` of ``document``, in a view where lengths are units."""
    sliced = _let(
        f"regexp_extract_all(regexp_replace(v, r'{ASTRAL}{UNIT_MARK}', '{UNIT_MARK * 2}'), r'{cuts}', 0)",
        "cut", _let(_starts("cut"), "at", "transform(cut, (p, i) -> substring(v, at[i] + 1, length(p)))"),
    )
    parts = (
        f"CASE WHEN length(v) = 0 THEN cast(array() AS array<string>) WHEN length(v) <= {limit} THEN array(v) "
        f"WHEN contains(v, '{UNIT_MARK}') THEN {sliced} ELSE regexp_extract_all(v, r'{cuts}', 0) END"
    )
    view = f"if(t RLIKE r'{ASTRAL}', regexp_replace(t, r'({ASTRAL})', '$1{UNIT_MARK}'), t)"
    return _let(_trim("document"), "t", _let(view, "v", _let(parts, "parts", body)))


def _retrieval() -> str:
    units = f"if(c RLIKE r'{ASTRAL}', octet_length(encode(c, 'UTF-16BE')) div 2, length(c))"
    piece = f"if(i = 0, p, concat(right(parts[i - 1], {RETRIEVAL_OVERLAP}), p))"
    chunks = f"transform(parts, (p, i) -> {_trim(_from_units(piece))})"
    kept = f"filter({chunks}, (c, i) -> i = 0 OR {units} > {RETRIEVAL_MIN_CHARS})"
    return _with_parts(RETRIEVAL_LIMIT, _RETRIEVAL_CUTS, kept)


def _summary() -> str:
    row = (
        f"named_struct('text', {_trim(_from_units('p'))}, 'start_character', at[i], "
        "'end_character', at[i + 1])"
    )
    rows = _let(_starts("parts"), "at", f"transform(parts, (p, i) -> {row})")
    return f"filter({_with_parts(SUMMARY_LIMIT, _SUMMARY_CUTS, rows)}, c -> c.text <> '')"


def register_splitters(spark: SparkSession) -> None:
    """Make retrieval_chunks(text) and summary_chunks(text) known to a session's SQL."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION retrieval_chunks(document STRING) "
        "RETURNS TABLE (chunk_index INT, text STRING) RETURN "
        f"SELECT i, c FROM (SELECT posexplode({_retrieval()}) AS (i, c))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION summary_chunks(document STRING) "
        "RETURNS TABLE (chunk_index INT, text STRING, start_character INT, end_character INT) RETURN "
        "SELECT i, c.text, c.start_character, c.end_character FROM "
        f"(SELECT posexplode({_summary()}) AS (i, c))"
    )
