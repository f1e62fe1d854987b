"""JSON of unknown shape: strict parsing and type-checked access."""

from __future__ import annotations

import json
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions.text import WS_CHARS, is_blank, let, trim_ws

# Ship the helper with the UDF: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUMMARY_STRINGS = (("title", "title"), ("documentType", "document_type"), ("summary", "summary"))
SUMMARY_ARRAYS = (
    ("keyPoints", "key_points"),
    ("mainIdeas", "main_ideas"),
    ("entities", "entities"),
    ("actionItems", "action_items"),
)
UNTITLED = "Untitled document"
UNTYPED = "Document"


def strict_json(c: Column) -> Column:
    """Variant of one complete JSON value, else NULL.

    try_parse_json alone ignores text after the first value.  Inside an array
    such text is an error, except one that closes the array itself, and that
    is an error inside an object.
    """

    def parse(x: Column) -> Column:
        items = F.try_variant_get(
            F.try_parse_json(F.concat(F.lit("["), x, F.lit("]"))), "$", "array<variant>"
        )
        whole = F.try_parse_json(F.concat(F.lit('{"v":'), x, F.lit("}"))).isNotNull()
        return F.when(whole & (F.size(items) == 1), F.get(items, F.lit(0)))

    return let(c, parse)


def type_at(v: Column, path: str) -> Column:
    """STRING, VOID (JSON null), OBJECT<...>, ...; NULL where the path is missing."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def string_at(v: Column, path: str) -> Column:
    """The value if it is a JSON string, else NULL."""
    return F.when(type_at(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _items_at(v: Column, path: str) -> Column:
    is_array = F.startswith(type_at(v, path), F.lit("ARRAY"))
    return F.when(is_array, F.try_variant_get(v, path, "array<variant>"))


def _is_string(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))


def _as_string(x: Column) -> Column:
    return F.try_variant_get(x, "$", "string")


def usable_strings_at(v: Column, path: str) -> Column:
    """Non-blank string items, untrimmed; [] for anything but an array."""
    strings = F.transform(F.filter(_items_at(v, path), _is_string), _as_string)
    return F.coalesce(
        F.filter(strings, lambda s: ~is_blank(s)), F.array().cast("array<string>")
    )


def strings_at(v: Column, path: str) -> Column:
    """All items of an array made only of strings, else NULL."""
    items = _items_at(v, path)
    return F.when(F.forall(items, _is_string), F.transform(items, _as_string))


def checked_summary(v: Column, root: str = "$") -> Column:
    """Struct of a value that is a complete summary, else NULL."""
    fields = [string_at(v, f"{root}.{key}").alias(name) for key, name in SUMMARY_STRINGS]
    fields += [strings_at(v, f"{root}.{key}").alias(name) for key, name in SUMMARY_ARRAYS]
    return let(
        F.struct(*fields),
        lambda s: F.when(
            sum((s[n].isNull().cast("int") for _, n in SUMMARY_STRINGS + SUMMARY_ARRAYS), F.lit(0)) == 0,
            s,
        ),
    )


def normalized_summary(v: Column) -> Column:
    """Struct with defaults filled in; NULL without a usable summary text."""

    def text_or(key: str, default: str) -> Column:
        return F.coalesce(F.nullif(trim_ws(string_at(v, f"$.{key}")), F.lit("")), F.lit(default))

    def build(body: Column) -> Column:
        return F.when(
            body != "",
            F.struct(
                text_or("title", UNTITLED).alias("title"),
                text_or("documentType", UNTYPED).alias("document_type"),
                body.alias("summary"),
                *[usable_strings_at(v, f"$.{key}").alias(name) for key, name in SUMMARY_ARRAYS],
            ),
        )

    return let(trim_ws(string_at(v, "$.summary")), build)


def clean_questions(v: Column, count: int) -> Column:
    """Usable questions, trimmed, ending in a question mark, at most ``count``."""
    asked = F.transform(usable_strings_at(v, "$.questions"), trim_ws)
    marked = F.transform(asked, lambda q: F.when(F.endswith(q, F.lit("?")), q).otherwise(F.concat(q, F.lit("?"))))
    return F.slice(marked, 1, count)


# --- Payload of a model completion ----------------------------------------
# Models wrap their JSON in prose, fences and reasoning.  What is plain JSON after
# fences and reasoning are off is parsed by built-ins.  Finding the first balanced
# object that parses in the rest needs a scanner, which no built-in offers, so that
# small helper runs in an Arrow UDF over those completions only.

_REASONING = re.compile(r"<think>.*?</think>", re.IGNORECASE | re.DOTALL)
_FENCE_OPEN = re.compile(r"\A```(?:json)?", re.IGNORECASE)
_FENCE_CLOSE = re.compile(r"```\Z")
_BRACES = re.compile(r'\\.|["{}]', re.DOTALL)


def _reject_constant(name: str):
    raise ValueError(name)


def _is_json(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_reject_constant)
        return True
    except (ValueError, RecursionError):
        return False


def _objects(text: str):
    """(start, end) of the balanced object from each opening brace, in order.

    A scan from a brace takes it as outside of strings.  What it sees from there on
    depends only on whether a global scan has a string open at the brace, so both
    cases are matched in one pass, each with its own stack of open braces.  A brace
    behind a backslash can start an object but counts in no other.
    """
    found: list[tuple[int, int]] = []
    stacks: tuple[list[int], list[int]] = ([], [])
    aside: tuple[list[tuple[int, int]], list[tuple[int, int]]] = ([], [])
    parity = 0
    for mark in _BRACES.finditer(text):
        sign, stack, waiting = mark.group(), stacks[parity], aside[parity]
        if sign == '"':
            parity ^= 1
        elif sign == "{":
            stack.append(mark.start())
        elif sign == "}":
            while waiting and waiting[-1][1] == len(stack):
                found.append((waiting.pop()[0], mark.end()))
            if stack:
                found.append((stack.pop(), mark.end()))
        elif sign == "\\{":
            waiting.append((mark.start() + 1, len(stack)))
    return sorted(found)


def find_json(raw: str | None) -> str | None:
    """The payload in one completion as it stands there, or None.

    Half of a surrogate pair, as a token limit may leave it, becomes U+FFFD when
    the payload's strings are read.
    """
    text = _REASONING.sub("", raw or "").strip(WS_CHARS)
    text = _FENCE_CLOSE.sub("", _FENCE_OPEN.sub("", text)).strip(WS_CHARS)
    if _is_json(text):
        return text
    for start, end in _objects(text):
        if _is_json(text[start:end]):
            return text[start:end]
    return None


@F.pandas_udf(StringType())
def _scan_json(content: pd.Series) -> pd.Series:
    return content.map(find_json)


# A \u escape of half a surrogate pair that its other half does not follow or precede.
_HIGH = r"\\u[dD][89abAB][0-9a-fA-F]{2}"
_LOW = r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
_ESCAPE = r"(?<!\\)((?:\\\\)*+)"


def whole_surrogates(c: Column) -> Column:
    """JSON text with lone surrogate escapes as U+FFFD escapes."""
    high = F.regexp_replace(c, rf"{_ESCAPE}{_HIGH}(?!{_LOW})", r"$1\\ufffd")
    return F.regexp_replace(high, rf"{_ESCAPE}(?<!{_HIGH}){_LOW}", r"$1\\ufffd")


def extract_json(content: Column | str) -> Column:
    """JSON text of the payload in a completion, or NULL."""
    c = F.col(content) if isinstance(content, str) else content
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), "(?is)<think>.*?</think>", "")
    fenced = F.regexp_replace(trim_ws(bare), r"(?i)\A```(?:json)?|```\z", "")

    def pick(text: Column) -> Column:
        plain = strict_json(text).isNotNull()
        return F.when(plain, text).otherwise(_scan_json(F.when(~plain, c)))

    return whole_surrogates(pick(trim_ws(fenced)))
