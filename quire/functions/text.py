"""Column helpers that fix the string semantics every other module relies on.

Lengths and cut points are counted in UTF-16 units, whitespace is the Unicode
set below (no U+0085, with U+FEFF), and word characters are ASCII.  All of it
stays in built-in expressions, so it is code-generated and needs no Python
worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set, once as a regex class body and once as the
# characters themselves (for btrim, which only looks at the two ends).
WS = r"\t\n\x0B\f\r \xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WS_INLINE = WS.replace(r"\n", "")
INLINE_WS = f"[{WS_INLINE}]"
WS_CHARS = (
    "\t\n\x0b\f\r \u00A0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202F\u205F\u3000\uFEFF"
)

# Whitespace beyond ASCII is rare; ASCII classes are bit sets in Java and run
# several times faster than the full class.  ASCII is refuted by one range test.
_RARE_WS = r"(?![\x00-\x9F])[\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
ASCII_INLINE_WS = r"[\t\x0B\f\r ]"
# Only the runs that are not one plain space: most words need no replacement.
_ASCII_TO_COLLAPSE = r" \s++|[\t-\r]\s*+"

# A code point outside the basic plane takes two UTF-16 units.  The view puts
# this noncharacter after each of them, so length(view) counts units.
UNIT_MARK = "\uFDD0"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    Column functions are trees: a name used five times is a subtree evaluated
    five times unless the optimizer spots it, which it does not inside lambdas
    and conditionals.  A one-element transform is a binding the optimizer keeps.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    return F.coalesce(trim_ws(c) == "", F.lit(True))


def has_rare_ws(c: Column) -> Column:
    return (F.octet_length(c) > F.length(c)) & c.rlike(_RARE_WS)


def collapse_ws(c: Column) -> Column:
    """Whitespace runs to one space, ends trimmed."""
    plain = let(c, lambda v: F.when(has_rare_ws(v), F.regexp_replace(v, _RARE_WS, " ")).otherwise(v))
    return F.btrim(F.regexp_replace(plain, _ASCII_TO_COLLAPSE, " "), F.lit(" "))


def has_astral(c: Column) -> Column:
    # An astral code point has four UTF-8 bytes: pure ASCII skips the regex.
    return (F.octet_length(c) >= F.length(c) + 3) & c.rlike(ASTRAL)


def unit_view(c: Column) -> Column:
    """Text whose code-point length equals the UTF-16 length of ``c``."""
    return F.when(
        has_astral(c), F.regexp_replace(c, f"({ASTRAL})", f"$1{UNIT_MARK}")
    ).otherwise(c)


def from_unit_view(c: Column) -> Column:
    """Undo unit_view on a slice; half a pair becomes U+FFFD."""

    def restore(v: Column) -> Column:
        whole = F.regexp_replace(v, f"^{UNIT_MARK}", "\uFFFD")
        whole = F.regexp_replace(whole, f"{ASTRAL}(?!{UNIT_MARK})", "\uFFFD")
        return F.when(
            F.contains(v, F.lit(UNIT_MARK)) | has_astral(v),
            F.regexp_replace(whole, UNIT_MARK, ""),
        ).otherwise(v)

    return let(c, restore)


def unit_length(c: Column) -> Column:
    """UTF-16 length."""
    return F.when(
        has_astral(c), F.octet_length(F.encode(c, "UTF-16BE")) / F.lit(2)
    ).otherwise(F.length(c)).cast("bigint")


def count_spaced_words(c: Column) -> Column:
    """Words of text that is already collapsed: no array is built."""
    spaces = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(spaces + 1).cast("bigint")


def count_words(c: Column) -> Column:
    return let(collapse_ws(c), count_spaced_words)


def safe_ratio(n: Column, d: Column) -> Column:
    """0 for a zero denominator (ANSI division would raise)."""
    return F.when(d == 0, F.lit(0.0)).otherwise(
        n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0))
    )


def fixed_two(x: Column) -> Column:
    """A ratio in [0, 1] with two decimals, halves of the exact binary value up.

    Scaling by 2^61 is exact for a double, so the rounding is done on integers.
    """
    wide = "decimal(20,0)"
    scaled = (x * F.lit(float(2**61))).cast("bigint").cast(wide)
    half_up = scaled * F.lit(200).cast("decimal(3,0)") + F.lit(2**61).cast(wide)
    hundredths = F.call_function("div", half_up, F.lit(2**62).cast(wide))
    return F.format_string("%d.%02d", F.call_function("div", hundredths, F.lit(100)), hundredths % 100)
