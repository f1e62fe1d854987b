"""Readability score of a page of text.

Counts are taken with regexes over the whitespace-collapsed text, whose words
are separated by single spaces, so nothing is exploded or shuffled and no word
array is filtered element by element.  Counts of characters are code points;
lengths are UTF-16 units.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import (
    UNIT_MARK,
    collapse_ws,
    count_spaced_words,
    fixed_two,
    let,
    safe_ratio,
    unit_view,
)

# Thresholds.
MIN_CHARACTERS = 3
MIN_WORDS = 1
MIN_PRINTABLE = 0.85
MIN_ALPHANUMERIC = 0.20
MAX_SUSPICIOUS_CHARACTERS = 0.05
SUSPICIOUS_SCORE = 0.55
TECHNICAL_FLOOR = 0.15
TECHNICAL_FULL = 8
LONG_TOKEN = 30

# Words that mark code or SQL.
CODE_WORDS = (
    "class", "interface", "function", "return", "const", "let", "var", "public", "private", "protected",
)
SQL_WORDS = (
    "SELECT", "FROM", "WHERE", "JOIN", "GROUP BY", "ORDER BY", "HAVING", "INSERT", "UPDATE", "DELETE",
)
KEYWORDS = [*CODE_WORDS, *SQL_WORDS]

# Reason texts.
REASON_EMPTY = "No text was extracted"
REASON_FEW_CHARACTERS = "Very little text was extracted"
REASON_FEW_WORDS = "No meaningful words were detected"
REASON_UNPRINTABLE = "Extracted text contains too many non-printable characters"
REASON_ALPHANUMERIC = "Extracted text contains very little alphanumeric content"
REASON_SUSPICIOUS = "Extracted text contains suspicious characters"
REASON_UNREADABLE = "Extracted tokens do not resemble normal readable text"
REASON_SINGLES = "Extracted text contains many single-character tokens"
REASON_ODD_WORDS = "Extracted text contains unusually structured words"
REASON_SHORT_WORDS = "Extracted words are unusually short"
REASON_LONG_TOKENS = "Extracted text contains unusually long tokens"
REASON_REPETITION = "Extracted text contains excessive token repetition"
REASON_VOWELS = "Extracted language has unusually low vowel content"
REASON_SCORE = "Text quality score is low (%s)"

_M = UNIT_MARK
# Words are counted in text with a space put before it: a literal is a cheaper start
# of a pattern than a look-behind, which is tried at every character.
_START, _END = " ", "(?![^ ])"
_TAIL = r"[.,;:!?)]?"


def _joined(unit: str) -> str:
    return rf"{_START}{unit}++(?:['’-]{unit}++)*+{_TAIL}{_END}"


# In the skeleton every run of letters is one a.
_SKELETON_OF = (r"\p{L}++", "a")
_WORD_LIKE = _joined(rf"[a\p{{N}}{_M}]")
_ALPHABETIC = _joined(f"[a{_M}]")
_LEXICAL = f"{_START}[a{_M}]++{_END}"
# Dotted capital I lower-cases to i plus a dot, so it is replaced by i before.
# (A class of ASCII only is a bit set in Java; one more letter makes it a union
# that runs several times slower.)
_DOTTED_I = ("\u0130", "i")
_VOWEL = "aeiouAEIOU"
_CONSONANT = f"[^{_VOWEL} ]"
_ODD_WORD = (
    rf"{_START}(?=(?:{_CONSONANT}{{4}}|(?:{_CONSONANT}{{0,4}}+[{_VOWEL}])*+{_CONSONANT}{{5}}))"
    rf"[\p{{L}}{_M}]{{4,}}+{_END}"
)
_SINGLE = rf"{_START}[^ ]{_END}"
_LONG = rf"{_START}[^ ]{{{LONG_TOKEN + 1},}}+"
_SYMBOLS = r"[{}\[\]();]|=>|::"


def _by_first_letter(words: list[str]) -> str:
    """Alternatives as a regex, those of one first letter in one branch."""
    first = sorted({w[0].lower() for w in words})
    tails = {c: "|".join(w[1:] for w in words if w[0].lower() == c) for c in first}
    return "|".join(f"{c}(?:{tails[c]})" for c in first)


_INITIALS = "".join(sorted({c for w in KEYWORDS for c in (w[0].lower(), w[0].upper())}))
# Java's \b is a Unicode word boundary; the rule wants an ASCII one.
_KEYWORD = (
    rf"(?=[{_INITIALS}])(?<![A-Za-z0-9_])(?i:{_by_first_letter(KEYWORDS)})(?![A-Za-z0-9_])"
)
_CALL = r"\.[A-Za-z0-9_]+\("

METRICS = (
    "character_count",
    "word_count",
    "alphanumeric_ratio",
    "printable_ratio",
    "suspicious_character_ratio",
    "average_word_length",
    "word_like_ratio",
    "single_character_token_ratio",
    "technical_structure_ratio",
    "suspicious_word_ratio",
    "single_character_ratio",
    "long_token_ratio",
    "repeated_token_ratio",
    "vowel_ratio",
    "alphabetic_word_ratio",
)


def _hits(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("bigint")


def repeated_token_count(words: Column) -> Column:
    """Tokens whose lower-cased form occurs more than once.

    In a sorted array the forms equal to their left neighbour, made distinct,
    are the repeated forms; the rest of the distinct forms are singletons.
    """

    def count(ws: Column) -> Column:
        equal = F.filter(ws, lambda w, i: w == F.get(ws, i - 1))
        once = F.size(F.array_distinct(ws)) - F.size(F.array_distinct(equal))
        return (F.size(ws) - once).cast("bigint")

    return let(F.sort_array(words), count)


def with_quality_counts(df: DataFrame, text: str) -> DataFrame:
    """Raw counts; each later ratio is a division of two of them.

    What does not depend on which letters a word has is counted in a skeleton a
    third as long as the text.
    """
    df = df.withColumn("_flat", collapse_ws(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn("_view", unit_view(F.col("_flat")))
    df = df.withColumn("_bones", F.regexp_replace("_view", *_SKELETON_OF))
    df = df.withColumns(
        {f"{c}_spaced": F.concat(F.lit(" "), F.col(c)) for c in ("_view", "_bones")}
    )
    v, bones = F.col("_view"), F.col("_bones")
    spaced_view, spaced_bones = F.col("_view_spaced"), F.col("_bones_spaced")
    other = F.length(F.replace(bones, F.lit("a"), F.lit("")))
    letters = (F.length(v) - other).cast("bigint")
    technical = _hits(bones, _SYMBOLS) + _hits(v, _KEYWORD) + _hits(v, _CALL)
    return df.withColumns(
        {
            "_chars": F.length(v).cast("bigint"),
            "_points": F.length("_flat").cast("bigint"),
            "_words": count_spaced_words(v),
            "_letters": letters,
            "_digits": _hits(bones, r"\p{N}"),
            "_unprintable": _hits(bones, r"[\x00-\x1F\x7F]"),
            "_suspicious": _hits(bones, r"[^\t\n\r -\x{FFFC}\x{FFFE}-\x{10FFFF}]"),
            "_vowels": (F.length(v) - F.length(F.regexp_replace(v, "[aeiouAEIOU]++", ""))).cast("bigint"),
            "_word_like": _hits(spaced_bones, _WORD_LIKE),
            "_alphabetic": _hits(spaced_bones, _ALPHABETIC),
            "_lexical": _hits(spaced_bones, _LEXICAL),
            "_odd": _hits(F.replace(spaced_view, *map(F.lit, _DOTTED_I)), _ODD_WORD),
            "_single": _hits(spaced_view, _SINGLE),
            "_long": _hits(spaced_view, _LONG),
            "_repeated": repeated_token_count(F.split(F.lower("_flat"), " ")),
            "_technical": F.least(technical / F.lit(float(TECHNICAL_FULL)), F.lit(1.0)),
        }
    )


def _score() -> Column:
    """Terms in the defined order: the cut-off is sensitive to the last bit."""
    c = F.col
    lit = F.lit

    def points(cases, default=0.0):
        out = None
        for cond, value in cases:
            out = F.when(cond, lit(value)) if out is None else out.when(cond, lit(value))
        return out.otherwise(lit(default))

    avg = c("average_word_length")
    technical = c("technical_structure_ratio")
    terms = [
        F.least(c("printable_ratio"), lit(1.0)) * lit(0.20),
        F.least(c("alphanumeric_ratio") / lit(0.50), lit(1.0)) * lit(0.15),
        F.least(c("word_like_ratio"), lit(1.0)) * lit(0.10),
        points([((avg >= 2) & (avg <= 20), 0.10), ((avg >= 1) & (avg <= 30), 0.05)]),
        points([(c("word_count") >= 10, 0.10), (c("word_count") >= 3, 0.07), (c("word_count") >= 1, 0.04)]),
        points([(c("character_count") >= 50, 0.05), (c("character_count") >= 10, 0.03)]),
        technical * lit(0.10),
        -points([((c("single_character_token_ratio") > 0.35) & (technical < TECHNICAL_FLOOR), 0.10)]),
        -F.least(c("suspicious_word_ratio") * lit(0.30), lit(0.20)),
        -F.least(c("long_token_ratio") * lit(0.20), lit(0.10)),
        -points([(c("repeated_token_ratio") > 0.60, 0.10)]),
        -points([((c("vowel_ratio") < 0.08) & (c("alphabetic_word_ratio") > 0.50), 0.10)]),
        -F.least(c("suspicious_character_ratio") * lit(2.0), lit(0.30)),
    ]
    total = reduce(lambda a, b: a + b, terms, lit(0.0))
    return F.when(c("character_count") == 0, lit(0.0)).otherwise(
        F.greatest(lit(0.0), F.least(total, lit(1.0)))
    )


def _reasons() -> Column:
    c = F.col
    plain = c("technical_structure_ratio") < TECHNICAL_FLOOR
    rules = [
        (c("character_count") < MIN_CHARACTERS, REASON_FEW_CHARACTERS),
        (c("word_count") < MIN_WORDS, REASON_FEW_WORDS),
        (c("printable_ratio") < MIN_PRINTABLE, REASON_UNPRINTABLE),
        (c("alphanumeric_ratio") < MIN_ALPHANUMERIC, REASON_ALPHANUMERIC),
        (c("suspicious_character_ratio") > MAX_SUSPICIOUS_CHARACTERS, REASON_SUSPICIOUS),
        ((c("word_count") >= 2) & (c("word_like_ratio") < 0.40) & plain, REASON_UNREADABLE),
        ((c("single_character_token_ratio") > 0.35) & plain, REASON_SINGLES),
        ((c("suspicious_word_ratio") > 0.25) & plain, REASON_ODD_WORDS),
        ((c("word_count") >= 3) & (c("average_word_length") < 1.5), REASON_SHORT_WORDS),
        (c("long_token_ratio") > 0.20, REASON_LONG_TOKENS),
        (c("repeated_token_ratio") > 0.60, REASON_REPETITION),
        ((c("vowel_ratio") < 0.08) & (c("alphabetic_word_ratio") > 0.50) & plain, REASON_VOWELS),
    ]
    before, after = REASON_SCORE.split("%s")
    low = F.when(
        c("quality_score") < SUSPICIOUS_SCORE,
        F.concat(F.lit(before), fixed_two(c("quality_score")), F.lit(after)),
    )
    found = F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in rules], low))
    return F.when(c("character_count") == 0, F.array(F.lit(REASON_EMPTY))).otherwise(found)


def with_quality(df: DataFrame, text: str = "text", reasons: bool = True) -> DataFrame:
    """Add every metric, the score, both flags and (optionally) the reasons."""
    keep = df.columns
    c = F.col
    df = with_quality_counts(df, text)
    words, chars = c("_words"), c("_chars")
    repeated = F.when(words < 2, F.lit(0).cast("bigint")).otherwise(c("_repeated"))
    empty = chars == 0
    ratios = {
        "character_count": chars,
        "word_count": words,
        "alphanumeric_ratio": safe_ratio(c("_letters") + c("_digits"), chars),
        "printable_ratio": safe_ratio(c("_points") - c("_unprintable"), chars),
        "suspicious_character_ratio": safe_ratio(c("_suspicious"), chars),
        "average_word_length": safe_ratio(chars - (words - 1), words),
        "word_like_ratio": safe_ratio(c("_word_like"), words),
        "single_character_token_ratio": safe_ratio(c("_single"), words),
        "technical_structure_ratio": F.when(empty, F.lit(0.0)).otherwise(c("_technical")),
        "suspicious_word_ratio": safe_ratio(c("_odd"), c("_lexical")),
        "single_character_ratio": safe_ratio(c("_single"), words),
        "long_token_ratio": safe_ratio(c("_long"), words),
        "repeated_token_ratio": safe_ratio(repeated, words),
        "vowel_ratio": safe_ratio(c("_vowels"), c("_letters")),
        "alphabetic_word_ratio": safe_ratio(c("_alphabetic"), words),
    }
    df = df.withColumns(ratios).withColumn("quality_score", _score())
    is_empty = (c("character_count") < MIN_CHARACTERS) | (c("word_count") < MIN_WORDS)
    df = df.withColumns(
        {
            "is_empty": is_empty,
            "is_suspicious": is_empty | (c("quality_score") < SUSPICIOUS_SCORE),
        }
    )
    out = [*keep, *METRICS, "quality_score", "is_empty", "is_suspicious"]
    if reasons:
        df = df.withColumn("reasons", _reasons())
        out.append("reasons")
    return df.select(*out)
