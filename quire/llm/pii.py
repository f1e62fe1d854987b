"""Personal data by patterns, checksums and context words, in built-in functions only.

For each kind a regular expression proposes spans from left to right without
overlap.  A match is taken together with the text since the previous one, so its
place is a running sum of lengths in code points.  Validators confirm: Luhn for
cards, mod-97 for account numbers, ranges and digit counts for the rest.  Each span
has a score; a confirming checksum and a context word shortly before raise it.

The four base kinds are reported whenever their validators pass.  The added kinds
(iban, ssn) are reported from a score of LEAST_SCORE.

Patterns start at the first character of a run (or where the last match ended) and
are possessive where that changes nothing, so no text takes quadratic time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT_CHARS = 48
LEAST_SCORE = 0.6
PATTERN_SCORE = 0.4
CHECKSUM_SCORE = 0.4
CONTEXT_SCORE = 0.25


@dataclass(frozen=True)
class Kind:
    """pattern: Java, without capturing groups; cheap: what any match contains."""

    name: str
    pattern: str
    cheap: str
    valid: str  # SQL over `match`
    checksum: bool
    context: str  # Java pattern of words
    base: bool = True


OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
DIGITS = "regexp_replace(match, '[^0-9]', '')"
MOD_97 = (
    "aggregate(split(concat(substring(regexp_replace(match, ' ', ''), 5), "
    "substring(regexp_replace(match, ' ', ''), 1, 4)), ''), 0L, (sum, c) -> "
    "if(c = '', sum, if(c between '0' and '9', (sum * 10 + cast(c as long)) % 97, "
    "(sum * 100 + ascii(c) - 55) % 97))) = 1"
)

KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@", "true", False, r"(?i)\b(?:e-?mail|mail|contact|write to)\b",
    ),
    Kind(
        "ip",
        r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
        ".", f"regexp_like(match, r'^{OCTET}(?:\\.{OCTET}){{3}}$')", False,
        r"(?i)\b(?:ip|host|server|address|client)\b",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        "", f"length({DIGITS}) between 13 and 19 and luhn_check({DIGITS})", True,
        r"(?i)\b(?:card|visa|mastercard|credit|debit|payment)\b",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "+", f"length({DIGITS}) between 9 and 15", False,
        r"(?i)\b(?:tel|phone|call|mobile|fax)\b",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
        "", MOD_97, True, r"(?i)\b(?:iban|account|bank|konto)\b", False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "-", "not regexp_like(match, '^(?:000|666|9..)|-00-|-0000$')", False,
        r"(?i)\b(?:ssn|social security)\b", False,
    ),
)
# A text without these is not searched further.
QUICK = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"(?:[0-9][\x20-]?){12}[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]",
    "iban": r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}


def quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def proposals(number: int, kind: Kind) -> str:
    """SQL: array of struct(kind, at, length, match, before) of one kind.

    length counts the code points since the previous match, the match included.
    """
    # Anchored at the last match, so that what follows the final one is read once.
    both = quoted(rf"\G(?s)(.*?)({kind.pattern})")
    none = (
        "cast(array() as array<struct<kind: int, at: int, length: int, match: string, "
        "before: string>>)"
    )
    quick = f"regexp_like(text, {quoted(QUICK[kind.name])})"
    if kind.cheap:
        quick = f"contains(text, '{kind.cheap}') and {quick}"
    return (
        f"if({quick}, transform(arrays_zip(regexp_extract_all(text, {both}, 1), "
        f"regexp_extract_all(text, {both}, 2)), (m, i) -> named_struct("
        f"'kind', {number}, 'at', i, 'length', char_length(m.`0`) + char_length(m.`1`), "
        f"'match', m.`1`, 'before', right(m.`0`, {CONTEXT_CHARS}))), {none})"
    )


def by_kind(expression) -> Column:
    """A CASE over the kinds; expression gives each kind's SQL."""
    cases = " ".join(f"WHEN {i} THEN {expression(k)}" for i, k in enumerate(KINDS))
    return F.expr(f"CASE kind {cases} END")


def find_spans(docs: DataFrame) -> DataFrame:
    """row_id, doc_id and, for each span found, kind (its number in KINDS), start, end
    (code points, end exclusive), match and score; one row with nulls where none is.

    Null texts are empty.  row_id tells repeated rows apart.  A text's proposals are
    brought together by row_id to sum their lengths, texts themselves never move.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    arrays = [proposals(i, k) for i, k in enumerate(KINDS)]
    found = rows.select(
        "row_id", "doc_id", F.explode_outer(F.expr(f"concat({', '.join(arrays)})")).alias("p")
    ).select("row_id", "doc_id", "p.*")
    order = Window.partitionBy("row_id", "kind").orderBy("at")
    placed = found.withColumn("end", F.sum("length").over(order).cast("long")).withColumn(
        "start", F.col("end") - F.char_length("match")
    )
    near = by_kind(lambda k: f"regexp_like(before, {quoted(k.context)})")
    sure = by_kind(lambda k: str(k.checksum).lower())
    scored = placed.withColumn("valid", by_kind(lambda k: f"({k.valid})")).withColumn(
        "score",
        F.lit(PATTERN_SCORE)
        + F.when(sure, CHECKSUM_SCORE).otherwise(0.0)
        + F.when(near, CONTEXT_SCORE).otherwise(0.0),
    )
    base = by_kind(lambda k: str(k.base).lower())
    taken = F.coalesce(F.col("valid") & (base | (F.col("score") >= LEAST_SCORE)), F.lit(False))
    return scored.select(
        "row_id",
        "doc_id",
        *(F.when(taken, F.col(c)).alias(c) for c in ("kind", "start", "end", "match", "score")),
    )


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256 and spans, both of kind:start:end by kind, then start.

    Texts without spans have zeros, the digest of nothing and an empty string.
    """
    labels = F.expr("element_at(array(" + ", ".join(f"'{k.name}'" for k in KINDS) + "), kind + 1)")
    n_base = sum(k.base for k in KINDS)
    found = find_spans(docs).withColumn(
        "label", F.concat_ws(":", labels, F.col("start"), F.col("end"))
    )
    listed = F.array_sort(
        F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "start", "label")))
    )
    counts = [
        F.count_if((F.col("kind") == i)).alias(f"n_{k.name}")
        for i, k in enumerate(KINDS) if k.base
    ]
    return (
        found.groupBy("row_id", "doc_id")
        .agg(*counts, listed.alias("listed"))
        .select(
            "doc_id",
            *(f"n_{k.name}" for k in KINDS if k.base),
            F.sha2(
                F.array_join(
                    F.expr(f"transform(filter(listed, x -> x.kind < {n_base}), x -> x.label)"), ","
                ),
                256,
            ).alias("base_sha256"),
            F.array_join(F.expr("transform(listed, x -> x.label)"), ",").alias("spans"),
        )
    )
