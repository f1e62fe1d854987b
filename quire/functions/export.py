"""Summary exports as text, Markdown and clipboard text."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import let, trim_ws, unit_length

SLUG_LIMIT = 60
RULE = 60
RULE_MIN = 16
SECTIONS = (("Key Points", "key_points"), ("Main Ideas", "main_ideas"), ("Action Items", "action_items"))
BULLET = "• "
MENTIONED = "Mentioned"


def format_export_date(iso: Column) -> Column:
    """e.g. Jan 5, 2024, 03:04 PM in UTC; text that is no date stays as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(iso), "MMM d, yyyy, hh:mm a"), iso)


LAST_LETTERS = 0x20000  # what lies beyond decomposes into ideographs only
ACCENTS = "".join(map(chr, range(0x300, 0x370)))


def _decompositions() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition without accents leaves of letters and digits.

    Characters that become one ASCII letter or digit, and what they become; accents are
    at the end of the first, with nothing to become.  Those that become several are a map
    of their own.  All others separate words, as they do without a table.
    """
    one, several = {}, {}
    for code in range(128, LAST_LETTERS):
        whole = unicodedata.normalize("NFKD", chr(code))
        if whole == chr(code):
            continue
        left = re.sub("[^a-z0-9]", "-", "".join(c for c in whole if c not in ACCENTS))
        if len(left) == 1 and left != "-" or not left:
            one[chr(code)] = left
        elif left.strip("-"):
            several[chr(code)] = left
    kept = {c: t for c, t in one.items() if t}
    gone = "".join(c for c, t in one.items() if not t) + ACCENTS
    return "".join(kept) + gone, "".join(kept.values()), several


PLAIN_FROM, PLAIN_TO, SPELLED = _decompositions()


def without_accents(text: Column) -> Column:
    """Lower-case letters and digits for what decomposes into them; accents go.

    Characters that do not are left, for slugify to drop.
    """
    table = F.map_from_arrays(
        F.array(*map(F.lit, SPELLED)), F.array(*map(F.lit, SPELLED.values()))
    )
    spelled = F.array_join(
        F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), ""
    )
    rare = F.rlike(text, F.lit("[" + "".join(SPELLED) + "]"))
    return F.translate(F.when(rare, spelled).otherwise(text), PLAIN_FROM, PLAIN_TO)


def slugify(title: Column) -> Column:
    lower = F.lower(title)
    # Most titles are ASCII and need no table.
    plain = let(
        lower, lambda t: F.when(F.octet_length(t) > F.length(t), without_accents(t)).otherwise(t)
    )
    dashed = F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))
    slug = F.substring(dashed, 1, SLUG_LIMIT)
    return F.when(slug == "", "summary").otherwise(slug)


def export_file_name(title: Column, extension: str) -> Column:
    return F.concat(slugify(title), F.lit(f".{extension}"))


def meta_lines(s: dict[str, Column], meta: dict[str, Column]) -> Column:
    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

    return F.array_compact(
        F.array(
            F.concat(F.lit("Document Type: "), s["document_type"]),
            line("Source File: ", meta["file_name"]),
            line("Summary Length: ", F.initcap(meta["length"])),
            F.concat(F.lit("Generated: "), format_export_date(meta["generated_at"])),
        )
    )


def _sections(s: dict[str, Column], render) -> Column:
    """Lines of the sections that have items, in order."""
    empty = F.array().cast("array<string>")
    return F.concat(
        *[F.when(F.size(s[name]) > 0, render(title, s[name])).otherwise(empty) for title, name in SECTIONS]
    )


def _mentioned(s: dict[str, Column], heading: list[str], body: Column) -> Column:
    empty = F.array().cast("array<string>")
    lines = F.array(*[F.lit(h) for h in heading], body)
    return F.when(F.size(s["entities"]) > 0, lines).otherwise(empty)


def _bulleted(items: Column) -> Column:
    return F.transform(items, lambda i: F.concat(F.lit(BULLET), i))


def _lines(*parts: Column, last: str = "") -> Column:
    return F.concat(F.array_join(F.concat(*parts), "\n"), F.lit(last))


def clipboard_text(s: dict[str, Column]) -> Column:
    return _lines(
        F.array(
            s["title"],
            F.concat(F.lit("Document Type: "), s["document_type"]),
            F.lit(""),
            F.lit("Summary"),
            s["summary"],
        ),
        _sections(s, lambda t, items: F.concat(F.array(F.lit(""), F.lit(t)), _bulleted(items))),
        _mentioned(s, ["", MENTIONED], F.array_join(s["entities"], ", ")),
    )


def plain_text(s: dict[str, Column], meta: dict[str, Column]) -> Column:
    thin = "-" * RULE
    width = F.least(F.lit(RULE), F.greatest(F.lit(RULE_MIN), unit_length(s["title"]))).cast("int")
    return _lines(
        F.array(s["title"], F.repeat(F.lit("="), width), F.lit("")),
        meta_lines(s, meta),
        F.array(F.lit(""), F.lit("SUMMARY"), F.lit(thin), s["summary"]),
        _sections(
            s,
            lambda t, items: F.concat(
                F.array(F.lit(""), F.lit(t.upper()), F.lit(thin)), _bulleted(items)
            ),
        ),
        _mentioned(s, ["", MENTIONED.upper(), thin], F.array_join(s["entities"], ", ")),
        last="\n",
    )


def markdown(s: dict[str, Column], meta: dict[str, Column]) -> Column:
    paragraphs = F.transform(
        F.split(trim_ws(s["summary"]), r"\n{2,}"),
        lambda b: F.replace(trim_ws(b), F.lit("\n"), F.lit("  \n")),
    )
    return _lines(
        F.array(F.concat(F.lit("# "), s["title"]), F.lit("")),
        F.transform(
            meta_lines(s, meta), lambda m: F.concat(F.lit("- "), F.replace(m, F.lit("*"), F.lit("\\*")))
        ),
        F.array(F.lit(""), F.lit("## Summary"), F.lit(""), F.array_join(paragraphs, "\n\n")),
        _sections(
            s,
            lambda t, items: F.concat(
                F.array(F.lit(""), F.lit(f"## {t}"), F.lit("")),
                F.transform(items, lambda i: F.concat(F.lit("- "), F.replace(i, F.lit("\n"), F.lit("\n  ")))),
            ),
        ),
        _mentioned(
            s,
            ["", f"## {MENTIONED}", ""],
            F.array_join(F.transform(s["entities"], lambda e: F.concat(F.lit("`"), e, F.lit("`"))), " · "),
        ),
        last="\n",
    )


def length_label(length: Column) -> Column:
    return F.initcap(length)


def word_count_label(n: Column) -> Column:
    return F.when(n.isNotNull(), F.concat(F.format_number(n, 0), F.lit(" words")))
