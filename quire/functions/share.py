"""Links that carry a whole summary in their fragment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.jsonx import SUMMARY_ARRAYS, SUMMARY_STRINGS, checked_summary, strict_json
from quire.functions.text import let

PAYLOAD_KEY = "d"


def to_base64_url(data: Column) -> Column:
    # Also drops the line breaks that chunked base64 would contain.
    text = F.regexp_replace(F.base64(data), "[=\r\n]+", "")
    return F.replace(F.replace(text, F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))


def from_base64_url(payload: Column) -> Column:
    """Binary, or NULL for text that is not base64."""

    def decode(plain: Column) -> Column:
        bits = F.length(plain) % 4
        # One match of the whole: a search for the opposite class is far slower on links.
        valid = (bits != 1) & plain.rlike(r"\A[A-Za-z0-9+/]*+\z")
        padded = F.concat(plain, F.repeat(F.lit("="), (F.lit(4) - bits) % 4))
        return F.when(valid, F.try_to_binary(padded, F.lit("base64")))

    standard = F.replace(F.replace(payload, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    return let(F.regexp_replace(standard, r"[\t\n\f\r ]|={1,2}\z", ""), decode)


def summary_json(s: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[s[name].alias(key) for key, name in SUMMARY_STRINGS + SUMMARY_ARRAYS]))


def share_link(s: dict[str, Column], origin: Column) -> Column:
    payload = to_base64_url(F.encode(summary_json(s), "UTF-8"))
    return F.concat(origin, F.lit(f"/s#{PAYLOAD_KEY}="), payload)


def link_payload(fragment: Column) -> Column:
    """First d parameter of '#...'; NULL when there is none or it is empty."""
    found = F.regexp_extract(
        fragment, rf"\A#(?:(?!{PAYLOAD_KEY}=)[^&]*+&)*+{PAYLOAD_KEY}=([^&]*)", 1
    )
    return let(F.try_url_decode(found), lambda p: F.when(p != "", p))


def parse_share_fragment(fragment: Column) -> Column:
    """Summary struct with the known fields only, or NULL for any bad link."""
    text = F.make_valid_utf8(from_base64_url(link_payload(fragment)).cast("string"))
    return let(strict_json(F.regexp_replace(text, r"\A﻿", "")), checked_summary)
