import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

import brute
from quire.functions.files import format_file_size
from quire.functions.normalize import normalize_extracted_text
from quire.functions.text import (
    WS_CHARS,
    collapse_ws,
    count_words,
    fixed_two,
    from_unit_view,
    trim_ws,
    unit_length,
    unit_view,
)


def test_whitespace_set(column):
    odd = ["﻿ a  b 　", "\u0085a\u0085", " \n\t ", "a  b\t\n c", ""]
    assert column(trim_ws, odd) == [x.strip(WS_CHARS) for x in odd]
    assert column(collapse_ws, odd) == ["a b", "\u0085a\u0085", "", "a b c", ""]
    assert column(count_words, odd) == [2, 1, 0, 3, 0]


def test_lengths_count_utf16_units(column):
    texts = ["x😀y", "", "é", "😀😀", "plain"]
    assert column(unit_length, texts) == [4, 0, 1, 4, 5]
    assert column(lambda c: from_unit_view(unit_view(c)), texts) == texts
    # A slice through the middle of a pair leaves a replacement character.
    assert column(lambda c: from_unit_view(F.substring(unit_view(c), 1, 2)), ["x😀y"]) == ["x�"]
    assert column(lambda c: from_unit_view(F.substring(unit_view(c), 3, 2)), ["x😀y"]) == ["�y"]


def test_two_decimals_round_the_exact_value(spark):
    rng = random.Random(1)
    xs = [0.285, 0.545, 0.125, 0.375, 0.005, 0.0, 1.0, 0.5499999999999999] + [rng.random() for _ in range(500)]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(fixed_two(F.col("x"))).collect()]
    assert got == [str(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP)) for x in xs]


def test_file_sizes(spark):
    cases = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1536: "1.5 KB", 2**20: "1.0 MB", 10 * 2**20: "10.0 MB", 1280: "1.3 KB"}
    df = spark.createDataFrame([(k,) for k in cases], "n bigint")
    assert {r[0]: r[1] for r in df.select("n", format_file_size(F.col("n"))).collect()} == cases


def test_normalize_known(column):
    cases = {
        "   \n\t ": "",
        "manage-\nment of things": "management of things",
        "one line\nthat wraps\nand wraps again.\nNext": "one line that wraps and wraps again.\nNext",
        "# Title\nbody text\n\n\n\nmore": "# Title\nbody text\n\nmore",
        "2.1 Background\nbody": "2.1 Background\nbody",
        "THE ACT, 1882\nfollows\n- item": "THE ACT, 1882\nfollows\n- item",
        "#\nfoo\nbar": "# foo\nbar",
        "1\nABC\nx": "1 ABC\nx",
        "A\nBC\nx": "A BC\nx",
        "abc\n#\nfoo\nbar": "abc # foo bar",
        "1\nfoo\nBAR": "1 foo BAR",
        "x\r\ny\rz": "x y z",
    }
    assert column(normalize_extracted_text, list(cases)) == list(cases.values())
    assert [brute.normalize(x) for x in cases] == list(cases.values())


def test_normalize_equals_line_by_line_fold(column):
    rng = random.Random(7)
    lines = [
        "", "#", "##", "# Head", "1", "12", "1.", "2.1 Intro", "A", "AB", "ABC DEF", "Ab", "word", "end.", "- item", "-",
        "a) x", "(b) y", "3. z", "3a) z", "lower", "foo-", "bar  baz", " lead", "trail \t", " ", "9 8", "X Y Z:",
        "é", "why?", "T" * 101, "7" * 101, "*", "* star", " tail ", "MIX ED", "K" * 98, "K" * 99,
    ]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9))) for _ in range(6000)]
    texts += ["\r\n".join(rng.choice(lines) for _ in range(4)) for _ in range(300)]
    got = column(normalize_extracted_text, texts)
    want = [brute.normalize(t) for t in texts]
    assert [(t, g, w) for t, g, w in zip(texts, got, want) if g != w][:3] == []
