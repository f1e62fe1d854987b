import random

import brute
from quire.functions.quality import (
    REASON_EMPTY,
    REASON_LONG_TOKENS,
    REASON_REPETITION,
    REASON_SINGLES,
    REASON_SUSPICIOUS,
    with_quality,
)

# Own texts, one for each way a page can look.
TEXTS = {
    "nothing": "",
    "blank": " \n\t ",
    "tiny": "ok",
    "prose": "Rain fell over the harbour all night, and by morning the lower streets were under water. "
    "Boats that had been tied to the quay drifted between the warehouses until someone found a rope.",
    "table": "Berth 4   |  12.50 m  |  open\nBerth 5   |   9.75 m  |  closed\nBerth 6   |  11.00 m  |  open",
    "program": "def tide(hour):\n    level = base + swing * cos(hour / period)\n    return max(level, 0)\n\n"
    "for hour in range(24):\n    print(hour, tide(hour))",
    "consonants": "brtk wqplm zzdfgh xkcdt mnbvcq tprrs lkjhg hwxyz qwrtp sdfgk vbnmz pltkq ghjkl",
    "letters": " ".join("qwertyuiopasdfghjklzxcvbnm") + " one two",
    "marks": "\ufffd\ufffd\ufffd lost \ufffd\ufffd\ufffd\ufffd signs \ufffd",
    "echo": "wave " * 36,
    "run-on": "n" * 44 + " " + "m" * 61 + " two words",
    "signs": "-- -- == == ++ ++ -- ==",
}


def scored(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(4)
    return sorted(with_quality(df).collect(), key=lambda r: r["i"])


def test_each_look_is_told_by_its_reasons(spark):
    rows = dict(zip(TEXTS, scored(spark, list(TEXTS.values()))))
    for name, text in TEXTS.items():
        want = brute.quality(text)
        assert {k: round(rows[name][k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}, name
    for name in ("nothing", "blank", "tiny"):
        assert rows[name].is_empty and rows[name].is_suspicious
    assert rows["nothing"].reasons == rows["blank"].reasons == [REASON_EMPTY]
    assert rows["prose"].reasons == [] and not rows["prose"].is_suspicious
    assert REASON_SINGLES in rows["letters"].reasons
    assert REASON_SUSPICIOUS in rows["marks"].reasons
    assert REASON_REPETITION in rows["echo"].reasons
    assert REASON_LONG_TOKENS in rows["run-on"].reasons
    assert rows["consonants"].is_suspicious and rows["signs"].is_suspicious
    assert rows["program"].technical_structure_ratio > rows["prose"].technical_structure_ratio
    assert rows["prose"].quality_score > rows["consonants"].quality_score


def test_score_stays_in_range(spark):
    rng = random.Random(8)
    noise = ["".join(chr(rng.choice([rng.randrange(1, 32), rng.randrange(32, 127), rng.randrange(160, 0x2FF)])) for _ in range(n)) for n in (5, 80, 700)]
    samples = [*noise, "7 " * 90, "qz" * 300, "\ufffd" * 50]
    assert all(0.0 <= r.quality_score <= 1.0 for r in scored(spark, samples))


def test_metrics_equal_brute_force(spark):
    rng = random.Random(3)
    tokens = [
        "word", "Don't", "semi-final,", "é", "Straße", "x", "I", "strength", "rhythm", "brrzzz", "42", "3rd", "e.g.", "(a)",
        "a" * 31, "a" * 30, "😀", "𝐀𝐁𝐂", "𝐀𝐁", "İstanbul", "İSTNBL", "naïve’s", "�", "\x01", "\x7f", "--", "foo_bar", "ΣΑΣ", "日本語日本",
        "word", "WORD", "co-op-x", "end)", "end))", "'quoted'", "̇x", "aﬁb", "１２",
    ]
    gaps = [" ", " ", "  ", "\n", "\t", " ", " "]
    texts = ["".join(rng.choice(tokens) + rng.choice(gaps) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    for text, row in zip(texts, scored(spark, texts)):
        want = brute.quality(text)
        got = {k: row[k] for k in want}
        assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}, repr(text)
