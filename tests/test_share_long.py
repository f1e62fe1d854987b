from pyspark.sql import functions as F

from quire.functions.share import from_base64_url


def test_payloads_are_checked_in_one_match_and_decoded(spark):
    # A search for the opposite class tries each character anew.
    piece = F.base64(F.substring(F.unhex(F.sha2(F.lit("any"), 512)), 1, 48))  # 64 characters
    df = spark.range(4).select("id", F.repeat(piece, 4_500 + F.col("id").cast("int")).alias("c"))
    decoded = df.select("id", F.length(from_base64_url(F.col("c"))).alias("n"))
    assert "[^A-Za-z0-9+/]" not in decoded._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, decoded.collect())) == [(i, 48 * (4_500 + i)) for i in range(4)]


def test_other_characters_are_refused_wherever_they_are(column):
    bad = ["QUJ*", "*UJD", "QUJDé", "QU\x00D", "QUJD\u2028"]
    good = ["", "QUJD", "QUI", "QUI=", "Q-_D", "QU\nJD"]
    got = column(from_base64_url, bad + good)
    assert got[: len(bad)] == [None] * len(bad)
    assert None not in got[len(bad) :]
