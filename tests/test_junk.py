"""Long degenerate texts must neither overflow a regex stack nor take quadratic time."""

import time

from quire.functions.jsonx import find_json
from quire.functions.normalize import normalize_extracted_text
from quire.functions.quality import with_quality
from quire.functions.share import parse_share_fragment
from quire.functions.split import document_sample, retrieval_chunks, summary_chunks
from quire.operators.pages import with_counts
from pyspark.sql import functions as F

N = 150_000
JUNK = [
    "a-" * N, "1." * N, "1.1 " * N, " " * (2 * N) + "x", "x" + " " * N + "y" + " \t" * N, "\n" * N, "😀" * N, "a😀" * N,
    "x" * (2 * N), "A " * N, "A" * N + "\n" + "B" * N, "#\n" * N, "1\n" * N, "-\n" * N, ".a" * N, ".a(" * N, "a’" * N, "b\n" * N,
    "&a" * N, "(a) " * N, "\r" * N, "\u0000" * N, "bcdfg" * N, "ab" * N, " " * N + "x",
]


def test_long_junk_passes_through_every_text_function(spark):
    df = spark.createDataFrame(list(enumerate(JUNK)), "i int, text string").repartition(8)
    t = F.col("text")
    started = time.time()
    scored = with_quality(df).select("i", "character_count", "quality_score").collect()
    assert len(scored) == len(JUNK)
    done = with_counts(df).select(
        "i",
        F.length(normalize_extracted_text(t)).alias("normal"),
        F.size(retrieval_chunks(t)).alias("chunks"),
        F.size(summary_chunks(t)).alias("parts"),
        F.length(document_sample(t)).alias("sample"),
        parse_share_fragment(F.concat(F.lit("#"), t)).alias("link"),
        "word_count",
    ).collect()
    assert all(r.link is None for r in done)
    assert time.time() - started < 120


def test_completion_without_an_end():
    started = time.time()
    assert find_json("{" * 5_000) is None and find_json('{"a": ' * 2_000) is None
    assert time.time() - started < 20
