import random

import brute
from pyspark.sql import functions as F

from quire.functions.split import retrieval_chunks, summary_chunks
from quire.functions.tables import register_splitters


def test_table_functions_split_like_the_columns(spark):
    rng = random.Random(3)
    pieces = ["word", "two words. ", "\n\n", "😀", "  ", "é. ", "Why? ", "x" * 300, "'q\\n'"]
    texts = ["", "   ", None, "short", "😀" * 1300, "a. " * 20_000]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 900))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    register_splitters(spark)
    got = spark.sql("SELECT doc_id, c.* FROM {df} d, LATERAL retrieval_chunks(d.text) c", df=df)
    want = df.select("doc_id", F.posexplode(retrieval_chunks(F.col("text"))).alias("chunk_index", "text"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    got = spark.sql("SELECT doc_id, c.* FROM {df} d, LATERAL summary_chunks(d.text) c", df=df)
    want = df.select("doc_id", F.posexplode(summary_chunks(F.col("text"))).alias("chunk_index", "c")).select(
        "doc_id", "chunk_index", "c.*"
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    known = {t: brute.retrieval_pieces(t) for t in texts if t}
    one = spark.sql("SELECT doc_id, c.* FROM {df} d, LATERAL retrieval_chunks(d.text) c", df=df).collect()
    for i, text in enumerate(texts):
        if text:
            assert [r.text for r in sorted(one) if r.doc_id == i] == known[text]
