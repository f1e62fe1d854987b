"""Filling up to the limit, and samples with many copies of one text."""

import random

from quire.llm import toxicity
from quire.llm.frequent import most_frequent


def test_the_limit_is_filled(spark):
    df = spark.range(0, 3000).selectExpr("id", "id div 10 as n")
    for limit in (0, 5, 100, 1234, 5000):
        rows = [r["n"] for r in most_frequent(df, "n", limit, fill=True).collect()]
        assert sorted(rows, reverse=True) == sorted((i // 10 for i in range(10, 3000)), reverse=True)[:limit]
    same = spark.range(0, 30_000).selectExpr("id", "7L as n")
    got = [r["id"] for r in most_frequent(same, "n", 2000, fill=True).collect()]
    assert len(got) == len(set(got)) == 2000
    assert sorted(got) == sorted(r["id"] for r in most_frequent(same.repartition(5), "n", 2000, fill=True).collect())


def test_many_copies_of_a_long_toxic_text(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(400)]
    copy = " ".join(f"copied{i}" for i in range(2600))
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = rng.choices(words, k=40)
        for _ in range(4 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(["blarg", "snotfish"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs += [(1000 + i, copy) for i in range(300)]
    labels += [(1000 + i, 1) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.learn(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(frame, model).collect()}
    right = sum(got[i] == (i % 4 == 0) for i in range(600))
    assert right >= 0.97 * 600


def test_many_telling_words_of_one_count(spark):
    docs = [(i, " ".join(f"bad{j}" for j in range(2600)) + f" own{i}") for i in range(60)]
    docs += [(100 + i, f"plain text number{i} of the others") for i in range(120)]
    labels = [(i, int(i < 100)) for i, _ in docs]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.learn(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(frame, model).collect()}
    assert all(got[i] == (i < 100) for i in got)
