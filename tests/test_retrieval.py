import random

import pytest
from pyspark.sql import functions as F

import brute
from quire.functions.split import token_runs
from quire.operators import retrieval
from quire.operators.retrieval import build_index, read_index, search_documents, search_index, write_index
from quire.operators.skew import SALT, copy_per_salt, hot_keys, salt_rows

VOCABULARY = [f"term{i}" for i in range(60)] + ["the", "and", "of", "x", "éclair", "Word", "42"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    docs = []
    for i, n in enumerate([0, 1, 30, 300, 900, 2500, 2500, 700]):
        text = "".join(rng.choice(VOCABULARY) + rng.choice([" ", " ", ". ", "\n\n"]) for _ in range(n))
        docs.append((i, text))
    questions = [
        (q, rng.randrange(len(docs)), " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, 6)))) for q in range(120)
    ]
    questions += [(1000, 4, "nothing known"), (1001, 5, "   "), (1002, 99, "term1"), (1003, 0, "term1"), (1004, 6, "term3 term3 term4")]
    return docs, questions


def expected(docs, questions):
    texts = dict(docs)
    out = {}
    for qid, doc, question in questions:
        if question.strip() and doc in texts:
            for rank, (chunk, similarity) in enumerate(brute.search(texts[doc], question), 1):
                out[qid, rank] = (doc, chunk, round(similarity, 9))
    return out


def frames(spark, corpus):
    docs, questions = corpus
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(questions, "question_id bigint, doc_id bigint, question string"),
    )


def found(df):
    return {(r.question_id, r["rank"]): (r.doc_id, r.chunk_index, round(r.similarity, 9)) for r in df.collect()}


def test_search_equals_brute_force(spark, corpus):
    assert found(search_documents(*frames(spark, corpus))) == expected(*corpus)


def test_hot_documents_give_the_same_answers(spark, corpus):
    # Every document with more than three questions is salted.
    assert found(search_documents(*frames(spark, corpus), hot_rows=3)) == expected(*corpus)


def test_stored_index(spark, corpus, tmp_path):
    docs, questions = frames(spark, corpus)
    write_index(build_index(docs), str(tmp_path / "index"))
    index = read_index(spark, str(tmp_path / "index"))
    assert found(search_index(index, questions)) == expected(*corpus)
    assert found(search_index(index, questions, hot_rows=3)) == expected(*corpus)


def test_texts_of_picks(spark, corpus):
    docs = dict(corpus[0])
    for r in search_documents(*frames(spark, corpus)).collect():
        assert r.text == brute.retrieval_pieces(docs[r.doc_id])[r.chunk_index]


def test_salting_spreads_one_key_and_keeps_pairs(spark):
    left = spark.range(10_000).select(F.col("id"), F.when(F.col("id") < 3_400, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(10_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = hot_keys(left, "k", 500)
    assert [tuple(r) for r in hot.collect()] == [(0, 7)]
    salted = salt_rows(left, hot, "k", "id")
    assert salted.where("k = 0").select(SALT).distinct().count() == 7
    joined = salted.join(copy_per_salt(right, hot, "k"), ["k", SALT])
    assert joined.count() == 10_000
    assert joined.where("v <> k * 2").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    return plan.count("Exchange hashpartitioning")


def test_index_takes_one_shuffle(spark, corpus):
    docs, _ = frames(spark, corpus)
    assert plan_of(build_index(docs).postings).count("Exchange ") == 1


def test_questions_move_once_and_postings_with_their_text_only(spark, corpus):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(search_documents(*frames(spark, corpus)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Twice the text and the list of what is asked about: for postings and for the
    # texts of picks, of which the second is reused; and the questions.
    assert exchanges(plan) <= 5
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not any("term" in line or "chunk" in line for line in moved)


@pytest.fixture(scope="module")
def stored(spark, corpus, tmp_path_factory):
    docs, _ = frames(spark, corpus)
    path = str(tmp_path_factory.mktemp("stored") / "index")
    write_index(build_index(docs), path, 16)
    return path


def test_stored_search_reads_asked_buckets_and_moves_no_index(spark, corpus, stored):
    _, questions = frames(spark, corpus)
    found_one = search_index(read_index(spark, stored), questions.where("doc_id = 5"))
    plan = plan_of(found_one)
    assert plan.count("SelectedBucketsCount: 1 out of 16") == 2
    assert plan.count("EqualTo(doc_id,5)") == 2
    # The only exchange is that of the questions; neither table is moved.
    assert plan.count("Exchange") == 1 and plan.count("Bucketed: true") == 2
    assert plan.count("Window [") == 2
    listed = {k: v for k, v in expected(*corpus).items() if v[0] == 5}
    assert found(found_one) == listed
    whole = search_index(read_index(spark, stored), questions, listed=2)
    assert "SelectedBucketsCount: 16 out of 16" in plan_of(whole)
    assert found(whole) == expected(*corpus)


def test_stored_index_is_read_by_another_session(spark, corpus, stored):
    for row in spark.catalog.listTables():
        if row.name.startswith("quire_"):
            spark.sql(f"DROP TABLE {row.name}")
    again = read_index(spark, stored)
    assert found(search_index(again, frames(spark, corpus)[1])) == expected(*corpus)


def test_hits_that_cannot_reach_the_rank_are_left_out(spark, corpus, stored):
    docs, questions = frames(spark, corpus)
    asked = retrieval._asked_terms(questions, ("doc_id", "question_id"))
    terms = read_index(spark, stored).terms
    keys, ask = ("doc_id",), ("doc_id", "question_id")
    hits = F.col("chunk_index").isNotNull()
    every = retrieval._scores(build_index(docs).postings, asked, keys, ask).where(hits)
    for k in (1, 4):
        kept = retrieval._bounded_scores(terms, asked, keys, ask, k).where(hits)
        assert kept.count() < every.count()
        found_k = search_index(read_index(spark, stored), questions, k=k)
        assert found(found_k) == {key: v for key, v in expected(*corpus).items() if key[1] <= k}


def test_runs_count_tokens(column):
    texts = ["b a b", "", "  ", "aa a aa a1 A", "x" * 50 + " x", "one", None, "a.a,a;b"]
    assert column(token_runs, texts) == [
        ["a", "b b"], [], [], ["a a", "a1", "aa aa"], ["x", "x" * 50], ["one"], None, ["a a a", "b"]
    ]
