import json

import pytest
from pyspark.sql import functions as F

from quire.plans.attempts import in_rounds
from quire.plans.summarize import summaries_in_rounds, summarize_documents

REQUESTS = [(f"r{i}", i, f"prompt {i}") for i in range(12)]


@pytest.fixture
def requests(spark):
    return spark.createDataFrame(REQUESTS, "request_id string, doc_id bigint, prompt string")


def body(content):
    return json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": content}}]})


def model(spark, answers, asked_log):
    """answers: (request_id, attempt) -> (status, content); anything else gets no response."""
    rows = [(r, a, status, body(content)) for (r, a), (status, content) in answers.items()]
    table = spark.createDataFrame(rows, "request_id string, attempt int, status int, body string")

    def complete(asked):
        asked_log.append(sorted(r.request_id for r in asked.select("request_id").collect()))
        return asked.select("request_id", "attempt").join(table, ["request_id", "attempt"])

    return complete


def good(i):
    return (200, json.dumps({"summary": f"about {i}"}))


def test_only_what_failed_is_asked_again(spark, requests):
    answers = {}
    for i in range(12):
        answers[f"r{i}", 1] = good(i) if i % 3 == 0 else (500, "") if i % 3 == 1 else (200, "no json")
        answers[f"r{i}", 2] = good(i) if i % 2 == 0 else (200, '{"title": "x"}')
    del answers["r4", 1]  # never came
    log = []
    done, rounds = summaries_in_rounds(requests, model(spark, answers, log))
    failed = sorted(f"r{i}" for i in range(12) if i % 3)
    assert log == [sorted(r for r, *_ in REQUESTS), failed]
    still = [i for i in range(12) if i % 3 and i % 2]
    assert [tuple(r) for r in rounds.orderBy("attempt").collect()] == [(1, 12, 8), (2, 8, len(still))]
    for r in done.collect():
        i = int(r.request_id[1:])
        if i in still:
            # The error of the last attempt, whatever the first one was.
            assert (r.summary, r.attempt, r.completion_error, r.status) == (None, None, "NO_SUMMARY", 502)
        else:
            assert r.summary.summary == f"about {i}" and r.attempt == (2 if i % 3 else 1) and r.success


def test_no_round_when_all_is_answered(spark, requests):
    log = []
    answers = {(f"r{i}", 1): good(i) for i in range(12)}
    done, rounds = summaries_in_rounds(requests, model(spark, answers, log))
    assert len(log) == 1 and [tuple(r) for r in rounds.collect()] == [(1, 12, 0)]
    assert done.where("success").count() == 12


def test_three_rounds_and_lost_requests(spark, requests):
    log = []
    answers = {(f"r{i}", a): (503, "") for i in range(11) for a in (1, 2)}
    answers |= {(f"r{i}", 3): good(i) for i in range(11)}
    judge_log = in_rounds(
        requests, model(spark, answers, log),
        lambda r: r.withColumn("value", F.get_json_object("body", "$.choices[0].message.content"))
        .withColumn("completion_error", F.when(F.col("status") != 200, "HTTP_ERROR")),
        "value", 3,
    )
    assert [len(asked) for asked in log] == [12, 12, 12]
    last = {r.request_id: (r.attempt, r.completion_error) for r in judge_log.results.collect()}
    assert last.pop("r11") == (None, "UNREACHABLE")
    assert set(last.values()) == {(3, None)}


def test_no_requests(spark, requests):
    done, rounds = summaries_in_rounds(requests.where("false"), model(spark, {("x", 1): good(1)}, []))
    assert done.collect() == [] and rounds.collect() == []


def test_long_documents_are_merged_from_sections(spark):
    texts = [(1, "short text", "short"), (2, "A sentence here. " * 4000, "long"), (3, "B sentence. " * 5000, "short")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, length string")

    def complete(asked):
        prompt = F.col("prompt")
        content = F.when(
            F.col("json_mode"), F.to_json(F.struct(F.length(prompt).cast("string").alias("summary")))
        ).otherwise("notes")
        broken = F.contains("request_id", F.lit("3:short:section:2"))
        return asked.select(
            "request_id", "attempt", "json_mode", F.when(broken, 500).otherwise(200).alias("status"),
            F.to_json(F.struct(F.array(F.struct(
                F.lit("stop").alias("finish_reason"), F.struct(content.alias("content")).alias("message")
            )).alias("choices"))).alias("body"),
        )

    rows = {r.doc_id: r for r in summarize_documents(docs, complete).collect()}
    assert rows[1].success and rows[2].success and rows[2].length == "long"
    assert not rows[3].success and rows[3].status == 502 and rows[3].summary is None
