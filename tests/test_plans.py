import json

import pytest
from pyspark.sql import functions as F

from quire.operators import pages
from quire.operators.completions import run_completions, with_request_body
from quire.operators.retrieval import search_index, stored_index
from quire.plans import ask, extract, panel, requests, summarize
from quire.session import shared_dir
from quire.sources.tables import export_table, scan_request_bodies, scan_responses, scan_uploads, write_exports, write_export_files, write_requests
from quire.workload.views import meta_columns, summary_columns

GOOD = {"title": "T", "documentType": "Report", "summary": "S", "keyPoints": ["k"], "mainIdeas": ["m"], "entities": [], "actionItems": []}
LONG_TEXT = "The contract covers delivery, payment and liability of both parties in detail. " * 3


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def body(content, finish="stop"):
    return json.dumps({"choices": [{"finish_reason": finish, "message": {"content": content}}]})


def responses(spark, rows):
    return spark.createDataFrame(rows, "request_id string, attempt int, status int, body string")


def test_requests_are_checked(spark):
    bodies = ["not json", "{}", '{"text":"   "}', '{"text":42}', '{"text":"x","length":"short"}', '{"text":"x","length":"gigantic"}', "null", '{"text":"x","question":7}', '{"text":"x","question":"q"}']
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    s = by_id(requests.summarize_requests(df), "i")
    assert [s[i].success for i in range(9)] == [False, False, False, False, True, True, False, True, True]
    assert s[0].error_message == "Request body must be JSON." and s[6].error_message.startswith("No document text")
    assert (s[4].length, s[5].length, s[1].status, s[1].error_code) == ("short", "medium", 400, "INVALID_INPUT")
    a = by_id(requests.answer_requests(df), "i")
    assert [a[i].success for i in range(9)] == [False] * 8 + [True]
    assert a[7].error_message == "No question was provided."
    assert [r.success for r in requests.question_requests(df).orderBy("i").collect()] == [s[i].success for i in range(9)]


def test_extraction_outcomes(spark):
    uploads = spark.createDataFrame(
        [(1, "a.pdf", "application/pdf", 5), (2, "b.png", "image/png", 5), (3, "c.pdf", "", 5), (4, "d.jpg", "", 5), (5, "e.exe", "", 5), (6, "f.pdf", "", 2**24), (7, "g.pdf", "", 5)],
        "doc_id bigint, file_name string, mime_type string, size_bytes bigint",
    )
    text = "This page holds a perfectly readable sentence about the quarterly results."
    native = spark.createDataFrame(
        [(1, 2, "xq zzrtk bcdfg"), (1, 1, text), (1, 3, "  "), (1, 4, "qq"), (3, 1, ""), (6, 1, text)], "doc_id bigint, page_number int, text string"
    )
    ocr = spark.createDataFrame([(1, 2, "Recog-\nnised page"), (1, 1, "ignored")], "doc_id bigint, page_number int, text string")
    images = spark.createDataFrame([(2, " Image text \n"), (4, "  ")], "doc_id bigint, text string")
    got = by_id(extract.extract_documents(uploads, native, ocr, images))
    assert got[1].text == f"-- 1 of 4 --\n{text}\n\n-- 2 of 4 --\nRecognised page"
    assert [(p.page_number, p.method, p.text) for p in got[1].pages] == [(1, "pdf", text), (2, "ocr", "Recognised page"), (3, "ocr", ""), (4, "ocr", "")]
    assert (got[1].page_count, got[1].method, got[1].success, got[1].status) == (4, "ocr", True, 200)
    assert got[1].word_count == len(got[1].text.split()) and got[1].character_count == len(got[1].text)
    assert (got[2].text, got[2].page_count, got[2].method) == ("Image text", None, "ocr")
    assert [(got[i].status, got[i].error_code) for i in range(3, 8)] == [
        (422, "EMPTY_EXTRACTION"), (422, "EMPTY_EXTRACTION"), (400, "INVALID_FILE"), (413, "FILE_TOO_LARGE"), (500, "EXTRACTION_FAILED"),
    ]


def test_a_document_of_thousands_of_pages_is_one_upload(spark):
    count = 5_000
    text = F.when(F.col("page_number") > 4_096, F.concat(F.lit("Readable text of page number "), "page_number", F.lit(" follows here."))).otherwise("")
    table = spark.range(1, count + 1).select(F.lit(1).cast("bigint").alias("doc_id"), F.col("id").cast("int").alias("page_number")).withColumn("text", text)
    uploads = spark.createDataFrame([(1, "a.pdf", "application/pdf", 10)], "doc_id bigint, file_name string, mime_type string, size_bytes bigint")
    none = spark.createDataFrame([], "doc_id bigint, text string")
    (row,) = extract.extract_documents(uploads, table, table.where("false"), none).collect()
    assert (row.success, row.status, row.method, row.page_count, len(row.pages)) == (True, 200, "ocr", count, count)
    assert row.text.startswith(f"-- 4097 of {count} --\n") and row.word_count == len(row.text.split())
    requests = summarize.map_requests(spark.createDataFrame([(1, row.text, "short")], "doc_id bigint, text string, length string")).collect()
    assert len({r.request_id for r in requests}) == len(requests) == 3


def test_summary_map_and_reduce(spark):
    docs = spark.createDataFrame([(1, "short text", "short"), (2, "word. " * 12_000, "other"), (3, "  ", "long")], "doc_id bigint, text string, length string")
    rows = summarize.map_requests(docs).collect()
    assert [(r.doc_id, r.n_chunks, r.json_mode, r.max_tokens, r.length) for r in rows if r.doc_id == 1] == [(1, 1, True, 2000, "short")]
    two = sorted((r for r in rows if r.doc_id == 2), key=lambda r: r.chunk_index)
    assert [(r.json_mode, r.max_tokens, r.length) for r in two] == [(False, 500, "medium")] * 3
    assert two[0].prompt.startswith("This is part 1 of 3")
    assert [r.error_message for r in summarize.empty_documents(docs).collect()] == ["There is no extracted text to summarize."]
    schema = "doc_id bigint, length string, chunk_index int, content string, completion_error string"
    sections = spark.createDataFrame(
        [(2, "medium", 1, "second", None), (2, "medium", 0, "first", None), (4, "long", 0, None, "TRUNCATED"), (4, "long", 1, "x", None)], schema
    )
    (final,) = summarize.final_requests(sections).collect()
    assert final.prompt.endswith("--- Section 1 ---\nfirst\n\n--- Section 2 ---\nsecond")
    (failed,) = summarize.failed_sections(sections).collect()
    assert (failed.doc_id, failed.status, failed.section_error) == (4, 502, "TRUNCATED")


def test_summaries_take_the_first_good_attempt(spark):
    good, other = json.dumps(GOOD), json.dumps(dict(GOOD, summary="second"))
    rows = [
        ("a", 1, 200, body(good)), ("a", 2, 200, body(other)),
        ("b", 1, 500, None), ("b", 2, 200, body("```json\n" + other + "\n```")), ("b", 3, 200, body(good)),
        ("c", 1, 200, body("nothing")), ("c", 2, 200, body('{"title": 1}')),
        ("d", 1, 200, body(good, "length")), ("d", 2, 200, body(" ")),
        ("e", 1, 500, None), ("e", 2, 429, None), ("e", 3, 200, body(good)),
        ("f", 1, 200, body('"just text"')), ("g", 1, None, None),
    ]
    got = by_id(summarize.summaries(responses(spark, rows)), "request_id")
    assert (got["a"].summary.summary, got["a"].attempt) == ("S", 1)
    assert (got["b"].summary.summary, got["b"].attempt) == ("second", 2)
    assert [(got[k].status, got[k].completion_error) for k in "cdefg"] == [
        (502, "NO_SUMMARY"), (500, "EMPTY_COMPLETION"), (200, None), (502, "BAD_SHAPE"), (500, "UNREACHABLE"),
    ]
    assert [k for k in "cdefg" if got[k].success] == ["e"]


def test_questions_and_answers(spark):
    docs = spark.createDataFrame([(1, LONG_TEXT), (2, "tiny"), (3, " ")], "doc_id bigint, text string")
    checked = by_id(ask.check_documents(docs))
    assert [checked[i].status for i in (1, 2, 3)] == [200, 502, 502]
    assert checked[2].error_message != checked[3].error_message
    assert [r.request_id for r in ask.question_requests(docs).collect()] == ["1:questions"]
    q = spark.createDataFrame([(10, 1, " What about payment? "), (11, 2, "x"), (12, 1, " ")], "question_id bigint, doc_id bigint, question string")
    (request,) = ask.answer_requests(docs, q).collect()
    assert (request.question_id, request.sources_used, request.max_tokens) == (10, 1, 1200)
    assert "Question: What about payment?\n" in request.prompt and "--- Relevant excerpt 1 ---" in request.prompt
    listed = ask.suggested_questions(responses(spark, [("1", 1, 200, body("[]")), ("1", 2, 200, body('{"questions": ["a", " b? "]}')), ("2", 1, 200, body("{}"))]))
    got = by_id(listed, "request_id")
    assert (got["1"].questions, got["1"].success, got["2"].status, got["2"].error_code) == (["a?", "b?"], True, 502, "QA_FAILED")
    answered = by_id(ask.answers(responses(spark, [("1", 1, 200, body(" yes ", "length")), ("2", 1, 500, None)])), "request_id")
    assert (answered["1"].answer, answered["1"].success, answered["2"].answer, answered["2"].status) == ("yes", True, None, 500)


def test_completion_hand_off_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, LONG_TEXT, "short")], "doc_id bigint, text string, length string")
    asked = with_request_body(summarize.map_requests(docs), "some-model")
    write_requests(asked, str(tmp_path / "out"))
    sent = json.loads(spark.read.json(str(tmp_path / "out")).collect()[0].body)
    assert sent["response_format"] == {"type": "json_object"} and sent["temperature"] == 0.2 and sent["reasoning"] == {"enabled": False}
    assert [m["role"] for m in sent["messages"]] == ["system", "user"] and sent["max_tokens"] == 2000
    prose = with_request_body(asked.withColumn("json_mode", F.lit(False)).drop("body"), "some-model").collect()[0]
    assert "response_format" not in json.loads(prose.body)
    answer = body(json.dumps(GOOD))
    run_completions(asked, lambda _: (200, answer)).write.json(str(tmp_path / "back"))
    (done,) = summarize.summaries(scan_responses(spark, str(tmp_path / "back"))).collect()
    assert done.summary.title == "T" and done.request_id == "1:short:direct:1"
    extracted = spark.createDataFrame([(1, "a.pdf", 33)], "doc_id bigint, file_name string, word_count bigint")
    saved = spark.createDataFrame([(done.summary, 1, "short")], "summary struct<title:string,document_type:string,summary:string,key_points:array<string>,main_ideas:array<string>,entities:array<string>,action_items:array<string>>, doc_id bigint, length string")
    (entry,) = panel.history_entries(extracted, saved, "2024-01-01T00:00:00.000Z").collect()
    assert (entry.source_type_label, entry.source_word_count, entry.file_name) == ("PDF", 33, "a.pdf")


def test_file_sources_and_export_sinks(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.pdf").write_bytes(b"12345")
    (row,) = scan_uploads(spark, str(tmp_path / "in")).drop("content").collect()
    assert (row.file_name, row.size_bytes, row.mime_type) == ("a.pdf", 5, "")
    (tmp_path / "bodies.txt").write_text('{"text": "x"}\nbroken\n')
    assert scan_request_bodies(spark, str(tmp_path / "bodies.txt")).count() == 2
    one = spark.createDataFrame(
        [("My Title", "Report", "line one\n\nline two", ["a"], [], ["e"], [], None, "short", "2024-01-05T15:04:00.000Z")],
        "title string, document_type string, summary string, key_points array<string>, main_ideas array<string>, entities array<string>, action_items array<string>, file_name string, length string, generated_at string",
    )
    table = export_table(one, summary_columns(), meta_columns())
    write_exports(table, str(tmp_path / "table"))
    assert {r.file_name for r in spark.read.parquet(str(tmp_path / "table")).collect()} == {"my-title.txt", "my-title.md"}
    write_export_files(table, str(tmp_path / "files"))
    (md,) = (tmp_path / "files").glob("format=md/file_name=my-title.md/*.txt")
    assert md.read_text(encoding="utf-8").startswith("# My Title\n\n- Document Type: Report\n- Summary Length: Short\n- Generated: Jan 5, 2024, 03:04 PM\n")


class StubSession:
    """Just what shared_dir looks at."""

    def __init__(self, configured, master):
        self.folder = None
        self.conf = self.sparkContext = self
        self.master = master
        self.configured = configured

    def get(self, key, default):
        return self.configured if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_dir(StubSession("/some/shared/folder", "yarn")) == "/some/shared/folder"
    local = StubSession(None, "local[8]")
    assert shared_dir(local).startswith("/tmp/spark-") and shared_dir(local) == local.folder
    with pytest.raises(ValueError):
        shared_dir(StubSession(None, "yarn"))


def test_extraction_is_stored_once_and_searched(spark):
    uploads = spark.createDataFrame([(1, "a.pdf", "", 5)], "doc_id bigint, file_name string, mime_type string, size_bytes bigint")
    native = spark.createDataFrame([(1, 1, LONG_TEXT)], "doc_id bigint, page_number int, text string")
    nothing = native.where("false")
    stored = panel.extract_once(uploads, native, nothing, nothing.select("doc_id", "text"))
    assert len(stored.inputFiles()) > 0 and stored.count() == 1
    lengths = spark.createDataFrame([(1, "short"), (1, "long")], "doc_id bigint, length string")
    assert {r.request_id for r in panel.summarize_at_lengths(stored, lengths).collect()} == {"1:short:direct:1", "1:long:direct:1"}
    q = spark.createDataFrame([(1, 1, "payment")], "question_id bigint, doc_id bigint, question string")
    index = stored_index(stored.select("doc_id", "text"))
    assert [r.chunk_index for r in search_index(index, q).collect()] == [0]
