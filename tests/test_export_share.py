import re
import unicodedata
import base64
import json

from pyspark.sql import functions as F

from quire.functions.export import format_export_date, slugify, word_count_label
from quire.functions.share import parse_share_fragment, share_link
from quire.operators.conversation import attach_answers, mark_asked
from quire.workload.views import summary_columns

FULL = {"title": "é", "documentType": "d", "summary": "s\n", "keyPoints": ["k"], "mainIdeas": [], "entities": ["e"], "actionItems": []}


def fragment(value):
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return "#d=" + base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def test_slugs(column):
    cases = {
        "Hello, World!": "hello-world", "Crème Brûlée ﬁne": "creme-brulee-fine", "  --  ": "summary", "": "summary",
        "日本": "summary", "a" * 70: "a" * 60, "x" * 59 + " yy": "x" * 59 + "-", "½ ②": "1-2-2",
    }
    assert column(slugify, list(cases)) == list(cases.values())


def test_dates_and_labels(column, spark):
    assert column(format_export_date, ["2024-01-05T15:04:00.000Z", "never", "2024-12-31T00:00:00Z"]) == [
        "Jan 5, 2024, 03:04 PM", "never", "Dec 31, 2024, 12:00 AM",
    ]
    df = spark.createDataFrame([(1234567,), (None,)], "n bigint")
    assert [r[0] for r in df.select(word_count_label(F.col("n"))).collect()] == ["1,234,567 words", None]


def test_links_round_trip(spark, column):
    df = spark.createDataFrame(
        [("ti?>tle" * 30, "d", "sum", ["a", "b"], [], ["e"], ["do"])],
        "title string, document_type string, summary string, key_points array<string>, main_ideas array<string>, entities array<string>, action_items array<string>",
    )
    link = df.select(share_link(summary_columns(), F.lit("https://x.org"))).collect()[0][0]
    assert link.startswith("https://x.org/s#d=") and not set(link.split("d=")[1]) & set("+=\n\r ")
    (parsed,) = column(parse_share_fragment, ["#" + link.split("#")[1]])
    assert parsed == df.collect()[0]


def test_bad_links_give_nothing(column):
    good = fragment(FULL)
    parsed = column(
        parse_share_fragment,
        [good, good + "&x=1", "#a=1&" + good[1:], fragment(dict(FULL, extra=1)), good[1:], "#d=", "#", "", "#e=" + good[3:], "#d=%%%",
         fragment(dict(FULL, entities=[1])), fragment("not json"), fragment([]), good + "!", fragment(json.dumps(FULL) + " tail"), "#d=A"],
    )
    assert [p is not None for p in parsed] == [True] * 4 + [False] * 12
    assert parsed[0].key_points == ["k"] and parsed[3] == parsed[0]


def test_conversations(spark):
    questions = spark.createDataFrame([(1, 7, " What? "), (2, 7, "  "), (3, 7, "Why?"), (4, 7, "How?")], "question_id bigint, doc_id bigint, question string")
    answers = spark.createDataFrame([(1, "so", True), (3, None, False)], "question_id bigint, answer string, success boolean")
    got = {(r.question_id, r.question, r.answer) for r in attach_answers(questions, answers).collect()}
    assert got == {(1, "What?", "so"), (4, "How?", None)}
    suggested = spark.createDataFrame([(7, "What?"), (7, "Who?"), (8, "What?")], "doc_id bigint, question string")
    flags = {(r.doc_id, r.question): r.was_asked for r in mark_asked(suggested, questions).collect()}
    assert flags == {(7, "What?"): True, (7, "Who?"): False, (8, "What?"): False}


def test_slugs_of_every_character(spark, column):
    def by_hand(title):
        whole = unicodedata.normalize("NFKD", title.lower())
        plain = "".join(c for c in whole if not 0x300 <= ord(c) < 0x370)
        return re.sub("[^a-z0-9]+", "-", plain).strip("-")[:60] or "summary"

    codes = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000] + list(range(0x1D400, 0x1D800)) + list(range(0x1F100, 0x1F200))
    titles = [f"x{chr(c)}y" for c in codes] + ["ﬁne ½ CAFÉ №1", "é" * 80, "Ǆ ẛ̣ ﷺ", None]
    # Java and Python know different versions of lower case for a few new letters.
    same = [t for t in titles if t is None or not t[1:2].isupper() or ord(t[1]) < 0x2C00]
    got = column(slugify, same)
    wrong = [(t, g, by_hand(t)) for t, g in zip(same, got) if t is not None and g != by_hand(t)]
    assert not wrong, wrong[:10]
    df = spark.createDataFrame([("é",)], "t string").select(slugify(F.col("t")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
