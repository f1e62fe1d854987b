import hashlib
import random
import re
import time

from quire.llm.pii import KINDS, find_spans, personal_data

SCHEMA = "doc_id long, text string, kind string, spans int"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(m):
    return "".join(c for c in m if c.isdigit())


RULES = [
    ("email", EMAIL, lambda m: True),
    ("ip", IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", CARD, lambda m: 13 <= len(digits_of(m)) <= 19 and luhn(digits_of(m))),
    ("phone", PHONE, lambda m: 9 <= len(digits_of(m)) <= 15),
]


def brute(text):
    spans, counts = [], []
    for name, pattern, valid in RULES:
        found = [m for m in pattern.finditer(text or "") if valid(m.group())]
        counts.append(len(found))
        spans += [f"{name}:{m.start()}:{m.end()}" for m in found]
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest()), spans


def documents():
    rng = random.Random(11)
    parts = ["a@b.c", "x.y+z@mail-1.example.com", "@", "a@b", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1",
             "0001.02.3.255", "4111111111111111", "4111 1111-1111 1111", "4111  1111", "1234567890123",
             "+1 (555) 010-9999", "+123", "++44 20 7946 0958.", "+4 ((((", "é🙂", " ", "\n", "word", ".", "-", "7",
             "_d@e.f", "a@b.c_d@e.f@g.h"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(0, 25)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "a@b.c " * 5000), (1003, "9" * 900),
             (1004, "a" * 900 + "@"), (1005, "+1" + " " * 900), (1006, "1." * 900),
             (1007, "1 " * 900), (3, rows[3][1])]
    return [(i, t, "k", 1) for i, t in rows]


def test_base_spans_equal_brute_force(spark):
    rows = documents()
    got = personal_data(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    want = sorted((i, *brute(t)[0]) for i, t, *_ in rows)
    assert sorted(tuple(r)[:6] for r in got) == want
    assert all(sum(r[k] for r in want) > 20 for k in (1, 2, 3, 4))
    listed = {r["doc_id"]: r["spans"] for r in got}
    for i, t, *_ in rows:
        base = [s for s in listed[i].split(",") if s.split(":")[0] in ("email", "ip", "card", "phone")]
        assert [s for s in base if s] == brute(t)[1]


def test_long_junk_is_read_once(spark):
    junk = ["9" * 100_000, "a" * 200_000 + "@", "+1" + " " * 100_000, "1." * 60_000, "1 " * 60_000]
    df = spark.createDataFrame(list(enumerate(junk)), "doc_id long, text string")
    started = time.time()
    rows = {r["doc_id"]: r["spans"] for r in personal_data(df).collect()}
    assert time.time() - started < 60
    assert rows[0] == rows[1] == rows[2] == rows[4] == "" and rows[3].count("ip:") == 15_000


def test_added_kinds_need_checksum_or_context(spark):
    texts = ["pay to GB82 WEST 1234 5698 7654 32 now", "pay to GB82 WEST 1234 5698 7654 33 now",
             "social security 219-09-9999", "number 219-09-9999", "ssn 000-09-9999", "card 4111111111111111"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in personal_data(df).collect()}
    assert spans == {0: "iban:7:34", 1: "", 2: "ssn:16:27", 3: "", 4: "", 5: "card:5:21"}
    scores = {r["doc_id"]: r["score"] for r in find_spans(df).filter("kind is not null").collect()}
    assert scores[5] > scores[0] > scores[2]


def test_no_python_in_the_plan_and_empty_table(spark):
    df = personal_data(spark.createDataFrame([], SCHEMA))
    assert df.collect() == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert [k.name for k in KINDS][:4] == ["email", "ip", "card", "phone"]
