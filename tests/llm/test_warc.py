import hashlib

import pytest

from quire.llm.warc import (
    archive_round_trip, dechunk, parse_records, read_archive, write_archive,
)

SCHEMA = "page_id long, url string, html string, digest string, payload long"
BIG = "grüße\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 60


def pages():
    return [
        (1, "http://a/", None, "x", 1),
        (2, None, "", "x", None),
        (3, "http://b/ c\r\nd", "short", None, 3),
        (4, "http://b/", "short", None, 3),
        (5, "http://c/", BIG, None, 3),
        (6, "http://c/", BIG, None, 3),
        (7, "http://c/", BIG + "!", None, 3),
        (8, "http://d/", "é" * 300_000 + "0\r\n\r\n", None, 3),
        (6, "http://c/", BIG, None, 3),
    ]


def expected(rows, least=1000):
    data = [(r[0], (r[2] or "").encode()) for r in rows]
    out = []
    for page_id, payload in data:
        same = [p for p, other in data if other == payload]
        answer = max(same)
        revisit = len(payload) >= least and answer != page_id
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(),
                    "revisit" if revisit else "response", answer if revisit else None, True))
    return sorted(out, key=repr)


def test_round_trip_of_odd_pages(spark):
    df = spark.createDataFrame(pages(), SCHEMA)
    got = archive_round_trip(df).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(pages())


def test_payloads_come_back_from_segments(spark, tmp_path):
    df = spark.createDataFrame(pages(), SCHEMA)
    path = f"{tmp_path}/warc"
    write_archive(df, path, segment_chars=700, chunk_chars=64)
    rows = read_archive(spark, path).filter("record_type = 'response'").collect()
    payloads = {(r["page_id"], bytes(r["payload"])) for r in rows}
    assert payloads == {(p[0], (p[2] or "").encode()) for p in pages() if p[0] != 5}
    assert all(r["complete"] for r in rows)


def test_missing_segment_is_not_complete(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "y" * 5000)], "page_id long, url string, html string")
    path = f"{tmp_path}/warc"
    write_archive(df, path, segment_chars=1000)
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    import gzip

    content = b"".join(gzip.decompress(bytes(r["content"])) for r in texts.collect() if r["content"])
    records = list(parse_records(content))
    assert len(records) > 3
    cut = b"".join(
        b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in f.items()).encode() + b"\r\n" + block
        + b"\r\n\r\n"
        for f, block in records if f.get("warc-segment-number") != "2"
    )
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part.warc").write_bytes(cut)
    row = read_archive(spark, str(broken)).collect()
    assert [r["complete"] for r in row] == [False] and row[0]["payload"] is None


def test_empty_table(spark):
    assert archive_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bad_framing_is_an_error():
    with pytest.raises(ValueError):
        list(parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert dechunk(head + b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        dechunk(head + b"2\r\nabc\r\n0\r\n\r\n")
