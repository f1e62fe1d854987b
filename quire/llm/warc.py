"""WARC archives written as text tables and read back record by record.

`write_archive` turns pages into WARC 1.1 records: a `response` for each payload,
or a `revisit` where another page holds the same payload.  Payloads above a
segment size go out as a first segment and `continuation` records; all of them
carry chunked transfer framing.  The files are written by Spark's own text
writer, gzipped, so its commit protocol covers lost executors and any file system
works.

`read_archive` reads whole files, takes the records apart by their lengths,
groups continuations by the identifier of their origin, orders them by segment
number, compares the total length and decodes the chunked framing.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quire.llm.arrow import map_rows
from quire.session import shared_dir

REVISIT_BYTES = 1000
SEGMENT_CHARS = 64 * 1024
CHUNK_CHARS = 16 * 1024
FILE_RECORDS = 512
END = "\r\n"
GZIP = b"\x1f\x8b"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def shared_payloads(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """payload_digest, payload_bytes, answer: payloads of several pages.

    A null payload is empty.  Of the pages with equal payloads of at least `least`
    bytes the one with the largest page_id answers; where that page_id comes in
    several rows, those are all responses.  No payload moves, and digests combine
    before the shuffle, so one that a third of the pages share is a row per task.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return (
        pages.select(
            F.col("page_id").cast("long").alias("page_id"),
            F.octet_length(html).cast("long").alias("payload_bytes"),
            F.sha1(F.encode(html, "UTF-8")).alias("payload_digest"),
        )
        .filter(F.col("payload_bytes") >= least)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("answer"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )


def with_answers(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to."""
    last = shared_payloads(pages, least)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    full = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        (F.col("url").cast("string") if "url" in pages.columns else F.lit("")).alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha1(F.encode(html, "UTF-8")).alias("payload_digest"),
    )
    return (
        full.join(last, ["payload_digest", "payload_bytes"], "left")
        .withColumn(
            "refers_to", F.when(F.col("answer") != F.col("page_id"), F.col("answer"))
        )
        .select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")
    )


def record_id(page_id: int | None, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{number}')}>"


def chunked(text: str, size: int) -> str:
    """Chunked transfer framing; chunks are cut between characters."""
    parts = []
    for at in range(0, len(text), size):
        piece = text[at : at + size]
        parts.append(f"{len(piece.encode()):x}{END}{piece}{END}")
    return "".join(parts) + f"0{END}{END}"


def header(fields: list[tuple[str, str]]) -> str:
    return VERSION + END + "".join(f"{k}: {v}{END}" for k, v in fields) + END


def one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def page_records(
    serial: int, page_id, url, html, size, digest, refers_to, segment: int, chunk: int
) -> Iterator[str]:
    """The records of one page, without the two line ends that close each record."""
    status = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"
    base = [
        ("WARC-Date", DATE),
        ("WARC-Target-URI", one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(size)),
    ]
    first = record_id(page_id, serial)
    if refers_to is not None:
        block = status + END
        yield (
            header(
                [("WARC-Type", "revisit"), ("WARC-Record-ID", first), *base,
                 ("WARC-Profile", PROFILE), ("X-Refers-To-Page", str(refers_to)),
                 ("Content-Type", "application/http;msgtype=response"),
                 ("Content-Length", str(len(block.encode())))]
            )
            + block
        )
        return
    block = status + f"Transfer-Encoding: chunked{END}{END}" + chunked(html, chunk)
    pieces = [block[at : at + segment] for at in range(0, len(block), segment)]
    total = len(block.encode())
    for number, piece in enumerate(pieces, 1):
        fields = [("WARC-Type", "response" if number == 1 else "continuation")]
        if number == 1:
            fields += [("WARC-Record-ID", first), *base]
        else:
            fields += [("WARC-Record-ID", record_id(page_id, serial * 100003 + number)),
                       ("WARC-Date", DATE), ("WARC-Target-URI", one_line(url)),
                       ("WARC-Segment-Origin-ID", first)]
        if len(pieces) > 1:
            fields.append(("WARC-Segment-Number", str(number)))
            if number == len(pieces):
                fields.append(("WARC-Segment-Total-Length", str(total)))
        fields += [("Content-Type", "application/http;msgtype=response"),
                   ("Content-Length", str(len(piece.encode())))]
        yield header(fields) + piece


def write_archive(
    pages: DataFrame,
    path: str,
    least: int = REVISIT_BYTES,
    segment_chars: int = SEGMENT_CHARS,
    chunk_chars: int = CHUNK_CHARS,
) -> None:
    """Write pages (page_id, url, html) as WARC files under `path`.

    Files are bounded: at most FILE_RECORDS records of at most `segment_chars`
    characters and a header.
    """

    def make(rows: Iterator[tuple]) -> Iterable[tuple]:
        from pyspark import TaskContext

        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 32
        for row in rows:
            serial += 1
            for record in page_records(serial, *row, segment_chars, chunk_chars):
                yield (record,)

    records = map_rows(with_answers(pages, least), make, "value string")
    (
        records.write.option("lineSep", END + END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", FILE_RECORDS)
        .text(path)
    )


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, found by lengths alone."""
    at = 0
    mark = VERSION.encode()
    while at < len(content):
        if content[at : at + 5] != mark[:5]:
            raise ValueError(f"no record at byte {at}")
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode().split(END)[1:]
        fields = dict((k.lower(), v.strip()) for k, v in (x.split(":", 1) for x in lines))
        begin = stop + 4
        length = int(fields["content-length"])
        if begin + length + 4 > len(content):
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, content[begin : begin + length]
        at = begin + length + 4


def dechunk(block: bytes) -> bytes:
    """The payload of an HTTP response block; chunked framing is taken off."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        if body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        at = line + 4 + size


def read_records(spark, path: str) -> DataFrame:
    """One row per record: type, ids, segment number, total length, block."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ).select("content")

    def make(rows: Iterator[tuple]) -> Iterable[tuple]:
        for (content,) in rows:
            if content[:2] == GZIP:
                content = gzip.decompress(content)  # also of several members
            for f, block in parse_records(content):
                yield (
                    f["warc-type"], f["warc-record-id"], f.get("warc-segment-origin-id"),
                    number(f.get("warc-segment-number")),
                    number(f.get("warc-segment-total-length")),
                    number(f.get("x-page-id")), f.get("warc-target-uri"),
                    f.get("warc-payload-digest"), number(f.get("x-refers-to-page")),
                    number(f.get("x-payload-length")), block,
                )

    return map_rows(
        files, make,
        "record_type string, record_id string, origin_id string, segment long, "
        "total_length long, page_id long, url string, digest string, refers_to long, "
        "declared_bytes long, block binary",
    )


def number(text: str | None) -> int | None:
    return int(text) if text else None


def read_archive(spark, path: str) -> DataFrame:
    """One row per page: page_id, url, record_type, refers_to, digest,
    declared_bytes, payload (binary; null where segments are missing or the total
    length differs), complete boolean.

    Only records that have segments are shuffled, by the identifier of their
    origin; a group is the segments of one page.
    """
    records = read_records(spark, path)
    whole = records.filter("segment is null")
    parts = records.filter("segment is not null")
    # One row per origin: the segments are concatenated in the order of their numbers.
    joined = (
        parts.groupBy(F.coalesce("origin_id", "record_id").alias("record_id"))
        .agg(
            F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("pieces"),
            F.max("total_length").alias("total_length"),
            *(F.max(c).alias(c) for c in ("page_id", "url", "digest", "refers_to", "declared_bytes")),
        )
        .withColumn("blocks", F.expr("transform(pieces, p -> p.block)"))
        .withColumn(
            "gapless",
            F.expr("transform(pieces, p -> p.segment) = sequence(1L, cast(size(pieces) as long))"),
        )
        .selectExpr(
            "'response' AS record_type", "page_id", "url", "digest", "refers_to",
            "declared_bytes", "blocks", "gapless", "total_length",
        )
    )
    single = whole.selectExpr(
        "record_type", "page_id", "url", "digest", "refers_to", "declared_bytes",
        "array(block) AS blocks", "true AS gapless",
        "cast(octet_length(block) as long) AS total_length",
    )

    def make(rows: Iterator[tuple]) -> Iterable[tuple]:
        for kind, page_id, url, digest, refers_to, declared, blocks, gapless, total in rows:
            block = b"".join(blocks)
            good = bool(gapless) and total == len(block)
            payload = dechunk(block) if good and kind == "response" else None
            sha = hashlib.sha1(payload).hexdigest() if payload is not None else None
            if payload is not None:
                good = digest == f"sha1:{sha}" and declared == len(payload)
            yield (page_id, url, kind, refers_to, (digest or "").removeprefix("sha1:"),
                   declared, payload, good)

    return map_rows(
        single.unionByName(joined), make,
        "page_id long, url string, record_type string, refers_to long, digest string, "
        "declared_bytes long, payload binary, complete boolean",
    )


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' records to the shared folder and report what reading finds.

    page_id, payload_bytes, payload_digest, record_type, refers_to, complete.
    Length and digest of a response are those of the payload that was read back;
    a revisit has none and states those of the payload it refers to.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    back = read_archive(spark, path)
    return back.select(
        "page_id",
        F.coalesce(F.octet_length("payload").cast("long"), "declared_bytes").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), "digest").alias("payload_digest"),
        "record_type",
        "refers_to",
        "complete",
    )
