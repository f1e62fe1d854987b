import os

from pyspark.sql import functions as F

from quire.operators.pages import combine_pages
from quire.sources.history_store import HistoryStore
from quire.streaming.documents import PAGE, READING, document_stream, stream_arrivals
from quire.streaming.ingest import append_to, upsert_history
from test_history import ENTRY_SCHEMA, entries, stamp


def ids(store):
    return {(r.id, r.created_at) for r in store.load().collect()}


def test_a_batch_is_applied_once(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "h"))
    new = entries(spark, [("a", stamp(1), 1), ("b", stamp(2), 2)])
    assert store.save(new, by_seq=True, batch=("s", 0))
    store.delete(spark.createDataFrame([("a",)], "id string"))
    assert store.applied_batches() == {"s": 0}
    # Delivered again after the delete: the deleted entry stays deleted.
    assert not store.save(new, by_seq=True, batch=("s", 0))
    assert ids(store) == {("b", stamp(2))}
    # Another stream counts for itself, and an older write of an entry changes nothing.
    older = entries(spark, [("b", stamp(7), 1), ("c", stamp(3), 3)])
    assert store.save(older, by_seq=True, batch=("t", 0))
    assert ids(store) == {("b", stamp(2)), ("c", stamp(3))}
    assert store.applied_batches() == {"s": 0, "t": 0}
    store.clear()
    assert store.applied_batches() == {"s": 0, "t": 0} and ids(store) == set()


def test_a_restarted_stream_changes_nothing_twice(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "history", "ck"))

    def run():
        stream = spark.readStream.schema(ENTRY_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        upsert_history(stream, path, checkpoint).awaitTermination()

    for rows in ([("a", stamp(5), 5)], [("b", stamp(1), 1), ("a", stamp(4), 4)]):
        entries(spark, rows).coalesce(1).write.mode("append").parquet(source)
    run()
    store = HistoryStore(spark, path)
    assert ids(store) == {("a", stamp(5)), ("b", stamp(1))}
    store.delete(spark.createDataFrame([("b",)], "id string"))
    versions = store.versions()
    # As if the driver had died after the save and before the batch was noted as done.
    commits = os.path.join(checkpoint, "commits")
    for name in sorted(os.listdir(commits)):
        if name.strip(".").startswith("1"):
            os.rename(os.path.join(commits, name), str(tmp_path / f"gone-{name.strip('.')}"))
    run()
    assert store.versions() == versions and ids(store) == {("a", stamp(5))}
    entries(spark, [("b", stamp(6), 6)]).coalesce(1).write.mode("append").parquet(source)
    run()
    assert ids(store) == {("a", stamp(5)), ("b", stamp(6))}


GOOD = "A readable page of text with several ordinary words in it, and one more."
BAD = "xq zzkt bbvw qqqq xx zz kk"


def test_documents_come_out_when_all_is_there(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    pages = [(1, 1, GOOD), (1, 2, BAD), (2, 1, GOOD), (2, 2, "  "), (3, 1, BAD), (4, 1, GOOD)]
    readings = [(1, 2, GOOD), (1, 1, "not needed"), (2, 2, GOOD), (4, 1, "late")]
    sizes = {1: 2, 2: 2, 3: 1, 4: 2}

    def arrive(minute, rows):
        shown = [(d, k, p, t, sizes.get(d), 1_700_000_000 + 60 * minute) for d, k, p, t in rows]
        df = spark.createDataFrame(shown, "doc_id bigint, kind string, page_number int, text string, n_pages int, s long")
        df.select("doc_id", "kind", "page_number", "text", "n_pages", F.timestamp_seconds("s").alias("arrived")).coalesce(1).write.mode("append").parquet(source)
        append_to(document_stream(stream_arrivals(spark, source)), sink, checkpoint).awaitTermination()
        return {r.doc_id: r for r in spark.read.parquet(sink).collect()}

    page = [(d, PAGE, p, t) for d, p, t in pages]
    reading = [(d, READING, p, t) for d, p, t in readings]
    assert arrive(0, page[:2] + reading[2:3]) == {}
    done = arrive(1, [reading[0], reading[1], page[0], page[2], page[4], page[5]])
    assert set(done) == {1}
    assert set(arrive(2, [page[3], reading[3], (1, PAGE, 1, "again")])) == {1, 2}
    # Documents 3 (no reading) and 4 (one page of two) end with the wait.
    done = arrive(300, [(-1, "tick", 0, "")])
    assert set(done) == {1, 2, 3, 4}
    assert {d: r.complete for d, r in done.items()} == {1: True, 2: True, 3: False, 4: False}
    want = combine_pages(
        spark.createDataFrame(pages, "doc_id bigint, page_number int, text string"),
        spark.createDataFrame(readings, "doc_id bigint, page_number int, text string"),
    )
    for r in want.collect():
        got = done[r.doc_id]
        assert (got.text, got.page_count, got.method, got.word_count) == (r.text, r.page_count, r.method, r.word_count)
    assert spark.read.parquet(sink).count() == 4
