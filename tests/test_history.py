import json
import random

from pyspark.sql import functions as F

import brute
from quire.operators.history import read_entries, save_entries
from quire.sources.history_store import ENTRY_SCHEMA, HistoryStore

SUMMARY = {"title": "t", "document_type": "d", "summary": "s", "key_points": [], "main_ideas": [], "entities": [], "action_items": []}


def entries(spark, rows):
    full = [(i, at, None, "PDF", "short", 3, SUMMARY, seq) for i, at, seq in rows]
    return spark.createDataFrame(full, ENTRY_SCHEMA)


def stamp(n):
    return f"2024-01-01T00:{n // 60:02d}:{n % 60:02d}.000Z"


def test_batch_save_equals_saves_one_by_one(spark):
    rng = random.Random(2)
    old = [(f"i{k}", stamp(rng.randrange(3000)), k) for k in range(100)]
    new = [(f"i{k}" if k % 3 else f"n{k}", stamp(3000 + k), k) for k in range(0, 90, 2)]
    # The last one written is the oldest by date: it stays all the same.
    new.append(("late", "2000-01-01T00:00:00.000Z", 1000))
    got = save_entries(entries(spark, old), entries(spark, new), 100).collect()
    want = brute.saves([e[:2] for e in sorted(old, key=lambda e: e[1])] + [e[:2] for e in new])
    assert {r.id for r in got} == want and "late" in want and len(got) == 100
    # Without a limit nothing is cut; with an owner each list is cut by itself.
    everyone = {e[0] for e in old + new}
    assert {r.id for r in save_entries(entries(spark, old), entries(spark, new)).collect()} == everyone
    both = [entries(spark, e).withColumn("owner", F.substring("id", 1, 1)) for e in (old, new)]
    kept = save_entries(*both, limit=20, owner="owner").collect()
    sizes = {o: sum(r.owner == o for r in kept) for o in "inl"}
    assert sizes == {"i": 20, "n": min(20, sum(e[0][0] == "n" for e in new)), "l": 1}
    last_i = max((e for e in new if e[0][0] == "i"), key=lambda e: e[2])[0]
    assert last_i in {r.id for r in kept}


def test_store_versions(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "history"))
    assert store.load().count() == 0
    store.save(entries(spark, [("a", stamp(1), 1), ("b", stamp(2), 2)]))
    store.save(entries(spark, [("a", stamp(3), 3)]))
    assert [(r.id, r.created_at) for r in store.load().collect()] == [("a", stamp(3)), ("b", stamp(2))]
    store.delete(spark.createDataFrame([("b",), ("zzz",)], "id string"))
    assert [r.id for r in store.load().collect()] == ["a"]
    # A version without its marker is a dead attempt and is ignored.
    entries(spark, [("x", stamp(9), 9)]).write.parquet(f"{store.path}/v=00000009")
    (tmp_path / "history" / "v=00000009" / "_SUCCESS").unlink()
    assert [r.id for r in store.load().collect()] == ["a"]
    store.clear()
    assert store.load().count() == 0 and store.versions() == [1, 2, 3, 4]


def test_stored_json_is_validated(spark, tmp_path):
    good = {
        "id": "a", "createdAt": stamp(1), "fileName": None, "sourceTypeLabel": None, "length": "short", "sourceWordCount": None,
        "summary": {"title": "t", "documentType": "d", "summary": "s", "keyPoints": ["k"], "mainIdeas": [], "entities": [], "actionItems": []},
    }
    bad = [
        dict(good, id=""), dict(good, id=3), dict(good, createdAt=1), dict(good, length="huge"), dict(good, fileName=4),
        dict(good, sourceWordCount="9"), dict(good, summary={}), {k: v for k, v in good.items() if k != "fileName"}, 3, None, [],
    ]
    also_good = dict(good, id="b", fileName="f.pdf", sourceWordCount=1234)
    values = [json.dumps([*bad, good, also_good]), "not json", json.dumps(good), "{}"]
    stored = spark.createDataFrame([(v,) for v in values], "value string")
    rows = read_entries(stored).orderBy("id").collect()
    assert [(r.id, r.file_name, r.source_word_count) for r in rows] == [("a", None, None), ("b", "f.pdf", 1234)]
    store = HistoryStore(spark, str(tmp_path / "imported"))
    store.import_json(stored.where(F.length("value") > 400))
    assert {r.id for r in store.load().collect()} == {"a", "b"}
