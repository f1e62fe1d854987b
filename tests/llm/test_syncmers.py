import hashlib
import random
import re

from xxhash import xxh64_intdigest

from quire.llm.syncmers import (
    K, S, SKETCH, anchors, block_of, compare_edited, fingerprints, range_blocks,
)
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, sketch string, key int"
MASK = 2**64 - 1


def chained(values):
    """Hash of several longs: each with the hash so far as its seed."""
    h = 42
    for v in values:
        h = xxh64_intdigest((v & MASK).to_bytes(8, "little"), h)
    return h


def signed(v):
    return v - (v >> 63 << 64)


def brute_anchors(text):
    hashes = [xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[ぁ-ゟ一-鿿]|[^\sぁ-ゟ一-鿿]+", text or "", re.A)]
    if not hashes:
        return []
    if len(hashes) < K:
        return [(0, chained(hashes) & 0xFFFFFFFF)]
    inner = [signed(chained(hashes[i : i + S])) for i in range(len(hashes) - S + 1)]
    out = []
    for i in range(len(hashes) - K + 1):
        run = inner[i : i + K - S + 1]
        if min(run) in (run[0], run[-1]):
            out.append((i, chained(run) & 0xFFFFFFFF))
    return out


def brute_sketch(text):
    return sorted({h for _, h in brute_anchors(text)})[:SKETCH]


def brute_likeness(a, b):
    if not a and not b:
        return 1.0
    union = sorted(set(a) | set(b))[:SKETCH]
    return sum(x in a and x in b for x in union) / len(union)


def documents():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)] + ["é", "🙂x", "漢字"]
    rows = [(i * 7, " ".join(rng.choices(words, k=rng.randrange(0, 400)))) for i in range(50)]
    rows += [(1001, None), (1002, ""), (1003, "one"), (1004, " \n "), (1005, "漢字仮名交じり文" * 9),
             (1006, "tie " * 3000), (1007, "y" * 90_000), (7, rows[1][1]), (7, "other text"), (None, "no id")]
    return [(i, t, "s", 1) for i, t in rows]


def test_rows_equal_brute_force(spark):
    rows = [(i, t or "") for i, t, *_ in documents()]
    ranked = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0]), reverse=True)
    ranked.sort(key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1].encode()))
    want = []
    for (i, t), (_, nxt) in zip(ranked, ranked[1:] + ranked[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = brute_sketch(t), brute_sketch(edited), brute_sketch(nxt)
        shown = ["".join(f"{x:08x}" for x in s) for s in (a, b)]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *shown,
                     brute_likeness(a, b), brute_likeness(a, c)))
    df = spark.createDataFrame(documents(), SCHEMA).repartition(5)
    got = [tuple(r) for r in compare_edited(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_anchors_do_not_depend_on_their_place(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{rng.randrange(99)}" for _ in range(60))
    texts = [passage, "before it " * 11 + passage + " after", passage.replace(" ", "\n")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [set() for _ in texts]
    for r in anchors(df).collect():
        found[r["doc_id"]].add(r["hash"])
        assert (r["at"], r["hash"]) in brute_anchors(texts[r["doc_id"]])
    assert found[0] == found[2] and found[0] <= found[1] and len(found[0]) > 15


def test_blocks_of_keys(spark):
    keys = spark.range(0, 60_000, 3).selectExpr("id * id as key")
    bounds, greatest = range_blocks(keys, "key")
    assert len(bounds) == 19 and [b for b, _ in greatest] == list(range(20))
    many = list(range(0, 3000, 2))
    got = spark.range(-2, 3002).select("id", block_of("id", many).alias("b")).collect()
    assert all(r["b"] == sum(x <= r["id"] for x in many) for r in got)


def test_equal_texts_have_equal_fingerprints_and_empty_table(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    by_text = {}
    for r in fingerprints(df).join(df, "doc_id").filter("doc_id <> 7").collect():
        by_text.setdefault(r["text"] or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert compare_edited(spark.createDataFrame([], SCHEMA)).collect() == []
    one = compare_edited(spark.createDataFrame([(5, "a b c d e f g h", "", 0)], SCHEMA)).first()
    assert one["near_next"] == 1.0
