import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm.trie import PRIMES, Hashing, prefix_trie

# depth and place clash with names inside.
SCHEMA = "conv_id long, turn long, role string, text string, depth string, place string"


def rule():
    return F.expr("conv_id - conv_id % 5"), F.expr("crc32(cast(conv_id AS string)) % 9")


def key(row):
    conv_id, turn, role, text = row
    return (turn is not None, turn or 0, role or "", text or "")


def by_hand(rows, rebuild=True):
    own = defaultdict(list)
    for row in rows:
        if row[0] is not None:
            own[row[0]].append(row)
    turns = {c: [(r[2] or "", r[3] or "") for r in sorted(v, key=key)] for c, v in own.items()}
    built = dict(turns)
    if rebuild:
        for c in turns:
            h = zlib.crc32(str(c).encode()) % 9
            built[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, held in members.items():
        cost = (len(held) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += cost
            leaves[node[:d]] += not children[node]
    nodes = [
        (min(held), len(node), min(members[node[:-1]]) if node else None, len(held),
         children[node], leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, held in members.items()
    ]
    return sorted(nodes, key=repr)


def conversations():
    rng = random.Random(6)
    texts = ["yes", "no", "", "漢字 é", None, "a longer text " * 20]
    rows = []
    for c in range(60):
        if c % 10 == 5:
            continue  # absent bases
        for t in range(rng.randrange(1, 14)):
            turn = None if rng.random() < 0.1 else t
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(texts[: 2 + c % 5])))
    script = [("user", "hello"), ("assistant", "who is there")] + [("user", str(i)) for i in range(5)]
    for c in range(100, 160):  # many equal ones
        rows += [(c, i, r, x) for i, (r, x) in enumerate(script)]
    rows += [(201, 0, "user", "only"), (202, 0, "user", "only")]  # bases absent, short
    rows += [rows[0], rows[0], (300, 1, "b", "tie"), (300, 1, "a", "tie"), (300, 1, "a", "sie")]
    rows += [(None, 0, "user", "of none"), (400, None, None, None), (-7, 0, "user", "minus")]
    return rows + [(500, i, "user", f"turn {i % 7}") for i in range(90)]


def frame(spark, rows, parts=3):
    full = [(*r, None, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def found(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
               "saved_tokens", "ends_sha256"]
    assert df.columns == columns
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_nodes_are_those_by_hand(spark):
    rows = [r for r in conversations() if r[0] != -7]  # remainders of negative ids differ
    got = found(prefix_trie(frame(spark, rows), *rule()))
    assert got == by_hand(rows)


def test_plain_trie(spark):
    rows = conversations()
    assert found(prefix_trie(frame(spark, rows))) == by_hand(rows, rebuild=False)


def test_a_conversation_over_many_tasks(spark):
    rows = [(5, i, "user", f"{i % 11}") for i in range(260)] + conversations()[:200]
    rows += [(c, i, "user", f"{i % 11}") for c in (6, 7, 8) for i in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(prefix_trie(frame(spark, rows), *rule()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == by_hand(rows)


def test_equal_fingerprints_of_unequal_prefixes_are_found(spark):
    rows = conversations()[:150]
    weak = Hashing(1, (3, 3, 3, 3))
    with pytest.raises(RuntimeError, match="not unique"):
        prefix_trie(frame(spark, rows), *rule(), attempts=(weak,))
    got = found(prefix_trie(frame(spark, rows), *rule(), attempts=(weak, Hashing(2))))
    assert got == by_hand(rows)


def test_primes_are_primes():
    assert len(set(PRIMES)) == 4
    for p in PRIMES:
        assert p < 2**31 and all(p % d for d in range(2, 46341))


def test_empty_table(spark):
    assert prefix_trie(frame(spark, [])).collect() == []
    assert prefix_trie(frame(spark, [(None, 0, "user", "x")]), *rule()).collect() == []
