import hashlib
import random
import re

import pytest

from quire.llm.decontaminate import clean_documents, decontaminate, kept_runs

SCHEMA = "doc_id long, text string, n_words string, item_id string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    wins = {}
    for item_id, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1) if words else ():
            wins.setdefault(tuple(words[i : i + size]), set()).add(str(item_id))
    sizes = {len(w) for w in wins}
    out = []
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                key = tuple(words[i : i + size])
                if key in wins:
                    hit |= set(range(i, i + size))
                    found |= wins[key]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=repr)


def tables():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünder", "漢字", "x1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 9, 10, 11, 25, 40])))) for i in range(30)]
    items += [(50, items[4][1]), (51, "solo"), (52, ""), (53, None), (54, "!!"), (4, items[4][1])]
    items += [(60, "the same the same the same the same the same the same")]
    docs = []
    for i in range(80):
        words = rng.choices(vocabulary, k=rng.randrange(0, 120))
        for _ in range(i % 3):
            source = items[rng.randrange(30)][1].split()
            cut = rng.randrange(0, max(1, len(source) - 8))
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = source[cut : cut + rng.randrange(7, 30)]
        docs.append((i, rng.choice([", ", " ", "\n"]).join(words).title()))
    docs += [(100, None), (101, ""), (102, "solo"), (103, "the same " * 500), (3, docs[3][1]),
             (104, "z" * 100_000 + " solo " + "w1 " * 40_000), (None, "solo")]
    return docs, items


@pytest.fixture(scope="module")
def frames(spark):
    docs, items = tables()
    return (
        spark.createDataFrame([(i, t, "n", "m") for i, t in docs], SCHEMA),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def test_hits_equal_brute_force(frames):
    got = sorted((tuple(r) for r in decontaminate(*frames).collect()), key=repr)
    want = brute(*tables())
    assert got == want
    assert sum(r[5] for r in want) > 10 and not all(r[5] for r in want)


def test_clean_documents_stay(frames):
    docs, _ = frames
    kept = clean_documents(*frames)
    assert kept.columns == docs.columns
    good = {r[0] for r in brute(*tables()) if not r[5]}
    assert {r["doc_id"] for r in kept.collect()} == good | {None}


def test_every_stretch_keeps_a_run():
    import numpy as np

    rng = np.random.default_rng(0)
    for size in (1, 5, 6, 7, 50):
        grams = rng.integers(0, 9, size).astype(np.uint64)
        kept = set(kept_runs(grams, 6).tolist())
        for i in range(size - 5):
            stretch = grams[i : i + 6]
            assert {i + int(j) for j in np.flatnonzero(stretch == stretch.min())} <= kept


def test_empty_tables(spark, frames):
    docs, items = frames
    none = spark.createDataFrame([], items.schema)
    assert all(r["n_hit"] == 0 and not r["contaminated"] for r in decontaminate(docs, none).collect())
    assert decontaminate(spark.createDataFrame([], docs.schema), items).collect() == []
