"""Toxicity, language identification and language-model scoring."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import langid, lm, toxicity

BAD = ["blarg", "snotfish", "grubwit"]


def vocabulary(letters, seed, size=300):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(size)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    words = vocabulary("abcdefghiklmnoprstu", 2)
    docs, labels = [], []
    for i in range(900):
        text = rng.choices(words, k=rng.randrange(5, 120))
        bad = i % 6 == 0
        for _ in range((1 + len(text) // 25) * bad):
            text.insert(rng.randrange(len(text)), rng.choice(BAD).title())
        docs.append((i, " ".join(text), "score", 5))
        labels.append((i, int(bad)))
    docs += [(2000, None, "", 1), (2001, "", "", 1), (2002, "!", "", 1), (2003, "xyz " * 50_000, "", 1),
             (2004, "blarg", "", 1), (2004, "blarg", "", 1), (None, "snotfish grubwit", "", 1)]
    labels += [(None, 1), (5000, None), (2004, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, score string, n_hits int"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_toxic_documents_are_found(spark, labelled):
    docs, labels = labelled
    train = labels.filter("crc32(cast(doc_id as string)) % 3 <> 1")
    model = toxicity.learn(docs, train)
    rows = toxicity.score_documents(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 900
            and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    wrong = sum(r["predicted"] != (r["doc_id"] % 6 == 0) for r in held)
    assert len(held) > 200 and wrong <= 0.03 * len(held)
    by_id = {r["doc_id"]: r for r in rows}
    assert [by_id[i]["score"] for i in (2000, 2001, 2002, 2003)] == [0, 0, 0, 0]
    assert by_id[2004]["predicted"] == by_id[None]["predicted"] == 1


def test_toxicity_without_labels(spark, labelled):
    docs, labels = labelled
    model = toxicity.learn(docs, labels.filter("false"))
    assert toxicity.score_documents(docs, model).filter("score > 0").isEmpty()
    assert toxicity.score_documents(docs.filter("false"), model).collect() == []


def test_most_frequent_rows(spark):
    from quire.llm.frequent import most_frequent

    df = spark.range(0, 3000).selectExpr("id", "id div 10 as n")
    for limit in (0, 5, 100, 1000, 5000):
        rows = [r["n"] for r in most_frequent(df, "n", limit).collect()]
        assert len(rows) <= limit and 0 not in rows
        assert not rows or sorted(rows) == [n for n in range(300) for _ in range(10) if n >= min(rows)]
    assert len(most_frequent(df, "n", 5000).collect()) == 2990


def test_threshold_gives_the_best_f1():
    rng = np.random.default_rng(3)
    for _ in range(50):
        share = rng.integers(0, 6, 40) / 10
        label = (rng.random(40) < share + 0.1).astype(int)
        at = toxicity.best_threshold(share, label)

        def f1(t):
            called = (share >= t) & (share > 0)
            return 2 * (called & (label == 1)).sum() / max(1, called.sum() + label.sum())

        assert math.isclose(f1(at), max(f1(t) for t in [0.05, *np.unique(share[share > 0])]))


ALPHABETS = {"aa": "abcdefgh", "bb": "ijklmnöp", "cc": "qrstuvwé", "zh": "漢字仮名交文"}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(4)
    words = {k: vocabulary(v, k) for k, v in ALPHABETS.items()}
    rows = []
    for i in range(400):
        lang = rng.choice(list(words))
        text = " ".join(rng.choices(words[lang], k=rng.randrange(3, 60))).title()
        rows.append((i, text, lang if i % 5 else None, "x"))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")


def test_languages_are_told_apart(spark, spoken):
    rows, docs = spoken
    model = langid.learn(docs)
    assert model.languages == sorted(ALPHABETS)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for i, text, lang, _ in rows:
        scores = {k: sum(c in v for c in text.lower()) for k, v in ALPHABETS.items()}
        assert got[i]["lang_pred"] == max(scores, key=scores.get)
        assert 0 < got[i]["score"] <= 1
    odd = [(1, None), (2, ""), (3, "123 !? ½ 🙂"), (4, "xyzzy"), (5, "abc " * 40_000), (1, None), (6, "ſ")]
    df = spark.createDataFrame(odd, "doc_id long, text string")
    rest = langid.identify(df, model).collect()
    assert len(rest) == 7
    by_id = {r["doc_id"]: r["lang_pred"] for r in rest}
    assert [by_id[i] for i in (1, 2, 3)] == ["und"] * 3
    assert by_id[5] == "aa" and by_id[4] in ALPHABETS and by_id[6] in ALPHABETS
    assert langid.identify(df.filter("false"), model).collect() == []


def test_nothing_learned_is_undetermined(spark, spoken):
    _, docs = spoken
    model = langid.learn(docs.filter("lang is null"))
    assert {r["lang_pred"] for r in langid.identify(docs, model).collect()} == {"und"}


def test_unseen_words_fall_back_to_shorter_grams():
    model = langid.LanguageModel(
        ["a", "b"], {"known": np.array([-1.0, -9.0])},
        {" xy": np.array([-2.0, -8.0]), "x": np.array([-3.0, -5.0]), "q": np.array([-7.0, -4.0])},
    )
    scores = langid.Scores(model)
    assert scores.of(["known"]).tolist() == [-1, -9]
    assert scores.of(["xy"]).tolist() == [-2.5, -6.5]  # " xy" at the space, "x" after it
    assert scores.of(["q", "known"]).tolist() == [-8, -13]
    assert scores.of(["?"]).tolist() == [0, 0]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    first, second = vocabulary("abcdef", 1, 120), vocabulary("uvwxyz", 2, 120)
    rows = []
    for i in range(500):
        words = first if i % 2 else second
        rows.append((i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(120)], k=rng.randrange(0, 80))), "s"))
    rows += [(1000, None, ""), (1001, "", ""), (1002, "never Seen here İ", ""), (3, rows[3][1], ""),
             (None, "abc", "")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, score string")


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [None]


@pytest.mark.parametrize("sent", [lm.SENT_WORDS, 20])
def test_base_scores_equal_brute_force(spark, corpus, monkeypatch, sent):
    monkeypatch.setattr(lm, "SENT_WORDS", sent)
    rows, docs = corpus
    train = docs.filter("doc_id % 7 <> 2")
    counts, model = lm.learn(train, outcome_words=15)
    seen = Counter(w for i, t, _ in rows if i is not None and i % 7 != 2 for w in tokens(t))
    total, distinct = sum(seen.values()), len(seen)
    assert (counts.tokens, counts.distinct) == (total, distinct)
    want = sorted(
        ((i, len(tokens(t)), sum(w in seen for w in tokens(t)),
          sum(math.log10((seen[w] + 1) / (total + distinct + 1)) for w in tokens(t)))
         for i, t, _ in rows), key=repr)
    got = lm.score_texts(docs, counts, model).collect()
    found = sorted(((r[0], r[1], r[2], r[3]) for r in got), key=repr)
    for a, b in zip(found, want, strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9)
    # All texts together are likelier than under single words, held out ones too.
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 7 == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got)
    assert lm.score_texts(docs.filter("false"), counts, model).collect() == []


def test_probabilities_are_normalised_and_learned():
    rng = np.random.default_rng(1)
    outcomes, side = 6, 7
    truth = rng.dirichlet(np.full(outcomes, 0.3), side)
    counts = np.round(5000 * truth[np.tile(np.arange(side), side)]).reshape(-1)
    logp = lm.train(counts, outcomes, steps=400).reshape(side * side, outcomes).astype(np.float64)
    assert np.allclose((10**logp).sum(axis=1), 1, atol=1e-4)
    n = counts.reshape(side * side, outcomes)
    unigram = np.log10(n.sum(axis=0) / n.sum())
    best = np.log10(np.maximum(n / n.sum(axis=1, keepdims=True), 1e-9))
    assert (n * logp).sum() > 0.15 * (n * unigram).sum() + 0.85 * (n * best).sum()


def test_language_model_of_nothing(spark, corpus):
    _, docs = corpus
    counts, model = lm.learn(docs.filter("false"))
    rows = lm.score_texts(docs, counts, model).collect()
    assert all(r["n_known"] == 0 and r["base_score"] == 0 for r in rows)
