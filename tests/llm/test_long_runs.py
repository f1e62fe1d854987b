"""Language identification reads runs of letters of any length to their end."""

import random

import pytest

from quire.llm import langid

LETTERS = {"aa": "abcdefgh", "zh": "漢字仮名交文章語", "zz": "春夏秋冬東西南北"}


@pytest.mark.parametrize("size", [1, 64, 65, 66, 67, 126, 127, 128, 129, 130, 1000])
def test_each_gram_starts_in_one_piece(size):
    rng = random.Random(size)
    run = "".join(rng.choices("abcdefgh", k=size))
    whole, seen = f" {run} ", []
    for piece in langid.words_of(run):
        held = langid.padded(piece)
        seen += [held[i : i + 4] for i in range(langid.places(piece, held))]
    assert seen == [whole[i : i + 4] for i in range(size + 2)]


def test_long_runs_are_read_to_their_end(spark):
    rng = random.Random(2)

    def run(lang, k):
        return "".join(rng.choices(LETTERS[lang], k=k))

    rows = [(i, run(lang, 200), lang) for i, lang in enumerate(sorted(LETTERS) * 30)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [(1, run("zh", 64) + run("zz", 2000)), (2, run("zz", 70) + run("zh", 2000)),
             (3, run("aa", 64) + run("zh", 100_000)), (4, run("zh", 30)), (5, rows[1][1])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, model).collect()}
    assert got == {1: "zz", 2: "zh", 3: "zh", 4: "zh", 5: "zh"}
    assert any(w.startswith(langid.PIECE) for w in model.words)  # pieces are met as learned
