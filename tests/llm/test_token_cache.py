"""The cache of words' ids: what stays when it is full, and words of Latin letters."""

import random

from test_bestfit import PATH
from tokenizers import Tokenizer

from quire.llm import bestfit
from quire.llm.bestfit import TextTokens


def test_frequent_words_stay_when_rare_ones_go(monkeypatch):
    monkeypatch.setattr(bestfit, "CACHED_WORDS", 200)
    own, asked = TextTokens(PATH), []
    one = own.one
    own.one = lambda part: asked.append(part) or one(part)
    rng = random.Random(2)
    for _ in range(60):
        rare = ["".join(rng.choices("bcdfgh", k=9)) for _ in range(20)]
        own.ids(" ".join(["always", *rare]))
    assert asked.count("always") == 1
    assert len(own) + len(own.before) <= 250


def test_parts_of_latin_words_are_as_the_tokenizer_cuts_them():
    reference, own = Tokenizer.from_file(PATH), TextTokens(PATH)
    own.encode = None  # none of these needs the whole text to be encoded
    for text in ["été,", "«été»", "ª1²½", "É'S", "l'été.", "ciência###", "\xad\xadé", "·é·", "ßäen***", "ÀÉ½3"]:
        assert own.ids(text) == b"".join(
            i.to_bytes(4, "little") for i in reference.encode(text, add_special_tokens=False).ids
        )


def test_other_words_are_encoded_whole():
    reference, own = Tokenizer.from_file(PATH), TextTokens(PATH)
    for text in ["İx,", "ß\xa0x,", "a\x85é", "É<|endoftext|>é", "ﬁé,", "éé,", "€é", "ſs,"]:
        assert own.ids(text) == b"".join(
            i.to_bytes(4, "little") for i in reference.encode(text, add_special_tokens=False).ids
        )
