import numpy as np
from tokenizers import Tokenizer

from quire.llm.packing import default_tokenizer, word_tokens


def test_words_are_kept_by_their_parts():
    own, text = word_tokens(default_tokenizer()), "alpha-beta, (gamma) alpha; x9"
    ids = np.frombuffer(own.ids(text), dtype="<u4").tolist()
    assert ids == Tokenizer.from_file(default_tokenizer()).encode(text, add_special_tokens=False).ids
    assert {b"alpha", b"beta", b"gamma"} <= set(own)
