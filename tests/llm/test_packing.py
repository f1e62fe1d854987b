import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from tokenizers import Tokenizer

from quire.llm.packing import (
    WordTokens, best_fill, default_tokenizer, fill_windows, pack_documents, powers,
)

SCHEMA = "doc_id long, text string, length long, offset string"


def documents():
    rng = random.Random(3)
    words = ["alpha", "Beta,", "gamma.", "it's", "x-ray", "naïve", "42", "…", "漢字", "<|endoftext|>"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 900))), 1, "a") for i in range(60)]
    rows += [(100, None, None, None), (101, "", 1, "b"), (102, "word " * 30_000, 1, "b"),
             (3, rows[3][1], 1, "a")]
    return rows


def test_pieces_hold_every_id_once(spark):
    rows = documents()
    reference = Tokenizer.from_file(default_tokenizer())
    ids = Counter()
    for doc_id, text, *_ in rows:
        found = reference.encode(text or "", add_special_tokens=False).ids + [2]
        ids[doc_id, tuple(found)] += 1
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = pack_documents(df).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        part = np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist()
        assert len(part) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"], r["doc_tokens"]].append((r["start"], part))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    total = sum(len(k[1]) * n for k, n in ids.items())
    assert padding < 0.02 * total
    back = Counter()
    for (doc_id, size), pieces in docs.items():
        copies = Counter(start for start, _ in pieces)[0]
        flat = sorted(pieces)
        joined = [i for _, part in flat[::copies] for i in part]
        assert len(joined) == size
        back[doc_id, tuple(joined)] += copies
    assert back == ids


def test_words_tokenize_like_texts():
    reference = Tokenizer.from_file(default_tokenizer())
    own = WordTokens(default_tokenizer())
    for text in ["İstanbul ÇÖĞ Σας ΣΑΣ don't it's. 'tis x..., a.b c.", "<|ENDOFTEXT|> a.\nb!\n",
                 "é  z\x1cq\x85w ﬁ Ǆ ² ½ 漢字 한국어 🙂a", "\x00 ", "Ħ ŉ ſ ı İ", "a. b? ?! c;"]:
        want = reference.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.ids(text), dtype="<u4").tolist() == want


def test_best_fill_is_the_largest_subset_sum():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        capacity = rng.randrange(1, 60)
        sums = {sum(c) for n in range(len(lengths) + 1) for c in combinations(lengths, n)}
        chosen = best_fill(Counter(lengths), capacity)
        assert not Counter(chosen) - Counter(lengths)
        assert sum(chosen) == max(s for s in sums if s <= capacity)


def test_windows_take_each_piece_once():
    rng = random.Random(2)
    lengths = [rng.randrange(1, 64) for _ in range(300)]
    windows = fill_windows(lengths, 64)
    assert sorted(i for w in windows for i in w) == list(range(300))
    assert all(sum(lengths[i] for i in w) <= 64 for w in windows)
    assert powers(37) == [32, 4, 1] and powers(4096) == [4096]


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []
