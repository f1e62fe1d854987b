import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quire.llm import bestfit
from quire.llm.bestfit import (
    Lengths, Places, TextTokens, fill_bin, pack_whole_documents, plan_bins, text_tokens,
)

PATH = public_tokenizers.path("word_bpe_49k.json")
# The last two clash with names of the result.
SCHEMA = "doc_id long, text string, length string, sequence_id string"


def documents():
    rng = random.Random(5)
    words = ["alpha", "Beta,", "gamma.", "it's", "x-ray", "naïve", "42", "…", "漢字", "Évreux!!",
             "<|endoftext|>", "can't've", "$$$", "ŉ", "ﬁn"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 1200))), "a", None) for i in range(80)]
    rows += [(100, None, None, None), (101, "", "b", "b"), (102, "word " * 9000, "b", "b"),
             (3, rows[3][1], "a", "a"), (None, "no id", "a", "a"), (103, "w" * 70_000, "a", "a")]
    return rows


def packed(spark, rows, parts, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return pack_whole_documents(df, **options).collect()


def test_every_piece_lies_in_one_place(spark):
    rows = documents()
    reference = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = reference.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            data = np.array(ids[at : at + 2048], dtype="<u4").tobytes()
            want[doc_id, piece, at, len(data) // 4, zlib.crc32(data)] += 1
    for parts in (1, 7):
        got = packed(spark, rows, parts)
        for r in got:
            assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        assert Counter(tuple(r)[:5] for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for held in bins.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= 2048
        total = sum(k[3] * n for k, n in want.items())
        assert set(bins) == set(range(len(bins)))
        assert len(bins) <= -(-total // 2048) + 1


def test_the_split_into_tasks_changes_no_number_of_bins(spark):
    rows = documents()
    bins = {len({r["sequence_id"] for r in packed(spark, rows, n, with_ids=False)}) for n in (1, 3, 8)}
    assert len(bins) == 1


def one_by_one(lengths, capacity):
    """Best-two-fit over a list of pieces, bin after bin, pairs by trying all."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        held, room = [], capacity
        for n in list(left):
            if n <= room:
                left.remove(n)
                held.append(n)
                room -= n
        while room and len(held) > 1:
            least = held[-1]
            pairs = [(a + b, max(a, b)) for a, b in combinations(left, 2)
                     if least < a + b <= room + least]
            if not pairs:
                break
            best = max(s for s, _ in pairs)
            # Of equal sums the pair with the shortest piece.
            large = max(b for s, b in pairs if s == best)
            for n in (large, best - large):
                left.remove(n)
                held.append(n)
            held.remove(least)
            left = sorted([*left, least], reverse=True)
            held.sort(reverse=True)
            room = capacity - sum(held)
        bins.append(held)
    return bins


def test_plan_is_that_of_single_bins():
    rng = random.Random(8)
    for round_ in range(120):
        capacity = rng.randrange(5, 60)
        pool = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
        lengths = [rng.choice(pool) for _ in range(rng.randrange(0, 60))]
        plan = plan_bins(Counter(lengths), capacity)
        got = [tuple(b) for b, times in plan for _ in range(times)]
        assert got == [tuple(b) for b in one_by_one(lengths, capacity)], round_
        assert Counter(n for b in got for n in b) == Counter(lengths)
        assert all(sum(b) <= capacity for b in got)


def test_two_pieces_replace_the_shortest():
    lengths = Lengths({60: 1, 30: 1, 25: 1, 14: 2, 39: 0})
    # 60 + 30 leaves 10; 25 + 14 fills 39 of the 40 that open up without the 30.
    assert fill_bin(lengths, 100) == [60, 25, 14]
    assert lengths.left == {30: 1, 14: 1}
    # A pair of equal lengths needs two pieces of it.
    assert Lengths({20: 1, 7: 1}).tightest_pair(40) == (20, 7)
    assert Lengths({20: 2, 7: 1}).tightest_pair(40) == (20, 20)
    assert Lengths({20: 1}).tightest_pair(40) is None


def test_places_are_those_of_the_plan():
    counts = {7: 9, 5: 4, 3: 100, 1: 2}
    places = Places(counts, 10)
    bins = defaultdict(list)
    for n, c in counts.items():
        sequence, offset = places.find(np.full(c, n), np.arange(c))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            bins[s].append((o, n))
    want = [b for b, times in plan_bins(counts, 10) for _ in range(times)]
    assert [[n for _, n in sorted(bins[s])] for s in range(len(want))] == want


def test_huge_counts_need_a_short_plan():
    rng = random.Random(9)
    counts = {n: rng.randrange(10**9) for n in range(1, 2049)}
    plan = plan_bins(counts)
    assert len(plan) < 3 * 2048
    assert sum(times for _, times in plan) < 1.01 * sum(n * c for n, c in counts.items()) / 2048


def test_words_tokenize_like_texts():
    reference, own = Tokenizer.from_file(PATH), TextTokens(PATH)
    assert own.by_word
    texts = ["İstanbul ÇÖĞ Σας ΣΑΣ don't it's. 'tis x..., a.b c. O'NEIL'S 'Sa", "<|ENDOFTEXT|> a.\nb!\n",
             "<|endoftext|>X <|startoftext|> A'B<|endoftext|>", "é  z\x1cq\x85w ﬁ Ǆ ² ½ 漢字 한국어 🙂a",
             "\x00 \x1f\x7f", "Ħ ŉ ſ ı İ É ß ẞ", "a. b? ?! c; 12a34'll", " x\xa0y z ", "éa"]
    rng = random.Random(4)
    signs = "aB9'.st lLreévÉß<|>\t \n\x0b\x1d漢🙂́-$"
    texts += ["".join(rng.choices(signs, k=rng.randrange(1, 60))) for _ in range(400)]
    for text in texts:
        want = reference.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.ids(text), dtype="<u4").tolist() == want, text


def test_other_tokenizers_read_whole_texts():
    own = text_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    assert not own.by_word
    want = own.tokenizer.encode("Two  words\n", add_special_tokens=False).ids
    assert np.frombuffer(own.ids("Two  words\n"), dtype="<u4").tolist() == want


def test_cache_is_emptied_between_texts(monkeypatch):
    monkeypatch.setattr(bestfit, "CACHED_WORDS", 3)
    own = TextTokens(PATH)
    first = own.ids("one two three four five")
    own.ids("six seven")
    assert own.ids("one two three four five") == first


def test_empty_table(spark):
    assert pack_whole_documents(spark.createDataFrame([], SCHEMA)).collect() == []
