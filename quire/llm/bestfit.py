"""Packing whole documents into few sequences by best-two-fit.

A document is tokenized and closed with an end token; only one that is longer than a
sequence is cut.  A bin is filled greedily with the longest piece that still fits;
when none does, its shortest piece is replaced by the two unpacked pieces that fill
the widened gap most tightly, as long as that leaves less of a gap.

What a bin looks like follows from how many pieces there are of each length, and
nothing else.  So the counts, at most one per length, are all that the driver needs:
it fills a bin, repeats it for as long as every length in it lasts, and gets a plan
of some thousand bins with a number of times each, however many pieces there are.
The pieces never come together: each has a number among those of its length, from
counts per task and a running sum of these, and the plan tells where that number goes.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from quire.llm.arrow import LOWER, map_rows
from quire.session import materialize

CAPACITY = 2048
END_ID = 0
CACHED_WORDS = 300_000

# How the default tokenizer cleans and cuts a text.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
ASCII_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
COMPOSED_BELOW = "ɐ"  # letters below it are composed already
LATIN = [chr(c) for c in range(128, ord(COMPOSED_BELOW))]
LETTERS, NUMBERS = (
    "".join(c for c in LATIN if unicodedata.category(c)[0] == kind) for kind in "LN"
)
LATIN_SPACES = "\x85\xa0"
LATIN_PARTS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9{NUMBERS}]|[^a-z{LETTERS}0-9{NUMBERS}]+"
)


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level tokenizers show for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def cuts_words(tokenizer) -> bool:
    """Whether a tokenizer works word by word in the way that TextTokens relies on."""
    cleans, cuts = (
        json.loads(part.__getstate__()) if part else {}
        for part in (tokenizer.normalizer, tokenizer.pre_tokenizer)
    )
    split = cuts.get("pretokenizers") or [{}]
    return (
        cleans == NORMALIZER
        and getattr(tokenizer.model, "end_of_word_suffix", None) == "</w>"
        and split[0].get("pattern") == {"Regex": WORD_PATTERN}
        and [s.get("type") for s in split] == ["Split", "ByteLevel"]
    )


class TextTokens(dict):
    """Texts to their ids as little-endian 32-bit integers.

    A tokenizer that lower-cases, drops white space and cuts the rest into letters,
    digits and marks gives a text the ids of its words in order, so each word's ids
    are kept, up to CACHED_WORDS words: those of the time before and those since, so
    that frequent words stay when the rest goes.  A word of Latin letters is cut into its
    parts here and only the parts go to the model.  Of any other tokenizer whole texts are
    encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_word = cuts_words(self.tokenizer)
        self.letters = byte_letters()
        self.before: dict[bytes, bytes] = {}
        self.special = b"<|"  # special tokens are looked for in the text as it is

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self.encode(text)
        data = text.encode("utf-8", "replace")
        if self.special not in data:
            data = data.translate(LOWER)
        if len(self) > CACHED_WORDS // 2:
            self.before = dict(self)
            self.clear()
        return b"".join([self[word] for word in data.split()])

    def __missing__(self, word: bytes) -> bytes:
        out = self.before.get(word)
        if out is None:
            kept = len(self)
            out = self.ids_of(word)
            if len(self) > kept:  # its parts are new themselves: one place is enough
                return out
        self[word] = out
        return out

    def ids_of(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters only
            return self.one(word.translate(LOWER).decode())
        if word.isascii() and self.special not in word:
            parts = ASCII_PARTS.findall(word.translate(LOWER))
            if len(parts) > 1:
                return b"".join([self[p] for p in parts])
            return self.one(self.in_letters(parts[0]))
        shown = word.decode()
        lower = shown.lower()
        if max(shown) >= COMPOSED_BELOW or len(lower) != len(shown):
            return self.encode(shown)
        if shown.isalpha():
            return self.one(self.in_letters(lower.encode()))
        if "<|" in shown or any(c in shown for c in LATIN_SPACES):
            return self.encode(shown)
        parts = LATIN_PARTS.findall(lower)
        if len(parts) > 1:
            return b"".join([self[p.encode()] for p in parts])
        return self.one(self.in_letters(lower.encode()))

    def in_letters(self, part: bytes) -> str:
        return part.decode("latin-1").translate(self.letters)

    def one(self, part: str) -> bytes:
        """The ids of one part of a word, in the model's letters."""
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


TOKENS: dict[str, TextTokens] = {}


def text_tokens(path: str) -> TextTokens:
    """The worker's cache for a tokenizer file, kept from task to task."""
    if path not in TOKENS:
        TOKENS[path] = TextTokens(path)
    return TOKENS[path]


class Lengths:
    """Unpacked pieces by length."""

    def __init__(self, counts: dict[int, int]):
        self.left = Counter({n: c for n, c in counts.items() if c > 0})
        self.sorted = sorted(self.left)

    def longest(self, room: int) -> int | None:
        at = bisect_right(self.sorted, room)
        return self.sorted[at - 1] if at else None

    def take(self, n: int, times: int = 1) -> None:
        self.left[n] -= times
        if not self.left[n]:
            del self.left[n]
            self.sorted.remove(n)

    def put(self, n: int) -> None:
        if n not in self.left:
            insort(self.sorted, n)
        self.left[n] += 1

    def tightest_pair(self, room: int) -> tuple[int, int] | None:
        """The two lengths with the largest sum of at most `room`."""
        lengths = np.array(self.sorted[: bisect_right(self.sorted, room)], dtype=np.int64)
        small = lengths[: np.searchsorted(lengths, room // 2, side="right")]
        if not len(small):
            return None
        at = np.searchsorted(lengths, room - small, side="right") - 1
        large = lengths[at]
        # A length can be paired with itself only where two are left.
        single = np.array([self.left[int(n)] == 1 for n in small]) & (large == small)
        totals = np.where(single | (large < small), -1, small + large)
        best = int(np.argmax(totals))
        return (int(large[best]), int(small[best])) if totals[best] >= 0 else None


def fill_bin(lengths: Lengths, capacity: int) -> list[int]:
    """Take one bin's pieces out of `lengths`, longest first."""
    out, room = [], capacity
    while (n := lengths.longest(room)) is not None:
        lengths.take(n)
        out.append(n)
        room -= n
    # The piece that opened the bin stays: it will never be easier to place.
    while room and len(out) > 1:
        least = out[-1]
        pair = lengths.tightest_pair(room + least)
        if pair is None or sum(pair) <= least:
            break
        for n in pair:
            lengths.take(n)
        lengths.put(out.pop())
        out = sorted([*out, *pair], reverse=True)
        room = capacity - sum(out)
    return out


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as lists of lengths, longest first, each with how often it is filled.

    The same as filling one bin after the other: as long as each length of a bin
    lasts, the same choices come out again.
    """
    lengths = Lengths(counts)
    plan = []
    while lengths.sorted:
        bin_lengths = fill_bin(lengths, capacity)
        needs = Counter(bin_lengths)
        more = min(lengths.left[n] // c for n, c in needs.items())
        if more:
            for n, c in needs.items():
                lengths.take(n, c * more)
        plan.append((bin_lengths, more + 1))
    return plan


class Places:
    """Where the r-th piece of a length goes.

    Numbers run through all pieces, shorter lengths first; a stretch of them belongs
    to one bin of the plan, so a binary search finds the bin and arithmetic the rest.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        base = np.zeros(capacity + 2, dtype=np.int64)
        for n, c in counts.items():
            base[n + 1] = c
        self.base = np.cumsum(base)
        used: dict[int, int] = defaultdict(int)
        stretches = []
        first = 0
        for lengths, times in plan_bins(counts, capacity):
            offset = 0
            for n, c in sorted(Counter(lengths).items(), reverse=True):
                stretches.append((int(self.base[n]) + used[n], c, first, offset))
                used[n] += c * times
                offset += n * c
            first += times
        table = np.array(sorted(stretches), dtype=np.int64).reshape(-1, 4)
        self.starts, self.per_bin, self.first, self.offset = table.T.copy()

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces that are the number-th of their lengths."""
        at = self.base[length] + number
        i = np.searchsorted(self.starts, at, side="right") - 1
        k, c = at - self.starts[i], self.per_bin[i]
        return self.first[i] + k // c, self.offset[i] + k % c * length


def cut_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool
) -> DataFrame:
    """The pieces of docs, with the task that made each and its number of that length."""
    end = end_id.to_bytes(4, "little")

    def make(rows: Iterator[tuple]) -> Iterable[tuple]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        tokens = text_tokens(tokenizer)
        seen: Counter = Counter()
        for doc_id, text in rows:
            ids = memoryview(tokens.ids(text) + end).cast("B")
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                data = ids[at : at + 4 * capacity]
                length = len(data) // 4
                row = (part, doc_id, piece, at // 4, length, zlib.crc32(data), seen[length])
                yield (*row, bytes(data)) if with_ids else row
                seen[length] += 1

    schema = (
        "part int, doc_id long, piece int, start long, length long, ids_crc32 long, "
        "number long" + (", ids binary" if with_ids else "")
    )
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_rows(source, make, schema)


def pack_whole_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32,
    sequence_id, offset and, with `with_ids`, the ids as binary (little-endian unsigned
    32-bit).

    A sequence's pieces lie without a gap from offset 0, and the sequences are numbered
    from 0.  A null text is empty: one end token.  Repeated rows are packed once each,
    null ids too; other columns are left out, and no rows give no rows.  Only the
    number of pieces of each length, at most `capacity` numbers, comes to the driver;
    the plan that goes back grows with the number of lengths, not with the pieces.
    The pieces are written to the shared folder first, so that a lost executor does
    not number them anew.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = materialize(cut_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(counts, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = per_task.select(
        "part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            sequence, offset = places.find(length, batch.column("at").to_numpy())
            columns = [batch.column(name) for name in kept]
            columns[5:5] = [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [*kept[:5], "sequence_id", "offset", *kept[5:]]
    schema = (
        "doc_id long, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long" + (", ids binary" if with_ids else "")
    )
    numbered = pieces.join(before, ["part", "length"]).select(
        *kept, (F.col("number") + F.col("before")).alias("at")
    )
    return numbered.mapInArrow(run, schema)
