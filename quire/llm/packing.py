"""Packing token sequences by minimum bin slack.

Each document is tokenized and closed with an end token.  Full windows are cut
off the front of a long document; what remains is one piece.  Pieces are gathered
in groups of a bounded number and each window is filled with the multiset of
remaining lengths whose sum is closest to its capacity: a bit set holds the sums
that can be reached, one shifted OR per length and power of two of its count, and
the counts that made the best sum are found by going back through the bit sets.

A task packs the rows of its own partition, so nothing is shuffled; the only
slack left is in windows no multiset fills, and the last window of a group is cut
into powers of two, which need no padding.

Null text counts as empty: one end token.  Repeated rows are packed once each.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quire.llm.arrow import map_rows
from quire.llm.bestfit import TextTokens

CAPACITY = 4096
END_ID = 2
GROUP_PIECES = 2048
SEQUENCES_PER_TASK = 1 << 33


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens(TextTokens):
    """Texts to their ids, the ids of each word kept from text to text."""


TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker's cache for a tokenizer file, kept from task to task."""
    if path not in TOKENS:
        TOKENS[path] = WordTokens(path)
    return TOKENS[path]


def best_fill(counts: Counter, capacity: int) -> list[int]:
    """Lengths, repeats included, whose sum is the largest not above `capacity`.

    Longer lengths are offered first, and backtracking prefers the shorter ones
    offered last, so of equal sums the one needing the fewest offers is taken.
    """
    mask = (1 << (capacity + 1)) - 1
    goal = 1 << capacity
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, power = min(counts[length], capacity // length), 1
        while left:
            take = min(power, left)
            grown = reach | (reach << (take * length)) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            power *= 2
        if reach & goal:
            break
    at = reach.bit_length() - 1
    chosen: list[int] = []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen += [length] * take
            at -= take * length
    return chosen


def fill_windows(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Indices of the pieces in each window; the longest piece left opens a window."""
    by_length: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        by_length.setdefault(n, []).append(i)
    counts = Counter({n: len(v) for n, v in by_length.items()})
    windows = []

    def take(n: int) -> int:
        counts[n] -= 1
        if not counts[n]:
            del counts[n]
        return by_length[n].pop()

    while counts:
        first = max(counts)
        window = [take(first)]
        fill = best_fill(counts, capacity - first) if capacity > first and counts else []
        window += [take(n) for n in fill]
        windows.append(window)
    return windows


def powers(total: int) -> list[int]:
    """A total as powers of two, largest first."""
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    group_pieces: int = GROUP_PIECES,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece of docs(doc_id, text): doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset and, with `with_ids`, the ids as binary
    (little-endian unsigned 32-bit).

    A sequence's pieces lie without a gap from offset 0.
    """
    path = tokenizer or default_tokenizer()
    end = end_id.to_bytes(4, "little")

    def make(rows: Iterator[tuple]) -> Iterable[tuple]:
        from pyspark import TaskContext

        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) * SEQUENCES_PER_TASK
        words = word_tokens(path)
        waiting: list[tuple] = []

        def out(piece: tuple, skip: int, length: int, seq: int, offset: int) -> tuple:
            doc_id, start, ids, total = piece
            part = ids[4 * skip : 4 * (skip + length)]
            row = (doc_id, start + skip, length, zlib.crc32(part), total, seq, offset)
            return (*row, part) if with_ids else row

        def close() -> Iterable[tuple]:
            nonlocal sequence
            windows = fill_windows([len(p[2]) // 4 for p in waiting], capacity)
            for n, window in enumerate(windows):
                pieces = [waiting[i] for i in window]
                used = sum(len(p[2]) // 4 for p in pieces)
                # The window that stays least full is cut so that nothing is padded.
                cuts = powers(used) if n == len(windows) - 1 else [used]
                piece, skip = 0, 0
                for room in cuts:
                    offset = 0
                    while offset < room:
                        length = min(len(pieces[piece][2]) // 4 - skip, room - offset)
                        yield out(pieces[piece], skip, length, sequence, offset)
                        offset += length
                        skip += length
                        if skip == len(pieces[piece][2]) // 4:
                            piece, skip = piece + 1, 0
                    sequence += 1
            waiting.clear()

        for doc_id, text in rows:
            ids = words.ids(text) + end
            total = len(ids) // 4
            full = total // capacity * capacity
            for start in range(0, full, capacity):
                piece = (doc_id, 0, ids, total)
                yield out(piece, start, capacity, sequence, 0)
                sequence += 1
            if full < total:
                waiting.append((doc_id, full, ids[4 * full :], total))
                if len(waiting) >= group_pieces:
                    yield from close()
        yield from close()

    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long" + (", ids binary" if with_ids else "")
    )
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_rows(source, make, schema)
