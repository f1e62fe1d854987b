"""Fill-in-the-middle: a text cut in three and put together with its middle last.

Cuts are drawn over tokens or over code points.  Text stays UTF-8 bytes throughout:
a sparse index holds only the characters of more than one byte, their places and
the bytes they have beyond one, and a binary search in it turns code points into
bytes or bytes into code points.  A text of ASCII has an empty index, so its cuts
are the same numbers in both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
SEED = 42
RATE = 50  # of 100 texts, so many are cut
SPM = 80  # of 100 of those, so many have the suffix first
OUT_BYTES = 8 << 20
SCHEMA = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
)


class WideIndex:
    """The characters of more than one byte in UTF-8 text, and nothing else.

    `excess[i]` is the number of bytes beyond one of all characters before the i-th
    of them, so a cut at code point c lies `excess[how many start before c]` bytes
    further on.
    """

    def __init__(self, data: np.ndarray):
        self.byte_at = np.flatnonzero(data >= 0xC0)
        lead = data[self.byte_at]
        beyond = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(beyond)])
        self.char_at = self.byte_at - self.excess[:-1]

    def to_bytes(self, chars: np.ndarray) -> np.ndarray:
        return chars + self.excess[np.searchsorted(self.char_at, chars)]

    def to_chars(self, at: np.ndarray) -> np.ndarray:
        return at - self.excess[np.searchsorted(self.byte_at, at)]


def token_ends(data: np.ndarray) -> np.ndarray:
    """Byte positions where tokens end: white space goes to the word that follows.

    White space at the end of the text is a token of its own.
    """
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    return np.append(ends, len(data)) if len(data) else ends


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers of a document; a null id counts as empty."""
    key = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(key.encode()).digest()
    return np.frombuffer(digest[:16], dtype=">u4").tolist()


def cut(data: bytes, unit: str, first: int, second: int) -> tuple[int, list[int], list[int]]:
    """Number of units, byte cuts and code-point cuts of the prefix's and middle's end."""
    view = np.frombuffer(data, dtype=np.uint8)
    wide = WideIndex(view)
    if unit == "char":
        n = int(wide.to_chars(np.array([len(view)]))[0])
        chars = np.sort(np.array([first % (n + 1), second % (n + 1)], dtype=np.int64))
        return n, wide.to_bytes(chars).tolist(), chars.tolist()
    ends = token_ends(view)
    n = len(ends)
    starts = np.concatenate([np.zeros(1, dtype=np.int64), ends])
    at = starts[np.sort([first % (n + 1), second % (n + 1)])]
    return n, at.tolist(), wide.to_chars(at).tolist()


def infill(
    doc_id: int | None, data: bytes, unit: str, rate: int, spm: int, seed: int
) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    first, second, keep, order = draws(seed, doc_id)
    n, at, chars = cut(data, unit, first, second)
    if not data or keep % 100 >= rate or any(m in data for m in MARKS):
        return n, "plain", None, None, data
    view = memoryview(data)
    prefix, middle, suffix = view[: at[0]], view[at[0] : at[1]], view[at[1] :]
    p, s, m = MARKS
    if order % 100 < spm:
        form, out = "spm", b"".join((s, suffix, p, prefix, m, middle))
    else:
        form, out = "psm", b"".join((p, prefix, s, suffix, m, middle))
    return n, form, chars[0], chars[1] - chars[0], out


def infill_documents(
    docs: DataFrame, unit: str = "token", rate: int = RATE, spm: int = SPM, seed: int = SEED
) -> DataFrame:
    """docs(doc_id, text) as doc_id, n, form, prefix_chars, middle_chars, output.

    `unit` is `token` or `char`; n counts them.  Of 100 texts `rate` are cut, by the
    hash of the seed and the id, and of 100 of these `spm` have the suffix first.
    Empty texts and texts that hold a mark stay plain, with null lengths; a null text
    is empty, a null id is hashed as empty, and repeated rows give equal rows.  Other
    columns are left out.  Texts of any length are held one at a time; bytes that are
    not UTF-8 pass through as they are.  No rows give no rows, and nothing is shuffled.
    """
    if unit not in ("token", "char"):
        raise ValueError(f"unit must be token or char, not {unit!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for doc_id, text in zip(ids, texts):
                buffer = text.as_buffer()
                data = buffer.to_pybytes() if buffer is not None else b""
                row = (doc_id.as_py(), *infill(doc_id.as_py(), data, unit, rate, spm, seed))
                held.append(row)
                size += len(row[-1])
                if size >= OUT_BYTES:
                    yield to_batch(held)
                    held, size = [], 0
        if held:
            yield to_batch(held)

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, SCHEMA)


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, n, form, prefix, middle, output = zip(*rows)
    longs = [pa.array(c, type=pa.int64()) for c in (doc_id, n, prefix, middle)]
    # A view: the bytes are those of the text, with marks of ASCII between.
    text = pa.array(output, type=pa.binary()).view(pa.string())
    return pa.RecordBatch.from_arrays(
        [*longs[:2], pa.array(form, type=pa.string()), *longs[2:], text],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    A text that is cut holds no mark, and no mark can begin in one part and end in
    another, so the first of each is the one that was put there.
    """

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substr(output, F.lit(len(left) + 1)), right, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    first_psm = between(PREFIX, SUFFIX)
    last_psm = F.substring_index(F.substring_index(output, MIDDLE, 1), SUFFIX, -1)
    last_spm = between(SUFFIX, PREFIX)
    first_spm = F.substring_index(F.substring_index(output, MIDDLE, 1), PREFIX, -1)
    return (
        F.when(form == "psm", F.concat(first_psm, middle, last_psm))
        .when(form == "spm", F.concat(first_spm, middle, last_spm))
        .otherwise(output)
    )
