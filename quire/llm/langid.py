"""Language identification: known words first, then shorter and shorter n-grams.

A word that a language's table has counts with its log frequency there.  A word
that no table has is scored by its character n-grams of the largest size; at a
place where no language knows that n-gram the next smaller one is taken, down to
single characters.  A run of more than LONGEST letters counts as several words, its
pieces, to its end.  Tables come from a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from quire.llm.arrow import map_rows
from quire.session import materialize

SAMPLE = 4000  # labelled documents per language at most, about
WORDS = 20_000  # per language
GRAMS = 20_000  # per language and size
SIZES = (4, 3, 2, 1)
LANGUAGES = 400
CACHED = 200_000
LONGEST = 64  # characters of a word; longer runs of letters are cut into pieces
PIECE = "\0"  # what a piece starts with
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class LanguageModel:
    """Log frequencies by word and by n-gram, a row of floats per entry."""

    languages: list[str]
    words: dict[str, np.ndarray] = field(default_factory=dict)
    grams: dict[str, np.ndarray] = field(default_factory=dict)


def padded(word: str) -> str:
    """A word between spaces, or what a piece holds."""
    return word[1:] if word.startswith(PIECE) else f" {word} "


def places(word: str, held: str) -> int:
    """At how many places of padded(word) n-grams start; a piece's last characters are
    those that the next piece starts with."""
    return min(len(held), LONGEST) if word.startswith(PIECE) else len(held)


def pieces(run: str) -> Iterator[str]:
    """A run of letters as a word or, if it is longer than LONGEST, as pieces.

    Pieces overlap such that each n-gram of the padded run starts in just one of them.
    """
    if len(run) <= LONGEST:
        yield run
        return
    run = f" {run} "
    for at in range(0, len(run), LONGEST):
        yield PIECE + run[at : at + LONGEST + SIZES[0] - 1]


def words_of(text: str | None) -> list[str]:
    found = WORD.findall(text.lower()) if text else []
    if any(len(run) > LONGEST for run in found):
        return [piece for run in found for piece in pieces(run)]
    return found


def training_counts(sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n) and (lang, gram, n) over sample(lang, text)."""

    def split(rows: Iterator[tuple]) -> Iterable[tuple]:
        for lang, text in rows:
            counts: dict[str, int] = defaultdict(int)
            for word in words_of(text):
                counts[word] += 1
            for word, n in counts.items():
                yield lang, word, n

    def cut(rows: Iterator[tuple]) -> Iterable[tuple]:
        for lang, word, n in rows:
            held = padded(word)
            for size in SIZES:
                for i in range(min(places(word, held), len(held) - size + 1)):
                    yield lang, held[i : i + size], n

    words = (
        map_rows(sample.select("lang", "text"), split, "lang string, word string, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    words = materialize(words, "language-words")
    grams = map_rows(words, cut, "lang string, gram string, n long")
    return words, grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def most(counts: DataFrame, entry: str, limit: int, *by: str) -> list:
    """The `limit` most frequent entries of each group, with the group's total."""
    group = Window.partitionBy(*by)
    ranked = counts.withColumns(
        {
            "rank": F.row_number().over(group.orderBy(F.desc("n"), entry)),
            "total": F.sum("n").over(group),
        }
    )
    return ranked.filter(F.col("rank") <= limit).select("lang", entry, "n", "total").collect()


def table(rows: list, entry: str, place: dict[str, int], floors: dict) -> dict[str, np.ndarray]:
    """Log frequencies per language; a language without the entry gets its floor."""
    out: dict[str, np.ndarray] = {}
    for r in rows:
        key = r[entry]
        if key not in out:
            out[key] = floors[len(key)].copy() if entry == "gram" else floors[0].copy()
        out[key][place[r["lang"]]] = np.log(r["n"] / r["total"])
    return out


def learn(
    docs: DataFrame, per_language: int = SAMPLE, languages: int = LANGUAGES
) -> LanguageModel:
    """Tables from docs(doc_id, text, lang); rows with a null lang or text teach nothing.

    Bounded: about `per_language` documents of each language are read, and WORDS
    words and GRAMS n-grams of each size come to the driver for each language.
    More than `languages` distinct languages is an error.
    """
    known = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")
    ).filter("lang is not null and text is not null")
    sizes = known.groupBy("lang").count().limit(languages + 1).collect()
    if len(sizes) > languages:
        raise ValueError(f"more than {languages} languages")
    names = sorted(r["lang"] for r in sizes)
    if not names:
        return LanguageModel([])
    place = {name: i for i, name in enumerate(names)}
    key = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 31))
    edges = F.create_map(
        *(F.lit(x) for r in sizes
          for x in (r["lang"], int((1 << 31) * min(1.0, per_language / r["count"]))))
    )
    sample = known.filter(key < F.element_at(edges, F.col("lang")))
    words, grams = training_counts(sample)
    word_rows = most(words, "word", WORDS, "lang")
    gram_rows = most(grams.withColumn("size", F.length("gram")), "gram", GRAMS, "lang", "size")
    totals: dict[tuple[str, int], int] = {}
    for r in word_rows:
        totals[r["lang"], 0] = r["total"]
    for r in gram_rows:
        totals[r["lang"], len(r["gram"])] = r["total"]
    floors = {
        size: np.array([np.log(0.5 / max(1, totals.get((name, size), 1))) for name in names])
        for size in (0, *SIZES)
    }
    return LanguageModel(
        names, table(word_rows, "word", place, floors), table(gram_rows, "gram", place, floors)
    )


class Scores(dict):
    """word -> its row in `rows`, filled as words are seen."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.rows = np.zeros((1024, len(model.languages)))

    def __missing__(self, word: str) -> int:
        score = self.model.words.get(word)
        if score is None:
            score = self.by_grams(word)
        if len(self) == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        at = len(self)
        self.rows[at] = score
        self[word] = at
        return at

    def by_grams(self, word: str) -> np.ndarray:
        """The mean over the word's places of the largest n-gram known there."""
        grams, total, known = self.model.grams, np.zeros(self.rows.shape[1]), 0
        held = padded(word)
        for i in range(places(word, held)):
            for size in SIZES:
                if i + size <= len(held):
                    score = grams.get(held[i : i + size])
                    if score is not None:
                        total += score
                        known += 1
                        break
        return total / known if known else total

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > CACHED:
            self.clear()
        at = list(map(self.__getitem__, words))
        return self.rows[at].sum(axis=0)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs(doc_id, text).

    A text that is null or has no letter, and any text if nothing was learned, is
    `und` with score 0.  Ties go to the language that is first by name.  score is
    the language's share of the likelihood over all languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(rows: Iterator[tuple]) -> Iterable[tuple]:
        scores = Scores(shared.value)
        for doc_id, text in rows:
            if not text or not shared.value.languages or not any(map(str.isalpha, text)):
                yield doc_id, UNKNOWN, 0.0
                continue
            words = words_of(text) or list(pieces(text.lower()))
            total = scores.of(words)
            best = int(np.argmax(total))
            yield doc_id, shared.value.languages[best], float(
                1 / np.exp(total - total[best]).sum()
            )

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_rows(source, make, "doc_id long, lang_pred string, score double")
