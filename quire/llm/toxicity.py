"""Toxicity by compression distance.

Two zstandard dictionaries are made from a bounded sample of labelled documents:
one of the words that recur in ordinary documents, one of the words that recur in
toxic documents and are rare in ordinary ones.  A window, a few words with a fixed
tail that both dictionaries hold, is compressed with each; where the toxic
dictionary saves `MARGIN` bytes or more over the ordinary one, the window counts as
a toxic hit.  A document's share of hits, against a threshold calibrated on labelled
documents that made neither dictionary, gives its score.

The dictionaries are raw content in order of document frequency, so that sizes
differ by matches alone; those that zstandard's own trainer picks from such short
windows miss most recurring words (see README).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from quire.llm.arrow import map_rows, plain_words
from quire.llm.frequent import most_frequent

SAMPLE_TOXIC = 6000  # labelled documents at most, about; see labelled_sample
SAMPLE_ORDINARY = 12000
CALIBRATION_PART = 3  # one in so many sampled documents calibrates
RECURRING = 0.01  # of the toxic sample's documents
LIFT = 10.0  # times the word's share of ordinary documents
LEAST_DOCUMENTS = 4
TOXIC_WORDS = 2000
ORDINARY_WORDS = 4000
WINDOW_WORDS = 1
MARGIN = 3  # bytes
CUT = 0.7  # score at the calibrated threshold
CACHED = 150_000
TAIL = b"||||================"


@dataclass(frozen=True)
class ToxicityModel:
    """What a task needs to score: both dictionaries' content and the threshold."""

    toxic: bytes
    ordinary: bytes
    threshold: float
    window: int = WINDOW_WORDS
    margin: int = MARGIN


class Hits(dict):
    """Whether a window of words is a toxic hit, computed once per distinct window."""

    def __init__(self, model: ToxicityModel):
        import zstandard as zs

        def compressor(content: bytes):
            params = zs.ZstdCompressionParameters(
                window_log=17, hash_log=16, chain_log=16, search_log=5, min_match=4,
                strategy=zs.STRATEGY_LAZY, format=zs.FORMAT_ZSTD1_MAGICLESS,
                write_content_size=0, write_checksum=0, write_dict_id=0,
            )
            dictionary = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            return zs.ZstdCompressor(dict_data=dictionary, compression_params=params).compress

        self.by_toxic = compressor(model.toxic) if model.toxic else None
        self.by_ordinary = compressor(model.ordinary)
        self.margin = model.margin

    def __missing__(self, window: bytes) -> int:
        if self.by_toxic is None:
            return 0
        framed = b"|" + window + TAIL
        saved = len(self.by_ordinary(framed)) - len(self.by_toxic(framed))
        if len(self) >= CACHED:
            self.clear()
        hit = self[window] = int(saved >= self.margin)
        return hit


def windows(text: str | None, width: int) -> list[bytes]:
    words = plain_words(text)
    if width == 1:
        return words
    return [b" ".join(words[i : i + width]) for i in range(0, len(words), width)]


def counted(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...]) -> DataFrame:
    """keep columns, n_windows and n_hits for each row; keep are longs or ints."""

    def make(rows: Iterator[tuple]) -> Iterable[tuple]:
        hits = Hits(model)
        for *kept, text in rows:
            found = windows(text, model.window)
            yield *kept, len(found), sum(map(hits.__getitem__, found))

    source = docs.select(*(F.col(c).cast("long") for c in keep), F.col("text").cast("string"))
    columns = ", ".join(f"{c} long" for c in keep)
    return map_rows(source, make, f"{columns}, n_windows long, n_hits long")


def sample_key(name: str = "doc_id") -> Column:
    """A hash of the id in [0, 2 ** 31), even over ids."""
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(name).cast("long")), F.lit(1 << 31))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, toxic: int, ordinary: int
) -> DataFrame:
    """doc_id, text, label, part of a sample of labelled documents.

    Of each label's rows those are taken whose hashed id is below a threshold that
    lets through `toxic` or `ordinary` documents on average, all if there are fewer.
    Equal texts of a label count once.  part 0 calibrates, the others make the
    dictionaries.
    """
    clean = labels.select(
        F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label")
    ).filter("doc_id is not null and label in (0, 1)")
    sizes = {r["label"]: r["count"] for r in clean.groupBy("label").count().collect()}
    limit = {1: toxic, 0: ordinary}
    edge = {k: int((1 << 31) * min(1.0, limit[k] / max(1, sizes.get(k, 0)))) for k in limit}
    key = sample_key()
    chosen = (
        clean.filter(
            ((F.col("label") == 1) & (key < edge[1])) | ((F.col("label") == 0) & (key < edge[0]))
        )
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    # About toxic + ordinary rows by the thresholds above: small enough to broadcast.
    return (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("label", "text")
        .agg(F.min("doc_id").alias("doc_id"))
        .withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(CALIBRATION_PART)))
    )


def document_frequencies(sample: DataFrame) -> DataFrame:
    """word (binary), toxic, ordinary: in how many documents of either label."""

    def make(rows: Iterator[tuple]) -> Iterable[tuple]:
        for label, text in rows:
            for word in set(plain_words(text)):
                if len(word) <= 64:
                    yield word, label

    return (
        map_rows(sample.select("label", "text"), make, "word binary, label int")
        .groupBy("word")
        .agg(
            F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("ordinary")
        )
    )


def learn(
    docs: DataFrame,
    labels: DataFrame,
    toxic: int = SAMPLE_TOXIC,
    ordinary: int = SAMPLE_ORDINARY,
) -> ToxicityModel:
    """Dictionaries and threshold from labelled documents; ids must be distinct.

    Bounded: about toxic + ordinary documents are read, TOXIC_WORDS and
    ORDINARY_WORDS words come to the driver, and two counts per calibration document.
    """
    from quire.session import materialize

    sample = materialize(labelled_sample(docs, labels, toxic, ordinary), "toxicity-sample")
    made = sample.filter("part <> 0")
    sizes = {r["label"]: r["count"] for r in made.groupBy("label").count().collect()}
    n_toxic, n_ordinary = sizes.get(1, 0), sizes.get(0, 0)
    frequencies = materialize(document_frequencies(made), "toxicity-words")
    least = max(LEAST_DOCUMENTS, RECURRING * n_toxic)
    telling = frequencies.filter(F.col("toxic") >= least).filter(
        F.col("toxic") * max(1, n_ordinary) >= F.col("ordinary") * LIFT * max(1, n_toxic)
    )
    marked = (
        most_frequent(telling, "toxic", TOXIC_WORDS, fill=True)
        .orderBy(F.desc("toxic"), "word").collect()
    )
    usual = (
        most_frequent(frequencies, "ordinary", ORDINARY_WORDS, fill=True)
        .orderBy(F.desc("ordinary"), "word").collect()
    )
    # The most frequent words come last, nearest to what is compressed.
    content = [b"|" + b"|".join(bytes(r["word"]) for r in reversed(rows)) + TAIL if rows else b""
               for rows in (marked, usual)]
    model = ToxicityModel(content[0], content[1] or TAIL, 1.0)
    seen = counted(sample.filter("part = 0"), model, ("label",)).collect()
    label = np.array([r["label"] for r in seen], dtype=np.int64)
    share = np.array([r["n_hits"] / max(1, r["n_windows"]) for r in seen])
    return ToxicityModel(content[0], content[1] or TAIL, best_threshold(share, label))


def best_threshold(share: np.ndarray, label: np.ndarray) -> float:
    """The share of hits from which calling a document toxic gives the best F1."""
    if not len(label) or not label.any():
        return 0.01
    order = np.argsort(-share, kind="stable")
    ranked, truth = share[order], label[order]
    right = np.cumsum(truth)
    f1 = 2 * right / (np.arange(1, len(truth) + 1) + truth.sum())
    # Only where the next document has a lower share can a threshold lie.
    ends = np.append(ranked[1:] < ranked[:-1], True) & (ranked > 0)
    if not ends.any():
        return 0.01
    at = int(np.argmax(np.where(ends, f1, -1)))
    below = ranked[at + 1] if at + 1 < len(ranked) else 0.0
    return float((ranked[at] + below) / 2)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted for each row of docs(doc_id, text).

    A share of hits at the threshold scores CUT; no hits, null and empty texts
    score 0, and repeated rows score alike.
    """
    share = F.col("n_hits") / F.greatest(F.lit(1), F.col("n_windows"))
    scale = model.threshold * (1 - CUT) / CUT
    return (
        counted(docs, model, ("doc_id",))
        .withColumn("score", share / (share + F.lit(scale)))
        .select("doc_id", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
    )
