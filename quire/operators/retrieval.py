"""Per-document TF-IDF index and cosine top-k search.

One shuffle moves each document's text to the partition of its key; chunking,
document frequencies and norms then all work within that partitioning, so they add
sorts but no exchange, and the questions come to it in one exchange.  A stored index is
bucketed by document, so that a search moves the questions only.  Of a question's hits
only the best k are gathered.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.split import is_term, retrieval_chunks, run_count, run_term, token_runs
from quire.functions.text import is_blank, trim_ws
from quire.operators.skew import HOT_ROWS, SALT, copy_per_salt, hot_list, salt_rows
from quire.session import shared_dir, shuffle_width

TOP_K = 4
DOC = ("doc_id",)
LISTED = 10_000


@dataclass(frozen=True)
class Index:
    """chunks(keys, chunks array), postings(keys, chunk_index, term, ...)."""

    chunks: DataFrame
    postings: DataFrame


def chunk_documents(documents: DataFrame, keys: tuple[str, ...] = DOC) -> DataFrame:
    """One row per document with its chunk array, partitioned by the keys."""
    return (
        documents.select(*keys, "text")
        .repartition(shuffle_width(documents.sparkSession), *keys)
        .select(*keys, retrieval_chunks(F.col("text")).alias("chunks"))
    )


def explode_chunks(chunked: DataFrame, keys: tuple[str, ...] = DOC) -> DataFrame:
    # The outer form keeps the optimizer from adding a size() filter that would
    # cut every text twice.
    return chunked.select(
        *keys,
        F.size("chunks").alias("n_chunks"),
        F.posexplode_outer("chunks").alias("chunk_index", "text"),
    ).where(F.col("chunk_index").isNotNull())


def count_terms(df: DataFrame, text: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, term, occurrences) of each row."""
    runs = df.select(*keys, F.explode_outer(token_runs(F.col(text))).alias("run"))
    terms = runs.select(*keys, run_term(F.col("run")).alias("term"), run_count(F.col("run")).alias("occurrences"))
    return terms.where(is_term(F.col("term")))


def weigh_terms(terms: DataFrame, keys: tuple[str, ...] = DOC) -> DataFrame:
    """Add df, idf, weight and the chunk norm to (keys, n_chunks, chunk_index, term)."""
    by_term = Window.partitionBy(*keys, "term")
    by_chunk = Window.partitionBy(*keys, "chunk_index")
    return (
        terms.withColumns(
            {
                "df": F.count(F.lit(1)).over(by_term),
                "_first": F.min("chunk_index").over(by_term),
            }
        )
        .withColumn("idf", F.log((F.col("n_chunks") + 1) / (F.col("df") + 0.5)))
        .withColumn("weight", (F.log(F.col("occurrences").cast("double")) + 1) * F.col("idf"))
        .withColumn("norm", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(by_chunk)))
        .withColumn("leads_term", F.col("chunk_index") == F.col("_first"))
        .drop("_first")
    )


def build_index(documents: DataFrame, keys: tuple[str, ...] = DOC) -> Index:
    chunked = chunk_documents(documents, keys)
    terms = count_terms(explode_chunks(chunked, keys), "text", (*keys, "n_chunks", "chunk_index"))
    return Index(chunked, weigh_terms(terms, keys))


@dataclass(frozen=True)
class StoredIndex:
    """An index in two tables that are bucketed and sorted by document.

    chunks(doc_id, chunks) and terms(doc_id, term, idf, hits): a row per term, with
    its chunks as hits(part, chunk_index), strongest first.  A part is the chunk's
    weight of the term divided by the chunk's norm.
    """

    chunks: DataFrame
    terms: DataFrame


def _table_name(kind: str, path: str) -> str:
    return f"quire_{kind}_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def write_index(index: Index, path: str, buckets: int | None = None) -> None:
    """Write an index below a path of the shared folder, as tables of `buckets` files.

    The number defaults to the width of the text shuffle, whose partitions then are the
    buckets, so that nothing is moved again.
    """
    part = F.col("weight") / F.nullif(F.col("norm"), F.lit(0.0))
    hits = F.sort_array(F.collect_list(F.struct(part.alias("part"), "chunk_index")), asc=False)
    terms = index.postings.groupBy("doc_id", "term").agg(
        F.first("idf").alias("idf"), hits.alias("hits")
    )
    n = buckets or shuffle_width(index.chunks.sparkSession)
    for kind, table, order in (("chunks", index.chunks, ()), ("terms", terms, ("term",))):
        if buckets:
            table = table.repartition(buckets, "doc_id")
        (
            table.write.mode("errorifexists").format("parquet")
            .bucketBy(n, "doc_id").sortBy("doc_id", *order)
            .option("path", f"{path}/{kind}").saveAsTable(_table_name(kind, path))
        )
    index.chunks.sparkSession.range(1).select(F.lit(n).alias("buckets")).write.json(f"{path}/layout")


def read_index(spark: SparkSession, path: str) -> StoredIndex:
    """An index that write_index has written, by this session or by another one."""
    n = spark.read.json(f"{path}/layout").first()["buckets"]
    tables = []
    for kind, order in (("chunks", "doc_id"), ("terms", "doc_id, term")):
        name, place = _table_name(kind, path), f"{path}/{kind}"
        if not spark.catalog.tableExists(name):
            columns = ", ".join(
                f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(place).schema
            )
            spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet "
                f"CLUSTERED BY (doc_id) SORTED BY ({order}) INTO {n} BUCKETS LOCATION '{place}'"
            )
        tables.append(spark.table(name))
    return StoredIndex(*tables)


def stored_index(documents: DataFrame, path: str | None = None) -> StoredIndex:
    """Build once in the shared folder, search many times."""
    spark = documents.sparkSession
    path = path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    write_index(build_index(documents), path)
    return read_index(spark, path)


def pick_chunks(
    documents: DataFrame, questions: DataFrame, k: int = TOP_K, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Index the documents and rank chunks for questions(question_id, doc_id, question).

    One row per question with its picks in rank order.  A question_id comes once per
    document.  A document that many questions ask about is copied once per salt before
    it is indexed, and its questions are spread over the copies.
    """
    # Documents that nobody asks about drop out before their text moves.
    asked = questions.where(~is_blank(F.col("question"))).select("doc_id").distinct()
    wanted = documents.select("doc_id", "text").join(asked, "doc_id", "left_semi")
    hot = hot_list(questions, "doc_id", hot_rows)
    if not hot:
        return _pick(build_index(wanted), questions, k, DOC)
    keys = (*DOC, SALT)
    index = build_index(copy_per_salt(wanted, _table_of(wanted, hot), "doc_id"), keys)
    return _pick(index, salt_rows(questions, _table_of(questions, hot), "doc_id", "question_id"), k, keys)


def _table_of(like: DataFrame, hot: list[tuple]) -> DataFrame:
    kind = like.schema["doc_id"].dataType.simpleString()
    return like.sparkSession.createDataFrame(hot, f"doc_id {kind}, _salts int")


def search_documents(
    documents: DataFrame, questions: DataFrame, k: int = TOP_K, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """pick_chunks with one row per pick."""
    return _one_row_per_pick(pick_chunks(documents, questions, k, hot_rows))


def search_index(
    index: StoredIndex,
    questions: DataFrame,
    k: int = TOP_K,
    hot_rows: int = HOT_ROWS,
    listed: int = LISTED,
) -> DataFrame:
    """search_documents over an index that was built and written before.

    Up to `listed` different documents are asked for by name, so that only their
    buckets, and in these only row groups that may hold them, are read; questions about
    more documents than that are in nearly all buckets anyway.  Neither table is moved,
    but for documents that very many questions ask about: these are copied and spread.
    """
    ids = [r[0] for r in questions.select("doc_id").distinct().limit(listed + 1).collect()]
    named = [i for i in ids if i is not None]
    if len(ids) <= listed:
        index = StoredIndex(*(t.where(F.col("doc_id").isin(named)) for t in (index.chunks, index.terms)))
    hot = hot_list(questions, "doc_id", hot_rows)
    if not hot:
        return _one_row_per_pick(_pick(index, questions, k, DOC))
    is_hot = F.coalesce(F.col("doc_id").isin([doc for doc, _ in hot]), F.lit(False))
    cold = _pick(index, questions.where(~is_hot), k, DOC)
    keys = (*DOC, SALT)
    copies = StoredIndex(
        *(
            copy_per_salt(t.where(is_hot), _table_of(t, hot), "doc_id")
            .repartition(shuffle_width(t.sparkSession), *keys)
            for t in (index.chunks, index.terms)
        )
    )
    salted = salt_rows(questions.where(is_hot), _table_of(questions, hot), "doc_id", "question_id")
    return _one_row_per_pick(cold.unionByName(_pick(copies, salted, k, keys)))


def _one_row_per_pick(picked: DataFrame) -> DataFrame:
    rows = picked.select(
        "doc_id", "question_id", "question", "n_chunks", F.explode_outer("picks").alias("_pick")
    )
    return rows.where(F.col("_pick").isNotNull()).select(
        "doc_id", "question_id", "question", "_pick.*", "n_chunks"
    )


def _asked_terms(questions: DataFrame, ask: tuple[str, ...]) -> DataFrame:
    """(ask, question, term, asked): a row per distinct token of each question.

    A first row with no term holds the question; tokens that are no terms have none.
    """
    q = questions.where(~is_blank(F.col("question"))).select(
        *ask, trim_ws(F.col("question")).alias("question")
    )
    runs = F.concat(F.array(F.lit("")), token_runs(F.col("question")))
    rows = q.select(*ask, "question", F.posexplode_outer(runs).alias("_at", "run"))
    term = run_term(F.col("run"))
    return rows.select(
        *ask,
        F.when(F.col("_at") == 0, F.col("question")).alias("question"),
        F.when(is_term(term), term).alias("term"),
        (F.log(run_count(F.col("run")).cast("double")) + 1).alias("asked"),
    )


def _scores(postings: DataFrame, asked: DataFrame, keys: tuple[str, ...], ask: tuple[str, ...]) -> DataFrame:
    """(ask, question, chunk_index, score) from postings by chunk; one row of each
    question has no chunk."""
    # Size estimates do not see that exploding text multiplies rows: never let
    # them turn the index into a broadcast.
    weight = F.col("asked") * F.col("idf")
    hits = asked.join(postings.hint("merge"), [*keys, "term"], "left").select(
        *ask, "question", "chunk_index", "norm",
        (weight * F.col("weight")).alias("dot"),
        # Once per asked term, whatever number of chunks holds it.
        F.when(F.col("leads_term"), weight * weight).otherwise(0.0).alias("square"),
    )
    per_chunk = hits.groupBy(*ask, "chunk_index").agg(
        F.max("question").alias("question"),
        F.sum("dot").alias("dot"),
        F.first("norm").alias("norm"),
        F.sum("square").alias("square"),
    )
    size = F.sqrt(F.sum("square").over(Window.partitionBy(*ask)))
    part = F.col("dot") / F.nullif("norm", F.lit(0.0))
    return per_chunk.select(*ask, "question", "chunk_index", (part / size).alias("score"))


def _bounded_scores(
    terms: DataFrame, asked: DataFrame, keys: tuple[str, ...], ask: tuple[str, ...], k: int
) -> DataFrame:
    """The same from lists of hits by term, without hits that cannot reach rank k.

    A term's k strongest hits are k chunks that score at least the weakest of these,
    so the best of these floors holds for rank k.  A chunk scores no more than its part
    of one term and the strongest parts of all others: a hit for which that is below
    the floor is left out before the lists are taken apart.
    """
    joined = asked.join(terms.hint("merge"), [*keys, "term"], "left").withColumn(
        "weight", F.col("asked") * F.col("idf")
    )
    of_question = Window.partitionBy(*ask)
    most = F.get("hits", F.lit(0))["part"]
    least = F.get("hits", F.lit(k - 1))["part"]
    bounded = joined.withColumns(
        {
            "size": F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(of_question)),
            "reach": F.sum(F.col("weight") * most).over(of_question),
            "floor": F.max(F.col("weight") * least).over(of_question),
        }
    )
    others = F.col("reach") - F.col("weight") * most
    # A margin for sums in another order.
    enough = F.coalesce(F.col("floor") * (1 - 1e-9), F.lit(0.0))
    kept = F.filter(
        "hits", lambda h: h["part"].isNull() | (F.col("weight") * h["part"] + others >= enough)
    )
    hits = bounded.select(*ask, "question", "size", "weight", F.explode_outer(kept).alias("hit"))
    return hits.groupBy(*ask, F.col("hit.chunk_index").alias("chunk_index")).agg(
        F.max("question").alias("question"),
        (F.sum(F.col("weight") * F.col("hit.part")) / F.max("size")).alias("score"),
    )


def _pick(index: Index | StoredIndex, questions: DataFrame, k: int, keys: tuple[str, ...]) -> DataFrame:
    """One row per question: doc_id, question_id, question, n_chunks, picks."""
    ask = (*keys, "question_id")
    asked = _asked_terms(questions, ask)
    if isinstance(index, StoredIndex):
        scores = _bounded_scores(index.terms, asked, keys, ask, k)
    else:
        scores = _scores(index.postings, asked, keys, ask)
    # Rounding makes the order independent of the order of summation.
    scored = scores.withColumn("key", -F.round("score", 12))
    # The row that holds the question comes first, so k + 1 rows hold it and k hits.
    is_hit = F.col("chunk_index").isNotNull()
    rank = F.row_number().over(Window.partitionBy(*ask).orderBy(is_hit, "key", "chunk_index"))
    found = F.slice(
        F.sort_array(F.collect_list(F.when(is_hit, F.struct("key", "chunk_index")))), 1, k
    )
    top = (
        scored.withColumn("_rank", rank).where(F.col("_rank") <= k + 1)
        .groupBy(*ask)
        .agg(F.max("question").alias("question"), found.alias("found"))
    )
    # No filter on the chunk array here: it would move below the shuffle and
    # cut every text a second time.
    joined = top.join(index.chunks.hint("merge"), [*keys])
    # Chunks without a shared term have similarity 0 and fill up in index order.
    spare = F.filter(
        F.transform("chunks", lambda _, i: i),
        lambda i: ~F.exists("found", lambda f: f["chunk_index"] == i),
    )
    filled = F.concat(
        "found",
        F.transform(
            F.slice(spare, F.lit(1), F.greatest(F.lit(k) - F.size("found"), F.lit(0))),
            lambda i: F.struct(F.lit(0.0).alias("key"), i.alias("chunk_index")),
        ),
    )
    picks = F.transform(
        filled,
        lambda f, i: F.struct(
            (i + 1).alias("rank"),
            f["chunk_index"].alias("chunk_index"),
            F.abs(f["key"]).alias("similarity"),
            F.get("chunks", f["chunk_index"]).alias("text"),
        ),
    )
    return joined.select(
        "doc_id", "question_id", "question", F.size("chunks").alias("n_chunks"), picks.alias("picks")
    )
