"""Saved summaries: validate, upsert, delete, list, count.

Everything before a cap is a combinable aggregation (latest write per id).  A cap
is an option and holds per owner: a rank within the owner's entries, so histories of
any number of owners are cut independently and nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.jsonx import checked_summary, string_at, type_at
from quire.functions.prompts import LENGTHS


def checked_entry(v: Column) -> Column:
    """Struct of a valid entry, else NULL.  Nullable fields must be present."""

    def null_or(path: str, *types: str) -> Column:
        kind = type_at(v, path)
        known = kind == "VOID"
        for t in types:
            known = known | F.startswith(kind, F.lit(t))
        return F.coalesce(known, F.lit(False))

    entry = F.struct(
        string_at(v, "$.id").alias("id"),
        string_at(v, "$.createdAt").alias("created_at"),
        string_at(v, "$.fileName").alias("file_name"),
        string_at(v, "$.sourceTypeLabel").alias("source_type_label"),
        string_at(v, "$.length").alias("length"),
        F.try_variant_get(v, "$.sourceWordCount", "bigint").alias("source_word_count"),
        checked_summary(v, "$.summary").alias("summary"),
    )
    valid = (
        (F.coalesce(string_at(v, "$.id"), F.lit("")) != "")
        & string_at(v, "$.createdAt").isNotNull()
        & null_or("$.fileName", "STRING")
        & null_or("$.sourceTypeLabel", "STRING")
        & F.coalesce(string_at(v, "$.length").isin(*LENGTHS), F.lit(False))
        & null_or("$.sourceWordCount", "BIGINT", "DECIMAL", "DOUBLE", "INT")
        & checked_summary(v, "$.summary").isNotNull()
    )
    return F.when(valid, entry)


def read_entries(stored: DataFrame, text: str = "value", *keep: str) -> DataFrame:
    """Valid entries of a stored JSON array; anything else gives no rows."""
    v = F.try_parse_json(F.col(text))
    items = F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>"))
    return (
        stored.select(*keep, F.posexplode(items).alias("position", "_item"))
        .withColumn("_entry", checked_entry(F.col("_item")))
        .where(F.col("_entry").isNotNull())
        .select(*keep, "position", "_entry.*")
    )


def latest_per_id(writes: DataFrame, *order: str) -> DataFrame:
    """Last write of each id by ``order`` (default seq), with map-side combination."""
    columns = [c for c in writes.columns if c != "id"]
    return (
        writes.groupBy("id")
        .agg(F.max_by(F.struct(*columns), F.struct(*(order or ("seq",)))).alias("_last"))
        .select("id", "_last.*")
    )


def newest_first(entries: DataFrame) -> DataFrame:
    return entries.orderBy(F.desc("created_at"), F.desc("seq"), "id")


def cap_entries(
    entries: DataFrame, newest: Column, limit: int | None = None, owner: str | None = None
) -> DataFrame:
    """The first ``limit`` entries of each ``owner``, ``newest`` in front whatever its
    date.  Without a limit all stay; without an owner there is one list, a top-k."""
    order = [F.desc(newest), F.desc("created_at"), F.desc("seq"), "id"]
    if limit is None:
        return entries
    if owner is None:
        return entries.orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(*order))
    return entries.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def save_entries(
    existing: DataFrame,
    new: DataFrame,
    limit: int | None = None,
    owner: str | None = None,
    by_seq: bool = False,
) -> DataFrame:
    """Upsert by id: existing and new carry ``seq``; new ones are written later.

    With ``by_seq`` the higher ``seq`` stays whichever came first, so that writes may
    arrive in any order; equal ones are replaced.

    The last write stays even if its date is the oldest, as when it is put in
    front before the list is cut.
    """
    writes = existing.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    merged = latest_per_id(writes, *(("seq", "_new") if by_seq else ("_new", "seq")))
    if limit is None:
        return merged.drop("_new")
    by = [owner] if owner else []
    last = new.groupBy(*by).agg(F.max("seq").alias("_last_seq")).withColumn("_new", F.lit(True))
    marked = (
        merged.join(last, ["_new", *by], "left")  # one row per owner
        .withColumn("_front", F.coalesce(F.col("seq") == F.col("_last_seq"), F.lit(False)))
    )
    return cap_entries(marked, F.col("_front"), limit, owner).drop("_new", "_front", "_last_seq")


def delete_entries(existing: DataFrame, ids: DataFrame) -> DataFrame:
    return existing.join(ids.select("id").distinct(), "id", "left_anti")


def history_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct(F.coalesce("file_name", "id")).alias("documents"),
        F.max("created_at").alias("last_activity"),
    )
