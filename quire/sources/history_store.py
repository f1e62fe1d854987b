"""History kept as immutable versions of a small table.

Each change writes a fresh folder and then renames it to the next version, which
fails if another writer has published that version; the change is then applied to
what that writer left.  So a job that dies half way changes nothing, no path is
overwritten while it is read, and no committed version is lost.

A version also holds the last batch of each stream that it contains.  A batch comes
with its stream's name and its number and is applied only if its number is higher, so
one that a restarted stream delivers again changes nothing, whatever happened since.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from quire.operators.history import delete_entries, newest_first, read_entries, save_entries

SUMMARY_SCHEMA = (
    "struct<title:string,document_type:string,summary:string,key_points:array<string>,"
    "main_ideas:array<string>,entities:array<string>,action_items:array<string>>"
)
ENTRY_SCHEMA = (
    "id string, created_at string, file_name string, source_type_label string, length string, "
    f"source_word_count bigint, summary {SUMMARY_SCHEMA}, seq bigint"
)


STREAM_SCHEMA = "stream string, batch bigint"
ATTEMPTS = 20


class HistoryStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = fs.globStatus(hadoop.Path(f"{self.path}/v=*/_SUCCESS")) or []
        return sorted(int(s.getPath().getParent().getName()[2:]) for s in done)

    def entries(self) -> DataFrame:
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        return self.spark.read.schema(ENTRY_SCHEMA).parquet(f"{self.path}/v={found[-1]:08d}")

    def load(self) -> DataFrame:
        return newest_first(self.entries())

    def _publish(self, folder: str, version: int) -> bool:
        """Give a written folder its version number; False if another writer has it."""
        jvm = self.spark._jvm
        fs = jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(
            fs.Path(self.path).toUri(), self.spark._jsc.hadoopConfiguration()
        )
        no_overwrite = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
        target = fs.Path(f"{self.path}/v={version:08d}")
        try:
            context.rename(fs.Path(folder), target, no_overwrite)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        return True

    def applied_batches(self) -> dict[str, int]:
        """The last batch of each stream in the current version."""
        found = self.versions()
        if not found:
            return {}
        folder = f"{self.path}/v={found[-1]:08d}/_streams"
        try:
            rows = self.spark.read.schema(STREAM_SCHEMA).parquet(folder).collect()
        except AnalysisException:  # written without any
            return {}
        return {r["stream"]: r["batch"] for r in rows}

    def _commit(
        self, change: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None
    ) -> bool:
        """Apply ``change`` to the current entries; start over if a version came between.

        False if the current version contains the batch already.
        """
        for _ in range(ATTEMPTS):
            version = (self.versions() or [0])[-1] + 1
            batches = self.applied_batches()
            if batch and batches.get(batch[0], -1) >= batch[1]:
                return False
            folder = f"{self.path}/_new-{uuid.uuid4().hex}"
            change(self.entries()).write.parquet(folder)
            batches |= dict([batch] if batch else [])
            if batches:
                rows = self.spark.createDataFrame(sorted(batches.items()), STREAM_SCHEMA)
                rows.coalesce(1).write.parquet(f"{folder}/_streams")
            if self._publish(folder, version):
                return True
        raise RuntimeError(f"{ATTEMPTS} other writers came first")

    def save(
        self,
        new: DataFrame,
        limit: int | None = None,
        owner: str | None = None,
        by_seq: bool = False,
        batch: tuple[str, int] | None = None,
    ) -> bool:
        """Upsert entries; with ``batch`` (stream, number) at most once."""
        return self._commit(lambda now: save_entries(now, new, limit, owner, by_seq), batch)

    def delete(self, ids: DataFrame) -> None:
        self._commit(lambda now: delete_entries(now, ids))

    def clear(self) -> None:
        self._commit(lambda now: now.where("false"))

    def import_json(self, stored: DataFrame) -> None:
        """Take over a list stored as one JSON array (text column ``value``)."""
        rows = read_entries(stored)
        self._commit(
            lambda _: rows.withColumn("seq", -rows["position"].cast("bigint")).drop("position")
        )
