"""Incremental ingest: only newly dropped files are read and appended.

The stream carries file names, not contents: each micro-batch goes through the
same folder scan as a batch run (any column order, drift, bad files aside) and
replaces its own folder of the table, so a batch that is retried after a
failure leaves no duplicates. Duplicates and medians are properties of the
whole, so cleaning and reports are recomputed from the stored lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.cleaning import normalise_na
from ..settings import NoReadableFileError, Settings
from ..sources.csv_files import scan_files, validate_columns
from ..staging import scratch

#: Partition column of the stored batches, a reserved name of the feed.
BATCH = "lot_ingestion"
_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def read_files(
    spark: SparkSession, paths: list[str], settings: Settings = Settings()
) -> tuple[DataFrame, DataFrame]:
    """Lines of the good files, gaps as NULL, and the description of all files."""
    scan = scan_files(spark, paths)
    return normalise_na(scan.lines, settings), scan.files


def follow_files(
    spark: SparkSession,
    in_dir: str,
    checkpoint_dir: str,
    handle: Callable[[SparkSession, list[str], int], None],
    max_files_per_batch: int = 10_000,
) -> None:
    """Call ``handle(session, paths, batch number)`` for all files that no earlier call has seen."""

    def batch_files(batch: DataFrame, batch_id: int) -> None:
        # File names only, at most max_files_per_batch of them.
        paths = [r["path"] for r in batch.filter(F.regexp_extract("path", "^(.*)/[^/]*$", 1) == top).collect()]
        if paths:
            handle(batch.sparkSession, paths, batch_id)

    # Subfolders are not part of the feed. They are listed all the same, because a folder
    # named like a partition would otherwise hide the files beside it.
    top = _qualified(spark, in_dir)
    query = (
        spark.readStream.format("binaryFile").schema(_FILE_SCHEMA)
        .option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files_per_batch)
        .load(in_dir)
        .select("path")
        .writeStream.foreachBatch(batch_files)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingest_new_files(
    spark: SparkSession,
    in_dir: str,
    table_dir: str,
    checkpoint_dir: str,
    settings: Settings = Settings(),
    max_files_per_batch: int = 10_000,
) -> None:
    """Process all files that no earlier call has seen, then return."""

    def append(session: SparkSession, paths: list[str], batch_id: int) -> None:
        with scratch(session):
            try:
                lines, files = read_files(session, paths, settings)
                lines = _known_names(lines, _stored(spark, table_dir))
                lines.write.mode("overwrite").parquet(f"{table_dir}/lignes/{BATCH}={batch_id}")
            except NoReadableFileError as error:
                files = error.files
            files.write.mode("overwrite").parquet(f"{table_dir}/fichiers/{BATCH}={batch_id}")

    follow_files(spark, in_dir, checkpoint_dir, append, max_files_per_batch)


def _qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.makeQualified(path).toString()


def _stored(spark: SparkSession, table_dir: str) -> DataFrame | None:
    """What earlier batches stored, None before the first lines."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table_dir}/lignes")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.option("mergeSchema", True).parquet(f"{table_dir}/lignes").drop(BATCH)


def _known_names(lines: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Give a column that differs from a stored one only in case a name of its own, as the
    scan of all files at once does: ``note`` beside ``Note`` is ``note~1`` in every batch."""
    taken = [] if stored is None else stored.columns
    lowered = {c.lower() for c in taken}
    names = []
    for name in lines.columns:
        column, k = name, 0
        while column not in taken and column.lower() in lowered:
            k += 1
            column = f"{name}~{k}"
        names.append(column)
    return lines.toDF(*names)


def stored_lines(spark: SparkSession, table_dir: str) -> DataFrame:
    """All lines ingested so far; files may have brought new columns at any time."""
    lines = _stored(spark, table_dir)
    if lines is None:
        raise NoReadableFileError(f"no line was stored in {table_dir}", None)
    return validate_columns(lines)


def stored_files(spark: SparkSession, table_dir: str) -> DataFrame:
    return spark.read.parquet(f"{table_dir}/fichiers").drop(BATCH)
