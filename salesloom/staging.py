"""Intermediate tables in the shared folder that the cluster names.

A table that is read more than once is written as parquet and read back: the
lineage ends there, a lost executor costs nothing but a re-read, and later
passes read only the columns they need.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Parquet's writer looks at the size of a page and a row group after 100 rows only; for rows
#: of megabytes it looks after each.
_LARGE_ROWS = {
    "parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1,
}

_LOCAL_ROOTS: dict[str, str] = {}
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def staging_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the warehouse of a cluster.

    A temporary folder is used only where driver and tasks are one process. A folder that
    the session names is taken at its word, as Spark's own checkpoints do: a path without
    a scheme may be a mount that all machines share.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured and not _one_process(context.master):
        # The warehouse is the other folder that a cluster must share.
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
        configured = f"{warehouse.rstrip('/')}/salesloom-staging" if warehouse else None
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if configured:
        return configured.rstrip("/")
    app = context.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="salesloom-")
    return _LOCAL_ROOTS[app]


def _one_process(master: str) -> bool:
    """Whether tasks run inside the driver; executors of ``local-cluster`` are processes of their own."""
    return master.startswith("local") and not master.startswith("local-cluster")


def staging_path(spark: SparkSession, name: str) -> str:
    """A path in the staging folder that no other call gets."""
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, path: str | None = None, large_rows: bool = False) -> DataFrame:
    """Write ``df`` once and return the written table.

    With ``large_rows`` (of megabytes each) a row group holds a few rows, so that tasks that
    write or read it hold no more of them at once.
    """
    spark = df.sparkSession
    target = path or staging_path(spark, name)
    written = _WRITTEN.get()
    if written is not None and path is None:
        written.append(target)
    df.write.mode("overwrite").options(**_LARGE_ROWS if large_rows else {}).parquet(target)
    if path is None:
        _remove_at_the_end(spark, target)
    return spark.read.schema(df.schema).parquet(target)


def materialise_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Write what ``make`` returns, and remove the staging tables that it wrote on the way."""
    target = staging_path(spark, name)
    outer = _WRITTEN.get()
    if outer is not None:
        outer.append(target)
    with scratch(spark):
        kept = materialise(make(), name, target)
    _remove_at_the_end(spark, target)
    release(spark)
    return kept


def release(spark: SparkSession) -> None:
    """Let Spark drop the broadcasts and shuffle files that nothing refers to any more.

    Its cleaner learns of them from the driver's garbage collector, which may run late:
    plans of finished jobs would fill the driver's heap until then. The threads that tell
    listeners hold the last finished query until they hear of another one, here of one
    that runs no job.
    """
    spark.sql("VALUES 1").collect()
    spark.sparkContext._jvm.System.gc()


def _remove_at_the_end(spark: SparkSession, target: str) -> None:
    """A table that no block removes goes with the application that wrote it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the staging tables that the block wrote (and nothing else)."""
    written: list[str] = []
    token = _WRITTEN.set(written)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for target in written:
            path = spark._jvm.org.apache.hadoop.fs.Path(target)
            path.getFileSystem(conf).delete(path, True)
