"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool
from typing import Any

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "biomeframe", **conf: str) -> SparkSession:
    """A session with AQE and skew handling on; on a cluster leave ``master`` to spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a temporary folder, which
    goes when the driver ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="biomeframe-")
    atexit.register(shutil.rmtree, fallback, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


# Parquet settings for rows of some 100 kB: pages and row groups close after about 1 and 8 MB.
# By default a page takes 100 rows before its size is looked at, and a reader's batch a whole group.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "16"}


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage.

    The written copy survives lost executors and fixes values that a re-run
    could change, such as partition ids. ``options`` go to the writer.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/biomeframe-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def concurrently(fn: Callable[[Any], Any], items: Iterable[Any], threads: int = 4) -> list[Any]:
    """Results of ``fn`` in order, with a few Spark jobs in flight at a time."""
    items = list(items)
    pool = ThreadPool(max(1, min(threads, len(items))))
    try:
        return pool.map(inheritable_thread_target(SparkSession.active())(fn), items)
    finally:
        pool.close()


def listed(spark: SparkSession, **columns: list[Any]) -> DataFrame:
    """A table from driver-side lists, planned as a local relation."""
    return spark.createDataFrame(pa.table(columns))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most ``rows`` rows between Spark and its Python workers, for the jobs run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
