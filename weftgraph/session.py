"""Session helper and table access."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that a task hands to its Python worker at once. A batch is held several times over, in the JVM and in the worker; Spark's own 64 MB take more than both need else.
BATCH_BYTES = 4 << 20
_BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_SHUFFLES_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "weftgraph") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on one machine, as in tests, one under /tmp where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file:///tmp/weftgraph-{spark.sparkContext.applicationId}"


def in_small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python workers in batches of about BATCH_BYTES; a size that the session has set stays."""
    if spark.conf.get(_BATCH_BYTES_KEY, None) is None:
        spark.conf.set(_BATCH_BYTES_KEY, str(BATCH_BYTES))


_scopes = threading.local()


def written(df: DataFrame, label: str, by: str | None = None, small: bool = False) -> DataFrame:
    """Write to a fresh Parquet table in the shared folder, in folders by a column if named, and read it back: columns stay prunable,
    unlike in a checkpoint. small takes less disk: more time goes into compression, and what the write has shuffled is deleted after it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    for own in getattr(_scopes, "open", [])[-1:]:
        own.append(path)
    if small:
        with _shuffles_deleted(spark):
            df.write.parquet(path, partitionBy=by, compression="zstd")
    else:
        df.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What a query within shuffles is deleted when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_SHUFFLES_KEY, "false")
    spark.conf.set(_SHUFFLES_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLES_KEY, before)


def _deleted(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Delete a table that written() made and that nothing reads any more."""
    _deleted(df.sparkSession, df.written_at)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What make gives, written small; the tables that it wrote on the way are deleted."""
    with scratch(spark):
        out = written(make(), label, small=True)
        _scopes.open[-1].remove(out.written_at)
    for own in _scopes.open[-1:]:
        own.append(out.written_at)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that written() makes within are deleted at the end. For work whose results are stored elsewhere by then."""
    held = _scopes.__dict__.setdefault("open", [])
    held.append([])
    try:
        yield
    finally:
        for path in held.pop():
            _deleted(spark, path)
