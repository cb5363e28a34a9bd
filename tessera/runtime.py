"""Session-level helpers shared by every operator."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT = "spark.checkpoint.dir"
#: Lets Spark remove the shuffle files of a query when it ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Narrow rows that a task holds where the width follows the input.
TASK_ROWS = 500_000
#: The owner of the tables that are being stored, and the paths that each owner has.
_owner: ContextVar[str | None] = ContextVar("owner", default=None)
_owned: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is absent a local session gets a fresh temporary folder; any other
    master must name one, since a machine-local folder would be invisible to other executors.
    """
    where = spark.conf.get(_CHECKPOINT, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_CHECKPOINT} must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(_CHECKPOINT, where)
    return where.rstrip("/")


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, and keeps Python stages or wide
    scans from running twice when a plan needs their rows more than once. The shuffle files that led
    to the table go when it is written. ``discard`` and ``release`` remove tables that are done with.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    if owner := _owner.get():
        _owned.setdefault(owner, []).append(path)
    frame = spark.read.schema(df.schema).parquet(path)
    frame._stored_at = path
    return frame


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*frames: DataFrame) -> None:
    """Remove the tables behind ``frames``, which ``stored`` returned and which no later query reads."""
    for frame in frames:
        _remove(frame.sparkSession, frame._stored_at)


@contextmanager
def scratch(owner: str) -> Iterator[None]:
    """Tables stored inside belong to ``owner``, to be removed by ``release``."""
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


def release(owner: str, reader: DataFrame) -> None:
    """Remove the tables of ``owner``, but for those that ``reader`` reads."""
    if paths := _owned.pop(owner, []):
        read = reader.inputFiles()
        for path in paths:
            name = path.rsplit("/", 1)[-1]
            if any(f"/{name}/" in file for file in read):
                _owned.setdefault(owner, []).append(path)
            else:
                _remove(reader.sparkSession, path)


def parallelism(spark: SparkSession) -> int:
    """The shuffle width the session is configured for, which clusters scale with their input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def width(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """As many tasks as leave each some ``rows`` rows of ``df``, a table,, the session's width at least: what a task holds then doesn't grow with the input."""
    return max(parallelism(df.sparkSession), -(-df.count() // rows))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its input has fewer pieces than these, as one small file has; larger inputs stay in place."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """A stored ``df``, marked for broadcast if it has no more than ``rows`` rows; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def small_batches(spark: SparkSession, rows: int = 512, size: int = 32 << 20) -> None:
    """Bound what one Arrow batch holds by rows and bytes, as a row may carry a whole document or file."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        # a setting with a unit is somebody's own
        if re.fullmatch(r"-?\d+b?", now) and not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
