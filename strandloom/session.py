"""Session helpers: lineage cuts that survive executor loss, and local test sessions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Only a session on one machine
    that names none gets a scratch folder; anywhere else that would be a local disk, so it fails.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="run-"))
    return context.getCheckpointDir()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an action that is planned and run inside go as soon as it ends.

    Spark otherwise keeps them until the driver collects its garbage, beside those of all later actions.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned in here


def saved(df: DataFrame) -> DataFrame:
    """Like ``checkpoint``, as a Parquet table: compressed, and later scans can prune columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that never broadcasts, for tables that grow with the data.

    Catalyst's size check goes by bytes of Parquet or shuffle files; regular rows take many times as much in the driver's memory.
    """
    return left.join(right.hint("merge"), on, how)


def spread_groups(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by ``keys`` over all shuffle partitions ahead of CPU-bound per-group work.

    A partition count given here is kept by adaptive execution, which otherwise merges
    partitions that are small in bytes but expensive to process.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows that one task sorts for windows.
TASK_ROWS = 250_000


def tasks_for(rows: int) -> int:
    """Partitions of so many rows; a count given to ``repartition`` is kept, so that a task's memory does not grow with the table."""
    return max(1, -(-rows // TASK_ROWS))


def spread_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by ``keys`` into as many partitions as the rows ask for."""
    return df.repartition(tasks_for(df.count()), *keys)


def local_session(name: str = "strandloom", cores: str = "*", shuffle: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
