"""Session helpers: shipping the package to executors and cutting lineage durably."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows in a task of by_size(), about: sorts of rows of some hundred bytes then take some ten MB each.
TASK_ROWS = 100_000
_SHIPPED: dict[str, bool] = {}


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    The zip goes through Spark's own file server, so executors need no shared
    source folder. Where the size of Arrow batches is Spark's default, it is
    lowered: rows here are whole texts, and a batch is held in memory twice.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "2000")
    app = spark.sparkContext.applicationId
    if _SHIPPED.get(app):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED[app] = True


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder; survives lost executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df in four partitions for each core: before a kernel that costs much more than reading, as a small file is read by one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def by_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """df dealt by keys as spread() deals rows: before a grouping whose kernel costs much more than its rows weigh, as small partitions are put together."""
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys) if keys else df


def by_size(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """df dealt by keys into partitions of some TASK_ROWS of so many rows: Spark's own number of partitions is fixed, so that its tasks would grow with the table."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return df.repartition(parts, *keys)


def written_table(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet into the shared folder and read again, and its path."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def durable_table(df: DataFrame) -> DataFrame:
    """As durable(), but columnar and compressed, for wide or large tables."""
    return written_table(df)[0]


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a table of written_table() that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
