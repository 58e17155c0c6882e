"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset a local session (tests, a laptop) gets a temporary
    folder; a cluster gets an error, as its executors wouldn't see the driver's folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        named = context.getCheckpointDir()
    return named


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    It cuts lineage, and its rows outlive any executor. The table stays until ``discard`` takes it away, as the
    returned frame reads it lazily.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._table_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` returned and that nothing reads any more, wherever the folder is.

    What was shuffled for them goes too: executors delete it once the driver's collector finds that no plan needs it.
    """
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._table_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()
