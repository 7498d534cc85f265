"""Session helpers shared by every operator: where lineage is cut, and how temporary tables are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCRATCH = "setweave-scratch"


def session(app: str = "setweave", cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the queries expect (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a local session without either gets a folder of this machine, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="setweave-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody else uses, in the application's part of the shared folder."""
    return f"{shared_dir(spark)}/{SCRATCH}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all temporary tables of this application; results that were not written anywhere else go with them."""
    drop_path(spark, f"{shared_dir(spark)}/{SCRATCH}/{spark.sparkContext.applicationId}")


def stash(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: lineage ends there.

    Unlike a cache this survives the loss of an executor, and the table's size is known to the planner, so later
    joins with it broadcast only when it is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of a table that is sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def if_small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` (a stored one of short rows) to be broadcast if it is counted to be small, else as it is."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
