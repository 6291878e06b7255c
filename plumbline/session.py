"""Session helpers shared by all operators: the shared checkpoint folder and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is absent and the master is local (tests, laptops) a temporary folder is
    taken; on a cluster a missing setting is an error, because a machine-local folder would be lost
    with its executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-plumbline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


_paths: dict[str, list[str]] = {}  # by application: one session's end must not take another's tables


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; ``drop_written`` deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.setdefault(_owner(spark), []).append(path)
    return path


def _owner(spark: SparkSession) -> str:
    """The application and, within it, the session, as Spark numbers it."""
    return f"{spark.sparkContext.applicationId}/{spark._jsparkSession.sessionUUID()}"


def drop_written(spark: SparkSession) -> int:
    """Deletes what this session's calls have written to the shared folder, and returns how many paths.

    Results are lazy and read those tables: call it when they have been read or stored.
    """
    conf, gone = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for written_to in _paths.pop(_owner(spark), []):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written_to)
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, rows_per_file: int | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet to the shared folder and reads it back.

    A lost executor then costs a re-read, not a recomputation of what stands before the cut. Few rows that
    mean much work each are spread over tasks by a small ``rows_per_file``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
