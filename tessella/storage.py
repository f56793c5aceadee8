"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in `spark.checkpoint.dir`, or the context's checkpoint folder.

    Without either, a session whose tasks all run in this process (a local master) gets
    a temporary folder; a cluster has no folder that every executor sees, so this raises.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame, tag: str = "table") -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends here, and a lost executor costs a reread.

    Everything after it sees the same rows, which plans that read a frame twice need
    where its rows depend on the run, as range partitions do: their bounds come from a
    sample. The files are removed when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
