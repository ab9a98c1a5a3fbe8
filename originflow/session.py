"""Session helpers: the checkpoint folder and the materialisation point used by iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a fresh local one only where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    elif spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: executors cannot share a local one")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back.

    Used where a result feeds several branches (the frame pass) or where an iteration would grow
    the lineage. Survives executor loss: the files do not live on executors.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Written:
    """A table written as Parquet to the shared checkpoint folder: read by column, survives lost executors, deleted by ``drop``."""

    def __init__(self, df: DataFrame, label: str):
        spark = df.sparkSession
        self.path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
