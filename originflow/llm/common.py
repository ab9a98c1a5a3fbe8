"""Helpers shared by the corpus operators: table reading, written intermediate tables, labelled samples."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from originflow.session import checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Staged:
    """A table written as Parquet to the shared checkpoint folder. It survives lost executors; ``drop`` deletes its files."""

    def __init__(self, df: DataFrame, label: str):
        spark = df.sparkSession
        self.path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of an id written as text: the key of the label folds."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def crc_of(value) -> int:
    """The same number in Python."""
    return zlib.crc32(str(value).encode())


def split_hot(df: DataFrame, keys: list[str], row_hash: Column, block: int) -> DataFrame:
    """Deal the rows of each key into blocks of about ``block`` rows and give each pair of blocks a group of its own.

    Adds ``pair_a`` and ``pair_b``, and ``own_block``, the row's own. Two rows of a key meet in at least one group (rows of
    different blocks in exactly one), and no group holds more than about two blocks. Keys with at most ``block`` rows (nearly
    all) keep one group and one copy of each row.
    """
    n_blocks = df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > block) \
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.ceil(F.col("_rows") / block).cast("int").alias("_blocks"))
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    dealt = df.join(n_blocks, on, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))) \
        .withColumn("own_block", F.pmod(row_hash, F.col("_blocks")).cast("int")) \
        .withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)")))
    return dealt.withColumns({"pair_a": F.least("own_block", "_other"), "pair_b": F.greatest("own_block", "_other")}) \
        .drop("_blocks", "_other", *[f"_k_{k}" for k in keys])


def usable_vector(col: str) -> Column:
    """Neither null nor zero, and all components finite."""
    return F.expr(f"`{col}` is not null and not exists(`{col}`, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
                  f" and aggregate(`{col}`, 0D, (s, x) -> s + cast(x as double) * cast(x as double)) > 0")
