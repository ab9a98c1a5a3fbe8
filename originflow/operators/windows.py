"""Rolling train/test windows as a table: a row belongs to every window whose days hold it."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RollingWindow:
    """Training days [train_start, test_start), test days [test_start, test_end); days from ``inner`` on are held out inside training.

    Each part uses actor state from before its own first day.
    """

    name: str
    train_start: str
    test_start: str
    test_end: str
    inner: str

    def __post_init__(self):
        if "|" in self.name or not self.train_start < self.inner <= self.test_start < self.test_end:
            raise ValueError(f"bad window {self}")


def windows_table(spark: SparkSession, windows: list[RollingWindow]) -> DataFrame:
    """``window, train_start, test_start, test_end, inner``, one row per window."""
    if len({w.name for w in windows}) != len(windows):
        raise ValueError("window names repeat")
    d = spark.createDataFrame([astuple(w) for w in windows], "window string, train_start string, test_start string, test_end string, inner string")
    return d.select("window", *[F.col(c).cast("date").alias(c) for c in d.columns[1:]])


def window_days(table: DataFrame) -> DataFrame:
    """``window, split, part, cutoff, day``: one row per window and day, the range join of ``table`` turned into an equi-join on days.

    ``part`` is fit, dev or test; ``cutoff`` is the first day of the row's split.
    """
    parts = F.array(F.struct(F.lit("train").alias("split"), F.col("train_start").alias("cutoff"), F.col("test_start").alias("stop")),
                    F.struct(F.lit("test").alias("split"), F.col("test_start").alias("cutoff"), F.col("test_end").alias("stop")))
    d = table.select("window", "inner", F.explode(parts).alias("p")).select("window", "inner", "p.*")
    d = d.withColumn("day", F.explode(F.sequence("cutoff", F.date_sub("stop", 1))))
    part = F.when(F.col("split") == "test", "test").when(F.col("day") < F.col("inner"), "fit").otherwise("dev")
    return d.select("window", "split", part.alias("part"), "cutoff", "day")


def with_windows(df: DataFrame, days: DataFrame, on: str = "day") -> DataFrame:
    """One row per (row, window) membership; rows outside all windows are dropped."""
    return df.join(days.withColumnRenamed("day", on), on)


def cutoffs(windows: list[RollingWindow]) -> list[str]:
    return sorted({c for w in windows for c in (w.train_start, w.test_start)})
