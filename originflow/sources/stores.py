"""Keyed stores: text-vector lookups, the append-only response log, and long result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originflow.operators.metrics import finite


def lookup_vectors(df: DataFrame, vectors: DataFrame, key: str, dim: int, vec: str = "emb") -> DataFrame:
    """Vector by key, the zero vector where the key is missing."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return df.join(vectors.select(key, vec), key, "left").withColumn(vec, F.coalesce(vec, zero))


def latest_by_key(log: DataFrame, key: str, seq: str, fields: list[str]) -> DataFrame:
    """Last usable record of each key; records without finite values are ignored. A grouped maximum, so a
    hot key combines map-side.
    """
    ok = F.lit(True)
    for f in fields:
        ok = ok & finite(f)
    rest = [c for c in log.columns if c not in (key, seq)]
    top = log.filter(ok & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(seq, *rest)).alias("r"))
    return top.select(key, "r.*")


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def missing_keys(items: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Unique items whose key is not stored yet."""
    return items.dropDuplicates([key]).join(store.select(key), key, "left_anti")


def write_results(results: DataFrame, path: str) -> None:
    """Long results (setting, target, method, metric, value). Only the settings that ``results`` holds are replaced."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("setting").parquet(path)


def read_result(results: DataFrame, default: float | None = None, **where: str) -> DataFrame:
    """The value at (setting, target, method, metric), or the default when there is none."""
    d = results
    for k, v in where.items():
        d = d.filter(F.col(k) == v)
    return d.agg(F.coalesce(F.max("value"), F.lit(default).cast("double")).alias("value"))


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """A table as CSV files with headers; ``single_file`` sends all rows through one task and is for small reports."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def score_lookup(rows: DataFrame, store: DataFrame, key: str, field: str, splits: list[str]) -> DataFrame:
    """Stored external score of val/test rows; NULL elsewhere and where the key is missing."""
    s = store.select(key, F.col(field).alias("_s"))
    return rows.join(s, key, "left").withColumn(
        "score", F.when(F.col("split").isin(*splits), F.col("_s"))).drop("_s")
