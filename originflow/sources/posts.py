"""Post tables: JSON-lines reader, the binding of the driver tables, and a day-partitioned sink.

Canonical post columns: sym, actor, us (epoch microseconds, UTC), day, hour, post_id, followers,
verified, and optionally text_id / text / stance / vec_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from originflow.functions.text import stance

RAW_POST = T.StructType([
    T.StructField("created_at", T.StringType()),
    T.StructField("kol_username", T.StringType()),
    T.StructField("author_followers", T.StringType()),
    T.StructField("author_verified", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("tweet_id", T.StringType()),
    T.StructField("tweet_type", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("cashtags", T.ArrayType(T.StringType())),
    T.StructField("_corrupt_record", T.StringType()),
])

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def day_of(us: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / F.lit(DAY_US)).cast("int"))


def hour_of(us: Column) -> Column:
    return (F.floor(us / F.lit(HOUR_US)) % 24).cast("int")


def micros(ts: Column, ntz: bool) -> Column:
    """Epoch microseconds, independent of the session time zone."""
    if ntz:  # field by field: a difference of zone-less times would go through the session zone
        seconds = F.extract(F.lit("SECOND"), ts)
        return (F.unix_date(ts.cast("date")).cast("bigint") * DAY_US + F.hour(ts).cast("bigint") * HOUR_US
                + F.minute(ts).cast("bigint") * (HOUR_US // 60) + (seconds * 1_000_000).cast("bigint"))
    return F.unix_micros(ts)


def parse_ts(created_at: Column) -> Column:
    """ISO-8601 text with an offset (or Z), with or without a fraction, to a timestamp; else NULL."""
    shaped = created_at.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$")
    colon = F.regexp_replace(created_at, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(shaped, F.try_to_timestamp(colon))


def line_number() -> Column:
    """A number that rises along a file's lines: where the line's block starts plus its row in the scan partition.

    A line takes a byte at least and a block that is not a file's last fills a partition alone, so numbers of one block stay
    below the start of the next. Only the order means something; it does not depend on how the file is split.
    """
    return F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def read_posts(spark: SparkSession, path: str, with_text: bool = True) -> DataFrame:
    """Read one JSON-lines file per symbol; the symbol is the file name without its ending.

    Unparsable lines and rows without a time or an actor are dropped. A follower count that is not
    a number becomes 0; a truthy verified flag becomes 1. ``line_no`` rises along the lines of a file, which
    is how equal time stamps are ordered; a row without a numeric id has a post id of its own from it.
    """
    raw = spark.read.schema(RAW_POST).option("mode", "PERMISSIVE").json(path).withColumn("line_no", line_number())
    raw = raw.withColumn("sym", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1))
    ts = parse_ts(F.col("created_at"))
    rows = raw.filter(
        F.col("_corrupt_record").isNull()
        & (F.length(F.coalesce("kol_username", F.lit(""))) > 0)
        & ts.isNotNull()
    )
    us = F.unix_micros(ts)
    number = F.regexp_extract("author_followers", r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$", 0)
    cols = [
        F.col("sym"), F.col("kol_username").alias("actor"), us.alias("us"), day_of(us).alias("day"),
        hour_of(us).alias("hour"), 
        F.coalesce(F.col("tweet_id").try_cast("bigint"), -1 - F.col("line_no")).alias("post_id"), F.col("line_no"),
        F.when(F.length(number) > 0, number.cast("double")).otherwise(F.lit(0.0)).alias("followers"),
        F.when(F.lower("author_verified").isin("true", "1"), 1.0).otherwise(0.0).alias("verified"),
        stance(F.col("text")).alias("stance"), F.col("tweet_type"), F.col("lang"), F.col("cashtags"),
    ]
    if with_text:
        cols.append(F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(*cols)


def write_posts(posts: DataFrame, path: str, mode: str = "append") -> None:
    """Day-partitioned Parquet, so that a date range reads only its own folders."""
    posts.repartition("day", "sym").write.mode(mode).partitionBy("day").parquet(path)


def load_posts(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Read a table written by :func:`write_posts`; the range prunes partitions."""
    df = spark.read.parquet(path)
    if start:
        df = df.filter(F.col("day") >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col("day") < F.lit(end).cast("date"))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bind_posts(
    spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None, text_key: bool = False,
) -> DataFrame:
    """The driver ``events`` table as posts. The date range reaches the scan as a pushed filter on ``ts``."""
    ev = table(spark, sf_dir, "events")
    ntz = isinstance(ev.schema["ts"].dataType, T.TimestampNTZType)
    kind = "timestamp_ntz" if ntz else "timestamp"
    if start:
        ev = ev.filter(F.col("ts") >= F.lit(f"{start} 00:00:00").cast(kind))
    if end:
        ev = ev.filter(F.col("ts") < F.lit(f"{end} 00:00:00").cast(kind))
    us = micros(F.col("ts"), ntz)
    out = ev.select(
        F.col("event_type").alias("sym"), F.col("user_id").alias("actor"), us.alias("us"),
        day_of(us).alias("day"), hour_of(us).alias("hour"), F.col("event_id").alias("post_id"),
        F.col("value").alias("followers"),
        F.when(F.col("user_id") % 5 == 0, 1.0).otherwise(0.0).alias("verified"),
    )
    if text_key:
        n_docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()
        out = out.withColumn("doc_id", F.col("post_id") % n_docs)
    return out


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for work that is heavy per row when the input has fewer splits than cores.

    Large inputs have more splits than cores and are left alone, so they are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bind_stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stance once per document, over its whole text."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", stance(F.col("text")).alias("stance"))


def bind_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("emb"))


def with_vec_id(posts: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    n_vec = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1))).scalar()
    return posts.withColumn("vec_id", F.col("post_id") % n_vec)
