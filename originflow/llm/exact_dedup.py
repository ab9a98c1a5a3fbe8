"""Exact dedup of batches against immutable snapshots that static binary-fuse filters screen.

A snapshot holds the distinct texts one batch added: a filter per shard of their digests, and the exact buckets, a table of
digests and texts bucketed by digest. Rows of a new batch are grouped by digest among themselves first; the distinct digests
are screened by the filters of every earlier snapshot, and only those that pass are joined to the exact buckets, where the
bytes decide.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from originflow.llm.common import Staged, id_crc
from originflow.session import checkpoint_dir

SHARD_KEYS = 1 << 17  # digests of a filter, on average; a filter takes about 150 kB
PART_KEYS = 1 << 18  # digests that one task screens against a filter
BUCKET_BYTES = 128 << 20  # text of an exact bucket, on average
HOT_SHARE = 1000  # a class with more than a thousandth of all rows is joined by broadcast: there are fewer than a thousand


def stripped(text: Column) -> Column:
    """The text without white space ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), " \t\n\x0b\x0c\r", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class FuseFilter:
    """Binary-fuse filter of arity 3 with 8-bit fingerprints: never false for a key it was built from, true for one in 256 others.

    A key has a slot in three consecutive segments; its fingerprint is the exclusive or of the three cells. Keys are peeled in
    rounds: all keys that are alone in some slot leave together, and get their cells in the opposite order.
    """

    def __init__(self, seed: int, segment: int, windows: int, cells: np.ndarray):
        self.seed, self.segment, self.windows, self.cells = seed, segment, windows, cells

    @classmethod
    def of(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys)
        n = max(2, len(keys))
        segment = 1 << min(18, int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
        room = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))) + 1
        windows = max(1, -(-room // segment) - 2)
        for seed in range(1, 200):
            out = cls(seed, segment, windows, np.zeros((windows + 2) * segment, np.uint8))
            if out._fill(keys):
                return out
            if seed % 8 == 0:
                windows += 1
        raise RuntimeError("no seed peels the keys")

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Three slots and the fingerprint of each key."""
        h = _mix(keys + np.uint64(self.seed * 0x9E3779B97F4A7C15 % 2**64))
        span, mask = np.uint64(self.windows * self.segment), np.uint64(self.segment - 1)
        first = (h >> np.uint64(32)) * span >> np.uint64(32)
        second = (first + np.uint64(self.segment)) ^ (h >> np.uint64(18) & mask)
        third = (first + np.uint64(2 * self.segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64), (_mix(h) & np.uint64(255)).astype(np.uint8)

    def _fill(self, keys: np.ndarray) -> bool:
        slots, prints = self._places(keys)
        count = np.bincount(slots.ravel(), minlength=len(self.cells))
        holds = np.zeros(len(self.cells), np.int64)  # exclusive or of the key numbers in a slot
        for s in slots:
            np.bitwise_xor.at(holds, s, np.arange(len(keys)))
        single, order, left = np.flatnonzero(count == 1), [], len(keys)
        while len(single):
            key, at = np.unique(holds[single], return_index=True)
            own = single[at]
            order.append((key, own))
            left -= len(key)
            touched = slots[:, key].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(holds, touched, np.tile(key, 3))
            touched = np.unique(touched)
            single = touched[count[touched] == 1]
        if left:
            return False
        for key, own in reversed(order):  # the slots of a round's keys that are their own belong to no other key of the round
            self.cells[own] = 0
            value = prints[key]
            for s in slots[:, key]:
                value = value ^ self.cells[s]
            self.cells[own] = value
        return True

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self._places(keys)
        return (self.cells[slots[0]] ^ self.cells[slots[1]] ^ self.cells[slots[2]]) == prints


def _words(digests) -> np.ndarray:
    """The first eight bytes of each digest."""
    raw = pc.binary_slice(digests.combine_chunks() if isinstance(digests, pa.ChunkedArray) else digests, 0, 8)
    return np.frombuffer(b"".join(raw.to_pylist()), np.uint64)


def _build(key, table):
    f = FuseFilter.of(_words(table["digest"]))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "seed": pa.array([f.seed], pa.int32()),
                     "segment": pa.array([f.segment], pa.int32()), "windows": pa.array([f.windows], pa.int32()),
                     "cells": pa.array([f.cells.tobytes()], pa.binary())})


def _screen(asked, filters):
    if not asked.num_rows or not filters.num_rows:
        return asked.slice(0, 0).select(["digest"])
    f = filters.to_pylist()[0]
    hit = FuseFilter(f["seed"], f["segment"], f["windows"], np.frombuffer(f["cells"], np.uint8)).may_hold(_words(asked["digest"]))
    return asked.select(["digest"]).filter(pa.array(hit))


class Snapshots:
    """The immutable snapshots under one folder. Adding a batch writes a new snapshot and never touches an older one.

    ``path`` is a folder that driver and executors share; by default a new one in ``spark.checkpoint.dir``. A folder that
    already holds snapshots is opened as it is, so batches of later sessions go on from there.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{checkpoint_dir(spark)}/snapshots-{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self.members = []
        if fs.exists(folder):
            self.members = [r.asDict() for r in spark.read.parquet(f"{self.path}/manifest").orderBy("number").collect()]
            for m in self.members:
                self._register(m)

    def _table(self, number: int) -> str:
        return f"exact_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.path}/{number}').hex}"

    def _register(self, m: dict) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table(m['number'])} (digest BINARY, text STRING) USING parquet "
                       f"CLUSTERED BY (digest) INTO {m['buckets']} BUCKETS LOCATION '{self.path}/texts-{m['number']}'")

    def add(self, digests: DataFrame, texts: DataFrame) -> None:
        """Write a snapshot of the distinct ``digests(digest)``; ``texts(digest, text)`` holds their texts, copies allowed."""
        number = len(self.members)
        chosen = Staged(texts.join(digests.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text")),
                        "snapshot-texts")
        n, size = chosen.df.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        m = {"number": number, "shards": max(1, -(-n // SHARD_KEYS)),
             "buckets": max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // BUCKET_BYTES))}
        shard = F.pmod(F.xxhash64("digest"), F.lit(m["shards"])).cast("int").alias("shard")
        chosen.df.select("digest", shard).groupBy("shard").applyInArrow(
            _build, "shard int, seed int, segment int, windows int, cells binary").write.parquet(f"{self.path}/filters-{number}")
        chosen.df.repartition(m["buckets"], "digest").write.bucketBy(m["buckets"], "digest") \
            .option("path", f"{self.path}/texts-{number}").format("parquet").saveAsTable(self._table(number))
        chosen.drop()
        self.spark.createDataFrame([tuple(m.values())], "number int, shards int, buckets int") \
            .coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.members.append(m)

    def positives(self, digests: DataFrame, number: int) -> DataFrame:
        """Those of the distinct ``digests(digest)`` that pass the filters of snapshot ``number``.

        Digests meet the filter of their shard, dealt into parts of about ``PART_KEYS``; a part gets a copy of the filter.
        """
        m = self.members[number]
        parts = max(1, -(-digests.count() // (PART_KEYS * m["shards"])))
        shard = F.pmod(F.xxhash64("digest"), F.lit(m["shards"])).cast("int").alias("shard")
        part = F.pmod(F.hash("digest"), F.lit(parts)).cast("int").alias("part")
        filters = self.spark.read.parquet(f"{self.path}/filters-{number}") \
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return digests.select("digest", shard, part).groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")) \
            .applyInArrow(_screen, "digest binary")

    def known(self, digests: DataFrame, texts: DataFrame) -> list[Staged]:
        """Written tables ``digest, snapshot`` of the distinct ``digests(digest)`` whose bytes a snapshot holds, one a snapshot.

        Filters screen the digests; only the texts of those that pass (``texts(digest, text)``, copies allowed) travel to the
        exact buckets, which stay where they are, and equal bytes decide.
        """
        parts, left = [], digests
        for m in self.members:
            passed = Staged(self.positives(left, m["number"]), "screened")
            asked = texts.join(passed.df, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("asked"))
            found = Staged(asked.join(self.spark.table(self._table(m["number"])), "digest").filter(F.col("asked") == F.col("text"))
                           .select("digest", F.lit(m["number"]).alias("snapshot")), "known")
            passed.drop()
            left = left.join(found.df, "digest", "left_anti")
            parts.append(found)
        if not parts:
            parts.append(Staged(digests.select("digest", F.lit(0).alias("snapshot")).limit(0), "known"))
        return parts

    def drop(self) -> None:
        for m in self.members:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(m['number'])}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: Column | None = None, batches: int = 2,
          store: Snapshots | None = None, digest=sha256) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, batch``.

    Texts are equal when they are identical without white space. Of equal texts stays the row with the most code points, then
    the smallest id; null ids come after all others, and of rows that repeat an id the first written one stays, so exactly one
    row of a group is ``kept``. Null texts count as empty and are equal to texts of white space only. Other columns are not
    read; an empty table gives no rows.

    ``docs`` arrives in ``batches`` parts given by ``batch`` (an integer from 0, by default from the crc32 of the id). Each is
    grouped by itself, screened against the snapshots of those before it, and what is new becomes a snapshot, the last batch's
    only if the caller passes a ``store``. Rows whose text an older snapshot of ``store`` holds have the group of this input
    only. A text equal in digest but not in bytes to one of a snapshot has a group of its own.

    Plan: one scan for digests; one for the texts of each batch but the last, of which one copy a task is shuffled; one for the
    texts that pass a filter. Copies are combined before every shuffle, and classes with more than ``1 / HOT_SHARE`` of all rows
    (fewer than ``HOT_SHARE``) are joined by broadcast.
    """
    spark, own = docs.sparkSession, store is None
    number = F.pmod(id_crc(id_col), F.lit(batches)).cast("int") if batch is None else batch.cast("int")
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(number, F.lit(0)).alias("batch"), F.col(text_col).alias("_raw"),
                       stripped(F.col(text_col)).alias("text"))
    rows = Staged(read.select("doc_id", "batch", digest(F.col("text")).alias("digest"), F.coalesce(F.length("_raw"), F.lit(0)).alias("n"),
                              F.monotonically_increasing_id().alias("row")), "dedup-digests").df
    first = F.struct((-F.col("n")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    grouped = Staged(rows.groupBy("batch", "digest").agg(F.count("*").alias("size"), F.min(first).alias("best")), "dedup-groups")
    groups = grouped.df
    store = Snapshots(spark) if own else store
    since = len(store.members)
    owner, written = [], []
    for k in range(batches):
        mine = groups.filter(F.col("batch") == k).select("digest")
        texts = read.filter(F.col("batch") == k).select(digest(F.col("text")).alias("digest"), "text")
        parts = store.known(mine, texts)
        found = reduce(DataFrame.union, [t.df for t in parts])
        written += parts
        if store.members[since:]:
            owner.append(found.filter(F.col("snapshot") >= since)
                         .select("digest", F.lit(k).alias("batch"), (F.col("snapshot") - since).alias("home")))
        if k < batches - 1 or not own:
            store.add(mine.join(found, "digest", "left_anti"), texts)
    joined = groups.withColumn("home", F.col("batch"))
    if owner:
        joined = groups.join(reduce(DataFrame.union, owner), ["batch", "digest"], "left").withColumn("home", F.coalesce("home", "batch"))
    whole = joined.groupBy("digest", "home").agg(F.sum("size").alias("group_size"), F.min("best").alias("keep"))
    classes = Staged(joined.select("batch", "digest", "home").join(whole, ["digest", "home"])
                     .select("batch", "digest", "group_size", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row")),
                     "dedup-classes").df
    for t in (grouped, *written):
        t.drop()
    if own:
        store.drop()
    total = rows.count()
    hot = classes.filter(F.col("group_size") * HOT_SHARE > total)
    keys, key_cols = ["batch", "digest"], ["doc_id", "digest", "batch", "row", "group_size", "keep_id", "keep_row"]
    out = rows.join(F.broadcast(hot), keys).select(*key_cols).union(
        rows.join(F.broadcast(hot), keys, "left_anti").join(classes.filter(F.col("group_size") * HOT_SHARE <= total), keys).select(*key_cols))
    return out.select("doc_id", "keep_id", F.col("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"), "batch")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
"""
