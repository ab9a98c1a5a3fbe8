"""Events: one (symbol, day) with the first post of each actor, in time order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from originflow.operators.ordered import BLOCK
from originflow.session import Written, cut
from originflow.sources.posts import HOUR_US

EVENT = ["sym", "day"]
MINUTE_US = 60_000_000
PAIR_EVENTS, PAIR_BITS = 512, 20  # events of a block of pair lists, bits that hold one of them


def day_range(df: DataFrame, start: str | None = None, end: str | None = None, col: str = "day") -> DataFrame:
    """Half-open day filter; ``end`` is also the point-in-time cutoff (rows strictly before)."""
    if start:
        df = df.filter(F.col(col) >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col(col) < F.lit(end).cast("date"))
    return df


def rows_before(df: DataFrame, cutoff: str) -> DataFrame:
    return day_range(df, end=cutoff)


def first_posts(
    posts: DataFrame, start: str | None = None, end: str | None = None, keys: list[str] = EVENT,
    carry: tuple[str, ...] = ("hour", "followers", "verified"),
) -> DataFrame:
    """Earliest post per (event, actor). A grouped minimum, so repeats of a busy actor combine map-side.

    ``first_seen`` is the actor's lowest line number in the event, or post id where posts have none; it orders equal timestamps.
    """
    tie = "line_no" if "line_no" in posts.columns else "post_id"
    carry = tuple(c for c in carry if c != tie)
    df = day_range(posts, start, end) if "day" in posts.columns else posts
    picked = F.min(F.struct("us", *dict.fromkeys([tie, "post_id"]), *carry)).alias("p")
    return (
        df.groupBy(*keys, "actor").agg(picked, F.min(tie).alias("first_seen"))
        .select(*keys, "actor", "p.us", "p.post_id", *[f"p.{c}" for c in carry], "first_seen")
    )


def rank_posts(fp: DataFrame, min_actors: int = 1, keys: list[str] = EVENT) -> DataFrame:
    """Add ``k`` (actors of the event), 1-based ``rank``, ``net_lead`` and ``elapsed_hours``.

    Ranking is two-level: within a minute by a window, across minutes by prefix counts (at most
    1,440 per day), so a very large event is spread over many tasks. Many posts with one and the
    same time stamp (day-resolution data) are cut further by first_seen.
    """
    fp = fp.withColumn("_m", F.floor(F.col("us") / F.lit(MINUTE_US)).cast("long"))
    before = Window.partitionBy(*keys).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    seen = F.col("first_seen").cast("double")
    minutes = fp.groupBy(*keys, "_m").agg(
        F.count(F.lit(1)).alias("_c"), F.min("us").alias("_u"), F.max("us").alias("_w"),
        F.min(seen).alias("_lo"), F.max(seen).alias("_hi"))
    # a minute whose posts all share one time stamp is cut further, along first_seen
    pieces = F.when((F.col("_u") == F.col("_w")) & (F.col("_c") > BLOCK), F.ceil(F.col("_c") / BLOCK))
    minutes = minutes.select(
        *keys, "_m", "_lo",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        F.sum("_c").over(every).alias("k"),
        F.min("_u").over(every).alias("_start"),
        ((F.col("_hi") - F.col("_lo") + 1.0) / pieces).alias("_width"),
    )
    if min_actors > 1:
        minutes = minutes.filter(F.col("k") >= min_actors)
    minutes = cut(minutes)  # at most 1,440 rows an event; mostly none of them is cut further
    if minutes.filter(F.col("_width").isNotNull()).isEmpty():
        local = Window.partitionBy(*keys, "_m").orderBy("us", "first_seen", "post_id")
        return _placed(fp.join(minutes, [*keys, "_m"]).withColumn("rank", F.col("_before") + F.row_number().over(local)))
    d = fp.join(minutes, [*keys, "_m"]).withColumn(
        "_s", F.coalesce(F.floor((seen - F.col("_lo")) / F.col("_width")), F.lit(0)).cast("int"))
    inside = Window.partitionBy(*keys, "_m").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    flat = d.filter(F.col("_width").isNotNull()).groupBy(*keys, "_m", "_s").agg(F.count(F.lit(1)).alias("_c")).select(
        *keys, "_m", "_s", F.coalesce(F.sum("_c").over(inside), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*keys, "_m", "_s").orderBy("us", "first_seen", "post_id")
    return _placed(d.withColumn("_r", F.row_number().over(local)).join(flat, [*keys, "_m", "_s"], "left")
                   .withColumn("rank", F.col("_before") + F.coalesce("_off", F.lit(0)) + F.col("_r")))


def _placed(d: DataFrame) -> DataFrame:
    return (
        d.withColumn("net_lead", F.col("k") + 1 - 2 * F.col("rank"))
        .withColumn("elapsed_hours", (F.col("us") - F.col("_start")) / F.lit(float(HOUR_US)))
        .drop("_m", "_r", "_before", "_start", "_lo", "_width", "_s", "_off")
    )


def rerank(ranked: DataFrame, keys: list[str] = EVENT) -> DataFrame:
    """Rank again after rows were removed (for example, to actors that have a trait)."""
    return rank_posts(ranked.drop("k", "rank", "net_lead", "elapsed_hours"), keys=keys)


def early_split(ranked: DataFrame, kind: str, value: float) -> DataFrame:
    """Mark ``early`` rows: the first n posts (events with more than n only) or those within h hours."""
    if kind == "count":
        return ranked.filter(F.col("k") > int(value)).withColumn("early", F.col("rank") <= int(value))
    return ranked.withColumn("early", F.col("elapsed_hours") <= float(value))


def pair_weights(ranked: DataFrame, pairs: DataFrame, block: int = PAIR_EVENTS) -> DataFrame:
    """For given (src, dst) pairs: how many events have src before dst, and how many have both.

    An actor's events are one sorted list of numbers (event, rank) per block of ``block`` events, and a pair meets the lists of
    both its actors: a pair is moved with some bytes an event instead of with a row an event. Sums over all pairs (degrees,
    graph scores) never list pairs; see :mod:`originflow.operators.graph`.
    """
    r = ranked.select(*EVENT, "actor", "rank")
    # one row an event, written so that every reader sees the same numbers; few against the rows
    number = cut(r.select(*EVENT).distinct().withColumn("_e", (F.row_number().over(Window.orderBy(*EVENT)) - 1).cast("long")))
    wide = r.join(number, EVENT).select("actor", F.floor(F.col("_e") / block).cast("int").alias("_eb"), F.shiftleft(F.col("_e") % block, 40).bitwiseOR(
        F.col("rank")).alias("_x"))
    lists = Written(wide.groupBy("actor", "_eb").agg(F.sort_array(F.collect_list("_x")).alias("x")), "pair-lists").df
    asked = pairs.select("src", "dst").distinct()
    a = asked.join(lists.withColumnsRenamed({"actor": "src", "x": "xa"}), "src")
    both = a.join(lists.withColumnsRenamed({"actor": "dst", "x": "xb"}), ["dst", "_eb"]).select("src", "dst", "xa", "xb")
    schema = T.StructType([both.schema["src"], both.schema["dst"], T.StructField("l", T.LongType()), T.StructField("t", T.LongType())])
    met = both.mapInArrow(_meetings, schema).groupBy("src", "dst").agg(F.sum("l").alias("lead_weight"), F.sum("t").alias("together"))
    return met.filter("together > 0")


def _meetings(batches):
    """Of each pair of lists, in how many events the first is before the second and how many events both hold."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            b = batch.slice(at, 1000)
            n = b.num_rows
            (ka, ra), (kb, rb) = (_event_keys(b.column(i)) for i in (2, 3))
            i = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
            both = kb[i] == ka
            pair = ka[both] >> PAIR_BITS
            lead = np.bincount(pair, ra[both] < rb[i[both]], n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lead), pa.array(np.bincount(pair, minlength=n).astype(np.int64))],
                                             ["src", "dst", "l", "t"])


def _event_keys(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, event in its block) as one rising number, and the rank, of all entries of the lists."""
    x = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    return (row << PAIR_BITS) | (x >> 40), x & ((1 << 40) - 1)


def adjacent_pairs(ranked: DataFrame) -> DataFrame:
    """Distinct (src, dst) with dst posting right after src in some event."""
    r = ranked.select(*EVENT, "actor", "rank")
    nxt = r.select(*EVENT, F.col("actor").alias("dst"), (F.col("rank") - 1).alias("rank"))
    return r.join(nxt, [*EVENT, "rank"]).select(F.col("actor").alias("src"), "dst").distinct()


def assign_block(day: Column | str, blocks: list[tuple[str, str, str]]) -> Column:
    """Block name of a day for half-open (name, start, end) ranges; NULL outside all of them."""
    c = F.col(day) if isinstance(day, str) else day
    out = None
    for name, start, end in blocks:
        cond = (c >= F.lit(start).cast("date")) & (c < F.lit(end).cast("date"))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def cutoff_index(day: Column | str, cutoffs: list[str]) -> Column:
    """Number of cutoffs that are not after the day; a row belongs to cutoff i when this is <= i."""
    c = F.col(day) if isinstance(day, str) else day
    n = F.lit(0)
    for x in cutoffs:
        n = n + (c >= F.lit(x).cast("date")).cast("int")
    return n


def spread_cutoffs(df: DataFrame, cutoffs: list[str], index: str = "_ci") -> DataFrame:
    """Copy each (already aggregated) row to the cutoffs it precedes and name the cutoff day.

    The fan-out is the number of cutoffs, a fixed short list.
    """
    days = F.array(*[F.lit(x).cast("date") for x in cutoffs])
    last = len(cutoffs) - 1
    return (
        df.filter(F.col(index) <= last)
        .withColumn("cutoff", F.explode(F.slice(days, F.col(index) + 1, F.lit(len(cutoffs)))))
        .drop(index)
    )
