"""Semantic frames: order-dependent grouping of an event's posts by vector similarity."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from originflow.operators.events import EVENT
from originflow.operators.ordered import BLOCK, block_of
from originflow.session import cut

FRAME = [*EVENT, "frame_j"]
VEC = T.ArrayType(T.DoubleType())
TINY = 1e-12
MAX_EVENT = 1_000_000  # posts of an event that one task walks: under a minute
SENT_VECTORS = 100_000  # vectors sent to every task: 64 floats of each are 26 MB


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column of equal lengths as a 2-d float64 array."""
    arr = column.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.chunk(0)
    if len(arr) == 0:
        return np.zeros((0, 0))
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arr), -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + TINY) if m.size else m


class FrameWalk:
    """The frames of one event so far: centroids and sizes, all that the walk keeps of the posts it has seen."""

    def __init__(self, dim: int):
        self.c = np.empty((64, dim))
        self.size = np.zeros(64, dtype=np.int64)
        self.m = 0

    def take(self, vecs: np.ndarray, thr: float):
        """Assign each unit vector, in order, to the most similar centroid at or above ``thr``, else open a frame."""
        c, size, m, n = self.c, self.size, self.m, len(vecs)
        frame = np.empty(n, dtype=np.int32)
        new = np.zeros(n, dtype=bool)
        best = np.full(n, np.nan)
        for i in range(n):
            v = vecs[i]
            if m:
                s = c[:m] @ v
                j = int(s.argmax())
                top = best[i] = s[j]
                if top >= thr:
                    u = c[j] * size[j] + v
                    c[j] = u / (math.sqrt(u @ u) + TINY)
                    size[j] += 1
                    frame[i] = j
                    continue
            if m == len(size):
                c = np.vstack([c, np.empty_like(c)])
                size = np.concatenate([size, np.zeros_like(size)])
            c[m], size[m] = v, 1
            frame[i], new[i] = m, True
            m += 1
        self.c, self.size, self.m = c, size, m
        return frame, new, best


def walk_frames(vecs: np.ndarray, thr: float):
    """``FrameWalk`` over all of an event's unit vectors: frames, new marks, best similarities, final centroids and sizes."""
    w = FrameWalk(vecs.shape[1])
    return *w.take(vecs, thr), w.c[:w.m], w.size[:w.m]


def _event_starts(b: pa.RecordBatch) -> np.ndarray:
    """Where the (sym, day) of a batch differs from that of the row before; 0 is always among them."""
    new = np.zeros(b.num_rows, dtype=bool)
    new[0] = True
    for c in EVENT:
        code = pc.dictionary_encode(b.column(b.schema.get_field_index(c)), null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _walk_of(vec: str, thr: float):
    """The walk over a partition whose events lie one behind the other, in rank order. A post goes out with its batch; only the
    rows that opened frames wait for the end of their event, where their final centroids and sizes are known."""

    def finished(part: pa.RecordBatch, frame, new, best, cents=None, size=None) -> pa.RecordBatch:
        n = part.num_rows
        return pa.RecordBatch.from_arrays(
            [*part.columns, pa.array(frame, pa.int32()), pa.array(new), pa.array(best, pa.float64(), mask=np.isnan(best)),
             pa.array(size if size is not None else [None] * n, pa.int64()),
             pa.array(list(cents) if cents is not None else [None] * n, pa.list_(pa.float64()))],
            names=[*part.schema.names, "frame_j", "is_new", "best_sim", "frame_n", "centroid"])

    def run(batches):
        event, walk, last, opened, seen = None, None, None, [], set()

        def close():
            for part, frame, best in opened:
                yield finished(part, frame, np.ones(len(frame), dtype=bool), best, walk.c[frame], walk.size[frame])
            opened.clear()

        for b in batches:
            if not b.num_rows:
                continue
            starts = _event_starts(b)
            rank = b.column(b.schema.get_field_index("rank")).to_numpy()
            for lo, hi in zip(starts, [*starts[1:], b.num_rows]):
                t = b.slice(lo, hi - lo)
                head = tuple(t.column(t.schema.get_field_index(c))[0].as_py() for c in EVENT)
                at = t.schema.get_field_index(vec)
                vecs = unit_rows(matrix(pa.chunked_array([t.column(at)])))
                if head != event:
                    yield from close()
                    event, walk, last = head, FrameWalk(vecs.shape[1]), None
                    again = head in seen
                    seen.add(head)
                if again or (np.diff(rank[lo:hi]) < 0).any() or (last is not None and rank[lo] < last):
                    raise ValueError(f"posts of {head} out of order")
                last = rank[hi - 1]
                frame, new, best = walk.take(vecs, thr)
                t = pa.RecordBatch.from_arrays([c for i, c in enumerate(t.columns) if i != at], names=[n for n in t.schema.names if n != vec])
                if new.any():
                    opened.append((t.filter(pa.array(new)), frame[new], best[new]))
                if not new.all():
                    yield finished(t.filter(pa.array(~new)), frame[~new], np.zeros(int((~new).sum()), dtype=bool), best[~new])
        yield from close()
    return run


def in_event_order(ranked: DataFrame, vectors: DataFrame | None = None, on: list[str] = []) -> DataFrame:
    """Whole events in a partition, one behind the other, in rank order; with their vectors where these are given apart.

    A vector table that fits every task is sent to the rows after they were moved, so that the vectors of the rows never
    travel; else rows and vectors meet first. The sort comes last: Spark drops one that a join follows.
    """
    if vectors is None:
        moved = ranked.repartition(*EVENT)
    elif vectors.limit(SENT_VECTORS + 1).count() <= SENT_VECTORS:
        moved = ranked.repartition(*EVENT).join(F.broadcast(vectors), on)
    else:
        moved = ranked.join(vectors, on).repartition(*EVENT)
    return moved.sortWithinPartitions(*EVENT, "rank")


def online_frames(ranked: DataFrame, thr: float, vec: str = "emb", max_event: int = MAX_EVENT, vectors: DataFrame | None = None,
                  on: list[str] = []) -> DataFrame:
    """Frames of every event, in arrival order; events are independent and run in parallel.

    Adds frame_j, is_new, best_sim (similarity to the best frame on arrival, NULL for the first post)
    and, on the row that opened a frame, its final centroid and size. A task holds the frames of one event and
    a batch of its posts, whatever the event's size. Events with more than ``max_event`` posts, whose walk would
    keep one task busy for long, go through :func:`originflow.operators.hot_frames.hot_event_frames`, which
    spreads one event over many tasks; both give the same rows. ``vectors`` are joined by ``on`` where ``ranked`` has none.
    """
    from originflow.operators.hot_frames import hot_event_frames

    largest = ranked.agg(F.max("k")).first()[0] or 0
    small = ranked.filter(F.col("k") <= max_event) if largest > max_event else ranked
    rows = in_event_order(small, vectors, on)
    kept = [f for f in rows.schema.fields if f.name != vec]
    schema = T.StructType(kept + [
        T.StructField("frame_j", T.IntegerType()), T.StructField("is_new", T.BooleanType()),
        T.StructField("best_sim", T.DoubleType()), T.StructField("frame_n", T.LongType()),
        T.StructField("centroid", VEC)])
    out = rows.mapInArrow(_walk_of(vec, thr), schema)
    if largest > max_event:
        hot = ranked.filter(F.col("k") > max_event)
        hot = hot.join(vectors, on) if vectors is not None else hot
        out = out.unionByName(hot_event_frames(hot, thr, vec, schema))
    return out


def frame_pass(ranked: DataFrame, vectors: DataFrame, on: list[str], thr: float, **kw) -> DataFrame:
    """Attach vectors, run the frame walk once and write its result: every later step reads it again."""
    ranked = cut(ranked)
    return cut(online_frames(ranked, thr, vectors=vectors, on=on, **kw))


def centroids(frames: DataFrame) -> DataFrame:
    return frames.filter("is_new").select(*FRAME, F.col("frame_n").alias("n"), "centroid")


def future_labels(frames: DataFrame) -> DataFrame:
    """Per frame: members strictly later than the origin, and their summed followers; plus the history
    variant that counts every member after the first.
    """
    reach = F.greatest(F.lit(0.0), F.col("followers"))
    by_time = frames.groupBy(*FRAME, "us").agg(
        F.count(F.lit(1)).alias("c"), F.sum(reach).alias("f"),
        F.min(F.struct("rank", reach.alias("own"))).alias("head"))
    t = by_time.groupBy(*FRAME).agg(
        F.sum("c").alias("c"), F.sum("f").alias("f"),
        F.min(F.struct("us", "c", "f")).alias("first"), F.min("head").alias("head"))
    adopt = (F.col("c") - F.col("first.c")).cast("double")
    far = F.when(F.col("c") > F.col("first.c"), F.col("f") - F.col("first.f")).otherwise(0.0)
    hist_far = F.when(F.col("c") > 1, F.col("f") - F.col("head.own")).otherwise(0.0)
    return t.select(
        *FRAME, adopt.alias("future_adopt"), F.greatest(far, F.lit(0.0)).alias("future_reach"),
        F.log1p(adopt).alias("log_future_adopt"), F.log1p(F.greatest(far, F.lit(0.0))).alias("log_future_reach"),
        (F.col("c") - 1).cast("double").alias("hist_adopt"),
        F.greatest(hist_far, F.lit(0.0)).alias("hist_reach"))


def best_match(left: DataFrame, right: DataFrame, keys: list[str], lid: str, rid: str,
               lvec: str = "vec", rvec: str = "vec", block: int = 2048, raw_left: bool = False) -> DataFrame:
    """For each left row the most similar right row of its group: keys, ``lid``, sim, ``rid`` (ties: lowest rid).

    Both sides are cut into blocks; a task sees one block of each, so no group is gathered whole.
    ``lid`` and ``rid`` are dense integers inside a group; ``raw_left`` scales left vectors to unit length first.
    """
    l = left.select(*keys, F.col(lid).cast("long").alias("l"), F.col(lvec).alias("lv")).withColumn(
        "lb", block_of(F.col("l"), block))
    r = right.select(*keys, F.col(rid).cast("long").alias("r"), F.col(rvec).alias("rv")).withColumn(
        "rb", block_of(F.col("r"), block))
    lmax = l.groupBy(*keys).agg(F.collect_set("lb").alias("lbs"))
    rmax = r.groupBy(*keys).agg(F.collect_set("rb").alias("rbs"))
    ls = l.join(rmax, keys).withColumn("rb", F.explode("rbs")).drop("rbs")
    rs = r.join(lmax, keys).withColumn("lb", F.explode("lbs")).drop("lbs")
    key_fields = [f for f in left.schema.fields if f.name in keys]
    key_fields.sort(key=lambda f: keys.index(f.name))
    schema = T.StructType(key_fields + [
        T.StructField("l", T.LongType()), T.StructField("sim", T.DoubleType()), T.StructField("r", T.LongType())])

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        out = a.select([*keys, "l"])
        if a.num_rows == 0 or b.num_rows == 0:
            empty = a.slice(0, 0).select([*keys, "l"])
            return empty.append_column("sim", pa.array([], pa.float64())).append_column("r", pa.array([], pa.int64()))
        b = b.sort_by([("r", "ascending")])
        left_m = matrix(a.column("lv"))
        s = (unit_rows(left_m) if raw_left else left_m) @ matrix(b.column("rv")).T
        j = s.argmax(axis=1)
        ids = b.column("r").to_numpy()
        out = out.append_column("sim", pa.array(s[np.arange(len(j)), j]))
        return out.append_column("r", pa.array(ids[j], pa.int64()))

    grp = [*keys, "lb", "rb"]
    rs = rs.select(*[F.col(c).alias(f"{c}_") for c in grp], F.col("r").alias("r"), F.col("rv").alias("rv"))
    per_block = ls.groupBy(*grp).cogroup(rs.groupBy(*[f"{c}_" for c in grp])).applyInArrow(match, schema)
    top = F.max(F.struct("sim", (-F.col("r")).alias("nr"))).alias("t")
    return per_block.groupBy(*keys, "l").agg(top).select(
        *keys, F.col("l").alias(lid), F.col("t.sim").alias("sim"), (-F.col("t.nr")).alias(rid))


def memory_window(cents: DataFrame, memory: int = 1000) -> DataFrame:
    """The rows an event compares with: the last ``memory`` final centroids of earlier events of its symbol.

    Frames get a running number per symbol from per-event counts. A centroid numbered q serves the
    events whose base lies in [q, q + memory); two equi-join keys per centroid cover that range.
    """
    per_event = cents.groupBy(*EVENT).agg(F.count(F.lit(1)).alias("f"))
    w = Window.partitionBy("sym").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    base = per_event.select(*EVENT, F.coalesce(F.sum("f").over(w), F.lit(0)).alias("base"))
    seq = cents.join(base, EVENT).select(
        "sym", (F.col("base") + F.col("frame_j") + 1).alias("q"), F.col("centroid").alias("mem"))
    span = F.array_distinct(F.array(F.floor(F.col("q") / memory), F.floor((F.col("q") + memory - 1) / memory)))
    return (
        seq.withColumn("_b", F.explode(span))
        .join(base.withColumn("_b", F.floor(F.col("base") / memory)), ["sym", "_b"])
        .filter((F.col("q") <= F.col("base")) & (F.col("q") > F.col("base") - memory))
        .select(*EVENT, (F.col("q") - F.greatest(F.col("base") - memory, F.lit(0)) - 1).alias("m"), "mem")
    )


def novelty_global(origins: DataFrame, cents: DataFrame, memory: int = 1000) -> DataFrame:
    """1 - highest cosine of an origin's own unit vector to the memory of its event; no row where memory is empty.

    ``origins`` has sym, day, rank and the vector ``vec`` of the post, of any length.
    """
    hit = best_match(origins, memory_window(cents, memory), EVENT, "rank", "m", "vec", "mem", raw_left=True)
    return hit.select(*EVENT, "rank", (1.0 - F.col("sim")).alias("novelty_global"))


def unit(c) -> "F.Column":
    """v / (|v| + 1e-12) as a column expression."""
    d = F.transform(c, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)) + F.lit(TINY)
    # binding the norm as a lambda variable keeps it from being computed again for every element
    return F.transform(F.array(norm), lambda n: F.transform(d, lambda x: x / n))[0]


def dot(a, b) -> "F.Column":
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mean_pool(members: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Unit mean of the member vectors of each group; position-wise averages, combined map-side."""
    pos = members.select(*keys, F.posexplode(vec).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    arr = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return pos.groupBy(*keys).agg(arr.alias("_m")).select(*keys, unit("_m").alias("pooled"))


def assign_to_seeds(later: DataFrame, seeds: DataFrame, keys: list[str], thr: float) -> DataFrame:
    """Each later post goes to its most similar fixed seed when at or above ``thr``: counts and reach per seed."""
    hit = best_match(later, seeds, keys, "rank", "frame_j", "vec", "centroid", raw_left=True).filter(F.col("sim") >= thr)
    own = later.select(*keys, "rank", "followers")
    return hit.join(own, [*keys, "rank"]).groupBy(*keys, F.col("frame_j").cast("int").alias("frame_j")).agg(
        F.count(F.lit(1)).cast("double").alias("future_adopt"),
        F.sum(F.greatest(F.lit(0.0), F.col("followers"))).alias("future_reach"))
