"""The frame walk for events too large for one task.

The walk is sequential by definition, so it runs in rounds over consecutive slices of the event. In
a round, comparing the slice with all existing frames is spread over blocks of frames; only the order-
dependent part, which concerns frames touched inside the slice, runs per event on the slice alone.
Of the frames a post might join, its best few go to that part: while one of them is untouched it is the
best of all untouched ones. Once all of a post's few were touched and others may be as good as what the
walk knows, the slice ends there and the next begins with that post. So the input of the sequential part
is bounded by the slice, and the result equals the single-task walk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from originflow.operators.events import EVENT
from originflow.operators.frames import TINY, VEC, matrix, unit
from originflow.operators.ordered import block_of
from originflow.session import cut

FRAME_STATE = [T.StructField("frame_j", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("centroid", VEC)]


def resolve_slice(ranks, vecs, near: dict, cents: dict, first_new: int, thr: float, more=frozenset()):
    """Walk one slice. ``near[rank]`` lists the best (frame, sim) at or above ``thr`` before the slice, ``more`` the ranks with
    others beyond the list; ``cents`` holds size and centroid of the listed frames. Returns per-post (frame, new, best among
    joined or active frames) up to the first post that cannot be decided, and the frames changed: frame -> (size, centroid,
    first rank that changed it).
    """
    ids: list[int] = []
    where: dict[int, int] = {}
    c = np.empty((64, vecs.shape[1]))
    size: list[int] = []
    touched: list[int] = []
    out = []
    nxt = first_new

    def activate(f: int, n: int, v: np.ndarray, rank: int) -> int:
        nonlocal c
        if len(ids) == len(c):
            c = np.vstack([c, np.empty_like(c)])
        where[f] = len(ids)
        c[len(ids)] = v
        ids.append(f)
        size.append(n)
        touched.append(rank)
        return where[f]

    for rank, v in zip(ranks, vecs):
        best, frame = -np.inf, -1
        if ids:
            s = c[: len(ids)] @ v
            top = s.max()
            best, frame = float(top), min(ids[i] for i in np.flatnonzero(s == top))
        listed = near.get(rank, ())
        if rank in more and all(f in where for f, _ in listed) and not best > min(sim for _, sim in listed):
            break
        for f, sim in listed:
            if f not in where and (sim > best or (sim == best and f < frame)):
                best, frame = sim, f
        if frame >= 0 and best >= thr:
            i = where[frame] if frame in where else activate(frame, *cents[frame], rank)
            u = c[i] * size[i] + v
            c[i] = u / (np.linalg.norm(u) + TINY)
            size[i] += 1
            out.append((frame, False, best))
        else:
            activate(nxt, 1, v, rank)
            out.append((nxt, True, best if np.isfinite(best) else None))
            nxt += 1
    return out, {f: (size[i], c[i], touched[i]) for f, i in where.items()}


def _blocks(posts: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copy the slice to every block of its event's frames."""
    fb = frames.withColumn("fb", block_of("frame_j", 2048))
    spread = posts.join(fb.select(*EVENT, "fb").distinct(), EVENT)
    return spread.groupBy(*EVENT, "fb"), fb.select(
        *[F.col(k).alias(f"{k}_") for k in (*EVENT, "fb")], "frame_j", "centroid", "touch").groupBy(*[f"{k}_" for k in (*EVENT, "fb")])


def best_few(i: np.ndarray, frame: np.ndarray, sim: np.ndarray, few: int):
    """Of each ``i`` the ``few`` entries of highest ``sim`` (ties: smaller ``frame``)."""
    order = np.lexsort((frame, -sim, i))
    i, frame, sim = i[order], frame[order], sim[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < few], frame[place < few], sim[place < few]


def hot_event_frames(ranked: DataFrame, thr: float, vec: str, schema: T.StructType, chunk: int = 4096, few: int = 8) -> DataFrame:
    spark = ranked.sparkSession
    key_fields = [ranked.schema["sym"], ranked.schema["day"]]
    posts = cut(ranked.withColumn("_v", unit(vec)).drop(vec))
    state_schema = T.StructType([*key_fields, *FRAME_STATE])
    frames = spark.createDataFrame([], state_schema)
    near_schema = T.StructType([*key_fields, T.StructField("rank", T.LongType()), T.StructField("frame_j", T.IntegerType()),
                                T.StructField("sim", T.DoubleType())])
    step_schema = T.StructType([*near_schema.fields, T.StructField("is_new", T.BooleanType()), T.StructField("n", T.LongType()),
                                T.StructField("centroid", VEC), T.StructField("touch", T.LongType())])

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return near_table(a, [], [], [])
        s = matrix(a.column("_v")) @ matrix(b.column("centroid")).T
        i, j = np.nonzero(s >= thr)
        return near_table(a, *best_few(i, b.column("frame_j").to_numpy()[j], s[i, j], few + 1))

    def near_table(a: pa.Table, i, frame, sim) -> pa.Table:
        got = a.select([*EVENT, "rank"]).take(pa.array(np.asarray(i, dtype=np.int64)))
        return got.append_column("frame_j", pa.array(frame, pa.int32())).append_column("sim", pa.array(sim, pa.float64()))

    def walk(a: pa.Table, b: pa.Table) -> pa.Table:
        a = a.sort_by([("rank", "ascending")])
        ranks = a.column("rank").to_pylist()
        isfr = b.column("rank").is_null()
        listed, held = b.filter(pc.invert(isfr)).sort_by([("rank", "ascending")]), b.filter(isfr)
        rank, frame, sim = (listed.column(c).to_numpy() for c in ("rank", "frame_j", "sim"))
        cand: dict[int, list] = {}
        for r, f, x in zip(rank.tolist(), frame.tolist(), sim.tolist()):
            cand.setdefault(r, []).append((f, x))
        more = set(rank[listed.column("more").to_numpy(zero_copy_only=False).astype(bool)].tolist())
        cents = dict(zip(held.column("frame_j").to_pylist(), zip(held.column("n").to_pylist(), matrix(held.column("centroid")))))
        out, changed = resolve_slice(ranks, matrix(a.column("_v")), cand, cents, a.column("f0")[0].as_py(), thr, more)
        head = {k: a.column(k)[0].as_py() for k in EVENT}
        rows = [{**head, "rank": r, "frame_j": f, "sim": s, "is_new": new, "n": None, "centroid": None, "touch": None}
                for r, (f, new, s) in zip(ranks, out)]
        rows += [{**head, "rank": None, "frame_j": f, "sim": None, "is_new": None, "n": n, "centroid": list(v), "touch": t}
                 for f, (n, v, t) in changed.items()]
        return pa.Table.from_pylist(rows, schema=arrow)

    def untouched(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return near_table(a, [], [], [])
        s = matrix(a.column("_v")) @ matrix(b.column("centroid")).T
        changed = np.array([np.inf if t is None else t for t in b.column("touch").to_pylist()])
        s[changed[None, :] < a.column("rank").to_numpy()[:, None]] = -np.inf
        top = s.max(axis=1)
        i = np.flatnonzero(np.isfinite(top))
        return near_table(a, i, np.zeros(len(i), dtype=np.int32), top[i])

    arrow = pa.schema([
        *[pa.field(f.name, pa.date32() if isinstance(f.dataType, T.DateType) else pa.string()) for f in key_fields],
        ("rank", pa.int64()), ("frame_j", pa.int32()), ("sim", pa.float64()), ("is_new", pa.bool_()), ("n", pa.int64()),
        ("centroid", pa.list_(pa.float64())), ("touch", pa.int64())])
    never = F.lit(None).cast("bigint")
    starts = cut(posts.groupBy(*EVENT).agg(F.lit(0).cast("bigint").alias("start"), F.max("rank").alias("last")))
    best = Window.partitionBy(*EVENT, "rank").orderBy(F.desc("sim"), "frame_j")
    placed = []
    while not starts.isEmpty():
        part = posts.join(starts.drop("last"), EVENT).filter((F.col("rank") > F.col("start")) & (F.col("rank") <= F.col("start") + chunk)).select(
            *EVENT, "rank", "_v")
        l, r = _blocks(part, frames.withColumn("touch", never))
        cand = l.cogroup(r).applyInArrow(near, near_schema).withColumn("at", F.row_number().over(best)).filter(F.col("at") <= few + 1)
        cand = cand.withColumn("more", F.max("at").over(Window.partitionBy(*EVENT, "rank")) > few).filter(F.col("at") <= few).drop("at")
        cand = cut(cand)
        used = cand.select(*EVENT, "frame_j").distinct().join(frames, [*EVENT, "frame_j"])
        none = lambda kind: F.lit(None).cast(kind)
        right = cand.select(*EVENT, "frame_j", F.col("rank"), "sim", "more", none("bigint").alias("n"), none("array<double>").alias("centroid")).unionByName(
            used.select(*EVENT, "frame_j", none("bigint").alias("rank"), none("double").alias("sim"), F.lit(False).alias("more"), "n", "centroid"))
        count = frames.groupBy(*EVENT).agg(F.count(F.lit(1)).cast("int").alias("f0"))
        left = part.join(count, EVENT, "left").fillna(0, ["f0"])
        right = right.select(*[F.col(k).alias(f"{k}_") for k in EVENT], "frame_j", "rank", "sim", "more", "n", "centroid")
        step = cut(left.groupBy(*EVENT).cogroup(right.groupBy(*[f"{k}_" for k in EVENT])).applyInArrow(walk, step_schema))
        done = step.filter("rank IS NOT NULL").select(*EVENT, "rank", "frame_j", "is_new", "sim")
        changed = step.filter("rank IS NULL").select(*EVENT, "frame_j", "n", "centroid", "touch")
        # a new frame's best similarity also looks at frames the slice had not changed by then
        opened = part.join(done.filter("is_new").select(*EVENT, "rank"), [*EVENT, "rank"], "left_semi")
        old = frames.join(changed.select(*EVENT, "frame_j", "touch"), [*EVENT, "frame_j"], "left")
        l, r = _blocks(opened, old)
        rest = l.cogroup(r).applyInArrow(untouched, near_schema).groupBy(*EVENT, "rank").agg(F.max("sim").alias("rest"))
        placed.append(cut(done.join(rest, [*EVENT, "rank"], "left").withColumn(
            "best_sim", F.when(F.col("is_new"), F.greatest("sim", "rest")).otherwise(F.col("sim"))).drop("sim", "rest")))
        kept = frames.join(changed, [*EVENT, "frame_j"], "left_anti")
        frames = cut(kept.unionByName(changed.drop("touch")))
        reached = done.groupBy(*EVENT).agg(F.max("rank").alias("start"))  # where the slice ended, perhaps before its last post
        starts = cut(starts.drop("start").join(reached, EVENT).filter(F.col("start") < F.col("last")).select(*EVENT, "start", "last"))
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    final = frames.select(*EVENT, "frame_j", F.lit(True).alias("is_new"), F.col("n").alias("frame_n"), "centroid")
    out = posts.drop("_v").join(out, [*EVENT, "rank"]).join(final, [*EVENT, "frame_j", "is_new"], "left")
    return out.select(*schema.fieldNames())
