"""The steps before the panel on events and actors of any size: what is moved and how much of it a task holds."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest

from originflow.operators import actors, events as ev, frames as fr
from tests.test_frames import DAY, events

US0 = 1_704_067_200_000_000


def test_an_event_over_many_batches_is_walked_alike(spark):
    """A task holds a batch of posts and the frames; the whole event was one Arrow table before."""
    df, vecs = events(spark, [90, 41, 7], seed=3)
    t = df.orderBy("sym", "rank").toArrow().combine_chunks()
    small = t.to_batches(max_chunksize=5)
    sizes = []

    def watched():
        for b in small:
            sizes.append(b.num_rows)
            yield b
    run = fr._walk_of("emb", 0.35)
    got = pa.Table.from_batches(list(run(watched()))).to_pylist()
    assert max(sizes) == 5 and len(got) == 138
    for s, vs in vecs.items():
        frame, new, best, cents, size = fr.walk_frames(fr.unit_rows(vs), 0.35)
        mine = sorted((r for r in got if r["sym"] == s), key=lambda r: r["rank"])
        assert [(r["frame_j"], r["is_new"]) for r in mine] == list(zip(frame.tolist(), new.tolist()))
        for r in mine:
            assert (r["frame_n"], r["centroid"]) == ((size[r["frame_j"]], cents[r["frame_j"]].tolist()) if r["is_new"] else (None, None))


def apart(spark):
    """Posts of many events in no order, and their vectors."""
    df, _ = events(spark, [30, 12, 25, 8, 17, 40, 9], seed=4)
    df = df.repartition(5, "actor").cache()
    on = ["sym", "vec_id"]
    return df, df.drop("emb").withColumnRenamed("actor", "vec_id"), df.select("sym", df.actor.alias("vec_id"), "emb"), on


def placed(d):
    return d.select("sym", "rank", "frame_j", "is_new", "frame_n").orderBy("sym", "rank").collect()


@pytest.mark.parametrize("sent", [100_000, 3])
def test_vectors_given_apart(spark, monkeypatch, sent):
    """Small vector tables meet the posts behind their shuffle, large ones before it; both give the rows of a plain walk."""
    df, posts, vectors, on = apart(spark)
    monkeypatch.setattr(fr, "SENT_VECTORS", sent)
    got = placed(fr.online_frames(posts, 0.4, vectors=vectors, on=on))
    want = []
    for s in sorted({r["sym"] for r in got}):
        own = sorted((r["rank"], r["emb"]) for r in df.filter(df.sym == s).collect())
        frame, new, _, _, size = fr.walk_frames(fr.unit_rows(np.array([v for _, v in own])), 0.4)
        want += [(s, r, f, n, size[f] if n else None) for (r, _), f, n in zip(own, frame.tolist(), new.tolist())]
    assert [tuple(r) for r in got] == want


def test_small_vector_tables_do_not_travel(spark):
    _, posts, vectors, on = apart(spark)
    plan = fr.in_event_order(posts, vectors, on)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Sort") < plan.index("BroadcastHashJoin") < plan.index("Exchange hashpartitioning")


def test_posts_out_of_order_are_refused(spark):
    df, _ = events(spark, [6, 6], seed=1)
    t = df.orderBy("rank", "sym").toArrow().combine_chunks()
    with pytest.raises(ValueError, match="out of order"):
        list(fr._walk_of("emb", 0.35)(t.to_batches()))


def post_rows(spark, n=400):
    g = np.random.default_rng(8)
    rows = []
    for i in range(n):
        us = US0 + int(g.integers(0, 12)) * 86_400_000_000 + int(g.integers(0, 86_400_000_000))
        foll = [0.0, None, float("nan"), -3.0, float(g.integers(1, 9))][min(4, int(g.integers(0, 9)))]
        rows.append((None if i % 57 == 0 else f"a{int(g.integers(0, 25)) ** 2 // 30}", dt.date(2024, 1, 1) + dt.timedelta(microseconds=us - US0),
                     us // 3_600_000_000 % 24, foll, float(g.integers(0, 2))))
    return spark.createDataFrame(rows, "actor string, day date, hour int, followers double, verified double")


@pytest.mark.parametrize("busy", [0, 20])
def test_actor_medians_from_batches_equal_those_from_counts(spark, busy):
    """Whole actors in a task, or counted piece by piece above ``busy`` posts: the same rows."""
    p, cutoffs = post_rows(spark), ["2024-01-04", "2024-01-09"]
    rows = lambda d: sorted(((str(r["cutoff"]), r["actor"] or "", *r[2:]) for r in d.filter("actor is not null").collect()))
    want = rows(actors.metadata(p, cutoffs))
    assert len(want) > 20 and want == rows(actors.metadata(p, cutoffs, busy=busy))
    for cutoff, actor, hour, foll, _, verified, n in want:
        own = [r for r in p.filter(f"actor = '{actor}' and day < '{cutoff}'").collect()] if actor in ("a0", "a7") else None
        if own is not None:
            good = [r["followers"] for r in own if r["followers"] is not None and r["followers"] > 0]
            assert (hour, foll) == (np.median([r["hour"] for r in own]), np.median(good) if good else 0.0)
            assert (verified, n) == (max(r["verified"] for r in own), len(own))


def test_first_posts_are_ranked_without_a_second_pass_over_them(spark):
    """No minute of equal time stamps: the rows are moved once for the ranks (twice before)."""
    rows = [("a", DAY, f"u{i}", US0 + i * 1_000_000, i) for i in range(50)]
    fp = spark.createDataFrame(rows, "sym string, day date, actor string, us long, post_id long").withColumn("first_seen", ev.F.col("post_id"))
    r = ev.rank_posts(fp, 5)
    assert [x["rank"] for x in r.orderBy("us").collect()] == list(range(1, 51))
    assert r._jdf.queryExecution().executedPlan().toString().count("Join") == 1
