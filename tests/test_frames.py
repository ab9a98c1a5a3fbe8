"""The frame walk, its spread-out form, seeds, labels and novelty against direct loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from originflow.operators import frames as fr
from originflow.operators.hot_frames import hot_event_frames, resolve_slice

DAY = dt.date(2024, 1, 1)


def slow_walk(vs, thr):
    """Plain re-statement on lists."""
    cents, sizes, out = [], [], []
    for v in vs:
        v = np.asarray(v, float)
        v = v / (np.linalg.norm(v) + 1e-12)
        sims = [float(c @ v) for c in cents]
        best = max(sims) if sims else None
        if best is not None and best >= thr:
            j = sims.index(best)
            c = cents[j] * sizes[j] + v
            cents[j] = c / (np.linalg.norm(c) + 1e-12)
            sizes[j] += 1
            out.append((j, False, best))
        else:
            cents.append(v)
            sizes.append(1)
            out.append((len(cents) - 1, True, best))
    return out, cents, sizes


def events(spark, sizes, dim=6, seed=1):
    g = np.random.default_rng(seed)
    rows, vecs = [], {}
    for e, n in enumerate(sizes):
        vs = g.normal(size=(n, dim))
        vecs[f"s{e}"] = vs
        for i, v in enumerate(vs):
            rows.append((f"s{e}", DAY, i + 1, n, i, 1000 * i, float(g.integers(0, 50)), [float(x) for x in v]))
    df = spark.createDataFrame(rows, "sym string, day date, rank long, k long, actor long, us long, followers double, emb array<double>")
    return df, vecs


@pytest.mark.parametrize("thr", [0.3, 0.7])
def test_walk_equals_plain_loop(spark, thr):
    df, vecs = events(spark, [1, 2, 17, 60])
    got = fr.online_frames(df.repartition(7), thr).orderBy("sym", "rank").collect()
    for s, vs in vecs.items():
        want, cents, sizes = slow_walk(vs, thr)
        mine = [r for r in got if r["sym"] == s]
        assert [(r["frame_j"], r["is_new"]) for r in mine] == [(a, b) for a, b, _ in want]
        assert mine[0]["is_new"] and mine[0]["best_sim"] is None
        for r, (_, _, b) in zip(mine[1:], want[1:]):
            assert r["best_sim"] == pytest.approx(b, abs=1e-9)
        for r in mine:
            if r["is_new"]:
                assert r["frame_n"] == sizes[r["frame_j"]]
                assert np.allclose(r["centroid"], cents[r["frame_j"]], atol=1e-9)


def test_join_at_exact_threshold(spark):
    rows = [("a", DAY, 1, 2, 1, 0, 1.0, [1.0, 0.0]), ("a", DAY, 2, 2, 2, 1, 1.0, [0.6, 0.8])]
    df = spark.createDataFrame(rows, "sym string, day date, rank long, k long, actor long, us long, followers double, emb array<double>")
    sim = float(np.array([1.0, 0.0]) / (1 + 1e-12) @ (np.array([0.6, 0.8]) / (1 + 1e-12)))
    assert fr.online_frames(df, sim).filter("is_new").count() == 1
    assert fr.online_frames(df, sim + 1e-9).filter("is_new").count() == 2


@pytest.mark.parametrize("thr, few", [(0.35, 8), (0.6, 8), (-0.2, 1), (0.1, 2)])
def test_spread_walk_equals_single_task_walk(spark, thr, few):
    """With one or two listed frames and a low threshold most slices end before their last post."""
    df, _ = events(spark, [90, 41] if few == 8 else [40, 23], seed=5)
    plain = fr.online_frames(df, thr)
    spread = hot_event_frames(df, thr, "emb", plain.schema, chunk=16, few=few)
    a = plain.orderBy("sym", "rank").collect()
    b = spread.orderBy("sym", "rank").collect()
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (x["sym"], x["rank"], x["frame_j"], x["is_new"], x["frame_n"]) == (y["sym"], y["rank"], y["frame_j"], y["is_new"], y["frame_n"])
        assert (x["best_sim"] is None) == (y["best_sim"] is None)
        if x["best_sim"] is not None:
            assert x["best_sim"] == pytest.approx(y["best_sim"], abs=1e-9)
        if x["centroid"] is not None:
            assert np.allclose(x["centroid"], y["centroid"], atol=1e-9)


def test_large_events_are_routed_to_the_spread_walk(spark):
    df, _ = events(spark, [12, 50], seed=9)
    a = fr.online_frames(df, 0.4).select("sym", "rank", "frame_j", "is_new").orderBy("sym", "rank").collect()
    b = fr.online_frames(df, 0.4, max_event=20).select("sym", "rank", "frame_j", "is_new").orderBy("sym", "rank").collect()
    assert a == b


def test_future_labels_exclude_equal_times(spark):
    rows = [("a", DAY, 0, 1, 10, 5.0), ("a", DAY, 0, 2, 10, 7.0), ("a", DAY, 0, 3, 11, -2.0), ("a", DAY, 0, 4, 12, 4.0), ("a", DAY, 1, 5, 13, 9.0)]
    df = spark.createDataFrame(rows, "sym string, day date, frame_j int, rank long, us long, followers double")
    got = {r["frame_j"]: r for r in fr.future_labels(df).collect()}
    assert got[0]["future_adopt"] == 2 and got[0]["future_reach"] == pytest.approx(4.0)
    assert got[0]["hist_adopt"] == 3 and got[0]["hist_reach"] == pytest.approx(11.0)
    assert got[1]["future_adopt"] == 0 and got[1]["future_reach"] == 0


def test_novelty_memory_window(spark):
    """Only the last frames of earlier days count, here the last three."""
    g = np.random.default_rng(3)
    rows, flat = [], []
    for d in range(6):
        day = DAY + dt.timedelta(days=d)
        for j in range(2):
            v = g.normal(size=4)
            v /= np.linalg.norm(v)
            rows.append(("a", day, j, j + 1, [float(x) for x in v]))
            flat.append((d, v))
    df = spark.createDataFrame(rows, "sym string, day date, frame_j int, rank long, vec array<double>")
    got = {(r["day"], r["rank"]): r["novelty_global"] for r in fr.novelty_global(
        df.select("sym", "day", "rank", "vec"), df.select("sym", "day", "frame_j", F.col("vec").alias("centroid")), memory=3).collect()}
    assert not any(day == DAY for day, _ in got)
    for i, (d, v) in enumerate(flat):
        past = [u for e, u in flat if e < d][-3:]
        if past:
            assert got[(DAY + dt.timedelta(days=d), i % 2 + 1)] == pytest.approx(1 - max(float(u @ v) for u in past), abs=1e-9)


def test_best_match_over_blocks(spark):
    g = np.random.default_rng(4)
    a, b = g.normal(size=(23, 5)), g.normal(size=(31, 5))
    l = spark.createDataFrame([("x", i, [float(t) for t in v]) for i, v in enumerate(a)], "g string, lid int, vec array<double>")
    r = spark.createDataFrame([("x", i, [float(t) for t in v]) for i, v in enumerate(b)], "g string, rid int, vec array<double>")
    s = a @ b.T
    for row in fr.best_match(l, r, ["g"], "lid", "rid", block=4).collect():
        assert row["rid"] == int(s[row["lid"]].argmax()) and row["sim"] == pytest.approx(s[row["lid"]].max())


def test_a_slice_ends_where_its_listed_frames_do_not_decide():
    """Two posts near the same frames: the second cannot know whether a frame beyond its list is better than what was touched."""
    c = {0: (1, np.array([1.0, 0.0])), 1: (1, np.array([0.8, 0.6]))}
    vecs = np.array([[1.0, 0.0], [0.9, np.sqrt(0.19)]])
    near = {1: [(0, 1.0)], 2: [(0, 0.9)]}  # frame 1 is better for the second post, but off a list of one
    out, _ = resolve_slice([1, 2], vecs, near, c, 2, 0.5, more={1, 2})
    assert len(out) == 1 and out[0][0] == 0
    out, _ = resolve_slice([1, 2], vecs, {1: near[1], 2: [(1, 0.98), (0, 0.9)]}, c, 2, 0.5, more={1})
    assert [o[0] for o in out] == [0, 1]
