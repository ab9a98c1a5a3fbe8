"""Graph scores against dense matrices, resampling against direct loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from originflow.operators import graph, resample

DAY = dt.date(2024, 1, 1)


def ranked(spark, n_events=30, n_actors=9, seed=0):
    g = np.random.default_rng(seed)
    rows, w, events = [], np.zeros((n_actors, n_actors)), []
    for e in range(n_events):
        k = int(g.integers(5, n_actors + 1))
        order = g.choice(n_actors, k, replace=False)
        events.append(order)
        for i, a in enumerate(order):
            rows.append(("s", DAY + dt.timedelta(days=e), int(a), i + 1, k, k + 1 - 2 * (i + 1)))
            w[a, order[i + 1:]] += 1
    return spark.createDataFrame(rows, "sym string, day date, actor long, rank long, k long, net_lead long"), w, events


def vec(df, col, n):
    out = np.zeros(n)
    for r in df.collect():
        out[r["actor"]] = r[col]
    return out


@pytest.mark.parametrize("blocks", [False, True])
def test_graph_scores(spark, monkeypatch, blocks):
    if blocks:  # events cut into blocks of three ranks: prefix sums cross blocks
        monkeypatch.setattr(graph, "block_of", lambda c, size=4096: F.floor(c / 3).cast("int"))
    df, w, events = ranked(spark, 12 if blocks else 30)
    n = len(w)
    g = graph.LeadGraph(df)
    x = {a: float(a * a + 1) for a in range(n)}
    xv = np.array([x[a] for a in range(n)])
    xd = spark.createDataFrame(list(x.items()), "actor long, x double")
    assert np.allclose(vec(g.product(xd, True), "y", n), w @ xv) and np.allclose(vec(g.product(xd, False), "y", n), w.T @ xv)
    if blocks:
        sums = sum(np.isin(np.arange(n), o) * xv[o].sum() for o in events)
        assert np.allclose(vec(g.event_sums(xd), "y", n), sums)
        return
    inn, out = w.sum(0), w.sum(1)
    p = np.full(n, 1 / n)
    for _ in range(100):
        q = 0.85 * (w @ np.where(inn > 0, p / np.maximum(inn, 1e-300), 0) + p[inn == 0].sum() / n) + 0.15 / n
        done, p = np.abs(q - p).sum() < n * 1e-6, q
        if done:
            break
    assert np.allclose(vec(graph.pagerank_reversed(g), "g_pr", n), p, atol=1e-9)
    u, s, vt = np.linalg.svd(w)
    h = np.abs(u[:, 0])
    assert np.allclose(vec(graph.hits_hub(g), "g_hub", n), h / h.sum(), atol=1e-6)
    i, pa = np.ones(n), np.ones(n)
    for _ in range(100):
        a, b = (w / np.maximum(out, 1e-300)[:, None]) @ pa, (w / np.maximum(inn, 1e-300)[None, :]).T @ i
        i, pa = a / a.sum() * n, b / b.sum() * n
    got = graph.influence_passivity(g)
    assert np.allclose(vec(got, "influence", n), i, atol=1e-8) and np.allclose(vec(got, "passivity", n), pa, atol=1e-8)
    rows, ys = [], []
    for o in events:
        for x1 in range(len(o)):
            for x2 in range(x1 + 1, len(o)):
                r = np.zeros(n)
                r[o[x2]], r[o[x1]] = 1, -1
                rows.append(r)
                ys.append(1.0)
    a, y = np.array(rows), np.array(ys)
    s = np.linalg.lstsq(a, y, rcond=None)[0]
    pot, report = graph.precedence_potential(g)
    assert np.allclose(vec(pot, "potential", n), s - s.mean(), atol=1e-7)
    assert report["comparisons"] == len(y) and report["residual"] == pytest.approx(((a @ s - y) ** 2).sum())
    g.close()


def test_walks_follow_shared_events(spark):
    df, _, events = ranked(spark, 8, 9, 3)
    g = graph.LeadGraph(df)
    walks = {}
    for r in graph.random_walks(g, walks=40, length=6).collect():
        walks.setdefault(r["walk"], {})[r["step"]] = r["actor"]
    together = np.zeros((9, 9))
    for o in events:
        together[np.ix_(o, o)] += 1
    np.fill_diagonal(together, 0)
    moves = np.zeros((9, 9))
    for w in walks.values():
        assert sorted(w) == list(range(6))
        for t in range(5):
            assert together[w[t], w[t + 1]] > 0
            moves[w[t], w[t + 1]] += 1
    want = together / together.sum(1, keepdims=True)
    assert np.abs(moves / moves.sum(1, keepdims=True) - want).max() < 0.12
    e = graph.node_embeddings(g, dim=8, walks=2, length=6)
    assert e.count() == g.n and len(e.first()["embedding"]) == 8


def deltas(spark, sizes, seed=0):
    g = np.random.default_rng(seed)
    rows = [("c", "m", f"s{i}", f"e{i}_{j}", float(g.normal(0.1 * i, 1))) for i, n in enumerate(sizes) for j in range(n)]
    return spark.createDataFrame(rows, "comparison string, metric string, sym string, event_id string, delta double"), rows


def test_two_level_bootstrap(spark):
    df, rows = deltas(spark, [40, 25, 60])
    one = resample.bootstrap(df, ["comparison", "metric"], B=800, seed=3).first()
    same = resample.bootstrap(df.repartition(11), ["comparison", "metric"], B=800, seed=3).first()
    assert one == same
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r[4])
    assert one["observed"] == pytest.approx(np.mean([np.mean(v) for v in by.values()]))
    g = np.random.default_rng(9)
    draws = [np.mean([np.mean(g.choice(by[s], len(by[s]))) for s in g.choice(sorted(by), len(by))]) for _ in range(4000)]
    assert one["se"] == pytest.approx(np.std(draws), rel=0.12)
    assert one["lo"] == pytest.approx(np.quantile(draws, 0.05), abs=0.05) and one["hi"] == pytest.approx(np.quantile(draws, 0.95), abs=0.05)


def test_pooled_bootstrap_in_blocks(spark):
    """Small blocks: the draws are split over blocks and the spread stays that of n draws."""
    df, rows = deltas(spark, [50, 50], 4)
    v = np.array([r[4] for r in rows])
    for block in (4096, 16):
        r = resample.bootstrap(df, ["comparison", "metric"], B=800, seed=5, levels=1, block=block).first()
        assert r["observed"] == pytest.approx(v.mean()) and r["se"] == pytest.approx(v.std() / 10, rel=0.12)


@pytest.mark.parametrize("size", [20_000, 4])
def test_auc_bootstrap_equals_weighted_auc(spark, size):
    """The small size gives many buckets and splits the rows of a shared score over tasks."""
    g = np.random.default_rng(2)
    n = 80
    y, s1, s2 = (g.random(n) < 0.3).astype(float), g.integers(0, 12, n).astype(float), g.normal(size=n)
    rows = [(m, "s0", i, float(y[i]), float(s[i])) for m, s in (("a", s1), ("b", s2)) for i in range(n)]
    df = spark.createDataFrame(rows, "method string, sym string, row_id long, y double, score double")
    got = {(r["method"], r["rep"]): r for r in resample.bootstrap_auc(df, "y", "row_id", B=7, seed=5, reps_per_task=3, task_rows=size).collect()}
    w = resample.poisson_weights(np.arange(n), np.arange(7), 5)
    for m, s in (("a", s1), ("b", s2)):
        for rep in range(7):
            if (m, rep) not in got:
                continue  # the single symbol was not drawn
            wt = w[:, rep]
            pos, neg = wt * y, wt * (1 - y)
            cmp = (s[:, None] > s[None, :]) + 0.5 * (s[:, None] == s[None, :])
            assert got[(m, rep)]["auc"] == pytest.approx((pos[:, None] * neg[None, :] * cmp).sum() / pos.sum() / neg.sum())
            ap = sum(pos[s == t].sum() * pos[s >= t].sum() / wt[s >= t].sum() for t in set(s) if wt[s >= t].sum()) / pos.sum()
            assert got[(m, rep)]["ap"] == pytest.approx(ap)
    w = resample.poisson_weights(np.arange(20000), np.arange(5), 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03


def test_permutation(spark):
    df, *_ = ranked(spark, 30, 9, 1)
    for k in (1, 2, 9, 10, 100):  # a permutation in every replicate, and each place equally often
        places = resample.permuted_places(np.arange(1, k + 1), np.full(k, k), np.full(k, -17), np.arange(4000), 3)
        assert (np.sort(places, axis=0) == np.arange(1, k + 1)[:, None]).all()
        if k == 9:
            seen = np.array([np.bincount(row, minlength=k + 1)[1:] for row in places])
            assert abs(seen / 4000 - 1 / k).max() < 0.03
            assert abs(np.corrcoef(places)[0, 1:] + 1 / (k - 1)).max() < 0.06
    fixed = spark.createDataFrame([("s", DAY + dt.timedelta(days=e), a, a + 1, 8, 9 - 2 * (a + 1)) for e in range(20) for a in range(8)],
                                  "sym string, day date, actor long, rank long, k long, net_lead long")
    strong = resample.permutation_hierarchy(fixed, n=60).first()
    assert strong["p_value"] == pytest.approx(1 / 61) and strong["observed"] > 5 * strong["null_mean"]
    assert resample.permutation_hierarchy(df, n=60).first()["p_value"] > 0.02
