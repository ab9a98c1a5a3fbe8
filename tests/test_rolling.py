"""Rolling windows, ablations, batched graph scores and listwise trees against direct loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from originflow.operators import ablation, boosting, graph, windows
from originflow.operators.metrics import event_metrics, symbol_mean

DAY = dt.date(2024, 1, 1)


# ---- windows

WINS = [windows.RollingWindow("a", "2024-01-03", "2024-01-07", "2024-01-09", "2024-01-06"),
        windows.RollingWindow("b", "2024-01-05", "2024-01-09", "2024-01-11", "2024-01-08")]


def test_a_row_belongs_to_every_window_that_holds_its_day(spark):
    days = windows.window_days(windows.windows_table(spark, WINS))
    df = spark.createDataFrame([(i, DAY + dt.timedelta(days=i)) for i in range(15)] + [(99, None)], "id int, day date")
    got = {(r.id, r.window, r.split, r.part, str(r.cutoff)) for r in windows.with_windows(df, days).collect()}
    want = set()
    for i in range(15):
        d = str(DAY + dt.timedelta(days=i))
        for w in WINS:
            if w.train_start <= d < w.test_start:
                want.add((i, w.name, "train", "fit" if d < w.inner else "dev", w.train_start))
            elif w.test_start <= d < w.test_end:
                want.add((i, w.name, "test", "test", w.test_start))
    assert got == want and len({g[1] for g in got if g[0] == 5}) == 2
    assert windows.cutoffs(WINS) == ["2024-01-03", "2024-01-05", "2024-01-07", "2024-01-09"]


@pytest.mark.parametrize("bad", [("x|y", "2024-01-01", "2024-01-03", "2024-01-04", "2024-01-02"),
                                 ("x", "2024-01-03", "2024-01-03", "2024-01-04", "2024-01-03"),
                                 ("x", "2024-01-01", "2024-01-03", "2024-01-04", "2024-01-05")])
def test_bad_windows_are_refused(bad):
    with pytest.raises(ValueError):
        windows.RollingWindow(*bad)


# ---- ablation

def ablation_rows(n=400, seed=0):
    g = np.random.default_rng(seed)
    rows = []
    for w in ("a", "b", "tiny"):
        for i in range(n if w != "tiny" else 12):
            x = g.normal(size=3)
            miss = g.random() < 0.1
            y = x[0] * (2 if w == "a" else -1) + 0.5 * x[1] + 0.1 * g.normal()
            rows.append((w, "train" if i % 4 else "test", f"e{i // 5}", "s", i % 5, float(x[0]), None if miss else float(x[1]),
                         float("nan") if g.random() < 0.05 else float(x[2]), float(y) if i != 9 else None))
    return rows


def brute_ridge(rows, w, cols, alpha=3.0):
    tr = [r for r in rows if r[0] == w and r[1] == "train" and r[8] is not None]
    col = lambda rs, c: np.array([np.nan if r[c] is None else r[c] for r in rs], float)
    med = {c: np.nanmedian(col(tr, c)) for c in cols}
    x = np.stack([np.where(np.isnan(col(tr, c)), med[c], col(tr, c)) for c in cols], 1)
    mu, sd = x.mean(0), x.std(0) + 1e-12
    y = np.array([r[8] for r in tr])
    z = (x - mu) / sd
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(len(cols)), z.T @ (y - y.mean()))
    return lambda rs: y.mean() + (np.stack([np.where(np.isnan(col(rs, c)), med[c], col(rs, c)) for c in cols], 1) - mu) / sd @ beta


def test_each_window_has_its_own_models(spark):
    rows = ablation_rows()
    df = spark.createDataFrame(rows, "window string, split string, event_id string, sym string, frame_j int, x0 double, x1 double, x2 double, y double")
    sets = {"one": ["x0"], "all": ["x0", "x1", "x2"]}
    fitted = ablation.fit_sets(df, sets, "y", F.col("split") == "train")
    status = {(w, m): s for w, m, _, _, s in fitted.fits}
    assert status == {(w, m): "too few rows" if w == "tiny" else "fitted" for w in ("a", "b", "tiny") for m in sets}
    assert {(w, m): n for w, m, _, n, _ in fitted.fits}["a", "all"] == 299
    test = [r for r in rows if r[1] == "test"]
    got = {(r.window, r.method, r.event_id, r.frame_j): r.score for r in
           ablation.score_sets_by(df.filter("split = 'test'"), fitted.models, ["event_id", "frame_j"]).collect()}
    want = {}
    for w in ("a", "b"):
        for m, fs in sets.items():
            mine = [r for r in test if r[0] == w]
            for r, s in zip(mine, brute_ridge(rows, w, [5 + int(f[1]) for f in fs])(mine)):
                want[w, m, r[2], r[4]] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_table_pools_test_events_of_all_windows(spark):
    df = spark.createDataFrame(ablation_rows(), "window string, split string, event_id string, sym string, frame_j int, x0 double, x1 double, x2 double, y double") \
        .withColumn("y", F.col("y") + 10)
    events, fitted = ablation.ablation_events(df, {"all": ["x0", "x1", "x2"]}, "y")
    table = {r.window: r for r in ablation.ablation_table(events, ["ndcg3"]).collect()}
    assert set(table) == {"a", "b", "pooled"} and table["pooled"].n_events == table["a"].n_events + table["b"].n_events
    assert abs(table["pooled"].ndcg3 - events.agg(F.avg("ndcg3")).first()[0]) < 1e-12
    empty, none = ablation.ablation_events(df.limit(0), {"all": ["x0"]}, "y")
    assert empty.count() == 0 and none.fits == []


# ---- graphs of several cutoffs

def lead_rows(n_events=36, n_actors=8, seed=2):
    g = np.random.default_rng(seed)
    rows, events = [], []
    for e in range(n_events):
        pool = n_actors if e >= 12 else n_actors - 2  # two actors appear late: some cutoffs do not know them
        k = int(g.integers(5, pool + 1))
        order = g.choice(pool, k, replace=False)
        events.append((DAY + dt.timedelta(days=e), order))
        rows += [("s", DAY + dt.timedelta(days=e), int(a), i + 1, k, 0) for i, a in enumerate(order)]
    return rows, events


def dense(events, cutoff, n):
    w, there = np.zeros((n, n)), np.zeros(n, bool)
    for day, order in events:
        if str(day) < cutoff:
            there[order] = True
            for i, a in enumerate(order):
                w[a, order[i + 1:]] += 1
    return w[np.ix_(there, there)], np.flatnonzero(there)


@pytest.mark.parametrize("blocks", [False, True])
def test_graph_scores_of_all_cutoffs_settle_in_one_batch(spark, monkeypatch, blocks):
    rows, events = lead_rows(20 if blocks else 36)
    if blocks:
        monkeypatch.setattr(graph, "block_of", lambda c, size=4096: F.floor(c / 3).cast("int"))
    df = spark.createDataFrame(rows, "sym string, day date, actor long, rank long, k long, net_lead long")
    g = graph.LeadGraph(df)
    cuts = ["2024-01-01", "2024-01-09", "2024-02-20"] if not blocks else ["2024-01-09", "2024-02-20"]  # the first knows no event
    got = {(str(r.cutoff), r.actor): r for r in graph.graph_features(g, cuts).collect()}
    want = 0
    for c in cuts:
        w, ids = dense(events, c, 8)
        if not len(ids):
            continue
        n, out, inn = len(ids), w.sum(1), w.sum(0)
        p = np.full(n, 1 / n)
        for _ in range(100):
            q = 0.85 * (w @ np.where(inn > 0, p / np.maximum(inn, 1e-300), 0) + p[inn == 0].sum() / n) + 0.15 / n
            done, p = np.abs(q - p).sum() < n * 1e-6, q
            if done:
                break
        h = np.full(n, 1 / n)
        for _ in range(500):
            q = w @ (w.T @ h)
            q = q / q.sum()
            done, h = np.abs(q - h).sum() < 1e-8, q
            if done:
                break
        a, b = np.ones(n), np.ones(n)
        for _ in range(100):
            x = np.where(out > 0, w @ b / np.maximum(out, 1e-300), 0)
            y = np.where(inn > 0, w.T @ a / np.maximum(inn, 1e-300), 0)
            a, b = x / x.sum() * n, y / y.sum() * n
        for i, actor in enumerate(ids):
            r = got[c, actor]
            want += 1
            assert np.allclose([r.g_out, r.g_in, r.g_net, r.g_pr, r.g_hub, r.influence, r.passivity],
                               [np.log1p(out[i]), np.log1p(inn[i]), out[i] - inn[i], p[i], h[i], a[i], b[i]], atol=1e-8)
    assert len(got) == want
    g.close()


# ---- listwise trees

def panel(n_events=300, seed=1):
    """Grades follow a step in ``a`` whose direction ``b`` decides: no linear score orders them."""
    g = np.random.default_rng(seed)
    rows = []
    for e in range(n_events):
        for j in range(6):
            a, b, c = g.normal(size=3)
            y = 3.0 * (a > 0.3) * (b > -0.5) + 1.5 * (abs(c) > 1) + 0.1 * g.random()
            rows.append((f"e{e}", "s", j, float(a), None if g.random() < 0.05 else float(b), float(c), float(y)))
    return rows


SCHEMA = "event_id string, sym string, frame_j int, a double, b double, c double, grade double"


def test_root_splits_against_a_loop(spark):
    rows = panel(60)
    got = {f: (gain, left) for f, gain, left in boosting.root_splits(spark.createDataFrame(rows, SCHEMA), ["a", "b", "c"], "grade", n_bins=8)}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    grads = []
    for ev in by.values():
        e = np.exp(np.array([r[6] for r in ev]) - max(r[6] for r in ev))
        grads += [(r, 1 / len(ev) - p, 1 / len(ev) * (1 - 1 / len(ev))) for r, p in zip(ev, e / e.sum())]
    for k, f in enumerate("abc"):
        x = np.array([np.nan if r[3 + k] is None else r[3 + k] for r, _, _ in grads])
        g, h = np.array([v[1] for v in grads]), np.array([v[2] for v in grads])
        best = (0.0, 0)
        for edge in [-np.inf, *np.quantile(x[~np.isnan(x)], np.arange(1, 8) / 8)]:
            left = np.isnan(x) | (x <= edge)
            if min(left.sum(), (~left).sum()) >= 20:
                t = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
                best = max(best, (t(left) + t(~left) - t(left | ~left), -int(left.sum())))
        assert abs(got[f][0] - best[0]) < 1e-9 and got[f][1] == -best[1]


def test_trees_learn_what_no_linear_score_can(spark):
    df = spark.createDataFrame(panel(), SCHEMA).cache()
    train, test = df.filter("event_id < 'e2'"), df.filter("event_id >= 'e2'")
    model = boosting.fit_trees(train, ["a", "b", "c"], "grade", 12, rate=0.3, depth=3)
    assert len(model.trees) == 12 and len(model.losses) == 13 and model.losses[-1] < model.losses[0] - 0.05
    ndcg = lambda d: symbol_mean(event_metrics(d, "grade", "score", ["event_id", "sym"], ks=(3,)), ["ndcg3"]).first().ndcg3
    from originflow.operators.models import listwise
    linear = test.withColumn("score", listwise(train, ["a", "b", "c"], "grade", F.lit(True)).column())
    assert ndcg(model.score(test)) > ndcg(linear) + 0.05
    # scores after each size are those of the shorter model, refreshed or not
    short = boosting.TreeRanker(model.features, model.edges, model.rate, model.trees[:5])
    both = model.score(test, [5, 12], "s").select("event_id", "frame_j", "s").collect()
    a = {(r.event_id, r.frame_j): r.score for r in short.score(test).collect()}
    b = {(r.event_id, r.frame_j): r.score for r in model.score(test).collect()}
    assert all(abs(r.s[0] - a[r.event_id, r.frame_j]) < 1e-12 and abs(r.s[1] - b[r.event_id, r.frame_j]) < 1e-12 for r in both)
    # the last loss is that of the final scores
    rows = [(r.event_id, r.grade, r.score) for r in model.score(train).collect()]
    by = {}
    for e, y, s in rows:
        by.setdefault(e, []).append((y, s))
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    loss = np.mean([-(soft(np.array([y for y, _ in v])) * np.log(soft(np.array([s for _, s in v])))).sum() for v in by.values()])
    assert abs(loss - model.losses[-1]) < 1e-9


def test_trees_without_rows_or_splits(spark):
    df = spark.createDataFrame(panel(3), SCHEMA)
    none = boosting.fit_trees(df.limit(0), ["a"], "grade", 3)
    few = boosting.fit_trees(df, ["a"], "grade", 3)  # 18 rows: no node can be split into two of 20
    assert none.trees == few.trees == []
    assert {r.score for r in few.score(df).collect()} == {0.0}


def test_number_of_trees_is_chosen_on_dev_rows(spark):
    df = spark.createDataFrame(panel(120), SCHEMA).withColumn("part", F.when(F.col("event_id") < "e5", "fit").otherwise("dev"))
    model, size, found = boosting.select_trees(df, ["a", "b", "c"], "grade", "grade", F.col("part") == "fit", F.col("part") == "dev",
                                               F.lit(True), [1, 4], rate=0.3, depth=2)
    assert set(found) == {1, 4} and size == max(found, key=lambda n: (found[n], -n)) and len(model.trees) == size
