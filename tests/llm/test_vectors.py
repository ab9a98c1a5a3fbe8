"""Embedding near-dedup and nearest neighbours against brute force."""

import numpy as np

from originflow.llm import mih, rp_forest


def planted(n=400, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = np.repeat(base[:20], 8, 0) + rng.normal(size=(160, dim)) * 0.12
    x = np.concatenate([base, near, np.repeat(base[:3], 5, 0)]).astype(np.float32)
    return x, rng.integers(0, 3, len(x))


def brute(ids, labels, x, threshold):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = (u @ u.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    root = np.arange(len(ids))
    while True:
        low = np.array([min([root[i], *root[link[i]]]) for i in range(len(ids))])
        if np.array_equal(low, root):
            return link.sum(1), root
        root = low


def test_forest_with_small_leaves_finds_every_link(spark):
    x, labels = planted()
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), [float(v) for v in e], int(k)) for i, e, k in zip(ids, x, labels)], "vec_id long, embedding array<float>, label int")
    n, root = brute(ids, labels, x, 0.93)
    assert n.sum() > 100
    for leaf in (1024, 24):  # one leaf, and several levels with split leaves
        got = {r.vec_id: r for r in rp_forest.near_duplicates(df, leaf=leaf).collect()}
        assert [got[i].n_links for i in ids.tolist()] == n.tolist()
        assert [got[i].component_id for i in ids.tolist()] == root.tolist()
        assert all(got[i].kept == (root[i] == i) for i in ids.tolist())


def test_pair_is_counted_once_over_trees_and_leaves():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    left, right = rp_forest.sides(x, x.mean(0), 5, 4, 0.5)
    leaves = [[set(rp_forest.leaves_of(int(left[i, t]), int(right[i, t]), 5)) for t in range(4)] for i in range(60)]
    for i in range(60):
        for j in range(i):
            first = next(((t, min(leaves[i][t] & leaves[j][t])) for t in range(4) if leaves[i][t] & leaves[j][t]), None)
            found = []
            for t in range(4):
                for leaf in leaves[i][t] & leaves[j][t]:
                    ok = (31 & ~(left[i, t] & left[j, t])) == leaf and not any(
                        ((left[i, s] & left[j, s]) | (right[i, s] & right[j, s])) == 31 for s in range(t))
                    if ok:
                        found.append((t, leaf))
            assert found == ([] if first is None else [first])


ODD = [(1, [1.0, 0.0], 1, "a"), (2, [2.0, 0.0], 1, "a"), (2, [2.0, 0.0], 1, "b"), (3, None, 1, "c"), (4, [0.0, 0.0], 1, "d"), (5, [1.0, None], 1, "e"),
       (6, [float("nan"), 1.0], 1, "f"), (7, [1.0, 0.0], None, "g"), (None, [1.0, 0.0], 1, "h"), (8, [1.0, 0.0, 0.0], 1, "i"), (50, [1.0, 0.1], 2, "j"),
       (9, [float("inf"), 1.0], 1, "k"), (100, [0.0, 1.0], 1, "l")]


def test_forest_odd_rows(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<float>, label int, rid string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in rp_forest.near_duplicates(df).collect()), key=str)
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 50, 100)] + [(None, 0, None, False)]
    assert got == sorted(want, key=str)
    assert rp_forest.near_duplicates(df.limit(0)).count() == 0


def test_search_recall_and_order(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = mih.search(df, enough=50).toPandas()
    hit = 0
    asked = ids[ids % 50 == 0]
    for q in asked:
        score = mih.cosines(x, x[ids == q][0])
        score[ids == q] = -9
        want = ids[np.lexsort((ids, -score))[:5]].tolist()
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and (np.diff(mine["score"]) <= 0).all()
        hit += len(set(want) & set(mine["vec_id"]))
    assert hit / (5 * len(asked)) >= 0.95


def test_probing_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (500, 8)).astype(np.uint8)
    codes[:40] = codes[0] ^ (rng.random((40, 8)) < 0.2).astype(np.uint8)
    index = mih.MultiIndex(codes)
    for q in codes[::25]:
        distance = np.bitwise_count(codes ^ q).sum(1)
        for enough in (1, 30, 499, 600):
            radius = np.sort(distance)[min(enough, 500) - 1]
            assert sorted(index.within_growing_radius(q, enough).tolist()) == np.flatnonzero(distance <= radius).tolist()


def test_search_odd_rows(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<float>, block int, asks string")
    got = [(r.query_id, r["rank"], r.vec_id) for r in mih.search(df).orderBy("query_id", "rank", "vec_id").collect()]
    assert [g for g in got if g[0] == 50] == [(50, 1, 1), (50, 2, 2), (50, 3, 2), (50, 4, 7), (50, 5, 100)]
    assert {g[0] for g in got} == {50, 100} and mih.search(df.limit(0)).count() == 0
