"""Ordered aggregates at sizes where a tied score or a single group would fill one task."""

import numpy as np
from pyspark.sql import functions as F

from originflow.operators import metrics as mx, ordered


def test_value_buckets_rise_with_the_value(spark):
    g = np.random.default_rng(0)
    v = np.concatenate([g.normal(size=4000), np.full(3000, 0.25), [np.nan, np.inf, -np.inf]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    rows = sorted((r.v, r.b) for r in ordered.with_value_bucket(df, "v", "b").collect() if r.v is not None and r.v == r.v)
    assert all(x[1] <= y[1] for x, y in zip(rows, rows[1:])) and len({b for _, b in rows}) >= 64
    alone = {b for x, b in rows if x == 0.25}
    assert len(alone) == 1 and next(iter(alone)) % 2 == 1 and {x for x, b in rows if b in alone} == {0.25}
    edges = ordered.value_edges(df, "v")
    assert edges == sorted(edges) and {r.b for r in ordered.with_value_bucket(df, "v", "b").filter("v is null").collect()} == {0}
    want = {x: 2 * (int(np.searchsorted(edges, x)) + 1) + (x in edges) for x, _ in rows}
    assert all(b == want[x] for x, b in rows)
    assert ordered.with_value_bucket(df.limit(0), "v").count() == 0


def test_number_of_buckets_follows_the_rows(spark):
    df = spark.range(1_500_000).select(F.col("id").cast("double").alias("v"))
    few, many = ordered.value_edges(df.limit(1000), "v"), None
    ordered_rows, ordered.BUCKET_ROWS = ordered.BUCKET_ROWS, 5_000
    try:
        many = ordered.value_edges(df, "v")
        top = ordered.with_value_bucket(df, "v").groupBy("_b").count().agg(F.max("count")).first()[0]
    finally:
        ordered.BUCKET_ROWS = ordered_rows
    assert len(few) == 63 and len(many) >= 255 and top < 3 * 5_000


def test_ties_are_split_by_what_follows_them(spark):
    """A million rows of one score: no block has more than three times its share, and blocks rise along the order."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(1.0).alias("s"), F.concat(F.lit("event:"), (F.col("id") % 5000).cast("string")).alias("e"), F.col("id").alias("j"))
    b = ordered.range_blocks(df, [F.desc("s"), "e", "j"], rows=50_000)
    sizes = [r["count"] for r in b.groupBy("_b").count().collect()]
    assert sum(sizes) == n and max(sizes) < 150_000 and len(sizes) >= 10
    spans = sorted((r._b, r.lo, r.hi) for r in b.groupBy("_b").agg(F.min(F.struct("e", "j")).alias("lo"), F.max(F.struct("e", "j")).alias("hi")).collect())
    assert all(tuple(x[2]) < tuple(y[1]) for x, y in zip(spans, spans[1:]))


def test_row_metrics_with_many_ties(spark):
    g = np.random.default_rng(1)
    rows = [(f"k{i % 2}", float(g.choice([0.5, 0.5, 0.5, g.random()])), f"e{int(g.integers(50)):02d}", i, float(g.random() < 0.3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, s double, e string, j int, y double")
    got = {r.k: r.ap for r in mx.average_precision_rows(df, "y", "s", ["e", "j"], ["k"]).collect()}
    at = {r.k: r for r in mx.at_p(df, "y", "s", ["e", "j"], ["k"]).collect()}
    for k in ("k0", "k1"):
        y = np.array([r[4] for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2], r[3]))])
        hits, place = np.cumsum(y), np.arange(1, len(y) + 1)
        assert abs(got[k] - (y * hits / place).sum() / y.sum()) < 1e-12
        assert abs(at[k].r_precision - y[:int(y.sum())].mean()) < 1e-12 and abs(at[k].precision_at_top - y[:50].mean()) < 1e-12
