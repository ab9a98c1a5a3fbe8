"""Streaming memory features equal the batch ones; late and repeated posts are handled."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from originflow.operators import frames as fr, memory as me
from originflow.operators.events import first_posts, rank_posts
from originflow.sources.posts import day_of
from originflow.streaming.memory import memory_stream

BASE = dt.datetime(2024, 1, 1, 1)
COLS = "ts timestamp, sym string, actor string, post_id long, followers double, current_ol double, emb array<double>"
FEATURES = ["frame_entropy", "dominant_frame_share", "novelty_to_memory", "matched_sim", "matched_prior_count", "matched_log_prior_reach",
            "matched_age_ranks", "matched_recency_ranks", "matched_origin_ol", "matched_max_ol", "matched_mean_ol", "matched_ol_sum",
            "memory_prior_ol_mean", "memory_prior_max_ol", "prior_frame_count", "prior_total_posts", "is_new_frame"]


def posts(n=60, seed=2):
    g = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        actor = f"a{int(g.integers(0, 25))}"
        ol = float(sum(map(ord, actor)) % 7 - 3)
        rows.append((BASE + dt.timedelta(minutes=4 * i), ["x", "y"][i % 2], actor, i, float(g.integers(0, 90)), ol, [float(t) for t in g.normal(size=4)]))
    return rows


def with_keys(df):
    us = F.unix_micros("ts")
    return df.withColumn("us", us).withColumn("day", day_of(us))


def test_stream_equals_batch(spark, tmp_path):
    rows = posts()
    late = (BASE + dt.timedelta(minutes=1), "x", "late_one", 900, 1.0, 1.0, [1.0, 0.0, 0.0, 0.0])
    end = (BASE + dt.timedelta(days=3), "z", "a1", 901, 1.0, 1.0, [1.0, 0.0, 0.0, 0.0])
    parts = [rows[:20], rows[20:45], [*rows[45:], late], [end], [(end[0] + dt.timedelta(days=2), *end[1:3], 902, *end[4:])]]
    src = tmp_path / "in"
    for i, p in enumerate(parts):
        spark.createDataFrame(p, COLS).coalesce(1).write.parquet(str(src / f"p{i}"))
    stream = spark.readStream.schema(T._parse_datatype_string(COLS)).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(str(src))
    q = (memory_stream(with_keys(stream), 0.5).writeStream.format("memory").queryName("mem_out").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {(r["sym"], r["post_id"]): r for r in spark.table("mem_out").collect() if r["sym"] != "z"}
    batch = with_keys(spark.createDataFrame(rows, COLS))
    ranked = rank_posts(first_posts(batch, carry=("followers", "current_ol", "emb")))
    want = me.memory_features(fr.online_frames(ranked, 0.5)).collect()
    assert len(got) == len(want)
    for w in want:
        r = got[(w["sym"], w["post_id"])]
        assert (r["rank"], r["frame_j"]) == (w["rank"], w["frame_j"])
        for f in FEATURES:
            assert r[f] == pytest.approx(w[f], abs=1e-9), f
    assert ("x", 900) not in got


def test_running_features_over_many_blocks(spark, monkeypatch):
    """Splitting events into tiny blocks changes nothing."""
    batch = with_keys(spark.createDataFrame(posts(90, 7), COLS))
    frames = fr.online_frames(rank_posts(first_posts(batch, carry=("followers", "current_ol", "emb"))), 0.4)
    cols = ["sym", "rank", *FEATURES]
    one = me.memory_features(frames, roles=True).orderBy("sym", "rank").collect()
    lab = me.suffix_labels(frames).orderBy("sym", "rank").collect()
    monkeypatch.setattr(me, "block_of", lambda c, size=4096: F.floor(c / 5).cast("int"))
    many = me.memory_features(frames, roles=True).orderBy("sym", "rank").collect()
    lab2 = me.suffix_labels(frames).orderBy("sym", "rank").collect()
    numeric = [c for c, v in one[0].asDict().items() if isinstance(v, float)]
    assert len(numeric) > 40 and set(cols) - set(one[0].asDict()) == set()
    for a, b in zip(one, many):
        for c in numeric:
            assert a[c] == pytest.approx(b[c], abs=1e-9), c
    assert [(r["future_adopt"], round(r["future_reach"], 9)) for r in lab] == [(r["future_adopt"], round(r["future_reach"], 9)) for r in lab2]
