"""Structured Streaming form of the prefix-memory features.

State is kept per (symbol, day): posts wait in a buffer until the watermark passes them, then are
handled in time order; the state ends at day end. Late posts are counted and left out.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originflow.operators.frames import TINY
from originflow.sources.posts import DAY_US

OUTPUT = (
    "sym string, day date, actor string, post_id long, us long, rank long, frame_j int, best_sim double, is_new_frame double, "
    "novelty_to_memory double, prior_total_posts double, prior_frame_count double, dominant_frame_share double, "
    "frame_entropy double, memory_prior_ol_mean double, memory_prior_max_ol double, matched_sim double, "
    "matched_prior_count double, matched_log_prior_reach double, matched_age_ranks double, matched_recency_ranks double, "
    "matched_origin_ol double, matched_max_ol double, matched_mean_ol double, matched_ol_sum double, late_posts long"
)


@dataclass
class EventState:
    """What one event must remember: the buffer, the actors seen, and sums per frame."""

    waiting: list = field(default_factory=list)
    actors: set = field(default_factory=set)
    centroids: list = field(default_factory=list)
    frames: list = field(default_factory=list)  # [count, reach, first rank, last rank, origin trait, max trait, trait sum]
    released: int = -1
    late: int = 0
    total: int = 0
    trait_sum: float = 0.0
    trait_max: float = -math.inf

    def place(self, v: np.ndarray, thr: float) -> tuple[int, float | None]:
        if not self.centroids:
            return -1, None
        s = np.stack(self.centroids) @ v
        j = int(s.argmax())
        return (j if s[j] >= thr else -1), float(s[j])

    def features(self, j: int, best: float | None) -> dict:
        """Values before the update; ``j`` is -1 for a new frame."""
        n, rank = self.total, self.total + 1
        share = np.array([f[0] for f in self.frames], dtype=float) / n if n else np.zeros(0)
        f = self.frames[j] if j >= 0 else None
        return {
            "rank": rank, "frame_j": j if j >= 0 else len(self.frames), "best_sim": best,
            "is_new_frame": float(j < 0), "novelty_to_memory": 1.0 - max(0.0, best) if n else 1.0,
            "prior_total_posts": float(n), "prior_frame_count": float(len(self.frames)),
            "dominant_frame_share": float(share.max()) if n else 0.0,
            "frame_entropy": float(-(share * np.log(share)).sum()) if n else 0.0,
            "memory_prior_ol_mean": self.trait_sum / n if n else 0.0,
            "memory_prior_max_ol": self.trait_max if n else 0.0,
            "matched_sim": best if f else 0.0, "matched_prior_count": float(f[0]) if f else 0.0,
            "matched_log_prior_reach": math.log1p(f[1]) if f else 0.0,
            "matched_age_ranks": float(rank - f[2]) if f else 0.0, "matched_recency_ranks": float(rank - f[3]) if f else 0.0,
            "matched_origin_ol": f[4] if f else 0.0, "matched_max_ol": f[5] if f else 0.0,
            "matched_mean_ol": f[6] / f[0] if f else 0.0, "matched_ol_sum": f[6] if f else 0.0,
        }

    def update(self, j: int, v: np.ndarray, followers: float, trait: float) -> None:
        self.total += 1
        rank, reach = self.total, max(0.0, followers)
        self.trait_sum += trait
        self.trait_max = max(self.trait_max, trait)
        if j < 0:
            self.centroids.append(v)
            self.frames.append([1, reach, rank, rank, trait, trait, trait])
            return
        f = self.frames[j]
        c = self.centroids[j] * f[0] + v
        self.centroids[j] = c / (np.linalg.norm(c) + TINY)
        self.frames[j] = [f[0] + 1, f[1] + reach, f[2], rank, f[4], max(f[5], trait), f[6] + trait]

    def release(self, until: int, thr: float) -> list[dict]:
        """Handle all waiting posts up to a time; the first post of each actor counts."""
        ready = sorted((w for w in self.waiting if w["us"] <= until), key=lambda w: (w["us"], w["post_id"]))
        self.waiting = [w for w in self.waiting if w["us"] > until]
        self.released = max(self.released, until)
        out = []
        for w in ready:
            if w["actor"] in self.actors:
                continue
            self.actors.add(w["actor"])
            v = np.asarray(w["emb"], dtype=np.float64)
            v = v / (np.linalg.norm(v) + TINY)
            j, best = self.place(v, thr)
            row = self.features(j, best)
            self.update(j, v, w["followers"], w["current_ol"])
            out.append({"actor": w["actor"], "post_id": w["post_id"], "us": w["us"], **row, "late_posts": self.late})
        return out


def memory_stream(posts: DataFrame, thr: float, watermark: str = "1 hour") -> DataFrame:
    """Streaming memory features. ``posts``: ts TIMESTAMP, sym, day, actor, post_id, us, followers, current_ol, emb.

    Join traits and vectors before (stream-static joins). Emits each post once, when the watermark has
    passed it, or at day end.
    """
    names = [c.split()[0] for c in OUTPUT.split(", ")]

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ev = EventState(**pickle.loads(state.get[0])) if state.exists else EventState()
        mark = state.getCurrentWatermarkMs() * 1000
        rows: list[dict] = []
        if state.hasTimedOut:
            rows = ev.release(2**62, thr)
            state.remove()
        else:
            for pdf in frames:
                for w in pdf[["us", "post_id", "actor", "followers", "current_ol", "emb"]].to_dict("records"):
                    if w["us"] <= ev.released:
                        ev.late += 1
                    else:
                        ev.waiting.append(w)
            if mark > 0:
                rows = ev.release(mark, thr)
            state.update((pickle.dumps(vars(ev)),))
            end_ms = ((key[1] - pd.Timestamp("1970-01-01").date()).days + 1) * (DAY_US // 1000)
            state.setTimeoutTimestamp(max(end_ms, state.getCurrentWatermarkMs() + 1))
        if rows:
            out = pd.DataFrame(rows)
            out["sym"], out["day"], out["actor"] = key[0], key[1], out["actor"].astype(str)
            yield out[names]

    return (
        posts.withWatermark("ts", watermark).groupBy("sym", "day")
        .applyInPandasWithState(step, OUTPUT, "blob binary", "append", "EventTimeTimeout")
    )


def stream_ready(posts: DataFrame, traits: DataFrame, vectors: DataFrame, vec_on: list[str]) -> DataFrame:
    """Attach traits (dropping actors without one) and vectors to a stream of posts."""
    t = traits.select("actor", F.col("oltrait").alias("current_ol"))
    return posts.join(t, "actor").join(vectors, vec_on).select(
        "ts", "sym", "day", F.col("actor").cast("string").alias("actor"), "post_id", "us", "followers", "current_ol",
        F.transform("emb", lambda x: x.cast("double")).alias("emb"))
