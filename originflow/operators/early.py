"""Early-frame panel: seed frames from an event's first posts, labels from the later ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originflow.operators.events import EVENT, early_split, rerank
from originflow.operators.frames import FRAME, assign_to_seeds, best_match, centroids, memory_window, online_frames
from originflow.session import cut

# The early modes.
EARLY_MODES = {
    "first3": ("count", 3), "first5": ("count", 5), "first10": ("count", 10), "first2h": ("hours", 2.0),
    "first6h": ("hours", 6.0),
}


def early_events(
    ranked: DataFrame, trait: DataFrame, kind: str, value: float, min_actors: int = 8, min_early: int = 3,
    min_future: int = 2,
) -> DataFrame:
    """Posts of trait members in events with enough early and later posts, marked early or not."""
    members = rerank(ranked.join(trait.select("actor"), "actor", "left_semi"))
    d = early_split(members.filter(F.col("k") >= min_actors), kind, value)
    size = d.groupBy(*EVENT).agg(F.sum(F.col("early").cast("int")).alias("n_early"),
                                 F.sum((~F.col("early")).cast("int")).alias("n_future"))
    size = size.filter((F.col("n_early") >= min_early) & (F.col("n_future") >= min_future))
    return d.join(size, EVENT)


def early_panel(
    ranked: DataFrame, vectors: DataFrame, on: list[str], trait: DataFrame, meta: DataFrame, thr: float,
    mode: str = "first10", stance: str = "stance", memory: int = 1000, **gates,
) -> DataFrame:
    """One row per seed frame with early features and later labels.

    ``ranked`` carries a stance column; ``trait`` and ``meta`` are keyed by actor (one cutoff).
    """
    kind, value = EARLY_MODES[mode]
    posts = cut(early_events(ranked, trait, kind, value, **gates))
    seeds = cut(online_frames(posts.filter("early").join(vectors, on), thr))
    enough = seeds.groupBy(*EVENT).agg(F.max("frame_j").alias("_top")).filter("_top >= 1").drop("_top")
    cents = centroids(seeds).join(enough, EVENT, "left_semi")
    later = posts.filter("NOT early").join(enough, EVENT, "left_semi").join(vectors, on).select(
        *EVENT, "rank", "followers", F.col("emb").alias("vec"))
    labels = cut(assign_to_seeds(later, cents, EVENT, thr))
    used = labels.select(*EVENT).distinct()
    cents = cents.join(used, EVENT, "left_semi")
    seeds = seeds.join(used, EVENT, "left_semi")

    st, reach = F.col(stance).cast("double"), F.greatest(F.lit(0.0), F.col("followers"))
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    frame = seeds.groupBy(*FRAME).agg(
        F.min(F.struct("rank", "actor", "post_id", st.alias("stance"), "followers", "verified")).alias("o"),
        F.count(F.lit(1)).alias("early_size"), F.sum(reach).alias("early_reach"),
        F.avg(st).alias("frame_stance_mean"), share(st > 0).alias("frame_bull_share"),
        share(st < 0).alias("frame_bear_share"), F.sum(st * reach).alias("_ws"),
        F.avg(F.when(~F.col("is_new"), F.col("best_sim"))).alias("_coh"),
        F.sum((st > 0).cast("int")).alias("_pos"), F.sum((st < 0).cast("int")).alias("_neg"))
    event = seeds.groupBy(*EVENT).agg(
        F.max("n_early").alias("n_early"), F.max("n_future").alias("n_future"),
        (F.max("frame_j") + 1).alias("n_seed_frames"), F.max("elapsed_hours").alias("cutoff_elapsed_hours"),
        F.sum(reach).alias("_ereach"), F.avg(st).alias("event_stance_mean"),
        share(st > 0).alias("event_bull_share"), share(st < 0).alias("event_bear_share"))
    # novelty of the seed's final centroid against earlier used events of the symbol
    own = cents.select(*EVENT, "frame_j", F.col("centroid").alias("vec"))
    nov = best_match(own, memory_window(cents, memory), EVENT, "frame_j", "m", "vec", "mem").select(
        *EVENT, F.col("frame_j").cast("int").alias("frame_j"), (1.0 - F.col("sim")).alias("novelty"))
    d = frame.join(event, EVENT).join(nov, FRAME, "left").join(labels, FRAME, "left")
    d = d.select("*", F.col("o.actor").alias("actor"), F.col("o.post_id").alias("post_id"),
                 F.col("o.stance").alias("origin_stance"), F.col("o.rank").alias("origin_rank"),
                 F.col("o.followers").alias("followers"), F.col("o.verified").alias("_own_verified"))
    d = d.join(trait.select("actor", F.col("oltrait").alias("origin_ol")), "actor")
    d = d.join(meta.select("actor", F.col("log_followers").alias("_lf"), F.col("verified").alias("_mv")), "actor", "left")
    zero = F.lit(0.0)
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    d = d.withColumns({
        "future_adopt": F.coalesce("future_adopt", zero),
        "future_reach": F.coalesce("future_reach", zero),
        "origin_logfoll": F.coalesce("_lf", F.log1p("followers")),
        "origin_verified": F.coalesce("_mv", "_own_verified"),
        "origin_rank_frac": F.col("origin_rank") / F.col("n_early"),
        "log_event_early_actors": F.log(F.col("n_early").cast("double")),
        "log_early_adopt": F.log1p((F.col("early_size") - 1).cast("double")),
        "log_early_reach": F.log1p("early_reach"),
        "early_frame_share": F.col("early_size") / F.col("n_early"),
        "early_reach_share": F.col("early_reach") / F.greatest(F.lit(1.0), F.col("_ereach")),
        "cohesion": F.coalesce("_coh", F.lit(1.0)),
        "frame_stance_abs": F.abs("frame_stance_mean"),
        "follower_weighted_stance": F.when(F.col("early_reach") > 0, F.col("_ws") / F.col("early_reach"))
                                     .otherwise(F.col("frame_stance_mean")),
        "event_stance_abs": F.abs("event_stance_mean"),
        "event_sentiment_disagreement": yes((F.col("event_bull_share") > 0) & (F.col("event_bear_share") > 0)),
        "stance_abs": yes(F.col("_pos") + F.col("_neg") > 0),
        "stance_pos": yes(F.col("_pos") > F.col("_neg")),
        "stance_neg": yes(F.col("_neg") > F.col("_pos")),
    })
    d = d.withColumns({
        "log_future_adopt": F.log1p("future_adopt"), "log_future_reach": F.log1p("future_reach"),
        "ol_x_visibility": F.col("origin_ol") * F.col("origin_logfoll"),
        "ol_x_novelty": F.col("origin_ol") * F.coalesce("novelty", zero),
        "sentiment_alignment": F.col("origin_stance") * F.col("frame_stance_mean"),
        "event_id": F.concat_ws(":", "sym", F.col("day").cast("string"), F.lit(mode)),
    })
    return d.drop("o", "followers", *[c for c in d.columns if c.startswith("_")])


def raw_routers(panel: DataFrame) -> DataFrame:
    """Scalar rankers of seed frames, as columns ``r_<name>``."""
    return panel.withColumns({
        "r_earliest_origin": -F.col("origin_rank_frac"),
        "r_follower_first": F.col("origin_logfoll"),
        "r_verified_first": F.col("origin_verified") + 1e-3 * F.col("origin_logfoll"),
        "r_sentiment_strength": F.col("frame_stance_abs"),
        "r_bullish_first": F.col("frame_stance_mean"),
        "r_novelty_first": F.col("novelty"),
        "r_early_adopt": F.col("log_early_adopt"),
        "r_early_reach": F.col("log_early_reach"),
        "r_early_share": F.col("early_frame_share"),
    })
