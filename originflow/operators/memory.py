"""Prefix-memory features of each arriving post, as running aggregates over the frame table.

Given the frame of every post, all features seen before an update are prefix sums, maxima and
minima of the event or of the matched frame; none needs per-row Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originflow.operators.events import EVENT
from originflow.operators.frames import FRAME
from originflow.operators.ordered import block_of, running

EARLY_MEMBERS = 2


def _xlogx(c: Column) -> Column:
    return F.when(c > 0, c * F.log(c)).otherwise(0.0)


def memory_features(frames: DataFrame, trait: str = "current_ol", roles: bool = False) -> DataFrame:
    """Add memory features to every post of ``frames`` (trait members only, ranked again).

    ``roles`` adds the early/late member roles of the matched frame and their interactions.
    """
    reach = F.greatest(F.lit(0.0), F.col("followers"))
    ol = F.col(trait)
    d = frames.withColumn("_b", block_of(F.col("rank") - 1))
    d = running(d, FRAME, "_b", ["rank"], {
        "_c": ("count", F.lit(1)), "_reach": ("sum", reach), "_first": ("min", F.struct("rank", ol.alias("ol"))),
        "_last": ("max", F.col("rank")), "_mx": ("max", ol), "_sum": ("sum", ol)})
    c = F.col("_c").cast("double")
    if roles:
        early, late = F.col("_c") < EARLY_MEMBERS, F.col("_c") >= EARLY_MEMBERS
        d = running(d, FRAME, "_b", ["rank"], {
            "_en": ("count", F.when(early, 1)), "_es": ("sum", F.when(early, ol)), "_ex": ("max", F.when(early, ol)),
            "_ln": ("count", F.when(late, 1)), "_ls": ("sum", F.when(late, ol)), "_lx": ("max", F.when(late, ol)),
            "_p1": ("min", F.when(ol > 0, F.struct("rank", "_c"))), "_p2": ("max", F.when(ol > 0, F.col("rank")))})
    d = running(d, EVENT, "_b", ["rank"], {
        "_frames": ("sum", F.col("is_new").cast("int")), "_osum": ("sum", ol), "_omax": ("max", ol),
        "_dom": ("max", F.col("_c") + 1), "_xlx": ("sum", _xlogx(c + 1) - _xlogx(c))})
    total = (F.col("rank") - 1).cast("double")
    some = total > 0
    zero = F.lit(0.0)
    old = ~F.col("is_new")
    seen = lambda x: F.when(old, x.cast("double")).otherwise(zero)
    d = d.withColumns({
        "current_ol": ol,
        "log_stream_rank": F.log(F.col("rank").cast("double")),
        "novelty_to_memory": F.when(some, 1.0 - F.greatest(zero, F.col("best_sim"))).otherwise(1.0),
        "prior_total_posts": total,
        "prior_frame_count": F.col("_frames").cast("double"),
        "dominant_frame_share": F.when(some, F.col("_dom") / total).otherwise(zero),
        "frame_entropy": F.when(some, F.greatest(zero, F.log(total) - F.col("_xlx") / total)).otherwise(zero),
        "memory_prior_ol_mean": F.when(some, F.col("_osum") / total).otherwise(zero),
        "memory_prior_max_ol": F.coalesce("_omax", zero),
        "is_new_frame": F.col("is_new").cast("double"),
        "matched_sim": seen(F.col("best_sim")),
        "matched_prior_count": seen(F.col("_c")),
        "matched_log_prior_reach": seen(F.log1p("_reach")),
        "matched_age_ranks": seen(F.col("rank") - F.col("_first.rank")),
        "matched_recency_ranks": seen(F.col("rank") - F.col("_last")),
        "matched_origin_ol": seen(F.col("_first.ol")),
        "matched_max_ol": seen(F.col("_mx")),
        "matched_mean_ol": seen(F.col("_sum") / F.col("_c")),
        "matched_ol_sum": seen(F.col("_sum")),
    })
    d = d.withColumns({
        "ol_x_matched_sim": F.col("current_ol") * F.col("matched_sim"),
        "ol_x_prior_reach": F.col("current_ol") * F.col("matched_log_prior_reach"),
    })
    if roles:
        d = d.withColumns({
            "matched_early_ol_mean": seen(F.coalesce(F.col("_es") / F.when(F.col("_en") > 0, F.col("_en")), zero)),
            "matched_early_ol_max": seen(F.coalesce("_ex", zero)),
            "matched_early_ol_sum": seen(F.coalesce("_es", zero)),
            "matched_late_ol_mean": seen(F.coalesce(F.col("_ls") / F.when(F.col("_ln") > 0, F.col("_ln")), zero)),
            "matched_late_ol_max": seen(F.coalesce("_lx", zero)),
            "matched_late_ol_sum": seen(F.coalesce("_ls", zero)),
            "matched_first_ol_rank": seen(F.coalesce(F.col("_p1.rank") - F.col("_first.rank"), F.lit(0))),
            "matched_last_ol_rank": seen(F.coalesce(F.col("_p2") - F.col("_first.rank"), F.lit(0))),
            "matched_ol_arrival_span": seen(F.coalesce(F.col("_p2") - F.col("_p1.rank"), F.lit(0))),
            "matched_first_ol_is_origin": seen(F.coalesce((F.col("_p1._c") == 0).cast("double"), zero)),
            "matched_has_early_ol": seen(F.coalesce((F.col("_p1._c") < EARLY_MEMBERS).cast("double"), zero)),
        })
        d = role_interactions(d)
    return d.drop(*[x for x in d.columns if x.startswith("_")])


def role_interactions(d: DataFrame) -> DataFrame:
    """Products of the current and matched traits with the state of the matched frame."""
    ol, origin, top = F.col("current_ol"), F.col("matched_origin_ol"), F.col("matched_max_ol")
    count, far, sim = F.col("matched_prior_count"), F.col("matched_log_prior_reach"), F.col("matched_sim")
    recency, age = F.col("matched_recency_ranks"), F.col("matched_age_ranks")
    yes = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    return d.withColumns({
        "current_ol_x_new_frame": ol * F.col("is_new_frame"),
        "current_ol_x_existing_frame": ol * (1.0 - F.col("is_new_frame")),
        "current_ol_x_young_frame": ol * yes((count > 0) & (count <= EARLY_MEMBERS)),
        "current_ol_x_mature_frame": ol * yes(count > EARLY_MEMBERS),
        "current_ol_x_recent_frame": ol / (1.0 + recency),
        "current_ol_x_frame_age": ol * F.log1p(age),
        "current_ol_x_frame_recency": ol * F.log1p(recency),
        "current_ol_x_prior_count": ol * F.log1p(count),
        "current_ol_x_prior_reach": ol * far,
        "matched_origin_ol_x_sim": origin * sim,
        "matched_origin_ol_x_prior_count": origin * F.log1p(count),
        "matched_origin_ol_x_prior_reach": origin * far,
        "matched_max_ol_x_prior_count": top * F.log1p(count),
        "matched_max_ol_x_prior_reach": top * far,
    })


def suffix_labels(frames: DataFrame) -> DataFrame:
    """For each post: number and follower sum of the later members of its frame (a batch job after the day closes)."""
    d = frames.withColumn("_b", -block_of(F.col("rank") - 1))
    d = running(d, FRAME, "_b", [F.desc("rank")], {
        "future_adopt": ("count", F.lit(1)), "future_reach": ("sum", F.greatest(F.lit(0.0), F.col("followers")))})
    return d.drop("_b").withColumns({
        "future_adopt": F.col("future_adopt").cast("double"),
        "log_future_adopt": F.log1p(F.col("future_adopt").cast("double")),
        "log_future_reach": F.log1p("future_reach")})
