"""Prefix-memory, timing-role and early-frame panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originflow.catalog.registry import query
from originflow.catalog.shared import Shared, big, rounded6
from originflow.catalog.sql import CUTOFFS, MIN_ACTORS, PIECES, THR, compose, r6, walk
from originflow.operators import early as ea, frames as fr, memory as me
from originflow.operators.events import EVENT, first_posts, rerank
from originflow.session import cut

FROM_DAY = CUTOFFS[0]

PIECES["mk"] = (["fp", "trait", "vec", "stance"], f"""mk0 AS (SELECT f.*, t.oltrait AS current_ol FROM fp f JOIN (SELECT actor, oltrait FROM trait WHERE cutoff = DATE '{FROM_DAY}') t USING (actor) WHERE day >= DATE '{FROM_DAY}'),
mk AS (SELECT * FROM (SELECT m.*, v.v, s.stance, row_number() OVER (PARTITION BY sym, day ORDER BY us, first_seen, post_id) AS rank, count(*) OVER (PARTITION BY sym, day) AS k,
 (us - min(us) OVER (PARTITION BY sym, day)) / 3600000000.0 AS elapsed_hours FROM mk0 m JOIN vec v USING (vec_id) JOIN stance s USING (doc_id)) WHERE k >= {MIN_ACTORS})""")
PIECES.update(walk("msteps", "mk", THR))
PIECES["msteps"] = (["mk"], PIECES["msteps"][1])
PIECES["mem"] = (["msteps"], """mem0 AS (SELECT k.* EXCLUDE v, s.frame_j, s.is_new, s.best AS best_sim, lag(s.ns) OVER e AS prev, CAST(k.rank - 1 AS DOUBLE) AS total,
 greatest(0.0, followers) AS own, list(current_ol) OVER eb AS ol_before FROM mk k JOIN msteps s USING (sym, day, rank)
 WINDOW e AS (PARTITION BY k.sym, k.day ORDER BY k.rank), eb AS (PARTITION BY k.sym, k.day ORDER BY k.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mem AS (SELECT *, CASE WHEN is_new THEN NULL ELSE list(current_ol) OVER f END AS fol, CASE WHEN is_new THEN NULL ELSE list(rank) OVER f END AS frk,
 coalesce(sum(own) OVER f, 0) AS freach, coalesce(sum(own) OVER g, 0) AS future_reach, CAST(count(*) OVER g AS DOUBLE) AS future_adopt FROM mem0
 WINDOW f AS (PARTITION BY sym, day, frame_j ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 g AS (PARTITION BY sym, day, frame_j ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))""")

_SEEN = lambda e: f"CASE WHEN is_new THEN 0 ELSE {e} END"
MEMORY_SQL = {
    "current_ol": "current_ol", "log_stream_rank": "ln(rank)", "elapsed_hours": "elapsed_hours",
    "novelty_to_memory": "CASE WHEN total > 0 THEN 1 - greatest(0.0, best_sim) ELSE 1 END",
    "prior_total_posts": "total", "prior_frame_count": "CASE WHEN total > 0 THEN len(prev) ELSE 0 END",
    "dominant_frame_share": "CASE WHEN total > 0 THEN list_max(prev) / total ELSE 0 END",
    "frame_entropy": "CASE WHEN total > 0 THEN list_sum(list_transform(prev, lambda n: -(n / total) * ln(n / total))) ELSE 0 END",
    "memory_prior_ol_mean": "CASE WHEN total > 0 THEN list_avg(ol_before) ELSE 0 END",
    "memory_prior_max_ol": "CASE WHEN total > 0 THEN list_max(ol_before) ELSE 0 END",
    "is_new_frame": "CASE WHEN is_new THEN 1 ELSE 0 END", "matched_sim": _SEEN("best_sim"),
    "matched_prior_count": _SEEN("len(fol)"), "matched_log_prior_reach": _SEEN("ln(1 + freach)"),
    "matched_age_ranks": _SEEN("rank - frk[1]"), "matched_recency_ranks": _SEEN("rank - frk[len(frk)]"),
    "matched_origin_ol": _SEEN("fol[1]"), "matched_max_ol": _SEEN("list_max(fol)"), "matched_mean_ol": _SEEN("list_avg(fol)"),
    "matched_ol_sum": _SEEN("list_sum(fol)"), "ol_x_matched_sim": "current_ol * " + _SEEN("best_sim"),
    "ol_x_prior_reach": "current_ol * " + _SEEN("ln(1 + freach)"),
}
_LATE = "fol[3:]"
_P1 = "list_position(list_transform(fol, lambda x: x > 0), true)"
_P2 = "(len(fol) + 1 - list_position(list_transform(list_reverse(fol), lambda x: x > 0), true))"
ROLE_SQL = {
    "matched_early_ol_mean": _SEEN("list_avg(fol[1:2])"), "matched_early_ol_max": _SEEN("list_max(fol[1:2])"), "matched_early_ol_sum": _SEEN("list_sum(fol[1:2])"),
    "matched_late_ol_mean": _SEEN(f"coalesce(list_avg({_LATE}), 0)"), "matched_late_ol_max": _SEEN(f"coalesce(list_max({_LATE}), 0)"),
    "matched_late_ol_sum": _SEEN(f"coalesce(list_sum({_LATE}), 0)"),
    "matched_first_ol_rank": _SEEN(f"coalesce(frk[{_P1}] - frk[1], 0)"), "matched_last_ol_rank": _SEEN(f"coalesce(frk[{_P2}] - frk[1], 0)"),
    "matched_ol_arrival_span": _SEEN(f"coalesce(frk[{_P2}] - frk[{_P1}], 0)"),
    "matched_first_ol_is_origin": _SEEN(f"CASE WHEN coalesce({_P1}, 0) = 1 THEN 1 ELSE 0 END"),
    "matched_has_early_ol": _SEEN(f"CASE WHEN coalesce({_P1}, 0) BETWEEN 1 AND 2 THEN 1 ELSE 0 END"),
    "current_ol_x_new_frame": "current_ol * CASE WHEN is_new THEN 1 ELSE 0 END", "current_ol_x_existing_frame": "current_ol * " + _SEEN("1"),
    "current_ol_x_young_frame": "current_ol * " + _SEEN("CASE WHEN len(fol) <= 2 THEN 1 ELSE 0 END"),
    "current_ol_x_mature_frame": "current_ol * " + _SEEN("CASE WHEN len(fol) > 2 THEN 1 ELSE 0 END"),
    "current_ol_x_recent_frame": "current_ol / (1 + " + _SEEN("rank - frk[len(frk)]") + ")",
    "current_ol_x_frame_age": "current_ol * " + _SEEN("ln(1 + rank - frk[1])"),
    "current_ol_x_frame_recency": "current_ol * " + _SEEN("ln(1 + rank - frk[len(frk)])"),
    "current_ol_x_prior_count": "current_ol * " + _SEEN("ln(1 + len(fol))"), "current_ol_x_prior_reach": "current_ol * " + _SEEN("ln(1 + freach)"),
    "matched_origin_ol_x_sim": _SEEN("fol[1] * best_sim"), "matched_origin_ol_x_prior_count": _SEEN("fol[1] * ln(1 + len(fol))"),
    "matched_origin_ol_x_prior_reach": _SEEN("fol[1] * ln(1 + freach)"), "matched_max_ol_x_prior_count": _SEEN("list_max(fol) * ln(1 + len(fol))"),
    "matched_max_ol_x_prior_reach": _SEEN("list_max(fol) * ln(1 + freach)"),
}


def member_frames(s: Shared) -> DataFrame:
    """Frames over trait members only, from the first cutoff on; built once per folder."""
    if "member_frames" not in s.__dict__:
        trait = s.state.trait.filter(F.col("cutoff") == F.lit(FROM_DAY).cast("date")).select("actor", F.col("oltrait").alias("current_ol"))
        fp = first_posts(s.posts, start=FROM_DAY, carry=("hour", "followers", "verified", "doc_id", "vec_id"))
        fp = fp.withColumns({"k": F.lit(0), "rank": F.lit(0), "net_lead": F.lit(0), "elapsed_hours": F.lit(0.0)})
        ranked = rerank(fp.join(trait, "actor")).filter(F.col("k") >= MIN_ACTORS)
        s.__dict__["member_frames"] = fr.frame_pass(ranked, s.vectors, ["vec_id"], THR)
    return s.__dict__["member_frames"]


def _key(d: DataFrame, cols: list[str]) -> DataFrame:
    return rounded6(d.select("sym", "day", "rank", "actor", *cols), *cols)


def _sql(cols: dict[str, str]) -> str:
    return compose("SELECT sym, day, rank, actor, " + ", ".join(r6(e, n) for n, e in cols.items()) + " FROM mem", "mem")


@query("memory_features", _sql(MEMORY_SQL))
def memory_features(spark, sf) -> DataFrame:
    return _key(me.memory_features(member_frames(Shared.of(spark, sf))), list(MEMORY_SQL))


@query("timing_roles", _sql(ROLE_SQL))
def timing_roles(spark, sf) -> DataFrame:
    return _key(me.memory_features(member_frames(Shared.of(spark, sf)), roles=True), list(ROLE_SQL))


@query("suffix_labels", _sql({"future_adopt": "future_adopt", "future_reach": "future_reach", "log_future_adopt": "ln(1 + future_adopt)",
                              "log_future_reach": "ln(1 + future_reach)"}))
def suffix_labels(spark, sf) -> DataFrame:
    return _key(me.suffix_labels(member_frames(Shared.of(spark, sf))), ["future_adopt", "future_reach", "log_future_adopt", "log_future_reach"])


# ---- early frames ----------------------------------------------------------------------------

PIECES["es"] = (["mk"], """es AS (SELECT *, rank <= 10 AS early, least(k, 10) AS n_early, k - 10 AS n_future FROM mk WHERE k >= 12),
eitems AS (SELECT * FROM es WHERE early)""")
_STEP = walk("esteps", "eitems", THR)["esteps"][1]
PIECES["esteps"] = (["es"], _STEP)
PIECES["ep"] = (["esteps", "meta"], f"""ecents AS (SELECT sym, day, unnest(range(len(cents))) AS frame_j, unnest(cents) AS centroid FROM esteps WHERE rank = 10 AND len(cents) >= 2),
ehit AS (SELECT sym, day, frame_j, count(*) AS n, sum(greatest(0.0, followers)) AS f FROM (
 SELECT l.sym, l.day, l.rank, l.followers, c.frame_j, list_dot_product(l.v, c.centroid) AS sim, row_number() OVER (PARTITION BY l.sym, l.day, l.rank ORDER BY list_dot_product(l.v, c.centroid) DESC, c.frame_j) AS z
 FROM es l JOIN ecents c USING (sym, day) WHERE NOT l.early) WHERE z = 1 AND sim >= {THR} GROUP BY 1, 2, 3),
eused AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY day, frame_j) AS q FROM ecents SEMI JOIN ehit USING (sym, day)),
enov AS (SELECT a.sym, a.day, a.frame_j, 1 - max(list_dot_product(a.centroid, b.centroid)) AS novelty FROM eused a JOIN (SELECT sym, day, min(q) - 1 AS base FROM eused GROUP BY 1, 2) e USING (sym, day)
 JOIN eused b ON b.sym = a.sym AND b.q <= e.base AND b.q > e.base - 1000 GROUP BY 1, 2, 3),
em_ AS (SELECT i.*, s.frame_j, s.is_new, s.best FROM eitems i JOIN esteps s USING (sym, day, rank) SEMI JOIN eused USING (sym, day)),
eev AS (SELECT sym, day, max(frame_j) + 1 AS n_seed_frames, max(elapsed_hours) AS cutoff_elapsed_hours, sum(greatest(0.0, followers)) AS er, avg(stance) AS event_stance_mean,
 avg(CASE WHEN stance > 0 THEN 1.0 ELSE 0.0 END) AS event_bull_share, avg(CASE WHEN stance < 0 THEN 1.0 ELSE 0.0 END) AS event_bear_share FROM em_ GROUP BY 1, 2),
efr AS (SELECT sym, day, frame_j, min(rank) AS origin_rank, arg_min(actor, rank) AS actor, arg_min(stance, rank) AS origin_stance, arg_min(current_ol, rank) AS origin_ol, count(*) AS early_size,
 sum(greatest(0.0, followers)) AS early_reach, avg(stance) AS frame_stance_mean, avg(CASE WHEN stance > 0 THEN 1.0 ELSE 0.0 END) AS frame_bull_share, avg(CASE WHEN stance < 0 THEN 1.0 ELSE 0.0 END) AS frame_bear_share,
 sum(stance * greatest(0.0, followers)) AS ws, avg(best) FILTER (NOT is_new) AS coh, max(n_early) AS n_early, max(n_future) AS n_future FROM em_ GROUP BY 1, 2, 3),
ep AS (SELECT f.*, e.* EXCLUDE (sym, day), n.novelty, coalesce(h.n, 0) AS future_adopt, coalesce(h.f, 0) AS future_reach, m.log_followers AS origin_logfoll, m.verified AS origin_verified
 FROM efr f JOIN eev e USING (sym, day) LEFT JOIN enov n USING (sym, day, frame_j) LEFT JOIN ehit h USING (sym, day, frame_j) JOIN meta m ON m.cutoff = DATE '{FROM_DAY}' AND m.actor = f.actor)""")
EARLY_SQL = {
    "origin_ol": "origin_ol", "origin_logfoll": "origin_logfoll", "origin_verified": "origin_verified", "origin_rank_frac": "origin_rank / n_early",
    "log_event_early_actors": "ln(n_early)", "cutoff_elapsed_hours": "cutoff_elapsed_hours", "log_early_adopt": "ln(early_size)", "log_early_reach": "ln(1 + early_reach)",
    "early_frame_share": "early_size / n_early", "early_reach_share": "early_reach / greatest(1.0, er)", "novelty": "novelty", "cohesion": "coalesce(coh, 1)",
    "origin_stance": "origin_stance", "frame_stance_mean": "frame_stance_mean", "frame_stance_abs": "abs(frame_stance_mean)", "frame_bull_share": "frame_bull_share",
    "frame_bear_share": "frame_bear_share", "follower_weighted_stance": "CASE WHEN early_reach > 0 THEN ws / early_reach ELSE frame_stance_mean END",
    "event_stance_mean": "event_stance_mean", "event_bull_share": "event_bull_share", "event_bear_share": "event_bear_share",
    "event_sentiment_disagreement": "CASE WHEN event_bull_share > 0 AND event_bear_share > 0 THEN 1 ELSE 0 END",
    "stance_abs": "CASE WHEN frame_bull_share + frame_bear_share > 0 THEN 1 ELSE 0 END", "stance_pos": "CASE WHEN frame_bull_share > frame_bear_share THEN 1 ELSE 0 END",
    "stance_neg": "CASE WHEN frame_bear_share > frame_bull_share THEN 1 ELSE 0 END", "future_adopt": "future_adopt", "future_reach": "future_reach",
    "log_future_adopt": "ln(1 + future_adopt)", "log_future_reach": "ln(1 + future_reach)", "ol_x_visibility": "origin_ol * origin_logfoll",
    "ol_x_novelty": "origin_ol * coalesce(novelty, 0)", "sentiment_alignment": "origin_stance * frame_stance_mean",
}
_EARLY_KEYS = "sym, day, CAST(frame_j AS BIGINT) AS frame_j, actor, CAST(n_early AS BIGINT) AS n_early, CAST(n_future AS BIGINT) AS n_future, CAST(n_seed_frames AS BIGINT) AS n_seed_frames"


def early_frames(s: Shared) -> DataFrame:
    if "early_frames" not in s.__dict__:
        at = F.col("cutoff") == F.lit(FROM_DAY).cast("date")
        ranked = s.ranked.filter(F.col("day") >= F.lit(FROM_DAY).cast("date")).join(s.stances, "doc_id")
        s.__dict__["early_frames"] = cut(ea.early_panel(
            ranked, s.vectors, ["vec_id"], s.state.trait.filter(at), s.state.meta.filter(at), THR, "first10"))
    return s.__dict__["early_frames"]


@query("early_panel", compose(f"SELECT {_EARLY_KEYS}, " + ", ".join(r6(e, n) for n, e in EARLY_SQL.items()) + " FROM ep", "ep"))
def early_panel(spark, sf) -> DataFrame:
    keys = ["frame_j", "n_early", "n_future", "n_seed_frames"]
    d = early_frames(Shared.of(spark, sf)).select("sym", "day", "actor", *keys, *EARLY_SQL)
    return big(rounded6(d, *EARLY_SQL), *keys)


_ROUTERS = {"r_earliest_origin": "-(origin_rank / n_early)", "r_verified_first": "origin_verified + 0.001 * origin_logfoll", "r_bullish_first": "frame_stance_mean", "r_novelty_first": "novelty"}


@query("raw_routers", compose("SELECT sym, day, CAST(frame_j AS BIGINT) AS frame_j, " + ", ".join(r6(e, n) for n, e in _ROUTERS.items()) + " FROM ep", "ep"))
def raw_routers(spark, sf) -> DataFrame:
    d = ea.raw_routers(early_frames(Shared.of(spark, sf))).select("sym", "day", "frame_j", *_ROUTERS)
    return big(rounded6(d, *_ROUTERS), "frame_j")
