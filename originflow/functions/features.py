"""Named feature lists of the panels (fixed values), and the method comparisons built on them."""

CONTEXT = [
    "origin_logfoll", "origin_verified", "log_origin_rank", "elapsed_hours", "prior_frame_count", "origin_stance",
    "origin_stance_abs", "novelty_global", "novelty_event", "hist_log_origin_count", "hist_mean_log_adopt",
    "hist_success_rate",
]
ORIGIN_SETS = {
    "followers": ["origin_logfoll"],
    "visibility": ["origin_logfoll", "origin_verified"],
    "rank_time": ["log_origin_rank", "elapsed_hours", "prior_frame_count"],
    "sentiment": ["origin_stance", "origin_stance_abs"],
    "novelty": ["novelty_global", "novelty_event"],
    "history": ["hist_log_origin_count", "hist_mean_log_adopt", "hist_success_rate"],
    "no_ol_strong": CONTEXT,
    "ol_only": ["origin_ol"],
    "ol_origin": ["origin_ol", *CONTEXT, "ol_x_visibility", "ol_x_novelty"],
}
ABLATION_SETS = {
    "no_ol_strong": CONTEXT,
    "ol_only": ["origin_ol"],
    "ol_origin_full": ORIGIN_SETS["ol_origin"],
    "shuffled_ol_origin": ["origin_ol_shuffled", *CONTEXT, "shuffled_ol_x_visibility", "shuffled_ol_x_novelty"],
    "follower_replacement": [*CONTEXT, "logfoll_x_visibility", "logfoll_x_novelty"],
    "raw_ol_origin": ["origin_ol_raw", *CONTEXT, "raw_ol_x_visibility", "raw_ol_x_novelty"],
}
GRAPH = ["g_out", "g_in", "g_net", "g_pr", "g_hub"]
GRAPH_SETS = {
    "A_context": CONTEXT,
    "B_ctx+Ok": [*CONTEXT, "origin_ol"],
    "G_ctx+graph": [*CONTEXT, *GRAPH],
    "BG_ctx+Ok+graph": [*CONTEXT, "origin_ol", *GRAPH],
}
RATE_SETS = {
    "A_context": CONTEXT,
    "B_ctx+Ok": [*CONTEXT, "origin_ol"],
    "BN_ctx+Ok+gnet": [*CONTEXT, "origin_ol", "g_net"],
    "BR_ctx+Ok+rate": [*CONTEXT, "origin_ol", "g_net_rate"],
}
ACTIVITY_SETS = {
    "A_context": CONTEXT,
    "C_ctx+act": [*CONTEXT, "log_g_total"],
    "G_ctx+gnet": [*CONTEXT, "g_net"],
    "CG_ctx+act+gnet": [*CONTEXT, "log_g_total", "g_net"],
    "R_ctx+gnetrate": [*CONTEXT, "g_net_rate"],
}
OL_RELATIONAL = ["ol_rank", "ol_gapmax", "ol_minusmean", "ol_istop"]
SHUFFLED_RELATIONAL = ["sh_rank", "sh_gapmax", "sh_minusmean", "sh_istop"]
RELATIONAL_SETS = {
    "A_context": CONTEXT,
    "B_ctx+Ok": [*CONTEXT, "origin_ol"],
    "B2_ctx+Ok+rel": [*CONTEXT, "origin_ol", *OL_RELATIONAL],
    "C_ctx+shuf+shufrel": [*CONTEXT, "origin_ol_shuffled", *SHUFFLED_RELATIONAL],
}

EARLY_POP = ["log_early_adopt", "log_early_reach", "early_frame_share", "origin_rank_frac"]
FRAME_STANCE = ["frame_stance_mean", "frame_stance_abs", "frame_bull_share", "frame_bear_share", "follower_weighted_stance"]
EVENT_STANCE = ["event_stance_mean", "event_stance_abs", "event_bull_share", "event_bear_share", "event_sentiment_disagreement"]
STANCE_FLAGS = ["stance_abs", "stance_pos", "stance_neg"]
SIZE = "log_event_early_actors"
EARLY_SETS = {
    "sentiment_event": [*EVENT_STANCE, SIZE],
    "sentiment_frame": ["origin_stance", *FRAME_STANCE, "sentiment_alignment", SIZE],
    "sentiment_all": ["origin_stance", *FRAME_STANCE, "sentiment_alignment", *EVENT_STANCE, SIZE],
    "early_pop": [*EARLY_POP, SIZE],
    "early_pop_sentiment": [*EARLY_POP, "origin_stance", *FRAME_STANCE, "event_sentiment_disagreement", SIZE],
    "origin_visibility": ["origin_logfoll", "origin_verified", "origin_rank_frac", SIZE],
    "ol_only": ["origin_ol", SIZE],
    "ol_visibility": ["origin_ol", "origin_logfoll", "origin_verified", "origin_rank_frac", SIZE],
    "semantic": ["novelty", "cohesion", *STANCE_FLAGS, SIZE],
    "semantic_no_actor": [*EARLY_POP, "novelty", "cohesion", "origin_stance", "frame_stance_mean", "frame_stance_abs",
                          "event_sentiment_disagreement", SIZE, "cutoff_elapsed_hours"],
    "full": [*EARLY_POP, "origin_ol", "origin_logfoll", "origin_verified", "novelty", "cohesion", *STANCE_FLAGS,
             "origin_stance", *FRAME_STANCE, "event_stance_mean", "event_stance_abs", "event_sentiment_disagreement",
             "ol_x_visibility", "ol_x_novelty", SIZE, "cutoff_elapsed_hours"],
}
LEARNED_ROUTERS = {
    "learned_early_pop": EARLY_SETS["early_pop"],
    "learned_pop_sent": EARLY_SETS["early_pop_sentiment"],
    "learned_semantic_no_actor": EARLY_SETS["semantic_no_actor"],
    "learned_full": EARLY_SETS["full"],
}

CURRENT_ACTOR = ["current_logfoll", "current_verified", "log_stream_rank", "elapsed_hours"]
CURRENT_SENTIMENT = ["current_stance", "current_stance_abs"]
HISTORY = ["hist_log_origin_count", "hist_mean_log_adopt", "hist_success_rate"]
SEMANTIC_MEMORY = [
    "matched_sim", "is_new_frame", "novelty_to_memory", "prior_total_posts", "prior_frame_count",
    "dominant_frame_share", "frame_entropy", "matched_prior_count", "matched_log_prior_reach", "matched_age_ranks",
    "matched_recency_ranks",
]
OL_MEMORY = [
    "current_ol", "matched_origin_ol", "matched_max_ol", "matched_mean_ol", "matched_ol_sum", "memory_prior_ol_mean",
    "memory_prior_max_ol", "ol_x_matched_sim", "ol_x_prior_reach",
]
NO_OL_MEMORY = [*CURRENT_ACTOR, *CURRENT_SENTIMENT, *HISTORY, *SEMANTIC_MEMORY]
MEMORY_SETS = {
    "follower_current": CURRENT_ACTOR,
    "sentiment_current": CURRENT_SENTIMENT,
    "semantic_memory": SEMANTIC_MEMORY,
    "no_ol_memory": NO_OL_MEMORY,
    "ol_current": [*CURRENT_ACTOR, "current_ol"],
    "ol_memory": [*NO_OL_MEMORY, *OL_MEMORY],
}
OL_ORIGIN_ROLE = ["current_ol_x_new_frame", "matched_origin_ol", "matched_origin_ol_x_sim"]
OL_EARLY_ROLE = [
    "matched_early_ol_mean", "matched_early_ol_max", "matched_early_ol_sum", "matched_first_ol_rank",
    "matched_first_ol_is_origin", "matched_has_early_ol", "current_ol_x_young_frame", "current_ol_x_recent_frame",
]
OL_LATE_ROLE = [
    "matched_late_ol_mean", "matched_late_ol_max", "matched_late_ol_sum", "matched_last_ol_rank",
    "matched_ol_arrival_span", "current_ol_x_existing_frame", "current_ol_x_frame_age", "current_ol_x_frame_recency",
    "current_ol_x_prior_count", "current_ol_x_prior_reach", "current_ol_x_mature_frame",
]
OL_MATURITY = [
    "matched_max_ol", "matched_mean_ol", "matched_ol_sum", "memory_prior_ol_mean", "memory_prior_max_ol",
    "matched_origin_ol_x_prior_count", "matched_origin_ol_x_prior_reach", "matched_max_ol_x_prior_count",
    "matched_max_ol_x_prior_reach",
]
_STEP1 = [*NO_OL_MEMORY, "current_ol"]
_STEP2 = [*_STEP1, *OL_ORIGIN_ROLE]
_STEP3 = [*_STEP2, *OL_EARLY_ROLE]
ROLE_SETS = {
    "follower_current": CURRENT_ACTOR,
    "sentiment_current": CURRENT_SENTIMENT,
    "semantic_memory": SEMANTIC_MEMORY,
    "no_ol_memory": NO_OL_MEMORY,
    "old_ol_memory": MEMORY_SETS["ol_memory"],
    "ol_current_step": _STEP1,
    "ol_origin_step": _STEP2,
    "ol_early_step": _STEP3,
    "ol_timing_roles": [*_STEP3, *OL_LATE_ROLE, *OL_MATURITY],
}
