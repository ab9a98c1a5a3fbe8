"""Candidate panels: one row per newly opened frame, with state known before its block."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originflow.operators.events import EVENT, assign_block
from originflow.operators.frames import FRAME
from originflow.operators.windows import with_windows


@dataclass(frozen=True)
class Block:
    """A half-open day range of panel rows, and the cutoff of the actor state they may use."""

    name: str
    start: str
    end: str
    cutoff: str
    split: str


def with_block(df: DataFrame, blocks: list[Block]) -> DataFrame:
    """Block, split and state cutoff of each row; rows outside all blocks are dropped."""
    d = df.withColumn("block", assign_block("day", [(b.name, b.start, b.end) for b in blocks]))
    d = d.filter(F.col("block").isNotNull())
    pick = lambda attr: F.element_at(
        F.create_map(*[F.lit(x) for b in blocks for x in (b.name, getattr(b, attr))]), F.col("block"))
    return d.withColumn("split", pick("split")).withColumn("cutoff", pick("cutoff").cast("date"))


def attach_state(
    rows: DataFrame, trait: DataFrame, meta: DataFrame, hist: DataFrame, shuffled: DataFrame | None = None
) -> DataFrame:
    """Look up actor state by (cutoff, actor). Rows of actors without a trait are dropped; the rest gets defaults."""
    on = ["cutoff", "actor"]
    d = rows.join(trait.select(*on, F.col("oltrait").alias("origin_ol"), F.col("raw_lead").alias("_raw")), on)
    d = d.join(meta.select(*on, "log_followers", F.col("verified").alias("_mv")), on, "left")
    d = d.join(hist.select(*on, "hist_log_origin_count", "hist_mean_log_adopt", "hist_success_rate"), on, "left")
    if shuffled is not None:
        d = d.join(shuffled.select(*on, F.col("oltrait").alias("_shuf")), on, "left")
    else:
        d = d.withColumn("_shuf", F.lit(None).cast("double"))
    zero = F.lit(0.0)
    own = F.log1p(F.greatest(zero, F.col("followers")))
    return d.withColumns({
        "origin_logfoll": F.coalesce("log_followers", own),
        "origin_verified": F.coalesce("_mv", "verified"),
        "hist_log_origin_count": F.coalesce("hist_log_origin_count", zero),
        "hist_mean_log_adopt": F.coalesce("hist_mean_log_adopt", zero),
        "hist_success_rate": F.coalesce("hist_success_rate", zero),
        "origin_ol_raw": F.coalesce("_raw", "origin_ol"),
        "origin_ol_shuffled": F.coalesce("_shuf", zero),
    }).drop("_raw", "_mv", "_shuf", "log_followers")


def add_interactions(df: DataFrame) -> DataFrame:
    """Trait times visibility and times novelty (missing novelty counts as 0), for each trait variant."""
    nov = F.coalesce("novelty_global", F.lit(0.0))
    vis = F.col("origin_logfoll")
    base = {"ol": "origin_ol", "raw_ol": "origin_ol_raw", "shuffled_ol": "origin_ol_shuffled", "logfoll": "origin_logfoll"}
    cols = {}
    for prefix, src in base.items():
        cols[f"{prefix}_x_visibility"] = F.col(src) * vis
        cols[f"{prefix}_x_novelty"] = F.col(src) * nov
    return df.withColumns(cols)


def origin_panel(
    frames: DataFrame, labels: DataFrame, novelty: DataFrame, blocks: list[Block] | DataFrame, trait: DataFrame,
    meta: DataFrame, hist: DataFrame, shuffled: DataFrame | None = None, stances: DataFrame | None = None,
    stance_key: str = "doc_id", max_rank: int | None = 10,
) -> DataFrame:
    """The point-in-time panel of new frames, from a written frame table and per-cutoff actor state.

    ``blocks`` are disjoint day ranges, or a table of ``windows.window_days``, in which a day may belong to several windows;
    ``novelty`` then has a row per window too.
    """
    rows = frames.filter("is_new")
    if max_rank is not None:
        rows = rows.filter(F.col("rank") <= max_rank)
    rolling = isinstance(blocks, DataFrame)
    rows = with_windows(rows, blocks) if rolling else with_block(rows, blocks)
    tags = ["window", "split", "part", "cutoff"] if rolling else ["block", "split", "cutoff"]
    rows = rows.select(
        *EVENT, *tags, "frame_j", "rank", "k", "actor", "post_id", "followers", "verified",
        F.log(F.col("rank").cast("double")).alias("log_origin_rank"), "elapsed_hours",
        F.col("frame_j").cast("double").alias("prior_frame_count"),
        (1.0 - F.col("best_sim")).alias("novelty_event"),
        *([stance_key] if stances is not None and stance_key in rows.columns else []))
    rows = attach_state(rows, trait, meta, hist, shuffled)
    if stances is not None:
        rows = rows.join(stances.select(stance_key, F.col("stance").cast("double").alias("origin_stance")),
                         stance_key, "left").withColumn("origin_stance", F.coalesce("origin_stance", F.lit(0.0)))
    elif "origin_stance" not in rows.columns:
        rows = rows.withColumn("origin_stance", F.lit(0.0))
    rows = rows.withColumn("origin_stance_abs", F.abs("origin_stance"))
    rows = rows.join(novelty, [*EVENT, "rank", *(["window"] if rolling else [])], "left").join(
        labels.select(*FRAME, "future_adopt", "future_reach", "log_future_adopt", "log_future_reach"), FRAME)
    return add_interactions(rows).withColumn(
        "event_id", F.concat_ws(":", "sym", F.col("day").cast("string")))


def attach_graph(panel: DataFrame, graph: DataFrame, cols: list[str]) -> DataFrame:
    """Graph features of the origin actor at the row's cutoff; 0 for actors outside the graph."""
    g = graph.select("cutoff", "actor", *cols)
    return panel.join(g, ["cutoff", "actor"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in cols})


def panel_profile(panel: DataFrame) -> DataFrame:
    return panel.groupBy("split", "block").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_id").alias("n_events"),
        F.count_distinct("sym").alias("n_symbols"), F.count_distinct("actor").alias("n_actors"),
        F.max("day").alias("last_day"))
