"""The candidate panel over rolling windows: one frame walk and one pass of actor state serve all windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originflow.operators import frames as fr
from originflow.operators.events import EVENT
from originflow.operators.panel import origin_panel
from originflow.operators.windows import RollingWindow, window_days, windows_table, with_windows
from originflow.plans.pit import PitState
from originflow.session import cut


def rolling_novelty(state: PitState, days: DataFrame, max_rank: int | None, memory: int) -> DataFrame:
    """Novelty of new frames against the memory of their own window, which starts at its first training day."""
    own = F.concat_ws("|", "window", "sym")  # a window has its own memory of each symbol
    f = with_windows(state.frames, days.select("window", "day")).withColumn("sym", own)
    o = f.filter("is_new")
    if max_rank is not None:
        o = o.filter(F.col("rank") <= max_rank)
    o = o.select(*EVENT, "rank", *state.vec_on).join(state.vectors, state.vec_on).select(*EVENT, "rank", F.col("emb").alias("vec"))
    parts = F.split("sym", r"\|", 2)
    return fr.novelty_global(o, fr.centroids(f), memory).withColumns({"window": parts[0], "sym": parts[1]})


def rolling_panel(state: PitState, windows: list[RollingWindow], stances: DataFrame | None = None, stance_key: str = "doc_id",
                  max_rank: int | None = 10, memory: int = 1000) -> DataFrame:
    """``origin_panel`` with a row per (new frame, window): ``window``, ``split``, ``part`` and ``cutoff`` say how the row is used.

    ``state`` must know the cutoffs of all windows. Event ids repeat across windows, so group by (window, event_id).
    """
    days = window_days(windows_table(state.posts.sparkSession, windows))
    nov = rolling_novelty(state, days, max_rank, memory)
    return cut(origin_panel(state.frames, state.labels, nov, days, state.trait, state.meta, state.hist, state.shuffled, stances,
                            stance_key, max_rank))
