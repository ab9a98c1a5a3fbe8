"""The point-in-time pipeline: posts -> events -> frames -> actor state per cutoff -> candidate panel."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originflow.operators import actors, frames as fr
from originflow.operators.events import EVENT, first_posts, rank_posts
from originflow.operators.panel import Block, origin_panel
from originflow.session import Written, cut


@dataclass
class PitState:
    """Tables shared by the steps of one run, each built and written when first asked for.

    Every event is ranked once and its frames are walked once: an event's frames do not depend on the
    cutoff, so all cutoffs share them. Actor state is aggregated for all cutoffs together.
    """

    posts: DataFrame
    vectors: DataFrame
    vec_on: list[str]
    cutoffs: list[str]
    thr: float = 0.5
    min_actors: int = 8
    trait_actors: int = 5
    trait_events: int = 4
    seed: int = 61

    @cached_property
    def ranked(self) -> DataFrame:
        carry = tuple(c for c in self.posts.columns if c not in (*EVENT, "actor", "us", "post_id"))
        first = Written(first_posts(self.posts, carry=carry), "first-posts")  # read for the minutes and for the ranks
        out = cut(rank_posts(first.df, min(self.min_actors, self.trait_actors)))
        first.drop()
        return out

    @cached_property
    def frames(self) -> DataFrame:
        gated = self.ranked.filter(F.col("k") >= self.min_actors)
        return cut(fr.online_frames(gated, self.thr, vectors=self.vectors, on=self.vec_on))

    @cached_property
    def labels(self) -> DataFrame:
        return cut(fr.future_labels(self.frames))

    @cached_property
    def meta(self) -> DataFrame:
        return cut(actors.metadata(self.posts, self.cutoffs))

    @cached_property
    def raw(self) -> DataFrame:
        return actors.raw_lead(self.ranked, self.cutoffs, self.trait_actors, self.trait_events)

    @cached_property
    def trait(self) -> DataFrame:
        return cut(actors.oltrait(self.raw, self.meta))

    @cached_property
    def hist(self) -> DataFrame:
        opened = self.frames.filter("is_new").select(*fr.FRAME, "actor").join(self.labels, fr.FRAME)
        return cut(actors.origin_history(opened, self.cutoffs))

    @cached_property
    def shuffled(self) -> DataFrame:
        return actors.shuffle_control(self.trait.select("cutoff", "actor", "oltrait"), "actor", ["oltrait"], self.seed)

    @cached_property
    def degree(self) -> DataFrame:
        return actors.lead_degree(self.ranked, self.cutoffs, self.trait_actors)


def novelty(state: PitState, start: str | None = None, max_rank: int | None = None, memory: int = 1000) -> DataFrame:
    """Global novelty of new frames. Memory starts at ``start`` and holds every frame of qualifying events."""
    f = state.frames
    if start:
        f = f.filter(F.col("day") >= F.lit(start).cast("date"))
    o = f.filter("is_new")
    if max_rank is not None:
        o = o.filter(F.col("rank") <= max_rank)
    o = o.select(*EVENT, "rank", *state.vec_on).join(state.vectors, state.vec_on).select(*EVENT, "rank", F.col("emb").alias("vec"))
    return fr.novelty_global(o, fr.centroids(f), memory)


def build_panel(
    state: PitState, blocks: list[Block], stances: DataFrame | None = None,
    stance_key: str = "doc_id", max_rank: int | None = 10, memory: int = 1000,
) -> DataFrame:
    start = min(b.start for b in blocks)
    nov = novelty(state, start, max_rank, memory)
    return cut(origin_panel(state.frames, state.labels, nov, blocks, state.trait, state.meta, state.hist,
                            state.shuffled, stances, stance_key, max_rank))
