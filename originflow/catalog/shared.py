"""Tables shared by the catalogue queries of one (session, folder): each is built once and written."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from originflow.catalog.sql import CUTOFFS, END, INNER, MIN_ACTORS, THR
from originflow.operators.panel import Block
from originflow.plans import pit
from originflow.session import cut
from originflow.sources.posts import bind_posts, bind_stances, bind_vectors, table, with_vec_id

BLOCKS = [Block("train", CUTOFFS[0], CUTOFFS[1], CUTOFFS[0], "train"), Block("test", CUTOFFS[1], END, CUTOFFS[1], "test")]


def is_train() -> Column:
    return F.col("split") == "train"


def inner_fit() -> Column:
    return is_train() & (F.col("day") < F.lit(INNER).cast("date"))


def inner_dev() -> Column:
    return is_train() & (F.col("day") >= F.lit(INNER).cast("date"))


class Shared:
    _all: dict = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf = spark, sf_dir

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Shared":
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._all:
            cls._all[key] = cls(spark, sf_dir)
        return cls._all[key]

    @classmethod
    def clear(cls) -> None:
        for shared in cls._all.values():
            if "lead_graph" in shared.__dict__:
                shared.__dict__["lead_graph"].close()
        cls._all.clear()

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf, name)

    @cached_property
    def posts(self) -> DataFrame:
        return with_vec_id(bind_posts(self.spark, self.sf, text_key=True), self.spark, self.sf)

    @cached_property
    def vectors(self) -> DataFrame:
        return bind_vectors(self.spark, self.sf)

    @cached_property
    def stances(self) -> DataFrame:
        return cut(bind_stances(self.spark, self.sf))

    @cached_property
    def ranked(self) -> DataFrame:
        return self.state.ranked

    @cached_property
    def state(self) -> pit.PitState:
        return pit.PitState(self.posts, self.vectors, ["vec_id"], CUTOFFS, THR, MIN_ACTORS)

    @cached_property
    def panel(self) -> DataFrame:
        return pit.build_panel(self.state, BLOCKS, self.stances)

    @cached_property
    def whole_panel(self) -> DataFrame:
        """The panel of all new frames, whatever their rank."""
        return pit.build_panel(self.state, BLOCKS, self.stances, max_rank=None)


def rounded6(df: DataFrame, *cols: str) -> DataFrame:
    """Round doubles for comparison with the check query."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


def big(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})
