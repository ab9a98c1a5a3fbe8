"""Actor state, always from rows strictly before a cutoff."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from originflow.operators.events import EVENT, cutoff_index, spread_cutoffs
from originflow.operators.ordered import exact_quantiles
from originflow.session import cut

BUSY_POSTS = 100_000  # posts of an actor that one task orders


def metadata(posts: DataFrame, cutoffs: list[str], busy: int = BUSY_POSTS) -> DataFrame:
    """Per (cutoff, actor): median hour, median of positive follower counts (else 0), its log1p, verified.

    An actor's posts are moved once, to a task that works out the medians before every cutoff from a batch of whole actors.
    Actors with more than ``busy`` posts are counted and ordered piece by piece instead, so that no actor is gathered whole.
    """
    rows = posts.select("actor", cutoff_index("day", cutoffs).alias("_ci"), "hour", "followers", "verified").filter(F.col("_ci") < len(cutoffs))
    many = cut(rows.groupBy("actor").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > busy).select(F.col("actor").alias("_busy")))
    if many.isEmpty():
        return _metadata_of_batches(rows, cutoffs)
    at = F.col("actor").eqNullSafe(F.col("_busy"))
    few = _metadata_of_batches(rows.join(many, at, "left_anti"), cutoffs)
    return few.unionByName(_metadata_of_counts(rows.join(many, at, "left_semi"), cutoffs))


def _metadata_of_batches(rows: DataFrame, cutoffs: list[str]) -> DataFrame:
    src = rows.select("actor", "_ci", F.col("hour").cast("double"), F.col("followers").cast("double"), F.col("verified").cast("double"))
    schema = T.StructType([T.StructField("_i", T.IntegerType()), rows.schema["actor"], *[T.StructField(c, T.DoubleType()) for c in (
        "medhour", "med_followers", "verified")], T.StructField("n_posts", T.LongType())])

    def medians(t: pa.Table):
        code = pc.dictionary_encode(t.column("actor").combine_chunks(), null_encoding="encode").indices.to_numpy()
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        ci, hour, followers, verified = (t.column(c).to_numpy() for c in ("_ci", "hour", "followers", "verified"))
        for i in range(len(cutoffs)):
            use = ci <= i
            n = np.bincount(code[use], minlength=len(first))
            there = np.flatnonzero(n)
            if not len(there):
                continue
            top = np.fmax.reduceat(np.where(use, verified, np.nan), first)[there]
            cols = [median_by(code[use], hour[use], len(first))[there], median_by(code, np.where(use & (followers > 0), followers, np.nan), len(first))[there], top]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(there), i, np.int32)), t.column("actor").take(pa.array(first[there])).combine_chunks(),
                *[pa.array(c, pa.float64(), mask=np.isnan(c)) for c in cols], pa.array(n[there].astype(np.int64))], names=schema.fieldNames())

    def run(batches):
        waiting = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if waiting is None else pa.concat_tables([waiting, t])
            code = pc.dictionary_encode(t.column("actor").combine_chunks(), null_encoding="encode").indices.to_numpy()
            whole = int(np.searchsorted(code, code[-1]))  # the last actor may go on in the next batch
            if whole:
                yield from medians(t.slice(0, whole))
            waiting = t.slice(whole)
        if waiting is not None:
            yield from medians(waiting)

    d = src.repartition("actor").sortWithinPartitions("actor").mapInArrow(run, schema)
    days = F.array(*[F.lit(x).cast("date") for x in cutoffs])
    return _metadata_columns(d.withColumn("cutoff", days[F.col("_i")]).withColumn("verified", F.col("verified").cast(rows.schema["verified"].dataType)))


def median_by(code: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Median of the values of each code below ``n``, NaN left out; NaN for a code without any."""
    known = ~np.isnan(value)
    code, value = code[known], value[known]
    value = value[np.lexsort((value, code))]
    count = np.bincount(code, minlength=n)
    start = np.cumsum(count) - count
    out, some = np.full(n, np.nan), count > 0
    at, last = start[some], count[some] - 1
    low, high = value[at + last // 2], value[at + (last + 1) // 2]
    out[some] = low + (high - low) * (last % 2 / 2.0)
    return out


def _metadata_of_counts(rows: DataFrame, cutoffs: list[str]) -> DataFrame:
    """Rows collapse to (actor, cutoff index, hour, followers) counts before they are copied to cutoffs."""
    base = rows.groupBy("actor", "_ci", "hour", "followers").agg(F.count(F.lit(1)).alias("n"), F.max("verified").alias("verified"))
    spread = cut(spread_cutoffs(base, cutoffs))  # read several times below; the posts are scanned once
    hours = spread.groupBy("cutoff", "actor").agg(
        F.percentile("hour", F.lit(0.5), F.col("n")).alias("medhour"),  # at most 24 distinct values
        F.max("verified").alias("verified"), F.sum("n").alias("n_posts"))
    folls = exact_quantiles(spread.filter(F.col("followers") > 0), ["cutoff", "actor"], "followers",
                            {"med_followers": 0.5}, weight="n").drop("n")
    return _metadata_columns(hours.join(folls, ["cutoff", "actor"], "left"))


def _metadata_columns(d: DataFrame) -> DataFrame:
    return (
        d.withColumn("med_followers", F.coalesce("med_followers", F.lit(0.0)))
        .withColumn("log_followers", F.log1p("med_followers"))
        .select("cutoff", "actor", "medhour", "med_followers", "log_followers", "verified", "n_posts")
    )


def raw_lead(ranked: DataFrame, cutoffs: list[str], min_actors: int = 5, min_events: int = 4) -> DataFrame:
    """Mean net lead over qualifying events before each cutoff, for actors with enough events."""
    base = ranked.filter(F.col("k") >= min_actors).groupBy("actor", cutoff_index("day", cutoffs).alias("_ci")).agg(
        F.sum("net_lead").alias("s"), F.count(F.lit(1)).alias("n"))
    return (
        spread_cutoffs(base, cutoffs).groupBy("cutoff", "actor").agg(F.sum("s").alias("s"), F.sum("n").alias("n_events"))
        .filter(F.col("n_events") >= min_events)
        .select("cutoff", "actor", (F.col("s") / F.col("n_events")).alias("raw_lead"), "n_events")
    )


def oltrait(raw: DataFrame, meta: DataFrame, method: str = "quadratic", group: tuple[str, ...] = ("cutoff",)) -> DataFrame:
    """Residual of raw lead on posting hour: a quadratic in the median hour, or hour-decile means.

    The quadratic fit needs only power sums, one row per group. With fewer than three distinct
    hours the projection is the line through the group means, or the mean.
    """
    by = list(group)
    joined = raw.join(meta.select("cutoff", "actor", "medhour"), ["cutoff", "actor"])
    if method == "decile":
        # position in (hour, actor) order from per-hour counts, then the usual ten near-equal tiles
        before = Window.partitionBy(*by).orderBy("medhour").rowsBetween(Window.unboundedPreceding, -1)
        heads = joined.groupBy(*by, "medhour").agg(F.count(F.lit(1)).alias("_c")).select(
            *by, "medhour", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
            F.sum("_c").over(Window.partitionBy(*by)).alias("_n"))
        local = Window.partitionBy(*by, "medhour").orderBy("actor")
        pos = F.col("_off") + F.col("_r")
        size, extra = F.floor(F.col("_n") / 10), F.col("_n") % 10
        wide = extra * (size + 1)
        tile = F.when(pos <= wide, F.ceil(pos / (size + 1))).otherwise(extra + F.ceil((pos - wide) / size))
        tiled = joined.withColumn("_r", F.row_number().over(local)).join(heads, [*by, "medhour"]).withColumn(
            "bin", tile.cast("int")).drop("_r", "_off", "_n")
        means = tiled.groupBy(*by, "bin").agg(F.avg("raw_lead").alias("_m"))
        return tiled.join(means, [*by, "bin"]).withColumn("oltrait", F.col("raw_lead") - F.col("_m")).drop("_m")
    x = F.col("medhour") - 12.0
    y = F.col("raw_lead")
    sums = joined.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("s0"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"),
        F.sum(x * x * x).alias("s3"), F.sum(x * x * x * x).alias("s4"), F.sum(y).alias("t0"),
        F.sum(x * y).alias("t1"), F.sum(x * x * y).alias("t2"),
        F.count_distinct("medhour").alias("hours"))
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))

    def det(a, b, c, d, e, f, g, h, i) -> Column:
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    full = F.col("hours") >= 3
    den3 = det(s0, s1, s2, s1, s2, s3, s2, s3, s4)
    den2 = s0 * s2 - s1 * s1
    c0 = F.when(full, det(t0, s1, s2, t1, s2, s3, t2, s3, s4) / den3) \
        .when(F.col("hours") == 2, (t0 * s2 - s1 * t1) / den2).otherwise(t0 / s0)
    c1 = F.when(full, det(s0, t0, s2, s1, t1, s3, s2, t2, s4) / den3) \
        .when(F.col("hours") == 2, (s0 * t1 - s1 * t0) / den2).otherwise(F.lit(0.0))
    c2 = F.when(full, det(s0, s1, t0, s1, s2, t1, s2, s3, t2) / den3).otherwise(F.lit(0.0))
    coef = sums.select(*by, c0.alias("_c0"), c1.alias("_c1"), c2.alias("_c2"))
    fit = F.col("_c0") + F.col("_c1") * x + F.col("_c2") * x * x
    return joined.join(coef, by).withColumn("oltrait", y - fit).drop("_c0", "_c1", "_c2")


def lead_degree(ranked: DataFrame, cutoffs: list[str], min_actors: int = 5) -> DataFrame:
    """Degrees of the lead graph in closed form: out = sum(K - rank), in = sum(rank - 1). No pairs are listed."""
    base = ranked.filter(F.col("k") >= min_actors).groupBy("actor", cutoff_index("day", cutoffs).alias("_ci")).agg(
        F.sum(F.col("k") - F.col("rank")).alias("o"), F.sum(F.col("rank") - 1).alias("i"),
        F.count(F.lit(1)).alias("p"))
    o, i = F.col("g_out_w"), F.col("g_in_w")
    return (
        spread_cutoffs(base, cutoffs).groupBy("cutoff", "actor")
        .agg(F.sum("o").cast("double").alias("g_out_w"), F.sum("i").cast("double").alias("g_in_w"),
             F.sum("p").cast("double").alias("part_count"))
        .withColumn("g_out", F.log1p(o)).withColumn("g_in", F.log1p(i)).withColumn("g_net", o - i)
        .withColumn("g_total", o + i).withColumn("log_g_total", F.log1p(o + i))
        .withColumn("g_net_rate", F.when(o + i > 0, (o - i) / (o + i)).otherwise(0.0))
    )


def origin_history(frames: DataFrame, cutoffs: list[str]) -> DataFrame:
    """Per (cutoff, actor), over the frames they opened before the cutoff: count, mean log adoption,
    mean log reach and success rate. Here adoption counts every later member.
    """
    base = frames.groupBy("actor", cutoff_index("day", cutoffs).alias("_ci")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.log1p("hist_adopt")).alias("a"),
        F.sum(F.log1p("hist_reach")).alias("r"), F.sum((F.col("hist_adopt") >= 1).cast("int")).alias("w"))
    n = F.col("n")
    return (
        spread_cutoffs(base, cutoffs).groupBy("cutoff", "actor")
        .agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("r").alias("r"), F.sum("w").alias("w"))
        .select("cutoff", "actor", F.log1p(n.cast("double")).alias("hist_log_origin_count"),
                (F.col("a") / n).alias("hist_mean_log_adopt"), (F.col("r") / n).alias("hist_mean_log_reach"),
                (F.col("w") / n).alias("hist_success_rate"))
    )


def shuffle_control(df: DataFrame, key: str, cols: list[str], seed: int, by: tuple[str, ...] = ("cutoff",)) -> DataFrame:
    """Permute whole tuples of ``cols`` across ``key`` inside each group; marginals stay as they are.

    Both sides get a dense position from the two-level numbering of :func:`dense_position`.
    """
    group = list(by)
    left = dense_position(df.select(*group, key), group, F.md5(F.concat_ws(":", F.lit("key"), F.col(key).cast("string"))), key)
    right = dense_position(df.select(*group, key, *cols), group, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).drop(key)
    return left.join(right, [*group, "_pos"]).drop("_pos")


def dense_position(df: DataFrame, group: list[str], order: Column, tie: str) -> DataFrame:
    """1..n in the order of a hex digest: position among equal first two digits plus the sizes of earlier ones."""
    d = df.withColumn("_h", order).withColumn("_hb", F.substring("_h", 1, 2))
    before = Window.partitionBy(*group).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    heads = d.groupBy(*group, "_hb").agg(F.count(F.lit(1)).alias("_n")).select(
        *group, "_hb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*group, "_hb").orderBy("_h", tie)
    return d.withColumn("_r", F.row_number().over(local)).join(heads, [*group, "_hb"]).withColumn(
        "_pos", F.col("_off") + F.col("_r")).drop("_h", "_hb", "_off", "_r")


def nearest_hour(meta: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """For each actor the other actor with the closest median hour (lowest id among equals).

    Median hours are multiples of one half, so a group has at most 48 of them: each hour keeps its two
    lowest actor ids, and hours are compared with hours instead of actors with actors.
    """
    m = meta.select("cutoff", "actor", "medhour")
    w = Window.partitionBy("cutoff", "medhour").orderBy("actor")
    heads = m.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2)
    per_hour = heads.groupBy("cutoff", "medhour").agg(
        F.min("actor").alias("a1"), F.max(F.when(F.col("_r") == 2, F.col("actor"))).alias("a2"))
    # the candidate list of a cutoff: at most 48 hours with two actors each
    table = per_hour.groupBy("cutoff").agg(F.collect_list(F.struct("medhour", "a1", "a2")).alias("_t"))
    opts = F.transform("_t", lambda t: F.struct(
        F.abs(t["medhour"] - F.col("medhour")).alias("gap"),
        F.when(t["a1"] == F.col("actor"), t["a2"]).otherwise(t["a1"]).alias("match")))
    best = F.array_min(F.filter(opts, lambda o: o["match"].isNotNull()))
    return m.join(table, "cutoff").withColumn("_b", best).filter(F.col("_b").isNotNull()).select(
        "cutoff", "actor", "medhour", F.col("_b.match").alias("match"), F.col("_b.gap").alias("gap"))


def group_traits(ranked: DataFrame, posts: DataFrame, group: str, min_events: int = 4) -> DataFrame:
    """The trait inside each value of a group column (time bin, symbol group), with hours from the same group.

    Returns (group, actor, raw_lead, n_events, medhour, oltrait).
    """
    raw = ranked.groupBy(group, "actor").agg(F.avg("net_lead").alias("raw_lead"), F.count(F.lit(1)).alias("n_events"))
    raw = raw.filter(F.col("n_events") >= min_events).withColumnRenamed(group, "cutoff")
    counts = posts.groupBy(group, "actor", "hour").agg(F.count(F.lit(1)).alias("n"))
    hours = counts.groupBy(group, "actor").agg(F.percentile("hour", F.lit(0.5), F.col("n")).alias("medhour"))
    return oltrait(raw, hours.withColumnRenamed(group, "cutoff")).withColumnRenamed("cutoff", group)


def hierarchy_statistic(ranked: DataFrame, min_actors: int = 5, min_events: int = 4, keys: list[str] = ["sym"]) -> DataFrame:
    """sum(S^2 / n) over actors, S the summed net lead: how strong the lead order of a symbol is."""
    per = ranked.filter(F.col("k") >= min_actors).groupBy(*keys, "actor").agg(
        F.sum("net_lead").alias("s"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_events)
    return per.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("statistic"), F.count(F.lit(1)).alias("actors"))
