"""Ranking and classification metrics as grouped DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from originflow.operators.ordered import attach_group, exact_quantiles, range_blocks, running, with_value_bucket

TINY = 1e-12
INF = float("inf")


def finite(c: Column | str) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(INF))


def _positive_ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(TINY))


def _divergence(p: Column, q: Column) -> Column:
    """One row's share of the Jensen-Shannon divergence (nats)."""
    m = F.greatest((p + q) * 0.5, F.lit(TINY))
    half = lambda a: F.when(a > 0, 0.5 * a * F.log(a / m)).otherwise(0.0)
    return half(p) + half(q)


def event_metrics(
    df: DataFrame, y: str, score: str, keys: list[str] = ["event_id", "sym"], tie: str = "frame_j",
    ks: tuple[int, ...] = (1, 2, 3, 5), bounded: bool = True,
) -> DataFrame:
    """ndcg@k, hit@k, mass@k and js per group; groups need two finite rows and a positive best outcome.

    ``bounded``: the caller guarantees small groups (candidates limited to the first ranks), and
    everything runs on one shuffle by ``keys``. Otherwise top-k rows are cut before the shuffle and
    group totals are attached by blocks of ``tie``, so that a group of any size is spread out.
    Equal scores are ordered by ``tie``.
    """
    rows = df.filter(finite(y) & finite(score)).select(
        *keys, F.col(y).cast("double").alias("y"), F.col(score).cast("double").alias("s"), F.col(tie).alias("t"))
    aggs = {"n": F.count(F.lit(1)), "ymax": F.max("y"), "ysum": F.sum("y"), "smax": F.max("s")}
    usable = (F.col("n") >= 2) & (F.col("ymax") > 0)
    weight = F.exp(F.greatest(F.col("s") - F.col("smax"), F.lit(-50.0)))
    p, q = _positive_ratio(F.col("y"), F.col("ysum")), _positive_ratio(F.col("e"), F.col("z"))
    by_score = Window.partitionBy(*keys).orderBy(F.desc("s"), "t")
    by_y = Window.partitionBy(*keys).orderBy(F.desc("y"), "t")
    top = max(ks)

    def outputs(rs: Column, ry: Column) -> list[Column]:
        gain = lambda r, k: F.sum(F.when(r <= k, F.col("y") / F.log2(r + 1)))
        out = []
        for k in ks:
            out += [
                _positive_ratio(gain(rs, k), gain(ry, k)).alias(f"ndcg{k}"),
                F.max(F.when((rs <= k) & (F.col("y") == F.col("ymax")), 1.0).otherwise(0.0)).alias(f"hit{k}"),
                _positive_ratio(F.sum(F.when(rs <= k, F.col("y"))), F.max("ysum")).alias(f"mass{k}"),
            ]
        return out

    rs, ry = F.col("rs"), F.col("ry")
    if bounded:
        w = Window.partitionBy(*keys)
        one = rows.select("*", *[a.over(w).alias(n) for n, a in aggs.items()],
                          F.row_number().over(by_score).alias("rs"), F.row_number().over(by_y).alias("ry"))
        one = one.filter(usable).withColumn("e", weight).withColumn("z", F.sum("e").over(w))
        return one.groupBy(*keys).agg(F.max("n").alias("n"), *outputs(rs, ry), F.sum(_divergence(p, q)).alias("js"))

    all_rows = attach_group(rows, keys, "t", aggs).filter(usable).withColumn("e", weight)
    all_rows = attach_group(all_rows, keys, "t", {"z": F.sum("e")})
    js = all_rows.groupBy(*keys).agg(F.sum(_divergence(p, q)).alias("js"))
    cols = [*keys, "y", "n", "ymax", "ysum"]
    none = F.lit(None).cast("int")
    a = all_rows.withColumn("rs", F.row_number().over(by_score)).filter(rs <= top).select(*cols, "rs", none.alias("ry"))
    b = all_rows.withColumn("ry", F.row_number().over(by_y)).filter(ry <= top).select(*cols, none.alias("rs"), "ry")
    both = a.unionByName(b).groupBy(*keys).agg(F.max("n").alias("n"), *outputs(rs, ry))
    return both.join(js, keys)


def event_distribution(
    df: DataFrame, y: str, score: str, keys: list[str] = ["event_id", "sym"], tie: str = "frame_j"
) -> DataFrame:
    """Per event: Spearman (mid-ranks), Pearson between outcome share and softmax, js, mass of the top three.

    Groups are candidate lists limited to the first ranks.
    """
    rows = df.filter(finite(y) & finite(score)).select(
        *keys, F.col(y).cast("double").alias("y"), F.col(score).cast("double").alias("s"), F.col(tie).alias("t"))
    w = Window.partitionBy(*keys)
    mid = lambda c: F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2.0
    d = rows.select("*", F.count(F.lit(1)).over(w).alias("n"), F.max("y").over(w).alias("ymax"),
                    F.sum("y").over(w).alias("ysum"), F.max("s").over(w).alias("smax"),
                    F.row_number().over(w.orderBy(F.desc("s"), "t")).alias("rs"),
                    mid("y").alias("ra"), mid("s").alias("rb"))
    d = d.filter((F.col("n") >= 2) & (F.col("ymax") > 0))
    d = d.withColumn("e", F.exp(F.greatest(F.col("s") - F.col("smax"), F.lit(-50.0))))
    d = d.withColumn("p", _positive_ratio(F.col("y"), F.col("ysum"))).withColumn(
        "q", _positive_ratio(F.col("e"), F.sum("e").over(w)))
    for c in ("ra", "rb", "p", "q"):
        d = d.withColumn(f"d{c}", F.col(c) - F.avg(c).over(w))

    def pearson(a: str, b: str) -> Column:
        den = F.sqrt(F.sum(F.col(a) * F.col(a)) * F.sum(F.col(b) * F.col(b)))
        return F.when(den > TINY, F.sum(F.col(a) * F.col(b)) / den)

    return d.groupBy(*keys).agg(
        F.max("n").alias("n"), pearson("dra", "drb").alias("spearman"), pearson("dp", "dq").alias("pearson_dist"),
        F.sum(_divergence(F.col("p"), F.col("q"))).alias("js"),
        F.sum(F.when(F.col("rs") <= 3, F.col("p"))).alias("mass3"))


def mid_ranks(df: DataFrame, value: str, name: str, keys: list[str] = []) -> DataFrame:
    """Average ranks of ``value`` over whole groups: equal values collapse first, then prefix counts by buckets."""
    vals = df.filter(finite(value)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    vals = running(with_value_bucket(vals, value), keys, "_b", [value], {"_below": ("sum", F.col("_n"))})
    ranks = vals.select(*keys, value, (F.col("_below") + (F.col("_n") + 1) / 2.0).alias(name))
    return df.join(ranks, [*keys, value])


def corr_rank(df: DataFrame, a: str, b: str, keys: list[str] = []) -> DataFrame:
    """Spearman correlation on mid-ranks, one row per group."""
    d = df.filter(finite(a) & finite(b)).select(*keys, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    d = mid_ranks(mid_ranks(d, "a", "ra", keys), "b", "rb", keys)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("rho"))


def auc_ap(df: DataFrame, y: str, score: str, keys: list[str] = []) -> DataFrame:
    """ROC-AUC and average precision (tied scores share one threshold) per group; NULL when a class is empty.

    Works on distinct scores with prefix counts, so neither a hot score nor a large group is sorted in one task.
    """
    d = df.filter(finite(score)).select(*keys, F.col(y).cast("double").alias("y"), F.col(score).cast("double").alias("s"))
    vals = d.groupBy(*keys, "s").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("pos"))
    vals = with_value_bucket(vals, "s").withColumn("_b", -F.col("_b"))
    vals = running(vals, keys, "_b", [F.desc("s")], {"ca": ("sum", F.col("c")), "pa": ("sum", F.col("pos"))})
    neg, neg_above = F.col("c") - F.col("pos"), F.col("ca") - F.col("pa")
    sums = vals.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.sum("pos").alias("n_pos"),
        F.sum(F.col("pos") * (neg_above + neg * 0.5)).alias("worse"),
        F.sum(F.col("pos") * (F.col("pa") + F.col("pos")) / (F.col("ca") + F.col("c"))).alias("gain"))
    n_neg = F.col("n") - F.col("n_pos")
    return sums.select(
        *keys, "n", "n_pos",
        F.when((F.col("n_pos") > 0) & (n_neg > 0), 1.0 - F.col("worse") / (F.col("n_pos") * n_neg)).alias("auc"),
        F.when(F.col("n_pos") > 0, F.col("gain") / F.col("n_pos")).alias("ap"))


def ranked_rows(df: DataFrame, score: str, tie: list[str], keys: list[str] = []) -> DataFrame:
    """Add ``pos``, the 1-based place by score (high first, then ``tie``) in each whole group, also where very many scores tie."""
    d = range_blocks(df, [*keys, F.desc(score), *tie])
    return running(d, keys, "_b", [F.desc(score), *tie], {"pos": ("count", F.lit(1))}, inclusive=True).drop("_b")


def average_precision_rows(df: DataFrame, y: str, score: str, tie: list[str], keys: list[str] = []) -> DataFrame:
    """Average precision walking rows one by one: tied scores follow ``tie``."""
    d = df.filter(finite(score)).select(*keys, F.col(score).alias("_s"), *tie, F.col(y).cast("double").alias("_y"))
    d = range_blocks(d, [*keys, F.desc("_s"), *tie])
    d = running(d, keys, "_b", [F.desc("_s"), *tie],
                {"_c": ("count", F.lit(1)), "_h": ("sum", F.col("_y"))}, inclusive=True)
    return d.groupBy(*keys).agg(
        (F.sum(F.col("_y") * F.col("_h") / F.col("_c")) / F.when(F.sum("_y") > 0, F.sum("_y"))).alias("ap"))


def at_p(df: DataFrame, y: str, score: str, tie: list[str], keys: list[str] = [], top: int = 50) -> DataFrame:
    """Precision at P positives, precision at ``top`` and lift, per group."""
    d = ranked_rows(df.filter(finite(score)), score, tie, keys)
    d = d.withColumn("_y", F.col(y).cast("double"))
    size = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").cast("long").alias("n_pos"))
    if keys:
        d = d.join(size, keys)
    else:
        d = d.withColumn("n", size.select("n").scalar()).withColumn("n_pos", size.select("n_pos").scalar())
    hit = lambda k: F.avg(F.when(F.col("pos") <= k, F.col("_y")))
    rate = F.max("n_pos") / F.max("n")
    return d.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("n_pos").alias("n_pos"), hit(F.col("n_pos")).alias("r_precision"),
        hit(F.lit(top)).alias("precision_at_top"), rate.alias("base_rate"),
        (hit(F.col("n_pos")) / rate).alias("lift"))


def quantile_label(df: DataFrame, y: str, train: Column, q: float = 0.9, name: str = "label") -> DataFrame:
    """1 where y reaches the training quantile."""
    limit = exact_quantiles(df.filter(train), [], y, {"q": q}).select("q").scalar()
    return df.withColumn("_q", limit).withColumn(name, (F.col(y) >= F.col("_q")).cast("int")).drop("_q")


def quantile_grade(df: DataFrame, y: str, train: Column | None = None, n: int = 32, name: str = "grade") -> DataFrame:
    """Integer grade by distinct quantile edges. Edges come from training rows; ``train=None`` uses all rows."""
    probs = {f"e{i}": i / n for i in range(n + 1)}
    src = df.filter(train) if train is not None else df
    one = exact_quantiles(src, [], y, probs)
    edges = one.select(F.array_sort(F.array_distinct(F.array(*probs))).alias("e")).scalar()
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    d = df.withColumn("_edges", edges).withColumn("_inner", inner)
    place = F.size(F.filter("_inner", lambda e: e <= F.col(y)))
    grade = F.least(place, F.greatest(F.lit(1), F.size("_edges") - 2))
    return d.withColumn(name, F.when(finite(y), grade).otherwise(0)).drop("_edges", "_inner")


def topq_label(df: DataFrame, y: str, q: float = 0.1, by: list[str] = [], min_rows: int = 30) -> DataFrame:
    """1 for the top share of outcomes, globally or per group; small or one-class groups are dropped."""
    if not by:
        return quantile_label(df, y, F.lit(True), 1.0 - q)
    cuts = exact_quantiles(df, by, y, {"_q": 1.0 - q}).filter(F.col("n") >= min_rows).drop("n")
    d = df.join(cuts, by).withColumn("label", (F.col(y) >= F.col("_q")).cast("int")).drop("_q")
    mixed = d.groupBy(*by).agg(F.avg("label").alias("_m")).filter((F.col("_m") > 0) & (F.col("_m") < 1)).drop("_m")
    return d.join(mixed, by, "left_semi")


def pooled_mean(events: DataFrame, metrics: list[str], keys: list[str] = []) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), *[F.avg(m).alias(m) for m in metrics])


def symbol_mean(events: DataFrame, metrics: list[str], keys: list[str] = [], sym: str = "sym") -> DataFrame:
    """Mean over symbols of per-symbol means."""
    per = events.groupBy(*keys, sym).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(m).alias(m) for m in metrics])
    return per.groupBy(*keys).agg(F.sum("_n").alias("n_events"), F.count(F.lit(1)).alias("n_symbols"),
                                  *[F.avg(m).alias(m) for m in metrics])


def summary_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, median, p10, p90, min and max of the finite values."""
    d = df.filter(finite(value))
    qs = exact_quantiles(d, keys, value, {"p10": 0.1, "median": 0.5, "p90": 0.9}).drop("n")
    basic = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
                                 F.min(value).alias("min"), F.max(value).alias("max"))
    return basic.join(qs, keys)


def relational(df: DataFrame, src: str, prefix: str, keys: list[str] = ["event_id"], tie: str = "frame_j") -> DataFrame:
    """Place of a value among the candidates of its event: rank share, gap to max, minus mean, is-top."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    place = F.row_number().over(w.orderBy(src, tie)) - 1
    return df.select(
        "*", F.when(n > 1, place / (n - 1)).otherwise(0.5).alias(f"{prefix}_rank"),
        (F.col(src) - F.max(src).over(w)).alias(f"{prefix}_gapmax"),
        (F.col(src) - F.avg(src).over(w)).alias(f"{prefix}_minusmean"),
        F.when(F.col(src) >= F.max(src).over(w), 1.0).otherwise(0.0).alias(f"{prefix}_istop"))


def within_demean(df: DataFrame, cols: list[str], key: str = "event_id", ordinal: str = "frame_j") -> DataFrame:
    """Subtract group means; groups with one row are dropped."""
    d = attach_group(df, [key], ordinal, {"_n": F.count(F.lit(1)), **{f"_m_{c}": F.avg(c) for c in cols}})
    d = d.filter(F.col("_n") >= 2)
    return d.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in cols}).drop("_n", *[f"_m_{c}" for c in cols])


def median_impute(df: DataFrame, value: str, fit: Column | None = None) -> DataFrame:
    """Replace missing or non-finite values by the median of the finite ones (of the rows in ``fit``); else 0."""
    src = df.filter(finite(value) & (fit if fit is not None else F.lit(True)))
    med = exact_quantiles(src, [], value, {"m": 0.5}).select("m").scalar()
    return df.withColumn("_m", med).withColumn(
        value, F.when(finite(value), F.col(value)).otherwise(F.coalesce("_m", F.lit(0.0)))).drop("_m")


def pareto(df: DataFrame, cost: str, quality: str) -> DataFrame:
    """Mark rows nobody beats: not costlier and not worse, with one of them strict.

    A row is kept when it has the best quality at its cost and beats every cheaper row.
    """
    per_cost = df.groupBy(cost).agg(F.max(quality).alias("_q"))
    per_cost = running(with_value_bucket(per_cost, cost), [], "_b", [cost], {"_best": ("max", F.col("_q"))}).drop("_b")
    d = df.join(per_cost, cost)
    keep = (F.col(quality) == F.col("_q")) & (F.col("_best").isNull() | (F.col("_best") < F.col(quality)))
    return d.withColumn("pareto", keep).drop("_q", "_best")
