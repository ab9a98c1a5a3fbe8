"""Resampling: bootstraps and permutations whose draws depend only on seeds and row numbers.

Rows stay where Spark puts them. A group is cut into blocks of numbered rows; each block draws its own
share of a multinomial split that every block can recompute, so any group size works and the result
does not depend on partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from originflow.operators.actors import dense_position
from originflow.operators.events import EVENT
from originflow.operators.metrics import corr_rank, finite, mid_ranks
from originflow.operators.ordered import with_value_bucket
from originflow.session import cut

BOOT_BLOCK = 4096
METRICS = ["ndcg3", "hit1", "mass3", "js"]


def metric_deltas(left: DataFrame, right: DataFrame, metrics: list[str] = METRICS, keys: list[str] = ["event_id", "sym"]) -> DataFrame:
    """Event-aligned differences, left minus right; divergences are reversed so that positive is better."""
    l = left.select(*keys, *[F.col(m).alias(f"l_{m}") for m in metrics])
    r = right.select(*keys, *[F.col(m).alias(f"r_{m}") for m in metrics])
    diff = lambda m: F.col(f"r_{m}") - F.col(f"l_{m}") if m == "js" else F.col(f"l_{m}") - F.col(f"r_{m}")
    return l.join(r, keys).select(*keys, *[diff(m).alias(m) for m in metrics])


def long_deltas(deltas: DataFrame, metrics: list[str] = METRICS, keys: list[str] = ["event_id", "sym"]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("delta")) for m in metrics])
    return deltas.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


def _split(seed: list[int], totals: np.ndarray, sizes: np.ndarray, block: int) -> np.ndarray:
    """This block's part of multinomial splits of ``totals`` draws (one per replicate) over all blocks of the group.

    The blocks are halved again and again; each halving is a binomial draw for all replicates at once, seeded by its place, so
    every block finds the same draws on its way down and needs only as many as the logarithm of the number of blocks.
    """
    lo, hi, ends = 0, len(sizes), np.concatenate([[0.0], np.cumsum(sizes)])
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.random.default_rng([*seed, lo, hi]).binomial(totals, (ends[mid] - ends[lo]) / (ends[hi] - ends[lo]))
        if block < mid:
            totals, hi = left, mid
        else:
            totals, lo = totals - left, mid
    return totals


def bootstrap(
    deltas: DataFrame, by: list[str], B: int = 600, seed: int = 707, levels: int = 2, ci: tuple[float, float] = (0.05, 0.95),
    block: int = BOOT_BLOCK, stratum: str = "sym",
) -> DataFrame:
    """Bootstrap of the mean ``delta`` per ``by`` group (comparison, metric).

    ``levels=2``: symbols are drawn with replacement, then events inside each drawn symbol, and the result
    is the mean of symbol means. ``levels=1``: events are drawn from the pool. Returns observed, lo, hi,
    p_gt0 and the sizes. Draws are keyed by (seed, replicate, symbol, block).
    """
    d = deltas.filter(finite("delta"))
    if levels == 1:
        d = d.withColumn(stratum, F.lit("pool"))
    d = dense_position(d.select(*by, stratum, "event_id", "delta"), [*by, stratum], F.md5("event_id"), "event_id")
    d = d.withColumn("_b", F.floor((F.col("_pos") - 1) / block).cast("int"))
    obs = d.groupBy(*by, stratum).agg(F.avg("delta").alias("m"), F.count(F.lit(1)).alias("n"))
    # strata of one comparison, numbered in name order: a short list (symbols)
    rank = Window.partitionBy(*by).orderBy(stratum)
    every = Window.partitionBy(*by)
    strata = obs.select(*by, stratum, "n", (F.row_number().over(rank) - 1).alias("s_no"), F.count(F.lit(1)).over(every).alias("s_all"))
    src = d.join(strata, [*by, stratum])
    fields = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in by)

    def one_block(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("_pos")["delta"].to_numpy()
        n, s, S, b = int(pdf["n"].iloc[0]), int(pdf["s_no"].iloc[0]), int(pdf["s_all"].iloc[0]), int(pdf["_b"].iloc[0])
        sizes = np.full(-(-n // block), block, dtype=float)
        sizes[-1] = n - block * (len(sizes) - 1)
        times = np.ones(B, np.int64)
        if levels == 2:
            times = (np.random.default_rng([seed, 0]).integers(0, S, (B, S)) == s).sum(1)
        m = _split([seed, s + 1], times * n, sizes, b)
        part, rng = np.zeros(B), np.random.default_rng([seed, s + 1, b + 1, 1])
        for r in range(0, B, 256):  # 256 replicates' draws at a time
            k = m[r:r + 256]
            drawn = x[rng.integers(0, len(x), int(k.sum()))]
            part[r:r + 256] = np.bincount(np.repeat(np.arange(len(k)), k), drawn, len(k)) / n / (S if levels == 2 else 1)
        out = pd.DataFrame({"rep": np.arange(B), "part": part})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "rep", "part"]]

    reps = src.groupBy(*by, stratum, "_b").applyInPandas(one_block, f"{fields}, rep int, part double")
    reps = reps.groupBy(*by, "rep").agg(F.sum("part").alias("v"))
    # B values per comparison
    spread = reps.groupBy(*by).agg(
        F.percentile("v", F.lit(ci[0])).alias("lo"), F.percentile("v", F.lit(ci[1])).alias("hi"),
        F.avg((F.col("v") > 0).cast("double")).alias("p_gt0"), F.stddev_pop("v").alias("se"))
    seen = obs.groupBy(*by).agg(F.avg("m").alias("observed"), F.count(F.lit(1)).cast("int").alias("n_symbols"),
                                F.sum("n").alias("n_events"))
    return seen.join(spread, by)


def _mix(a: np.ndarray) -> np.ndarray:
    """64-bit finaliser: turns numbered cells into independent-looking bits."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


POISSON_CDF = np.cumsum([np.exp(-1.0) / max(1, np.prod(np.arange(1, k + 1))) for k in range(16)])


def poisson_weights(ids: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) multiplicity of row ``id`` in replicate ``rep``: the same wherever it is computed."""
    with np.errstate(over="ignore"):
        cell = _mix(ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + _mix(
            reps.astype(np.uint64)[None, :] + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03)))
    return np.searchsorted(POISSON_CDF, cell.astype(np.float64) / 2.0**64).astype(np.float64)


def bootstrap_auc(
    scores: DataFrame, y: str, row_id: str, methods: str = "method", sym: str = "sym", B: int = 2000, seed: int = 777,
    reps_per_task: int = 100, task_rows: int = 20_000,
) -> DataFrame:
    """Two-level bootstrap of ROC-AUC and PR-AUC for several methods on the same resamples.

    ``scores`` is long: (method, sym, row_id, y, score). A row's multiplicity in a replicate is Poisson(1)
    of its id, so all methods see the same resample wherever their rows are sorted. Each score bucket adds
    its own part; prefix totals join the parts. There are as many buckets as ``task_rows`` asks for, and a
    score shared by very many rows has its own bucket, whose rows are dealt out to several tasks. A row is
    moved once per pass whatever ``B`` is: a task goes through the replicates, ``reps_per_task`` at a time.
    Returns (method, rep, auc, ap).
    """
    d = cut(scores.filter(finite("score")).select(
        F.col(methods).alias("method"), F.col(sym).alias("sym"), F.col(row_id).cast("long").alias("id"),
        F.col(y).cast("double").alias("y"), F.col("score").cast("double").alias("score")))
    n_buckets = max(4, -(-d.count() // task_rows))
    d = with_value_bucket(d, "score", "_b", n_buckets).withColumn("_b", -F.col("_b"))
    size = d.groupBy("method", "sym", "_b").agg(F.ceil(F.count(F.lit(1)) / task_rows).cast("int").alias("_p"))
    single = F.abs(F.col("_b")) % 2 == 1
    d = d.join(size, ["method", "sym", "_b"]).withColumn(
        "salt", F.when(single, F.pmod(F.xxhash64("id"), F.col("_p"))).otherwise(0).cast("int")).drop("_p")

    def weighted(pdf: pd.DataFrame):
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        ids, good, s = pdf["id"].to_numpy(), pdf["y"].to_numpy()[:, None], pdf["score"].to_numpy()
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        for c in range(0, B, reps_per_task):
            reps = np.arange(c, min(B, c + reps_per_task))
            w = poisson_weights(ids, reps, seed)
            yield reps, np.add.reduceat(w * good, starts, axis=0), np.add.reduceat(w, starts, axis=0)

    keys = ["method", "sym", "_b"]

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        return pd.concat([pd.DataFrame({"method": head["method"], "sym": head["sym"], "_b": head["_b"], "rep": reps,
                                        "pos": pos.sum(0), "cnt": cnt.sum(0)}) for reps, pos, cnt in weighted(pdf)])

    tot = d.groupBy(*keys, "salt").applyInPandas(totals, "method string, sym string, _b int, rep int, pos double, cnt double")
    tot = cut(tot.groupBy(*keys, "rep").agg(F.sum("pos").alias("pos"), F.sum("cnt").alias("cnt")))
    before = Window.partitionBy("method", "sym", "rep").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select("method", "sym", "_b", "rep", "pos", "cnt",
                       F.coalesce(F.sum("pos").over(before), F.lit(0.0)).alias("pa"),
                       F.coalesce(F.sum("cnt").over(before), F.lit(0.0)).alias("ca"))

    def parts(pdf: pd.DataFrame, car: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(car):
            return pd.DataFrame(columns=["method", "sym", "rep", "pos", "cnt", "worse", "gain"])
        car = car.sort_values("rep")
        pa, ca = car["pa"].to_numpy(), car["ca"].to_numpy()
        head, out = pdf.iloc[0], []
        for reps, pos, cnt in weighted(pdf):
            tp, n = np.cumsum(pos, axis=0) + pa[reps], np.cumsum(cnt, axis=0) + ca[reps]
            neg = cnt - pos
            neg_above = (n - tp) - neg
            out.append(pd.DataFrame({"method": head["method"], "sym": head["sym"], "rep": reps, "pos": pos.sum(0), "cnt": cnt.sum(0),
                                     "worse": (pos * (neg_above + 0.5 * neg)).sum(0), "gain": (pos * tp / np.maximum(n, 1e-12)).sum(0)}))
        return pd.concat(out)

    # one score per bucket: totals are enough
    upto = F.when(F.col("ca") + F.col("cnt") > 0, F.col("ca") + F.col("cnt"))
    alone = carry.filter(single).select(
        "method", "sym", "rep", "pos", "cnt",
        (F.col("pos") * (F.col("ca") - F.col("pa") + 0.5 * (F.col("cnt") - F.col("pos")))).alias("worse"),
        F.coalesce(F.col("pos") * (F.col("pa") + F.col("pos")) / upto, F.lit(0.0)).alias("gain"))
    carry = carry.filter(~single).select(*[F.col(k).alias(f"{k}_") for k in keys], "rep", "pa", "ca")
    per = d.filter(~single).groupBy(*keys).cogroup(carry.groupBy(*[f"{k}_" for k in keys])).applyInPandas(
        parts, "method string, sym string, rep int, pos double, cnt double, worse double, gain double").unionByName(alone)
    per = per.groupBy("method", "sym", "rep").agg(*[F.sum(c).alias(c) for c in ("pos", "cnt", "worse", "gain")])
    neg = F.col("cnt") - F.col("pos")
    per = per.filter((F.col("pos") > 0) & (neg > 0)).select(
        "method", "sym", "rep", (1.0 - F.col("worse") / (F.col("pos") * neg)).alias("auc"),
        (F.col("gain") / F.col("pos")).alias("ap"))
    # symbol multiplicities of a replicate come from the symbol's number, as for rows
    syms = per.select("sym").distinct()
    num = dense_position(syms, [], F.md5("sym"), "sym")

    @F.pandas_udf("double")
    def drawn(pos: pd.Series, rep: pd.Series) -> pd.Series:
        ids = (pos.to_numpy() + 10_000_000_019).astype(np.uint64)
        with np.errstate(over="ignore"):
            cell = _mix(ids * np.uint64(0x9E3779B97F4A7C15) + _mix(rep.to_numpy().astype(np.uint64) + np.uint64(seed + 1) * np.uint64(0xD1B54A32D192ED03)))
        return pd.Series(np.searchsorted(POISSON_CDF, cell.astype(np.float64) / 2.0**64).astype(np.float64))

    w = per.join(num, "sym").withColumn("w", drawn("_pos", "rep")).filter("w > 0")
    return w.groupBy("method", "rep").agg(
        (F.sum(F.col("w") * F.col("auc")) / F.sum("w")).alias("auc"),
        (F.sum(F.col("w") * F.col("ap")) / F.sum("w")).alias("ap"))


def auc_intervals(draws: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Differences of methods on the same replicates: mean, 90 % and 95 % limits, share above zero."""
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in pairs])).alias("p")
    long = draws.select("method", "rep", F.explode(F.array(
        F.struct(F.lit("auc").alias("metric"), F.col("auc").alias("v")),
        F.struct(F.lit("ap").alias("metric"), F.col("ap").alias("v")))).alias("c")).select("method", "rep", "c.*")
    left = long.select("*", pair).select("method", "rep", "metric", "v", "p.*").filter("method = left").drop("method")
    right = long.select(F.col("method").alias("right"), "rep", "metric", F.col("v").alias("v2"))
    d = left.join(right, ["right", "rep", "metric"]).withColumn("d", F.col("v") - F.col("v2"))
    q = lambda p, name: F.percentile("d", F.lit(p)).alias(name)  # B values
    return d.groupBy("left", "right", "metric").agg(
        F.avg("d").alias("observed"), q(0.05, "lo90"), q(0.95, "hi90"), q(0.025, "lo95"), q(0.975, "hi95"),
        F.avg((F.col("d") > 0).cast("double")).alias("p_gt0"))


def permuted_places(rank: np.ndarray, k: np.ndarray, event: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """Places (rows x replicates) of ranks 1..k under a pseudo-random permutation of their event in each replicate.

    Four Feistel rounds on an m x m grid of at least k cells, repeated where a place falls outside 1..k. A row finds its place
    from its own rank and its event's number alone, so nothing is sorted and no row meets another.
    """
    size = k.astype(np.uint64)[:, None]
    m = np.ceil(np.sqrt(size.astype(np.float64))).astype(np.uint64)
    m = np.where(m * m < size, m + np.uint64(1), m)
    with np.errstate(over="ignore"):
        key = _mix(event.astype(np.int64).view(np.uint64)[:, None] + _mix(reps.astype(np.uint64)[None, :] + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03)))
        x = np.broadcast_to((rank.astype(np.uint64) - np.uint64(1))[:, None], key.shape).copy()
        m, size = np.broadcast_to(m, key.shape), np.broadcast_to(size, key.shape)
        todo = np.ones(x.shape, bool)
        while todo.any():
            left, right, q, mm = x[todo] // m[todo], x[todo] % m[todo], key[todo], m[todo]
            for step in range(4):
                left, right = right, (left + _mix(q + right * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step)) % mm) % mm
            x[todo] = left * mm + right
            todo = x >= size
    return x.astype(np.int64) + 1


def permutation_hierarchy(ranked: DataFrame, n: int = 1000, seed: int = 11, min_actors: int = 5, min_events: int = 4) -> DataFrame:
    """Per symbol, the hierarchy statistic sum(S^2 / n) against lead ranks permuted inside events.

    S is an actor's summed net lead. A row's permuted rank needs only the row (``permuted_places``), so rows are moved once,
    to their actor, and a task adds up S^2 / n of its actors for all replicates; one row per task, symbol and replicate goes on.
    """
    base = ranked.filter(F.col("k") >= min_actors).select(
        "sym", "actor", F.xxhash64("sym", "day").alias("event"), F.col("k").cast("long"), F.col("rank").cast("long"), F.col("net_lead").cast("double"))
    names = ["sym", "actor", "event", "k", "rank", "net_lead"]

    def flush(d: pd.DataFrame, sums: dict) -> None:
        new = np.r_[True, (d["sym"].to_numpy()[1:] != d["sym"].to_numpy()[:-1]) | (d["actor"].to_numpy()[1:] != d["actor"].to_numpy()[:-1])]
        starts = np.flatnonzero(new)
        events = np.diff(np.r_[starts, len(d)])
        used = events >= min_events
        if not used.any():
            return
        sym = d["sym"].to_numpy()[starts][used]
        t = np.empty((int(used.sum()), n + 1))
        t[:, 0] = np.add.reduceat(d["net_lead"].to_numpy(), starts)[used]
        k, rank, event = (d[c].to_numpy() for c in ("k", "rank", "event"))
        for r in range(0, n, 50):
            reps = np.arange(r + 1, min(n, r + 50) + 1)
            lead = k[:, None] + 1 - 2 * permuted_places(rank, k, event, reps, seed)
            t[:, reps] = np.add.reduceat(lead.astype(np.float64), starts, axis=0)[used]
        t = t * t / events[used][:, None]
        for s in np.unique(sym):
            old, count = sums.get(s, (0.0, 0))
            sums[s] = (old + t[sym == s].sum(0), count + int((sym == s).sum()))

    def run(batches):
        sums, waiting = {}, None

        def out():
            for s, (t, actors) in sums.items():
                yield pd.DataFrame({"sym": s, "rep": np.arange(n + 1), "t": t, "actors": actors})
            sums.clear()
        for d in batches:
            d = d if waiting is None else pd.concat([waiting, d], ignore_index=True)
            last = (d["sym"] == d["sym"].iloc[-1]) & (d["actor"] == d["actor"].iloc[-1]) if len(d) else None
            done = d[~last] if len(d) else d
            waiting = d[last].reset_index(drop=True) if len(d) else None
            if len(done):
                flush(done.reset_index(drop=True), sums)
            if len(sums) > 500:
                yield from out()
        if waiting is not None and len(waiting):
            flush(waiting, sums)
        yield from out()

    t = base.select(*names).repartition("sym", "actor").sortWithinPartitions("sym", "actor").mapInPandas(
        run, f"sym {base.schema['sym'].dataType.simpleString()}, rep int, t double, actors long") \
        .groupBy("sym", "rep").agg(F.sum("t").alias("t"), F.sum("actors").alias("actors"))
    obs = t.filter("rep = 0").select("sym", F.col("t").alias("observed"), "actors")
    null = t.filter("rep > 0").select("sym", "t")
    return obs.join(null, "sym").groupBy("sym", "observed", "actors").agg(
        F.count(F.lit(1)).alias("n_perm"), F.avg("t").alias("null_mean"),
        ((1 + F.sum((F.col("t") >= F.col("observed")).cast("int"))) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def persistence(traits: DataFrame, lag: int = 1, match: DataFrame | None = None) -> DataFrame:
    """Spearman of the trait in bin t and bin t + lag, per bin pair.

    ``traits``: (bin INT, actor, trait). With ``match`` (actor, match) the later value is that of the matched other
    actor, which is the null for shared posting hours.
    """
    a = traits.select("bin", "actor", F.col("trait").alias("a"))
    b = traits.select((F.col("bin") - lag).alias("bin"), "actor", F.col("trait").alias("b"))
    if match is not None:
        a = a.join(match.select("actor", "match"), "actor")
        b = b.withColumnRenamed("actor", "match")
        return corr_rank(a.join(b, ["bin", "match"]), "a", "b", ["bin"])
    return corr_rank(a.join(b, ["bin", "actor"]), "a", "b", ["bin"])


def partial_rank_corr(df: DataFrame, a: str, b: str, given: str, keys: list[str] = []) -> DataFrame:
    """Rank correlation of a and b after removing the rank of a third variable from both."""
    d = df.filter(finite(a) & finite(b) & finite(given))
    for c, n in ((a, "_ra"), (b, "_rb"), (given, "_rc")):
        d = mid_ranks(d, c, n, keys)
    agg = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("r_ab"),
                               F.corr("_ra", "_rc").alias("r_ac"), F.corr("_rb", "_rc").alias("r_bc"))
    den = F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("r_ac") ** 2) * (1 - F.col("r_bc") ** 2)))
    # no partial correlation where the third variable explains one of the two wholly
    return agg.withColumn("partial", (F.col("r_ab") - F.col("r_ac") * F.col("r_bc")) / F.when(den > 0, den))
