"""Linear models fitted from distributed cross-products.

Rows never reach the driver: each task adds up its own d x d products, Spark adds the partial
sums, and the driver solves a d x d system (d is the number of features).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from originflow.operators.frames import matrix
from originflow.operators.metrics import event_metrics, finite, symbol_mean, within_demean
from originflow.operators.ordered import exact_quantiles
from originflow.session import cut

ZERO_VAR = {"add": 1e-12, "strict": 1e-8, "loose": 1e-6}


def scale_rule(sd: np.ndarray, rule: str) -> np.ndarray:
    """Zero-variance rule: ``add`` a tiny number, or use 1 where the sd is at most the named limit."""
    return sd + ZERO_VAR["add"] if rule == "add" else np.where(sd > ZERO_VAR[rule], sd, 1.0)


def cross_products(df: DataFrame, vec: str, by: list[str] = []) -> dict[tuple, np.ndarray]:
    """X'X of an array column per group of ``by`` (few groups), as numpy matrices.

    One pass; a task emits d rows per group, which are summed by Spark position-wise.
    """
    schema = ", ".join([f"{c} string" for c in by] + ["i int", "g array<double>"])

    def partial(batches):
        acc: dict[tuple, np.ndarray] = {}
        for b in batches:
            if b.num_rows == 0:
                continue
            x = matrix(pa.chunked_array([b.column(b.schema.get_field_index(vec))]))
            if by:
                keys = list(zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in by]))
                for k in set(keys):
                    part = x[np.fromiter((q == k for q in keys), dtype=bool, count=len(keys))]
                    acc[k] = acc.get(k, 0.0) + part.T @ part
            else:
                acc[()] = acc.get((), 0.0) + x.T @ x
        for k, g in acc.items():
            cols = [pa.array([v] * len(g), pa.string()) for v in k]
            yield pa.record_batch(
                cols + [pa.array(range(len(g)), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))],
                names=[*by, "i", "g"])

    src = df.select(*[F.col(c).cast("string").alias(c) for c in by], vec)
    rows = src.mapInArrow(partial, schema).groupBy(*by, "i").agg(
        vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g")).collect()  # d rows per group
    out: dict[tuple, list] = {}
    for r in rows:
        out.setdefault(tuple(r[c] for c in by), []).append((r["i"], r["g"]))
    return {k: np.array([g for _, g in sorted(v)]) for k, v in out.items()}


def feature_medians(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Exact medians of the finite values of each column, in one job; 0 for a column without any."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in features])).alias("p")).select("p.*")
    got = exact_quantiles(long.filter(finite("v")), ["f"], "v", {"m": 0.5}).collect()  # one row per feature
    med = {r["f"]: float(r["m"]) for r in got}
    return {f: med.get(f, 0.0) for f in features}


@dataclass
class Moments:
    """Cross-products of imputed columns and targets over the fit rows, around the medians."""

    features: list[str]
    targets: list[str]
    n: float
    med: dict[str, float]
    g: np.ndarray  # of [1, x - med, y]
    pos: dict[str, int] = field(default_factory=dict)

    def standardised(self, features: list[str], target: str, rule: str):
        ix = [self.pos[f] for f in features]
        t = self.pos["y:" + target]
        s = self.g[0, ix]
        mu = s / self.n
        cov = self.g[np.ix_(ix, ix)] - self.n * np.outer(mu, mu)
        sd = scale_rule(np.sqrt(np.maximum(np.diag(cov) / self.n, 0.0)), rule)
        ybar = self.g[0, t] / self.n
        xty = self.g[ix, t] - self.n * mu * ybar
        yty = self.g[t, t] - self.n * ybar * ybar
        return mu, sd, cov / np.outer(sd, sd), xty / sd, ybar, yty


def moments(df: DataFrame, features: list[str], targets: list[str], fit: Column) -> Moments:
    """One medians job and one cross-product job for the union of all feature sets."""
    ok = fit
    for t in targets:
        ok = ok & finite(t)
    rows = df.filter(ok)
    med = feature_medians(rows, features)
    x = [F.when(finite(f), F.col(f).cast("double")).otherwise(F.lit(med[f])) - F.lit(med[f]) for f in features]
    vec = F.array(F.lit(1.0), *x, *[F.col(t).cast("double") for t in targets]).alias("v")
    got = cross_products(rows.select(vec), "v")
    size = 1 + len(features) + len(targets)
    g = got.get((), np.zeros((size, size)))
    pos = {f: 1 + i for i, f in enumerate(features)}
    pos |= {"y:" + t: 1 + len(features) + i for i, t in enumerate(targets)}
    return Moments(features, targets, float(g[0, 0]), med, g, pos)


@dataclass
class Linear:
    """A fitted linear scorer in standardised space."""

    features: list[str]
    beta0: float
    beta: np.ndarray
    med: dict[str, float]
    mu: np.ndarray  # of x - med
    sd: np.ndarray

    def column(self) -> Column:
        """The score as a column expression: stays in generated code, no Python per row."""
        s = F.lit(float(self.beta0))
        for f, b, m, d in zip(self.features, self.beta, self.mu, self.sd):
            x = F.when(finite(f), F.col(f).cast("double")).otherwise(F.lit(self.med[f])) - F.lit(self.med[f])
            s = s + F.lit(float(b)) * (x - F.lit(float(m))) / F.lit(float(d))
        return s

    def raw(self) -> tuple[np.ndarray, float]:
        """Weights and intercept on imputed, unscaled features."""
        w = self.beta / self.sd
        mean = np.array([self.med[f] for f in self.features]) + self.mu
        return w, float(self.beta0 - w @ mean)

    def parameters(self) -> list[tuple]:
        """(feature, coef_std, median, mean, sd, coef_raw) rows, the intercepts first."""
        raw, intercept = self.raw()
        mean = np.array([self.med[f] for f in self.features]) + self.mu
        head = ("(intercept)", float(self.beta0), None, None, None, intercept)
        return [head] + [(f, float(b), float(self.med[f]), float(m), float(s), float(r))
                         for f, b, m, s, r in zip(self.features, self.beta, mean, self.sd, raw)]


PARAMETER_SCHEMA = "feature string, coef_std double, median double, mean double, sd double, coef_raw double"


def solve_ridge(mom: Moments, features: list[str], target: str, alpha: float, rule: str = "add",
                min_extra: int = 30) -> Linear | None:
    """Ridge with a free intercept; None when there are fewer than d + ``min_extra`` fit rows."""
    if mom.n < len(features) + min_extra:
        return None
    mu, sd, gram, xty, ybar, _ = mom.standardised(features, target, rule)
    beta = np.linalg.solve(gram + alpha * np.eye(len(features)), xty)
    return Linear(features, ybar, beta, {f: mom.med[f] for f in features}, mu, sd)


def solve_ridge_gcv(mom: Moments, features: list[str], target: str, alphas: list[float], rule: str = "strict") -> tuple[Linear, float]:
    """Ridge with the penalty of the lowest generalised (leave-one-out) cross-validation error."""
    mu, sd, gram, xty, ybar, yty = mom.standardised(features, target, rule)
    val, vec = np.linalg.eigh(gram)
    z = vec.T @ xty
    def gcv(a: float) -> float:
        shrink = 1.0 / (np.maximum(val, 0.0) + a)
        rss = yty - 2.0 * (z * z * shrink).sum() + (z * z * shrink * shrink * np.maximum(val, 0.0)).sum()
        dof = 1.0 + (np.maximum(val, 0.0) * shrink).sum()
        return rss / max(mom.n - dof, 1e-9) ** 2
    best = min(alphas, key=gcv)
    beta = vec @ (z / (np.maximum(val, 0.0) + best))
    return Linear(features, ybar, beta, {f: mom.med[f] for f in features}, mu, sd), best


FEW_MODELS = 6


def score_sets(df: DataFrame, models: dict[str, Linear], keep: list[str]) -> DataFrame:
    """Long (keep..., method, score) from one pass over the rows for all models.

    A few models are plain column expressions. Many (a penalty grid) would outgrow one generated
    method, so they go through one matrix product per Arrow batch. Models share their medians.
    """
    names = list(models)
    if len(models) <= FEW_MODELS:
        cells = F.array(*[F.struct(F.lit(k).alias("method"), m.column().alias("score")) for k, m in models.items()])
        return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.method", "c.score")
    med = {f: v for m in models.values() for f, v in m.med.items()}
    union = sorted(med)
    w = np.zeros((len(union), len(names)))
    c = np.zeros(len(names))
    for j, m in enumerate(models.values()):
        w[[union.index(f) for f in m.features], j], c[j] = m.raw()
    x = F.array(*[F.when(finite(f), F.col(f).cast("double")).otherwise(F.lit(med[f])) for f in union])
    src = df.select(*keep, x.alias("_x"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("_s", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = matrix(pa.chunked_array([b.column(b.num_columns - 1)])) @ w + c
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], pa.array(list(s), pa.list_(pa.float64()))], names=[*b.schema.names[:-1], "_s"])

    long = src.mapInArrow(run, schema).select(*keep, F.posexplode("_s").alias("_i", "score"))
    return long.select(*keep, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1).alias("method"), "score")


PANEL_KEYS = ["event_id", "sym", "frame_j"]


def ridge_sets(df: DataFrame, sets: dict[str, list[str]], target: str, fit: Column, alpha: float = 3.0,
               rule: str = "add") -> dict[str, Linear]:
    """One ridge per named feature set, from one shared cross-product pass."""
    union = sorted({f for fs in sets.values() for f in fs})
    mom = moments(df, union, [target], fit)
    out = {k: solve_ridge(mom, fs, target, alpha, rule) for k, fs in sets.items()}
    return {k: m for k, m in out.items() if m is not None}


def ridge_select(
    df: DataFrame, sets: dict[str, list[str]], target: str, fit: Column, dev: Column, refit: Column,
    alphas: list[float], rule: str = "strict", tie: str = "largest",
) -> tuple[dict[str, Linear], DataFrame]:
    """Choose each set's penalty by symbol-balanced ndcg3 on ``dev`` rows, then refit.

    All penalties and sets share one pass per fit mask and one metric job. Returns the models and
    the (method, alpha, ndcg3) table of the search.
    """
    union = sorted({f for fs in sets.values() for f in fs})
    inner = moments(df, union, [target], fit)
    grid = {}
    for name, fs in sets.items():
        for a in alphas:
            m = solve_ridge(inner, fs, target, a, rule)
            if m is not None:
                grid[f"{name}|{a!r}"] = m
    best = {name: 3.0 if tie == "largest" else 10.0 for name in sets}
    table = []
    if grid:
        scored = score_sets(df.filter(dev), grid, [*PANEL_KEYS, target])
        ev = event_metrics(scored, target, "score", ["method", "event_id", "sym"], ks=(3,))
        rows = symbol_mean(ev, ["ndcg3"], ["method"]).select("method", "ndcg3").collect()  # sets x alphas rows
        found: dict[str, list] = {}
        for r in rows:
            name, a = r["method"].rsplit("|", 1)
            found.setdefault(name, []).append((round(r["ndcg3"], 12), float(a)))  # equal up to the order of sums
            table.append((name, float(a), float(r["ndcg3"])))
        for name, opts in found.items():
            pick = max(opts, key=lambda o: (o[0], o[1] if tie == "largest" else -alphas.index(o[1])))
            best[name] = pick[1]
    final = moments(df, union, [target], refit)
    models = {k: solve_ridge(final, fs, target, best[k], rule) for k, fs in sets.items()}
    search = df.sparkSession.createDataFrame(sorted(table), "method string, alpha double, ndcg3 double")
    return {k: m for k, m in models.items() if m is not None}, search


# ---- vector features -------------------------------------------------------------------------

@dataclass
class VectorRidge:
    """Ridge on an array column: standardisation and eigen-system of one fit mask, shared by all penalties."""

    mu: np.ndarray
    sd: np.ndarray
    val: np.ndarray
    vec: np.ndarray
    z: np.ndarray
    ybar: float

    def weights(self, alpha: float) -> tuple[np.ndarray, float]:
        beta = self.vec @ (self.z / (np.maximum(self.val, 0.0) + alpha)) / self.sd
        return beta, float(self.ybar - beta @ self.mu)


def fit_vector_ridge(df: DataFrame, vec: str, target: str, fit: Column, rule: str = "loose") -> VectorRidge:
    rows = df.filter(fit & finite(target)).select(
        F.concat(F.array(F.lit(1.0)), F.transform(vec, lambda x: x.cast("double")),
                 F.array(F.col(target).cast("double"))).alias("v"))
    g = cross_products(rows, "v")[()]
    n, d = g[0, 0], len(g) - 2
    ix = np.arange(1, d + 1)
    mu = g[0, ix] / n
    cov = g[np.ix_(ix, ix)] - n * np.outer(mu, mu)
    sd = scale_rule(np.sqrt(np.maximum(np.diag(cov) / n, 0.0)), rule)
    ybar = g[0, d + 1] / n
    val, e = np.linalg.eigh(cov / np.outer(sd, sd))
    return VectorRidge(mu, sd, val, e, e.T @ ((g[ix, d + 1] - n * mu * ybar) / sd), float(ybar))


def score_vector(df: DataFrame, vec: str, weights: dict[str, tuple[np.ndarray, float]], prefix: str = "s_") -> DataFrame:
    """One score column per weight vector; Arrow batches through one matrix product."""
    names = [f"{prefix}{k}" for k in weights]
    w = np.stack([b for b, _ in weights.values()], axis=1)
    c = np.array([a for _, a in weights.values()])
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches):
        for b in batches:
            x = matrix(pa.chunked_array([b.column(b.schema.get_field_index(vec))])) if b.num_rows else None
            s = x @ w + c if x is not None else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *[pa.array(s[:, i]) for i in range(len(names))]], names=[*b.schema.names, *names])

    return df.mapInArrow(run, schema)


def vector_ridge_select(df: DataFrame, vec: str, target: str, fit: Column, dev: Column, refit: Column,
                        alphas: list[float]) -> tuple[DataFrame, float]:
    """Ridge on vectors with the penalty chosen on ``dev`` rows; returns scored rows and the penalty."""
    inner = fit_vector_ridge(df, vec, target, fit)
    named = {str(i): inner.weights(a) for i, a in enumerate(alphas)}
    scored = score_vector(df.filter(dev).select(*PANEL_KEYS, target, vec), vec, named).drop(vec)
    long = scored.select(*PANEL_KEYS, target, F.explode(F.array(*[
        F.struct(F.lit(i).alias("a"), F.col(f"s_{i}").alias("score")) for i in range(len(alphas))])).alias("c")).select(
        *PANEL_KEYS, target, "c.*")
    got = symbol_mean(event_metrics(long, target, "score", ["a", "event_id", "sym"], ks=(3,)), ["ndcg3"], ["a"]).collect()
    best = max(((round(r["ndcg3"], 12), alphas[r["a"]]) for r in got), default=(0.0, alphas[-1]))[1]
    final = fit_vector_ridge(df, vec, target, refit)
    return score_vector(df, vec, {"score": final.weights(best)}, prefix=""), best


def residual_plugin(
    df: DataFrame, vec: str, features: list[str], target: str, fit: Column, dev: Column, refit: Column,
    alphas: list[float], lambdas: list[float],
) -> tuple[DataFrame, dict]:
    """Vector ridge plus lambda times a ridge of its residual on structured features.

    The inner base is fitted on inner-fit rows only, so the rows used to choose the penalties stay unseen.
    """
    inner = fit_vector_ridge(df, vec, target, fit)
    named = {str(i): inner.weights(a) for i, a in enumerate(alphas)}
    dev_rows = score_vector(df.filter(dev).select(*PANEL_KEYS, target, vec), vec, named).drop(vec)
    long = dev_rows.select(*PANEL_KEYS, target, F.explode(F.array(*[
        F.struct(F.lit(i).alias("a"), F.col(f"s_{i}").alias("score")) for i in range(len(alphas))])).alias("c")).select(
        *PANEL_KEYS, target, "c.*")
    got = symbol_mean(event_metrics(long, target, "score", ["a", "event_id", "sym"], ks=(3,)), ["ndcg3"], ["a"]).collect()
    base_alpha = max(((round(r["ndcg3"], 12), alphas[r["a"]]) for r in got if r["ndcg3"] is not None), default=(0.0, alphas[-1]))[1]
    with_base = cut(score_vector(df, vec, {"base": inner.weights(base_alpha)}, prefix="_").drop(vec).withColumn(
        "_resid", F.col(target) - F.col("_base")))
    mom = moments(with_base, features, ["_resid"], fit)
    cells = []
    for i, a in enumerate(alphas):
        m = solve_ridge(mom, features, "_resid", a, "loose")
        if m is not None:
            cells.append(F.struct(F.lit(i).alias("a"), m.column().alias("part")))
    # penalties first, weights after, so that each model's sum is written once
    weights = F.explode(F.array(*[F.struct(F.lit(j).alias("l"), F.lit(float(v)).alias("v")) for j, v in enumerate(lambdas)])).alias("w")
    long = with_base.filter(dev).select(*PANEL_KEYS, target, "_base", F.explode(F.array(*cells)).alias("c")).select(
        *PANEL_KEYS, target, "_base", "c.*", weights).select(
        *PANEL_KEYS, target, "a", "w.l", (F.col("_base") + F.col("w.v") * F.col("part")).alias("score"))
    got = symbol_mean(event_metrics(long, target, "score", ["a", "l", "event_id", "sym"], ks=(3,)),
                      ["ndcg3"], ["a", "l"]).collect()
    # of equal results the strongest penalty and weight; without usable dev events the strongest penalty and the first weight
    _, alpha, lam = max(((round(r["ndcg3"], 12), alphas[r["a"]], lambdas[r["l"]]) for r in got if r["ndcg3"] is not None),
                        default=(0.0, alphas[-1], lambdas[0]))
    outer = fit_vector_ridge(df, vec, target, refit)
    final = cut(score_vector(df, vec, {"base": outer.weights(base_alpha)}, prefix="_").drop(vec).withColumn(
        "_resid", F.col(target) - F.col("_base")))
    comp = solve_ridge(moments(final, features, ["_resid"], refit), features, "_resid", alpha, "loose")
    part = F.lit(lam) * comp.column() if comp is not None else F.lit(0.0)  # too few rows to fit: the base alone
    out = final.withColumn("base_score", F.col("_base")).withColumn("score", F.col("_base") + part).drop("_base", "_resid")
    return out, {"base_alpha": base_alpha, "alpha": alpha, "lambda": lam}


# ---- listwise ranker -------------------------------------------------------------------------

def listwise(df: DataFrame, features: list[str], grade: str, fit: Column, l2: float = 1.0, steps: int = 12,
             group: str = "event_id") -> Linear:
    """Linear ranker by listwise softmax cross-entropy: target softmax(grade), model softmax(score) per event.

    Each step is one Spark job that returns the loss and its gradient (d + 1 numbers); the driver keeps a
    short L-BFGS history. Events are candidate lists limited to the first ranks.
    """
    mom = moments(df, features, [grade], fit)
    mu, sd, _, _, _, _ = mom.standardised(features, grade, "strict")
    zero = Linear(features, 0.0, np.zeros(len(features)), mom.med, mu, sd)
    x = [F.when(finite(f), F.col(f).cast("double")).otherwise(F.lit(mom.med[f])) - F.lit(mom.med[f]) for f in features]
    xs = [((c - F.lit(float(m))) / F.lit(float(s))).alias(f"x{i}") for i, (c, m, s) in enumerate(zip(x, mu, sd))]
    w = Window.partitionBy(group)
    rows = df.filter(fit & finite(grade)).select(group, F.col(grade).cast("double").alias("y"), *xs)
    rows = rows.withColumn("_e", F.exp(F.col("y") - F.max("y").over(w))).withColumn(
        "p", F.col("_e") / F.sum("_e").over(w)).drop("_e", "y")
    rows = cut(rows.repartition(group))

    def loss_grad(b: np.ndarray) -> tuple[float, np.ndarray]:
        s = F.lit(0.0)
        for i, v in enumerate(b):
            s = s + F.lit(float(v)) * F.col(f"x{i}")
        d = rows.withColumn("s", s).withColumn("m", F.max("s").over(w))
        d = d.withColumn("z", F.sum(F.exp(F.col("s") - F.col("m"))).over(w))
        logq = F.col("s") - F.col("m") - F.log("z")
        r = F.exp(logq) - F.col("p")
        got = d.agg(F.sum(-F.col("p") * logq), F.count_distinct(group),
                    *[F.sum(r * F.col(f"x{i}")) for i in range(len(b))]).first()
        n = max(int(got[1] or 1), 1)
        return float(got[0] or 0.0) / n + 0.5 * l2 * float(b @ b) / n, np.array(got[2:], dtype=float) / n + l2 * b / n

    b = np.zeros(len(features))
    f0, g0 = loss_grad(b)
    hist: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, mem = g0.copy(), []
        for s_, y_ in reversed(hist[-6:]):
            a = (s_ @ q) / (y_ @ s_)
            q -= a * y_
            mem.append(a)
        if hist:
            q *= (hist[-1][0] @ hist[-1][1]) / (hist[-1][1] @ hist[-1][1])
        for (s_, y_), a in zip(hist[-6:], reversed(mem)):
            q += s_ * (a - (y_ @ q) / (y_ @ s_))
        step, better = 1.0, False
        while step >= 1e-3 and not better:
            nb = b - step * q
            f1, g1 = loss_grad(nb)
            better = f1 <= f0 - 1e-4 * step * float(q @ g0)
            step *= 0.5
        if not better:  # keep the point that no trial improved
            break
        s_, y_ = nb - b, g1 - g0
        if s_ @ y_ > 1e-12:
            hist.append((s_, y_))
        done = abs(f0 - f1) < 1e-9
        b, f0, g0 = nb, f1, g1
        if done:
            break
    return Linear(features, 0.0, b, zero.med, mu, sd)


def tree_ranker(df: DataFrame, features: list[str], grade: str, fit: Column, group: str = "event_id",
                trees: int = 20, depth: int = 4, seed: int = 0, out: str = "score") -> DataFrame:
    """Boosted regression trees (MLlib) on grades centred inside each event; scores all rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    med = feature_medians(df.filter(fit), features)
    filled = df.withColumns({f"_f_{f}": F.when(finite(f), F.col(f).cast("double")).otherwise(F.lit(med[f])) for f in features})
    data = VectorAssembler(inputCols=[f"_f_{f}" for f in features], outputCol="_x").transform(filled)
    train = within_demean(data.filter(fit).withColumn("_g", F.col(grade).cast("double")), ["_g"], group)
    model = GBTRegressor(featuresCol="_x", labelCol="_g", predictionCol=out, maxIter=trees, maxDepth=depth, stepSize=0.1,
                         subsamplingRate=0.8, seed=seed).fit(train)
    return model.transform(data).drop("_x", *[f"_f_{f}" for f in features])


# ---- within-event regression ------------------------------------------------------------------

@dataclass
class ClusterFit:
    features: list[str]
    n: int
    groups: int
    beta: np.ndarray
    se: np.ndarray
    vcov: np.ndarray
    ssr: float
    sst: float

    @property
    def r2(self) -> float:
        return 1.0 - self.ssr / max(self.sst, 1e-12)


def within_ols(df: DataFrame, features: list[str], target: str, rows: Column, scale: Moments,
               group: str = "event_id", ordinal: str = "frame_j") -> ClusterFit:
    """Event fixed-effects least squares with event-clustered errors.

    Features are imputed and scaled by ``scale`` (training moments, population sd + 1e-12), then demeaned.
    Two passes: cross-products for the coefficients, per-event score vectors for the error matrix.
    """
    mu, sd, *_ = scale.standardised(features, scale.targets[0], "add")
    cols = {}
    for f, m, s in zip(features, mu, sd):
        med = scale.med[f]
        cols[f"x_{f}"] = (F.when(finite(f), F.col(f).cast("double")).otherwise(F.lit(med)) - F.lit(float(med + m))) / F.lit(float(s))
    d = df.filter(rows & finite(target)).withColumns({**cols, "_y": F.col(target).cast("double")})
    names = list(cols)
    d = within_demean(d.select(group, ordinal, "_y", *names), ["_y", *names], group, ordinal)
    g = cross_products(d.select(F.array(*names, "_y", F.lit(1.0)).alias("v")), "v")[()]
    k = len(names)
    n = int(round(g[k + 1, k + 1]))
    inv = np.linalg.pinv(g[:k, :k])
    beta = inv @ g[:k, k]
    sst = g[k, k]
    ssr = float(sst - 2 * beta @ g[:k, k] + beta @ g[:k, :k] @ beta)
    u = F.col("_y")
    for c, b in zip(names, beta):
        u = u - F.lit(float(b)) * F.col(c)
    per = d.withColumn("_u", u).groupBy(group).agg(*[F.sum(F.col(c) * F.col("_u")).alias(c) for c in names])
    m = cross_products(per.select(F.array(*names, F.lit(1.0)).alias("v")), "v")[()]
    groups = int(round(m[k, k]))
    fix = (groups / max(groups - 1, 1)) * ((n - 1) / max(n - k, 1))
    v = fix * inv @ m[:k, :k] @ inv
    return ClusterFit(features, n, groups, beta, np.sqrt(np.maximum(np.diag(v), 0.0)), v, ssr, float(sst))


def nested_wald(base: ClusterFit, full: ClusterFit, added: list[str]) -> dict[str, float]:
    """Gain of the added terms: within-R2, residual sum of squares, and their joint Wald test."""
    from originflow.functions.special import chi2_sf

    ix = [full.features.index(f) for f in added]
    b = full.beta[ix]
    w = float(b @ np.linalg.pinv(full.vcov[np.ix_(ix, ix)]) @ b)
    return {"delta_r2_within": full.r2 - base.r2, "ssr_reduction": (base.ssr - full.ssr) / max(base.ssr, 1e-12),
            "wald_chi2": w, "df": float(len(ix)), "p_value": chi2_sf(w, len(ix))}
