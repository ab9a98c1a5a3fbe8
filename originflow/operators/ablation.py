"""Many feature sets over many windows: one pass of cross-products, one scoring pass, one metric job."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from originflow.operators.frames import matrix
from originflow.operators.metrics import event_metrics, finite, symbol_mean
from originflow.operators.models import Linear, Moments, cross_products, solve_ridge
from originflow.operators.ordered import exact_quantiles

KEYS = ["event_id", "sym", "frame_j"]


def moments_by(df: DataFrame, features: list[str], target: str, fit: Column, by: str) -> dict[str, Moments]:
    """The moments of each value of ``by`` (few): one medians job and one cross-product job for all of them."""
    rows = df.filter(fit & finite(target))
    long = rows.select(by, F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in features]))
                       .alias("p")).select(by, "p.*")
    got = exact_quantiles(long.filter(finite("v")), [by, "f"], "v", {"m": 0.5}).select(by, "f", "m").collect()  # windows x features rows
    groups = [r[0] for r in rows.select(by).distinct().collect()]
    med = {g: dict.fromkeys(features, 0.0) for g in groups}
    for r in got:
        med[r[by]][r["f"]] = float(r["m"])
    if not groups:
        return {}
    medians = F.create_map(*[c for g in groups for c in (F.lit(g), F.array(*[F.lit(med[g][f]) for f in features]))])
    x = [F.when(finite(f), F.col(f).cast("double")).otherwise(F.col("_m")[i]) - F.col("_m")[i] for i, f in enumerate(features)]
    vec = F.array(F.lit(1.0), *x, F.col(target).cast("double")).alias("v")
    g = cross_products(rows.withColumn("_m", F.element_at(medians, F.col(by))).select(by, vec), "v", [by])
    pos = {f: 1 + i for i, f in enumerate(features)} | {"y:" + target: 1 + len(features)}
    return {k[0]: Moments(features, [target], float(m[0, 0]), med[k[0]], m, pos) for k, m in g.items()}


@dataclass
class Ablation:
    """Fitted models by (window, method), and a row for each that tells how it was fitted or why it was not."""

    models: dict[tuple[str, str], Linear]
    fits: list[tuple]

    SCHEMA = "window string, method string, n_features int, n_fit long, status string"


def fit_sets(df: DataFrame, sets: dict[str, list[str]], target: str, fit: Column, by: str = "window", alpha: float = 3.0,
             rule: str = "add") -> Ablation:
    """A ridge for each feature set and window. A set with fewer than d + 30 fit rows in a window has no model, and its row says so."""
    union = sorted({f for fs in sets.values() for f in fs})
    moments = moments_by(df, union, target, fit, by)
    windows = sorted({r[0] for r in df.select(by).distinct().collect()})
    models, fits = {}, []
    for w in windows:
        for name, fs in sets.items():
            m = solve_ridge(moments[w], fs, target, alpha, rule) if w in moments else None
            n = int(moments[w].n) if w in moments else 0
            if m is not None:
                models[w, name] = m
            fits.append((w, name, len(fs), n, "fitted" if m is not None else "too few rows"))
    return Ablation(models, fits)


def score_sets_by(df: DataFrame, models: dict[tuple[str, str], Linear], keep: list[str], by: str = "window") -> DataFrame:
    """Long ``keep..., by, method, score``: each row by the models of its own window, one matrix product per window and batch."""
    methods = list(dict.fromkeys(m for _, m in models))
    union = sorted({f for m in models.values() for f in m.features})
    at = {f: i for i, f in enumerate(union)}
    weights = {}
    for w in {k[0] for k in models}:
        mat, const, med = np.zeros((len(union), len(methods))), np.full(len(methods), np.nan), np.zeros(len(union))
        for j, name in enumerate(methods):
            if (m := models.get((w, name))) is not None:
                mat[[at[f] for f in m.features], j], const[j] = m.raw()
                for f in m.features:
                    med[at[f]] = m.med[f]
        weights[w] = mat, const, med
    nan = F.lit(float("nan"))
    src = df.select(*keep, by, F.array(*[F.when(finite(f), F.col(f).cast("double")).otherwise(nan) for f in union]).alias("_x"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("_s", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(pa.chunked_array([b.column(b.num_columns - 1)]))
            own = np.array(b.column(b.schema.get_field_index(by)).to_pylist(), object)
            s = np.full((len(own), len(methods)), np.nan)
            for w, (mat, const, med) in weights.items():
                rows = own == w
                if rows.any():
                    s[rows] = np.where(np.isnan(x[rows]), med, x[rows]) @ mat + const
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(s), pa.list_(pa.float64()))], names=[*b.schema.names[:-1], "_s"])

    long = src.mapInArrow(run, schema).select(*keep, by, F.posexplode("_s").alias("_i", "score")).filter(~F.isnan("score"))
    return long.select(*keep, by, F.element_at(F.array(*[F.lit(n) for n in methods]), F.col("_i") + 1).alias("method"), "score")


def ablation_events(panel: DataFrame, sets: dict[str, list[str]], target: str, by: str = "window", alpha: float = 3.0,
                    rule: str = "add") -> tuple[DataFrame, Ablation]:
    """Metrics of every test event under every feature set: (window, method, event_id, sym, ...), and the fits."""
    fitted = fit_sets(panel, sets, target, F.col("split") == "train", by, alpha, rule)
    scored = score_sets_by(panel.filter("split = 'test'"), fitted.models, [*KEYS, target], by)
    return event_metrics(scored, target, "score", [by, "method", "event_id", "sym"], ks=(1, 3)), fitted


def ablation_table(events: DataFrame, metrics: list[str], by: str = "window", pooled: str = "pooled") -> DataFrame:
    """Symbol-balanced means per (window, method), and over the pooled test events of all windows."""
    both = events.withColumn(by, F.explode(F.array(F.col(by), F.lit(pooled))))
    return symbol_mean(both, metrics, [by, "method"])
