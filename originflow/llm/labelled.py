"""Labelled samples with a documented bound, folds by the crc32 of the id, and a one-feature logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originflow.llm.common import id_crc


def held_out(id_col: str, folds: int, fold: int):
    """True where the row is kept from learning; a null id is never learned from."""
    return F.coalesce(F.pmod(id_crc(id_col), F.lit(folds)) == fold, F.lit(True))


def learning_rows(labels: DataFrame, label_col: str, folds: int, fold: int, id_col: str = "doc_id") -> DataFrame:
    """``_lid, _label``: all learning ids. Null labels are left out; an id with several labels counts as its largest."""
    return labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("_lid")).agg(F.max(F.col(label_col)).cast("int").alias("_label")) \
        .filter(~held_out("_lid", folds, fold))


def sample(labels: DataFrame, label_col: str, folds: int, fold: int, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``per_class`` of the ``learning_rows`` of each class, the first by hash of the id. Two bounded rows' worth
    of ids, so the result may be broadcast."""
    rows = learning_rows(labels, label_col, folds, fold, id_col)
    parts = [rows.filter(F.col("_label") == k).orderBy(F.xxhash64("_lid"), "_lid").limit(per_class) for k in (0, 1)]
    return parts[0].union(parts[1])


def with_labels(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, few: bool = True) -> DataFrame:
    """``_lid, _label, _text`` of the labelled documents; ``few`` rows are broadcast, others meet them in a plain join."""
    return docs.select(F.col(id_col).alias("_lid"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(rows) if few else rows, "_lid")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept by Newton steps with halving; with one class or no rows, slope 0 and the smoothed log odds."""
    n1, n = float(y.sum()), len(y)
    if n1 in (0.0, float(n)):
        return 0.0, float(np.log((n1 + 1) / (n - n1 + 1)))
    a, w = np.stack([x, np.ones(n)], 1), np.array([0.0, np.log((n1 + 1) / (n - n1 + 1))])

    def loss(v):
        z = a @ v
        return np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * ridge * v[0] ** 2
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        g = a.T @ (y - p) - ridge * np.array([w[0], 0.0])
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([ridge, 1e-9])
        step, t = np.linalg.solve(h, g), 1.0
        while t > 1e-6 and not loss(w + t * step) < now:
            t /= 2
        if t <= 1e-6:
            break
        w, now = w + t * step, loss(w + t * step)
    return float(w[0]), float(w[1])


def fit_logistic_table(rows: DataFrame, ridge: float = 1e-2) -> tuple[float, float]:
    """``fit_logistic`` of a table ``x, y`` of any size: a Newton step is one aggregate, six numbers reach the driver."""
    n, n1 = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0)).cast("double")).first()
    if n1 in (0.0, float(n)):
        return 0.0, float(np.log((n1 + 1) / (n - n1 + 1)))

    def sums(v):
        z = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.lit(float(v[0])) * F.col("x") + F.lit(float(v[1]))))
        p = 1 / (1 + F.exp(-z))
        r, h, x = F.col("y") - p, p * (1 - p), F.col("x")
        loss, *s = rows.agg(F.sum(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("y") * z), F.sum(r * x), F.sum(r),
                            F.sum(h * x * x), F.sum(h * x), F.sum(h)).first()
        return loss + 0.5 * ridge * v[0] ** 2, np.array([s[0] - ridge * v[0], s[1]]), np.array([[s[2] + ridge, s[3]], [s[3], s[4] + 1e-9]])
    w = np.array([0.0, np.log((n1 + 1) / (n - n1 + 1))])
    now, g, h = sums(w)
    for _ in range(100):
        step, t = np.linalg.solve(h, g), 1.0
        if g @ step < 1e-10 * (1 + now):  # what the step could gain is lost in rounding
            break
        while t > 1e-6 and not (new := sums(w + t * step))[0] < now:
            t /= 2
        if t <= 1e-6:
            break
        w, (now, g, h) = w + t * step, new
    return float(w[0]), float(w[1])
