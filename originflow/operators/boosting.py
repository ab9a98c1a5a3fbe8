"""Listwise boosted trees, grown from histograms that Spark adds up.

A row's gradient comes from the softmax cross-entropy of its event: target softmax(grade), model softmax(score). A level of a
tree is one job: tasks work out scores, gradients and nodes of their rows and emit a histogram per node and feature; Spark adds
them; the driver sees nodes x features x bins sums and picks the splits. Rows never leave their chunk of whole events.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from originflow.operators.frames import matrix
from originflow.operators.metrics import event_metrics, finite, symbol_mean
from originflow.operators.ordered import exact_quantiles
from originflow.session import Written

CHUNK_ROWS = 50_000  # rows of a chunk of whole events, on average
EQUAL_GAIN = 1e-9  # gains closer than this are equal: they differ by the order in which rows were added up
REFRESH = 10  # trees after which the scores of the rows are written anew


@dataclass
class Tree:
    """A binary tree in heap order: node k has children 2k + 1 and 2k + 2; feature -1 marks a leaf. Bins up to ``split`` go left."""

    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            right = bins[rows, np.maximum(f, 0)] > self.split[at]
            at = np.where(inner, 2 * at + 1 + right, at)


@dataclass
class TreeRanker:
    """A fitted ranker. Feature values are binned by ``edges``; bin 0 holds missing values."""

    features: list[str]
    edges: list[list[float]]
    rate: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)  # mean over events, before the first tree and after each

    def bins(self) -> Column:
        place = lambda f, e: F.when(finite(f), F.size(F.filter(F.array(*[F.lit(x) for x in e]), lambda x: x < F.col(f).cast("double"))) + 1) \
            .otherwise(0) if e else F.when(finite(f), 1).otherwise(0)
        return F.array(*[place(f, e).cast("double") for f, e in zip(self.features, self.edges)])

    def score(self, df: DataFrame, sizes: list[int] | None = None, out: str = "score") -> DataFrame:
        """``df`` with the score of all trees, or an array of the scores after each of ``sizes`` trees."""
        stops = sizes or [len(self.trees)]
        src = df.withColumn("_bins", self.bins())
        schema = T.StructType([*df.schema.fields, T.StructField("_scores", T.ArrayType(T.DoubleType()))])
        trees, rate = self.trees, self.rate

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                bins = matrix(pa.chunked_array([b.column(b.num_columns - 1)])).astype(np.int64)
                s, parts = np.zeros(len(bins)), np.zeros((len(bins), len(stops)))
                for t, tree in enumerate(trees):
                    for j in np.flatnonzero(np.array(stops) == t):
                        parts[:, j] = s
                    s = s + rate * tree.value[tree.nodes(bins)]
                for j in np.flatnonzero(np.array(stops) >= len(trees)):
                    parts[:, j] = s
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(parts), pa.list_(pa.float64()))],
                                                 names=[*b.schema.names[:-1], "_scores"])

        scored = src.mapInArrow(run, schema)
        return scored.withColumnRenamed("_scores", out) if sizes else scored.withColumn(out, F.col("_scores")[0]).drop("_scores")


def bin_edges(rows: DataFrame, features: list[str], n_bins: int) -> list[list[float]]:
    """Distinct inner quantiles of each feature's finite values, in one job; a bin is (edge before, edge]."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in features])).alias("p"))
    probs = {f"e{i}": i / n_bins for i in range(1, n_bins)}
    got = {r["f"]: sorted({float(r[e]) for e in probs}) for r in
           exact_quantiles(long.select("p.*").filter(finite("v")), ["f"], "v", probs).collect()}  # one row per feature
    return [got.get(f, []) for f in features]


def softmax(values: np.ndarray, event: np.ndarray, n: int) -> np.ndarray:
    top = np.full(n, -np.inf)
    np.maximum.at(top, event, values)
    e = np.exp(values - top[event])
    return e / np.bincount(event, e, n)[event]


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the keys and the salt only, so that a task that runs again draws the same."""
    x = keys.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


class _Rows:
    """The training rows in chunks of whole events, with the scores of the trees written so far."""

    def __init__(self, rows: DataFrame):
        self.written = Written(rows, "boosting")
        self._hold()

    def _hold(self):
        self.df = self.written.df.repartition("chunk").persist()

    def refresh(self, update) -> None:
        nxt = Written(self.df.groupBy("chunk").applyInArrow(update, self.written.df.schema), "boosting")
        self.close()
        self.written = nxt
        self._hold()

    def close(self) -> None:
        self.df.unpersist()
        self.written.drop()


def histograms(rows: DataFrame, tree: Tree, level: int, recent: list[Tree], rate: float, n_bins: int, columns: list[int],
               subsample: float, salt: int) -> dict[tuple[int, int], np.ndarray]:
    """``(node, feature) -> sums of gradient, curvature and rows per bin`` for the nodes of a level; key (-1, 0) holds the loss
    and the number of events of all rows before this tree."""
    first, width = 2**level - 1, 2**level

    def partial(table):
        bins = matrix(table["bins"]).astype(np.int64)
        event, code = np.unique(table["event"].to_numpy(), return_inverse=True)
        s = table["score"].to_numpy().copy()
        for t in recent:
            s += rate * t.value[t.nodes(bins)]
        p, q = softmax(table["grade"].to_numpy().astype(float), code, len(event)), softmax(s, code, len(event))
        out = [(-1, 0, [float(-(p * np.log(np.maximum(q, 1e-300))).sum()), float(len(event))])] if level == 0 else []
        at = tree.nodes(bins) - first
        use = (at >= 0) & (at < width) & (_uniform(event, salt)[code] < subsample)
        at, bins, g, h = at[use], bins[use], (q - p)[use], (q * (1 - q))[use]
        for f in columns:
            cell = at * n_bins + bins[:, f]
            sums = np.stack([np.bincount(cell, w, width * n_bins) for w in (g, h, np.ones(len(g)))]).reshape(3, width, n_bins)
            out += [(first + k, f, sums[:, k].ravel()) for k in np.unique(at)]
        return pa.table({"node": pa.array([o[0] for o in out], pa.int32()), "f": pa.array([o[1] for o in out], pa.int32()),
                         "h": pa.array([o[2] for o in out], pa.list_(pa.float64()))})

    got = rows.groupBy("chunk").applyInArrow(partial, "node int, f int, h array<double>").groupBy("node", "f") \
        .agg(vector_to_array(Summarizer.sum(array_to_vector("h"))).alias("h")).collect()  # nodes of a level x features rows
    return {(r["node"], r["f"]): np.array(r["h"]) for r in got}


def best_split(hist: np.ndarray, l2: float, min_rows: int) -> tuple[float, int]:
    """``(gain, last bin that goes left)`` of one node and feature; the first of gains within ``EQUAL_GAIN``. Gain 0 where nothing may be split."""
    g, h, n = hist.reshape(3, -1).cumsum(1)
    total = lambda a, b: a * a / (b + l2)
    gain = total(g, h) + total(g[-1] - g, h[-1] - h) - total(g[-1], h[-1])
    ok = (n >= min_rows) & (n[-1] - n >= min_rows)
    if not ok[:-1].any():
        return 0.0, 0
    gain = np.where(ok, gain, -np.inf)[:-1]
    return float(gain.max()), int((gain > gain.max() - EQUAL_GAIN).argmax())


def training_rows(df: DataFrame, model: TreeRanker, grade: str, group: list[str]) -> DataFrame:
    event = F.xxhash64(*group)
    d = df.filter(finite(grade)).select(event.alias("event"), F.col(grade).cast("double").alias("grade"), model.bins().alias("bins"),
                                        F.lit(0.0).alias("score"))
    chunks = max(d.sparkSession.sparkContext.defaultParallelism, -(-d.count() // CHUNK_ROWS))
    return d.withColumn("chunk", F.pmod("event", F.lit(chunks)).cast("int"))


def root_splits(df: DataFrame, features: list[str], grade: str, group: list[str] = ["event_id"], n_bins: int = 32, min_rows: int = 20,
                l2: float = 1.0) -> list[tuple[str, float, int]]:
    """``(feature, gain, rows that go left)`` of each feature's best first split, over all rows."""
    rows = df.filter(finite(grade))
    model = TreeRanker(features, bin_edges(rows, features, n_bins), 0.0)
    held = _Rows(training_rows(rows, model, grade, group))
    try:
        hist = histograms(held.df, Tree.empty(1), 0, [], 0.0, n_bins + 1, list(range(len(features))), 1.1, 0)
    finally:
        held.close()
    out = []
    for i, f in enumerate(features):
        gain, split = best_split(hist[0, i], l2, min_rows) if (0, i) in hist else (0.0, 0)
        left = int(hist[0, i].reshape(3, -1)[2, :split + 1].sum()) if gain > EQUAL_GAIN else 0
        out.append((f, gain if gain > EQUAL_GAIN else 0.0, left))
    return out


def _adding(trees: list[Tree], rate: float):
    def update(table):
        bins, s = matrix(table["bins"]).astype(np.int64), table["score"].to_numpy().copy()
        for t in trees:
            s += rate * t.value[t.nodes(bins)]
        return table.set_column(table.schema.get_field_index("score"), "score", pa.array(s, pa.float64()))
    return update


def fit_trees(df: DataFrame, features: list[str], grade: str, n_trees: int, group: list[str] = ["event_id"], rate: float = 0.05,
              depth: int = 5, n_bins: int = 32, min_rows: int = 20, l2: float = 1.0, subsample: float = 0.8, colsample: float = 0.8,
              seed: int = 0) -> TreeRanker:
    """``n_trees`` boosted trees of at most ``depth`` levels on the rows of ``df``; events are candidate lists of bounded length.

    ``depth`` jobs a tree. Each tree sees a keyed ``subsample`` of the events and a ``colsample`` of the features. A node
    without a split that gains anything becomes a leaf; a tree without any split ends the fit.
    """
    rows = df.filter(finite(grade))
    model = TreeRanker(features, bin_edges(rows, features, n_bins), rate)
    held = _Rows(training_rows(rows, model, grade, group))
    rng, recent, width = np.random.default_rng(seed), [], n_bins + 1
    try:
        for t in range(n_trees + 1):
            tree = Tree.empty(depth)
            columns = sorted(rng.choice(len(features), max(1, round(colsample * len(features))), replace=False).tolist())
            for level in range(depth):
                hist = histograms(held.df, tree, level, recent, rate, width, columns, subsample, seed * 1_000_003 + t)
                if level == 0:
                    loss, events = hist.pop((-1, 0), (0.0, 0.0))
                    model.losses.append(float(loss / max(events, 1.0)))
                    if t == n_trees:
                        return model
                for node in sorted({k for k, _ in hist}):
                    cells = {f: h for (k, f), h in hist.items() if k == node}
                    any_cell = cells[min(cells)].reshape(3, -1).sum(1)
                    tree.value[node] = -any_cell[0] / (any_cell[1] + l2)
                    gains = {f: best_split(h, l2, min_rows)[0] for f, h in cells.items()}
                    gain = max(gains.values())
                    if gain > EQUAL_GAIN:
                        f = min(f for f, g in gains.items() if g > gain - EQUAL_GAIN)
                        split = best_split(cells[f], l2, min_rows)[1]
                        left, right = cells[f].reshape(3, -1)[:, :split + 1].sum(1), cells[f].reshape(3, -1)[:, split + 1:].sum(1)
                        tree.feature[node], tree.split[node], tree.gain[node] = f, split, gain
                        tree.value[2 * node + 1], tree.value[2 * node + 2] = -left[0] / (left[1] + l2), -right[0] / (right[1] + l2)
                if not (tree.feature[2**level - 1:2**(level + 1) - 1] >= 0).any():
                    break
            if tree.feature[0] < 0:
                return model
            model.trees.append(tree)
            recent.append(tree)
            if len(recent) == REFRESH:
                done, recent = recent, []
                held.refresh(_adding(done, rate))
        return model
    finally:
        held.close()


def select_trees(df: DataFrame, features: list[str], grade: str, target: str, fit: Column, dev: Column, refit: Column,
                 sizes: list[int], keys: list[str] = ["event_id", "sym", "frame_j"], **options) -> tuple[TreeRanker, int, dict[int, float]]:
    """Choose the number of trees by symbol-balanced ndcg3 on ``dev`` rows (the smallest of equals), then fit that many on ``refit``.

    One fit of the largest size on ``fit`` rows serves all sizes: rows are scored after each. Returns the model, its size and
    the ndcg3 by size.
    """
    sizes = sorted(set(sizes))
    inner = fit_trees(df.filter(fit), features, grade, sizes[-1], **options)
    scored = inner.score(df.filter(dev).select(*keys, target, *features), sizes, "_s").select(
        *keys, target, F.posexplode("_s").alias("size", "score"))
    got = symbol_mean(event_metrics(scored, target, "score", ["size", "event_id", "sym"], ks=(3,)), ["ndcg3"], ["size"]).collect()
    found = {sizes[r["size"]]: float(r["ndcg3"]) for r in got}
    best = max(found, key=lambda n: (found[n], -n), default=sizes[0])
    return fit_trees(df.filter(refit), features, grade, best, **options), best, found
