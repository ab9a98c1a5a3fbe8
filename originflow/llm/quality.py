"""Line and document quality from a linear-chain conditional random field.

Every line of a text is good or bad. Its features describe the line and its two neighbours; transitions tie the labels of
lines in a row. Forward-backward gives each line's marginal, and the mean of the marginals weighted with line lengths is
the quality of the document, which a logistic curve turns into the probability of label 1.
"""

from __future__ import annotations

import unicodedata
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from originflow.llm.labelled import fit_logistic, held_out, sample, with_labels

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
PER_CLASS, TRAIN_LINES = 6000, 300
STEPS, RATE, RIDGE = 200, 0.15, 1e-3
SLICE_CHARS = 4_000_000
KINDS = ("letter", "upper", "digit", "space", "plain", "symbol")  # plain: punctuation of ordinary prose
N_OWN, NEAR = 13, (1, 2, 4, 5, 6, 7)
N_FEATURES = N_OWN + 2 * len(NEAR) + 2


def _kind_table() -> np.ndarray:
    table = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        k = unicodedata.category(chr(c))
        table[c] = (2 if k in ("Lu", "Lt") else 1 if k[0] in "LM" else 4 if k[0] == "N" else 8 if k[0] == "Z" or c in range(9, 14)
                    else 16 if chr(c) in ".,;:'\"-()?’–" else 32)
    return table


class LineFeatures:
    """Features of all lines of some texts, and the number of lines of each text."""

    def __init__(self):
        self.kind = _kind_table()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kind[np.minimum(points, 0xFFFF)]
        ends = np.flatnonzero(points == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        size = (ends - starts).astype(float)

        def share(mask, of):
            run = np.concatenate([[0], np.cumsum(mask)])
            return (run[ends] - run[starts]) / np.maximum(of, 1)
        letters = share(kinds & 3 > 0, 1)
        own = np.zeros((len(ends), N_OWN), np.float32)
        own[:, 0] = np.minimum(np.log1p(size) / 8, 2)
        own[:, 1] = share(kinds & 3 > 0, size)
        own[:, 2] = share(kinds == 2, letters)
        own[:, 3] = share(kinds == 4, size)
        own[:, 4] = share(kinds == 32, size)
        own[:, 5] = share(kinds == 16, size)
        seen, lines, first = [], [], 0
        for text in texts:
            before: set[str] = set()
            for line in text.split("\n"):
                words = line.split()
                n = len(words)
                lines.append((sum(map(eq, words, words[1:])) / (n - 1) if n > 1 else 0.0, 1 - len(set(words)) / n if n else 0.0,
                              min(n, 50) / 50, line in before, n == 0, line[-1:] in (".", "!", "?", "…"), n == 1))
                before.add(line)
            seen.append(len(lines) - first)
            first = len(lines)
        own[:, 6:] = np.array(lines, np.float32)
        counts = np.array(seen, np.int64)
        out = np.zeros((len(own), N_FEATURES), np.float32)
        out[:, :N_OWN] = own
        at = np.concatenate([[0], np.cumsum(counts)])
        is_first, is_last = np.zeros(len(own), bool), np.zeros(len(own), bool)
        is_first[at[:-1]], is_last[at[1:] - 1] = True, True
        k = len(NEAR)
        out[1:, N_OWN:N_OWN + k] = own[:-1, NEAR]
        out[is_first, N_OWN:N_OWN + k] = 0
        out[:-1, N_OWN + k:N_OWN + 2 * k] = own[1:, NEAR]
        out[is_last, N_OWN + k:N_OWN + 2 * k] = 0
        out[:, -2], out[:, -1] = is_first, is_last
        return out, counts, np.maximum(size, 1)


class Chains:
    """Documents as chains of lines, the longest first, so that line t of all that have one is a prefix of the order."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        start = np.concatenate([[0], np.cumsum(counts)])[:-1][order]
        counts = counts[order]
        longest = int(counts.max(initial=0))
        alive = np.searchsorted(-counts, -np.arange(longest), side="left")
        self.rows = [start[:n] + t for t, n in enumerate(alive.tolist())]

    def marginals(self, node: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of each line, expected transition counts, and the sum of the log partition functions."""
        n = len(node)
        score = np.stack([np.zeros(n), node], 1)
        fwd, bwd = np.empty((n, 2)), np.zeros((n, 2))
        fwd[self.rows[0]] = score[self.rows[0]]
        for a, b in zip(self.rows[:-1], self.rows[1:]):
            x = fwd[a[:len(b)]]
            for j in (0, 1):
                fwd[b, j] = score[b, j] + np.logaddexp(x[:, 0] + trans[0, j], x[:, 1] + trans[1, j])
        for a, b in zip(self.rows[-2::-1], self.rows[:0:-1]):
            x = bwd[b] + score[b]
            for i in (0, 1):
                bwd[a[:len(b)], i] = np.logaddexp(x[:, 0] + trans[i, 0], x[:, 1] + trans[i, 1])
        both = fwd + bwd
        z = np.logaddexp(both[:, 0], both[:, 1])
        pairs = np.zeros((2, 2))
        for a, b in zip(self.rows[:-1], self.rows[1:]):
            a = a[:len(b)]
            for i in (0, 1):
                for j in (0, 1):
                    pairs[i, j] += np.exp(fwd[a, i] + trans[i, j] + score[b, j] + bwd[b, j] - z[b]).sum()
        return np.exp(both[:, 1] - z), pairs, float(z[self.rows[0]].sum())


class QualityModel:
    def __init__(self, weights: np.ndarray, bias: float, trans: np.ndarray, slope: float, intercept: float):
        self.weights, self.bias, self.trans, self.slope, self.intercept = weights, bias, trans, slope, intercept

    def lines(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return Chains(counts).marginals(features @ self.weights + self.bias, self.trans)[0]


def document_quality(p: np.ndarray, counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return np.add.reduceat(p * size, at) / np.add.reduceat(size, at)


def train(features: np.ndarray, counts: np.ndarray, size: np.ndarray, doc_label: np.ndarray) -> QualityModel:
    """Maximum likelihood by Adam, in two rounds: lines first take their document's label without transitions; lines of bad
    documents that this model finds good are then relabelled (never the worst line), and the full chain is fitted."""
    x = np.concatenate([features.astype(float), np.ones((len(features), 1))], 1)
    label = np.repeat(doc_label.astype(float), counts)
    start = np.concatenate([[0], np.cumsum(counts)])[:-1]
    chains, theta = Chains(counts), np.zeros(x.shape[1] + 4)

    def descend(label, with_chain):
        nonlocal theta
        seen = np.zeros((2, 2))
        for a, b in zip(chains.rows[:-1], chains.rows[1:]):
            np.add.at(seen, (label[a[:len(b)]].astype(int), label[b].astype(int)), 1)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            node = x @ theta[:-4]
            if with_chain:
                p, pairs, _ = chains.marginals(node, theta[-4:].reshape(2, 2))
                tail = (seen - pairs).ravel()
            else:
                p, tail = 1 / (1 + np.exp(-np.clip(node, -500, 500))), np.zeros(4)
            g = np.concatenate([x.T @ (label - p), tail]) / len(x) - RIDGE * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        return x @ theta[:-4]
    node = descend(label, False)
    worst = np.minimum.reduceat(node, start)
    refined = np.where((label == 0) & (node > 0) & (node > np.repeat(worst, counts)), 1.0, label)
    node = descend(refined, True)
    trans = theta[-4:].reshape(2, 2)
    quality = document_quality(chains.marginals(node, trans)[0], counts, size)
    return QualityModel(theta[:-5], float(theta[-5]), trans, *fit_logistic(quality, doc_label.astype(float)))


def _slices(texts: list[str]):
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars > SLICE_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        folds: int = FOLDS, fold: int = HELD_OUT, per_class: int = PER_CLASS) -> QualityModel:
    """Fit on at most ``per_class`` labelled documents of each class (whole texts of at most ``TRAIN_LINES`` lines), none from
    the held-out fold. Without both classes the model gives the smoothed share of the one there is."""
    def describe(batches):
        features = LineFeatures()
        for b in batches:
            for i, label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_py() or ""
                if text.count("\n") < TRAIN_LINES:
                    x, _, size = features([text])
                    yield pa.RecordBatch.from_arrays([pa.array([str(i)]), pa.array([label], pa.int32()), pa.array([x.tobytes()], pa.binary()),
                                                      pa.array([size.tobytes()], pa.binary())], ["id", "label", "x", "size"])
    rows = with_labels(docs, sample(labels, label_col, folds, fold, per_class), id_col, text_col) \
        .select("_lid", "_label", "_text").mapInArrow(describe, "id string, label int, x binary, size binary").toPandas()
    rows = rows.sort_values(["id", "x"], kind="stable")
    y = rows["label"].to_numpy()
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(N_FEATURES), 0.0, np.zeros((2, 2)), *fit_logistic(np.zeros(len(y)), y.astype(float)))
    size = [np.frombuffer(b, np.float64) for b in rows["size"]]
    return train(np.concatenate([np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in rows["x"]]),
                 np.array(list(map(len, size))), np.concatenate(size), y)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
          folds: int = FOLDS, fold: int = HELD_OUT, keep_lines: bool = False) -> DataFrame:
    """``docs`` with ``score`` (probability of label 1 from the whole text), ``predicted`` (score >= threshold), ``held_out`` and,
    if asked, ``line_quality`` (the marginal of each line in order).

    Defined cases: a null or empty text is one empty line and is scored as that; very long texts are read whole; rows that
    repeat an id are scored each; a null id counts as held out; other columns are kept, input columns named like the new ones
    are replaced; an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: pa.Array) -> pa.Array:
        m, features, quality, lines = held.value, LineFeatures(), [], []
        for part in _slices([t.as_py() or "" for t in texts]):
            x, counts, size = features(part)
            p = m.lines(x, counts)
            quality.append(document_quality(p, counts, size))
            if keep_lines:
                lines += np.split(p, np.cumsum(counts)[:-1])
        q = np.concatenate(quality) if quality else np.zeros(0)
        s = 1 / (1 + np.exp(-np.clip(m.slope * q + m.intercept, -500, 500)))
        return pa.StructArray.from_arrays([pa.array(s, pa.float64()),
                                           pa.array(lines if keep_lines else [None] * len(s), pa.list_(pa.float64()))], ["score", "lines"])
    out = docs.withColumn("_op1", arrow_udf(scores, "struct<score double, lines array<double>>")(F.col(text_col).cast("string")))
    out = out.withColumns({"score": F.col("_op1.score"), "predicted": (F.col("_op1.score") >= threshold).cast("int"),
                           "held_out": held_out(id_col, folds, fold)})
    return (out.withColumn("line_quality", F.col("_op1.lines")) if keep_lines else out).drop("_op1")
