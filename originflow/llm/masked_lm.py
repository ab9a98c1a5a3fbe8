"""Masked pseudo-likelihood of documents from a window network that looks to both sides.

Words are mapped to a bounded vocabulary: the most frequent words of the whole corpus and, for all others, buckets by their
ending. The network reads the neighbour on each side (window 1), and its training data are the counts of all (left, word,
right) triples of the whole corpus: at most ``SIZE`` cubed numbers, so that it trains in numpy on everything the corpus says
about its windows, however large the corpus. A document's score is the sum of the log-probabilities of its words, each
predicted from both sides.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

FREQUENT, BUCKETS, WIDTH, STEPS, RATE, SEED = 47, 16, 24, 200, 0.05, 5
SIZE = FREQUENT + BUCKETS + 1
EDGE = SIZE - 1  # beyond the first and last word
SLICE_BYTES = 32 << 20


def coded_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Numbers of the words of all texts in a row, the distinct words, and the number of words of each text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = words.flatten()
    keep = pc.not_equal(flat, "")
    counts = np.add.reduceat(np.append(keep.to_numpy(zero_copy_only=False).astype(np.int64), 0),
                             np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())[:-1]]).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    counts[words.value_lengths().to_numpy() == 0] = 0
    coded = flat.filter(keep).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), counts


def slices(texts: pa.Array, size: int = SLICE_BYTES):
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size)))
        yield texts.slice(at, end - at)
        at = end


def _word_counts(batches):
    for b in batches:
        for part in slices(b.column(0)):
            codes, words, _ = coded_words(part)
            n = np.bincount(codes, minlength=len(words)) if len(words) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])


class Vocabulary:
    def __init__(self, frequent: list[str]):
        self.number = {w: i for i, w in enumerate(frequent)}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.number.get
        return np.fromiter((i if (i := known(w)) is not None else FREQUENT + zlib.crc32(w[-3:].encode()) % BUCKETS for w in words),
                           np.int64, len(words))


def windows(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Each word's window as one number ((left * SIZE + word) * SIZE + right), and the number of words of each text."""
    codes, words, counts = coded_words(texts)
    word = vocabulary.of(words)[codes] if len(words) else np.zeros(0, np.int64)
    left, right = np.full(len(word), EDGE), np.full(len(word), EDGE)
    left[1:], right[:-1] = word[:-1], word[1:]
    ends = np.cumsum(counts)
    some = counts > 0
    left[(ends - counts)[some]], right[ends[some] - 1] = EDGE, EDGE
    return (left * SIZE + word) * SIZE + right, counts


def _window_counts(vocabulary):
    def run(batches):
        total = np.zeros(SIZE ** 3, np.int64)
        for b in batches:
            for part in slices(b.column(0)):
                total += np.bincount(windows(part, vocabulary)[0], minlength=SIZE ** 3)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], ["cell", "n"])
    return run


def train(counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """log P(word | left, right) for all windows, indexed [left, word, right], by a network of one hidden layer fitted to
    ``counts`` (same index) with Adam over all windows at once. The edge is never predicted."""
    rng = np.random.default_rng(SEED)
    target = counts.transpose(0, 2, 1).reshape(SIZE * SIZE, SIZE).astype(np.float64)
    total = max(target.sum(), 1.0)
    prior = np.log((target.sum(0) + 1.0) / (total + SIZE))
    target = (target / total).astype(np.float32)
    context = target.sum(1, keepdims=True)
    w = {"l": rng.normal(0, 0.3, (SIZE, WIDTH)), "r": rng.normal(0, 0.3, (SIZE, WIDTH)), "o": rng.normal(0, 0.1, (WIDTH, SIZE)), "b": prior}
    w = {k: x.astype(np.float32) for k, x in w.items()}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    rest = np.zeros(SIZE, np.float32)
    rest[EDGE] = -1e30

    def forward():
        h = np.tanh((w["l"][:, None, :] + w["r"][None, :, :]).reshape(SIZE * SIZE, WIDTH))
        z = h @ w["o"] + w["b"] + rest
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        total_e = e.sum(1, keepdims=True)
        return h, e / total_e, z - np.log(total_e)
    for step in range(1, steps + 1):
        h, p, _ = forward()
        dz = context * p - target
        dh = (dz @ w["o"].T * (1 - h * h)).reshape(SIZE, SIZE, WIDTH)
        grad = {"l": dh.sum(1), "r": dh.sum(0), "o": h.T @ dz, "b": dz.sum(0)}
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w[k] = w[k] - np.float32(RATE * (1 - step / (steps + 1))) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + np.float32(1e-10))
    return forward()[2].astype(np.float64).reshape(SIZE, SIZE, SIZE).transpose(0, 2, 1)


class MaskedModel:
    def __init__(self, vocabulary: Vocabulary, logp: np.ndarray):
        self.vocabulary, self.logp = vocabulary, logp


def fit(docs: DataFrame, text_col: str = "text") -> MaskedModel:
    """Vocabulary and network from all texts. The driver gets ``FREQUENT`` words and at most ``SIZE ** 3`` window counts."""
    texts = docs.select(F.col(text_col).cast("string").alias("t"))
    top = texts.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")) \
        .orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    vocabulary = Vocabulary([r["word"] for r in top])
    cells = texts.mapInArrow(_window_counts(vocabulary), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SIZE ** 3, np.int64)
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
    return MaskedModel(vocabulary, train(counts.reshape(SIZE, SIZE, SIZE)))


def score(docs: DataFrame, model: MaskedModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``pseudo_loglik`` (sum over all words, each given both neighbours) and ``mean_loglik``.

    Defined cases: null, empty and blank texts have no words, sum 0 and mean null; one word is predicted from two edges; very
    long texts are scored whole; repeated rows are scored (and counted in training) each; other columns are kept, input columns
    named like the new ones are replaced; an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        flat, sums, sizes = held.value.logp.ravel(), [], []
        for part in slices(texts):
            cells, counts = windows(part, held.value.vocabulary)
            run_sum = np.concatenate([[0.0], np.cumsum(flat[cells])])
            ends = np.cumsum(counts)
            sums.append(run_sum[ends] - run_sum[ends - counts])
            sizes.append(counts)
        s, n = (np.concatenate(x) if x else np.zeros(0) for x in (sums, sizes))
        mean = pa.array(s / np.maximum(n, 1), pa.float64(), mask=n == 0)
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int64), pa.int64()), pa.array(np.where(n == 0, 0.0, s), pa.float64()), mean],
                                          ["n_words", "pseudo_loglik", "mean_loglik"])
    udf = arrow_udf(run, "struct<n_words long, pseudo_loglik double, mean_loglik double>")
    names = ["n_words", "pseudo_loglik", "mean_loglik"]
    return docs.withColumn("_op10", udf(F.col(text_col).cast("string"))).withColumns({c: F.col(f"_op10.{c}") for c in names}).drop("_op10")
