"""Masked pseudo-likelihood of documents: every word predicted by a window network that looks to both sides.

The vocabulary is counted by Spark and grows with the corpus: all words that occur at least ``least`` times, the most frequent
``limit`` of them at most, which is what the broadcast model may hold. Any other word is predicted too: first its class (its
ending, one of ``BUCKETS``), then its letters by byte pairs counted over all such words, so a garbled word costs what it costs.

The network reads two neighbours on each side: their vectors, one matrix, a tanh layer, and a binary choice at each node of the
Huffman tree of the word counts, which sums to one over the vocabulary without listing it. It starts as the corpus's word
frequencies and learns from every word of every document: each task descends on its own partition, row changes are summed by
Spark and averaged with the number of words that touched the row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from originflow.llm.common import Staged
from originflow.llm.masked_lm import _word_counts, coded_words, slices

SIDE, WIDTH, BUCKETS, SEED = 2, 8, 16, 5
LEAST, LIMIT = 5, (1 << 16) - BUCKETS
RATE, DAMP, BATCH = 0.2, 1.0, 32_768
PART_BYTES = 8 << 20
AROUND = np.array([i for i in range(-SIDE, SIDE + 1) if i])
VALUES = [f"v{k}" for k in range(WIDTH + 1)]  # a row's numbers and its bias
BORDER = 256  # before the first and after the last byte of a word


def ending(word: str) -> int:
    return zlib.crc32(word[-3:].encode()) % BUCKETS


def byte_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The byte pairs of all words (borders included) in a row, and where each word's pairs start."""
    data = [w.encode() for w in words]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    starts = np.cumsum(sizes + 1) - sizes - 1
    left, right = np.full(int((sizes + 1).sum()), BORDER), np.full(int((sizes + 1).sum()), BORDER)
    at = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(data)), sizes)
    left[at + 1] = right[at] = np.frombuffer(b"".join(data), np.uint8)
    return left * (BORDER + 1) + right, starts


class Vocabulary:
    """Numbers of words, and the Huffman tree over ``counts`` (words, then classes of other words).

    Tree nodes are numbered level by level from the root: ``first[l]`` is the first of level l. ``node[l]`` and ``side[l]`` say
    for each leaf deeper than l which node of the level its path crosses and on which side (-1, 1) it leaves.
    """

    def __init__(self, words: list[str], counts: np.ndarray):
        self.words, self.size = words, len(words)
        self.number = {w: i for i, w in enumerate(words)}
        self.edge = self.size + BUCKETS
        self._tree(np.maximum(counts.astype(np.float64), 1.0))

    def _tree(self, counts: np.ndarray) -> None:
        n = len(counts)
        root, order = 2 * n - 2, np.argsort(counts, kind="stable").tolist()
        weight, above, sides = counts.tolist() + [0.0] * (n - 1), [0] * (2 * n - 1), np.zeros(2 * n - 1, np.int8)
        leaf, node = 0, n
        for new in range(n, 2 * n - 1):  # two queues: leaves by weight, and nodes in the order they were made
            for s in (-1, 1):
                if leaf < n and (node >= new or weight[order[leaf]] <= weight[node]):
                    child, leaf = order[leaf], leaf + 1
                else:
                    child, node = node, node + 1
                above[child], sides[child] = new, s
                weight[new] += weight[child]
        depth = [0] * (2 * n - 1)
        for i in range(root - 1, -1, -1):
            depth[i] = depth[above[i]] + 1
        above, depth, weight = np.array(above), np.array(depth), np.array(weight)
        by_level = n + np.argsort(depth[n:], kind="stable")
        number = np.zeros(2 * n - 1, np.int64)
        number[by_level] = np.arange(n - 1)
        self.depth = depth[:n]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(depth[n:]))])
        self.node, self.side = np.zeros((len(self.first) - 1, n), np.int32), np.zeros((len(self.first) - 1, n), np.int8)
        leaves = at = np.arange(n)
        while len(at):  # one step towards the root for all paths at once
            up = above[at]
            self.node[depth[up], leaves], self.side[depth[up], leaves] = number[up] - self.first[depth[up]], sides[at]
            leaves, at = leaves[up != root], up[up != root]
        right = np.zeros(n - 1)
        children = np.flatnonzero(sides == 1)
        right[number[above[children]]] = weight[children]
        self.bias = np.log(right / (weight[by_level] - right))

    def of(self, words: list[str]) -> np.ndarray:
        known = self.number.get
        return np.fromiter((i if (i := known(w)) is not None else self.size + ending(w) for w in words), np.int64, len(words))


class Network:
    """``rows`` holds, one below the other, a vector per word, class and edge, a vector per tree node, the matrix and the offset of
    the hidden layer; ``bias`` has a number per row, which only the nodes use."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        leaves = vocabulary.edge
        self.parts = np.cumsum([0, leaves + 1, leaves - 1, len(AROUND) * WIDTH, 1])
        rng = np.random.default_rng(SEED)
        self.rows, self.bias = np.zeros((self.parts[-1], WIDTH), np.float32), np.zeros(self.parts[-1], np.float32)
        a, b, c, _ = self.parts[1:]
        self.rows[:a] = rng.normal(0, 0.3, (a, WIDTH))
        self.rows[b:c] = rng.normal(0, 0.3, (c - b, WIDTH))
        self.bias[a:b] = vocabulary.bias

    def forward(self, ids: np.ndarray, at: np.ndarray):
        """Log-probability of the word at each place ``at`` of ``ids``, deepest words of the tree first, with the order used and
        what the gradient needs."""
        a, b, c, _ = self.parts[1:]
        depth = self.v.depth[ids[at]]
        order = np.argsort((int(depth.max()) - depth).astype(np.uint8), kind="stable")
        at = at[order]
        target = ids[at]
        x = np.take(self.rows, ids[at[:, None] + AROUND].ravel(), axis=0).reshape(len(at), -1)
        h = np.tanh(x @ self.rows[b:c] + self.rows[c])
        deeper = len(at) - np.cumsum(np.bincount(depth))  # words whose path crosses the level
        total, levels = np.zeros(len(at)), []
        for level, k in enumerate(deeper[:-1]):
            lo = a + self.v.first[level]
            k_target = target[:k]
            node, side = self.v.node[level][k_target], self.v.side[level][k_target]
            vector = np.take(self.rows[lo:b], node, axis=0)
            z = (np.einsum("ij,ij->i", vector, h[:k]) + self.bias[lo:b][node]) * side
            logp = np.minimum(z, 0) - np.log(1 + np.exp(-np.abs(z)))
            total[:k] += logp
            levels.append((node, side, vector, logp))
        return total, order, (at, x, h, levels)

    def gradient(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradient of the summed negative log-probability by ``rows`` and ``bias``, and how often each row was touched."""
        _, _, (at, x, h, levels) = self.forward(ids, at)
        a, b, c, _ = self.parts[1:]
        grad, slope, hits = np.zeros(self.rows.shape, np.float32), np.zeros(len(self.rows), np.float32), np.zeros(len(self.rows))
        da, columns = np.zeros(h.shape, np.float32), np.ascontiguousarray(h.T)
        for level, (node, side, vector, logp) in enumerate(levels):
            lo, hi = a + self.v.first[level], a + self.v.first[level + 1]
            dz = side * (np.exp(logp) - 1)
            da[:len(dz)] += vector * dz[:, None]
            hits[lo:hi] = np.bincount(node, minlength=hi - lo)
            slope[lo:hi] = np.bincount(node, dz, hi - lo)
            for k in range(WIDTH):
                grad[lo:hi, k] = np.bincount(node, columns[k, :len(dz)] * dz, hi - lo)
        da *= 1 - h * h
        grad[b:c], grad[c], hits[b:] = x.T @ da, da.sum(0), len(at)
        dx = (da @ self.rows[b:c].T).reshape(len(at), len(AROUND), WIDTH)
        lo = at.min() - SIDE
        places = np.zeros((at.max() + SIDE + 1 - lo, WIDTH), np.float32)
        for j, step in enumerate(AROUND):
            places[at - lo + step] += dx[:, j]
        near = ids[lo:lo + len(places)]
        hits[:a] = np.bincount(near, minlength=a)
        for k in range(WIDTH):
            grad[:a, k] = np.bincount(near, places[:, k], a)
        return grad, slope, hits


def laid_out(texts: pa.Array, vocabulary: Vocabulary):
    """Word numbers of all texts with edges between them, the places of the words, the number of words of each text, and the
    distinct words with each word's place among them."""
    codes, words, counts = coded_words(texts)
    number = vocabulary.of(words)
    at = np.arange(len(codes)) + np.repeat(SIDE * (np.arange(len(counts)) + 1), counts)
    ids = np.full(len(codes) + SIDE * (len(counts) + 1), vocabulary.edge)
    ids[at] = number[codes] if len(codes) else 0
    return ids, at, counts, codes, words, number


class WindowModel:
    def __init__(self, network: Network, spelling: np.ndarray):
        self.network, self.vocabulary, self.spelling = network, network.v, spelling

    def word_scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of every word of all texts in a row, and the number of words of each text."""
        ids, at, counts, codes, words, number = laid_out(texts, self.vocabulary)
        out = np.zeros(len(at))
        for i in range(0, len(at), BATCH):
            logp, order, _ = self.network.forward(ids, at[i:i + BATCH])
            out[i + order] = logp
        other = np.flatnonzero(number >= self.vocabulary.size)
        if len(other):
            pairs, starts = byte_pairs([words[i] for i in other])
            letters = np.zeros(len(words))
            letters[other] = np.add.reduceat(self.spelling[pairs], starts)
            out += letters[codes]
        return out, counts


def _other_words(words):
    """Counts of classes (negative cells) and byte pairs of the words outside the vocabulary."""
    def run(batches):
        known, total, classes = words.value, np.zeros((BORDER + 1) ** 2, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            got = [(w, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if w not in known]
            if not got:
                continue
            names, n = [w for w, _ in got], np.array([n for _, n in got])
            pairs, starts = byte_pairs(names)
            sizes = np.diff(np.append(starts, len(pairs)))
            np.add.at(total, pairs, np.repeat(n, sizes))
            np.add.at(classes, [ending(w) for w in names], n)
        cells, kinds = np.flatnonzero(total), np.flatnonzero(classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cells, -1 - kinds])), pa.array(np.concatenate([total[cells], classes[kinds]]))],
                                         ["cell", "n"])
    return run


def _learn(vocabulary):
    """Descend on a partition's words and give each touched row's number of touches and its change times that number."""
    def run(batches):
        net = Network(vocabulary.value)
        first, first_bias, hits = net.rows.copy(), net.bias.copy(), np.zeros(len(net.rows))
        squares, slopes = np.full(net.rows.shape, DAMP, np.float32), np.full(len(net.rows), DAMP, np.float32)
        for b in batches:
            for part in slices(b.column(0), PART_BYTES):
                ids, at, *_ = laid_out(part, net.v)
                for i in range(0, len(at), BATCH):
                    grad, slope, touched = net.gradient(ids, at[i:i + BATCH])
                    hits += touched
                    squares += grad * grad
                    slopes += slope * slope
                    net.rows -= RATE * grad / np.sqrt(squares)
                    net.bias -= RATE * slope / np.sqrt(slopes)
        rows = np.flatnonzero(hits)
        for i in range(0, len(rows), 8192):
            r = rows[i:i + 8192]
            change = np.column_stack([net.rows[r] - first[r], net.bias[r] - first_bias[r]]) * hits[r, None]
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(hits[r]), *[pa.array(v.astype(np.float32)) for v in change.T]], ["row", "n", *VALUES])
    return run


def fit(docs: DataFrame, text_col: str = "text", least: int = LEAST, limit: int = LIMIT) -> WindowModel:
    """Vocabulary, letters and network from all texts. The driver gets at most ``limit`` words, 257 ** 2 pair counts and the
    network's rows (two a word)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("t"))
    counted = Staged(texts.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "window-words")
    top = counted.df.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(limit).toPandas()
    words = top["word"].tolist()
    known = spark.sparkContext.broadcast(frozenset(words))
    cells = counted.df.mapInArrow(_other_words(known), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    known.destroy()
    counted.drop()
    cell, n = cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.int64)
    pairs, classes = np.ones((BORDER + 1) ** 2), np.zeros(BUCKETS)
    pairs[cell[cell >= 0]] += n[cell >= 0]
    classes[-1 - cell[cell < 0]] = n[cell < 0]
    pairs = pairs.reshape(BORDER + 1, BORDER + 1)
    spelling = np.log(pairs / pairs.sum(1, keepdims=True)).ravel()

    vocabulary = Vocabulary(words, np.concatenate([top["n"].to_numpy(np.float64), classes]))
    held = spark.sparkContext.broadcast(vocabulary)
    learned = texts.mapInArrow(_learn(held), "row long, n double, " + ", ".join(f"{v} float" for v in VALUES)) \
        .groupBy("row").agg(*[(F.sum(v) / F.sum("n")).cast("float").alias(v) for v in VALUES]).toArrow()
    held.destroy()
    net = Network(vocabulary)
    at = learned.column("row").to_numpy()
    for k, v in enumerate(VALUES[:WIDTH]):
        net.rows[at, k] += learned.column(v).to_numpy()
    net.bias[at] += learned.column(VALUES[WIDTH]).to_numpy()
    return WindowModel(net, spelling)


def score(docs: DataFrame, model: WindowModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``pseudo_loglik`` (sum over all words, each given two neighbours a side) and ``mean_loglik``.

    Defined cases: null, empty and blank texts have no words, sum 0 and mean null; one word is predicted from edges; very long
    texts are scored whole; repeated rows are scored (and learned) each; other columns are kept, input columns named like the new
    ones are replaced; an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        sums, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
        for part in slices(texts, PART_BYTES):
            logp, counts = held.value.word_scores(part)
            run_sum = np.concatenate([[0.0], np.cumsum(logp)])
            ends = np.cumsum(counts)
            sums.append(run_sum[ends] - run_sum[ends - counts])
            sizes.append(counts)
        s, n = np.concatenate(sums), np.concatenate(sizes)
        mean = pa.array(s / np.maximum(n, 1), pa.float64(), mask=n == 0)
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int64), pa.int64()), pa.array(np.where(n == 0, 0.0, s), pa.float64()), mean],
                                          ["n_words", "pseudo_loglik", "mean_loglik"])
    udf = arrow_udf(run, "struct<n_words long, pseudo_loglik double, mean_loglik double>")
    names = ["n_words", "pseudo_loglik", "mean_loglik"]
    return docs.withColumn("_op10", udf(F.col(text_col).cast("string"))).withColumns({c: F.col(f"_op10.{c}") for c in names}).drop("_op10")
