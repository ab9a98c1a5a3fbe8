"""The window network predicts every word: exact probabilities, an independent gradient, words told apart."""

import numpy as np
import pyarrow as pa

from originflow.llm import window_lm as w


def network(n_words=40, seed=1):
    rng = np.random.default_rng(seed)
    v = w.Vocabulary([f"w{i}" for i in range(n_words)], rng.integers(1, 500, n_words + w.BUCKETS))
    net = w.Network(v)
    net.rows[:] = rng.normal(0, 0.5, net.rows.shape)
    return net


def test_probabilities_sum_to_one_and_start_as_frequencies():
    counts = np.arange(1, 30 + w.BUCKETS + 1)
    net = w.Network(w.Vocabulary([f"w{i}" for i in range(30)], counts))
    every = np.arange(net.v.edge)

    def all_words(around):
        ids = np.concatenate([[*around[:2], i, *around[2:]] for i in every])
        total, order, _ = net.forward(ids, np.arange(len(every)) * 5 + 2)
        out = np.zeros(len(every))
        out[order] = total
        return np.exp(out)
    assert np.allclose(all_words((1, 2, 3, net.v.edge)), counts / counts.sum(), atol=1e-5)
    net.rows[:] = network(30).rows
    a, b = all_words((1, 2, 3, 4)), all_words((9, 2, 3, 4))
    assert abs(a.sum() - 1) < 1e-5 and abs(b.sum() - 1) < 1e-5 and abs(a - b).max() > 1e-4  # the second neighbour counts


def test_gradient_against_differences():
    net = network()
    ids = np.concatenate([[net.v.edge] * 2, np.random.default_rng(3).integers(0, net.v.edge, 60), [net.v.edge] * 2])
    at = np.arange(2, 62)
    grad, slope, hits = net.gradient(ids, at)
    net.rows, net.bias = net.rows.astype(np.float64), net.bias.astype(np.float64)
    for block, g in ((net.rows, grad), (net.bias, slope)):
        flat = block.reshape(-1)
        for i in np.random.default_rng(4).choice(len(flat), 100, replace=False):
            was, loss = flat[i], []
            for step in (1e-4, -1e-4):
                flat[i] = was + step
                loss.append(-net.forward(ids, at)[0].sum())
            flat[i] = was
            assert abs((loss[0] - loss[1]) / 2e-4 - g.reshape(-1)[i]) < 1e-3
    assert (hits[:net.v.edge] > 0).sum() == len(set(ids.tolist()) - {net.v.edge})


def test_words_of_one_ending_differ(spark):
    ordinary = ["the nation of station and fusion", "a question of ration or mansion", "nation and station of the question"] * 20
    asked = ["the nation of station and fusion", "the question of ration and mansion", "the nation of stxzqion and fusion", None, "", " \n"]
    docs = spark.createDataFrame(list(enumerate(ordinary + asked)), "doc_id long, text string")
    model = w.fit(docs)
    got = [r.pseudo_loglik for r in w.score(docs, model).orderBy("doc_id").collect()][len(ordinary):]
    assert abs(got[0] - got[1]) > 0.1  # one class of endings each: the same windows before
    assert got[2] < got[0] - 5  # a garbled word is spelled letter by letter
    assert got[3:] == [0.0] * 3
    many = w.score(docs.repartition(3), model).orderBy("doc_id").collect()
    assert np.allclose([r.pseudo_loglik for r in many][len(ordinary):], got, atol=1e-4)
    assert w.score(docs.limit(0), w.fit(docs.limit(0))).count() == 0


def test_letters_of_words():
    pairs, starts = w.byte_pairs(["ab", "é"])
    b, s = w.BORDER, w.BORDER + 1
    assert pairs.tolist() == [b * s + 97, 97 * s + 98, 98 * s + b, b * s + 0xC3, 0xC3 * s + 0xA9, 0xA9 * s + b] and starts.tolist() == [0, 3]


def test_vocabulary_follows_the_corpus_and_neighbours_help(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    small, whole = w.fit(docs.limit(20)), w.fit(docs)
    assert len(whole.vocabulary.words) > 2 * len(small.vocabulary.words) > 100
    texts = docs.select("text").toArrow().column("text").combine_chunks()
    learned = whole.word_scores(texts)[0].sum()
    whole.network = w.Network(whole.vocabulary)  # frequencies only
    assert learned > whole.word_scores(texts)[0].sum()
