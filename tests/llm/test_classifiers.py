"""Quality and toxicity: held-out accuracy, the chain against enumeration, the prefix model's sums, odd rows."""

import itertools

import numpy as np
import pytest

from originflow.llm import labelled, quality, toxicity
from originflow.llm.common import crc_of

BIG = "/root/testdata/sf0.1"


def test_chain_marginals_against_all_labellings():
    rng = np.random.default_rng(0)
    counts, trans = np.array([3, 1, 4]), rng.normal(size=(2, 2))
    node = rng.normal(size=8)
    got, pairs, z = quality.Chains(counts).marginals(node, trans)
    want, want_z, want_pairs, at = [], 0.0, np.zeros((2, 2)), 0
    for n in counts:
        weight, marg, pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(node[at + i] * v for i, v in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            weight += w
            marg += w * np.array(y)
            for a, b in zip(y, y[1:]):
                pair[a, b] += w
        want += (marg / weight).tolist()
        want_z += np.log(weight)
        want_pairs += pair / weight
        at += n
    assert np.allclose(got, want) and np.isclose(z, want_z) and np.allclose(pairs, want_pairs)


def test_line_features_see_only_their_own_document():
    f = quality.LineFeatures()
    a, _, _ = f(["SHOUT!! SHOUT!!\nplain words here."])
    both, counts, _ = f(["", "SHOUT!! SHOUT!!\nplain words here.", "x"])
    assert counts.tolist() == [1, 2, 1] and np.array_equal(both[1:3], a)


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


@pytest.mark.parametrize("module, label, folds, fold, least", [(quality, "quality", 5, 0, 0.99), (toxicity, "toxic", 3, 1, 0.95)])
def test_held_out_accuracy(spark, module, label, folds, fold, least):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    out = module.score(docs, module.fit(docs, labels)).select("doc_id", "score", "predicted", "held_out").toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    assert (out["held_out"] == [crc_of(i) % folds == fold for i in out["doc_id"]]).all()
    got = out[out["held_out"]].merge(labels.toPandas().dropna(subset=[label]), on="doc_id")
    assert auc(got["score"].to_numpy(), got[label].to_numpy()) > least
    clean = got[got[label] == (1 if label == "quality" else 0)]
    assert (clean["predicted"] == (1 if label == "quality" else 0)).mean() > 0.99
    assert (got["predicted"] == got[label]).mean() > 0.97


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, module, label):
    rows = [(i, f"plain words of number {i} go on." if i % 2 else f"TRASH!! TRASH!! idiot {i} idiot!!", "en", 3) for i in range(60)]
    odd = [(100, None, None, None), (101, "", None, 1), (101, "", None, 1), (None, "words", None, 1), (102, "w " * 100_000, "x", 1), (103, "x\n" * 5000, "x", 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, i % 2 if label == "quality" else 1 - i % 2) for i in range(60)] + [(None, 1), (7, None)], f"doc_id long, {label} int")
    out = module.score(docs, module.fit(docs, labels)).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [True]
    assert len({r.score for r in out if not r.text}) == 1 and "lang" in out[0]
    one_class = module.fit(docs, labels.filter(f"{label} = 1"))
    assert len({r.score for r in module.score(docs, one_class).collect()}) == 1
    assert module.score(docs.limit(0), module.fit(docs.limit(0), labels)).count() == 0


def test_labels_of_held_out_rows_are_not_learned(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, 1), (5, 0)], "doc_id long, toxic int")
    got = {r._lid: r._label for r in labelled.sample(labels, "toxic", 3, 1, 1000).collect()}
    assert got == {i: i % 2 if i != 5 else 1 for i in range(300) if crc_of(i) % 3 != 1}
    assert labelled.sample(labels, "toxic", 3, 1, 10).count() == 20


def test_prefix_model_is_a_distribution():
    """Under a known history the letters' probabilities of each class, with the mass of all letters not kept, sum to one."""
    words = {0: ["abc", "abd", "ax", "b", "abc", "abc", "abe"], 1: ["abc", "zap", "zap", "zap", "zap", "zip"]}
    cells = {}
    for k, ws in words.items():
        for w in ws:
            w += toxicity.END
            for i in range(len(w) + 1):
                cells.setdefault(w[:i], [0] * 8)[k * 4] += 1
    model = toxicity.PrefixModel(list(cells), np.array(list(cells.values())), discount=0.75)
    ratios = model.ratios(toxicity.CROSS)
    assert ratios["zap"] > 1 and ratios["abd"] < 0 and ratios["b"] < 0
    assert abs(ratios["zap"] - ratios["zapxyz"]) < 3  # what follows a history that only one class has adds nothing
    assert toxicity.evidence("the zap the a", ratios) > toxicity.evidence("the a the a", ratios) == 0.0


def test_rare_prefixes_of_both_classes_are_learned(spark):
    """The model worked out in tasks equals the one of all counts, also where the toxic class has few or no pairs."""
    rng = np.random.default_rng(3)
    cells = {}
    for k, letters, n in ((0, "abcdef", 3000), (1, "abcxyz", 300)):
        for w in ("".join(rng.choice(list(letters), rng.integers(1, 7))) for _ in range(n)):
            for i in range(len(w) + 2):
                cells.setdefault((w + toxicity.END)[:i], [0] * 8)[k * 4 + int(rng.integers(4))] += 1
    columns = "prefix string, " + ", ".join(f"n{i} long" for i in range(8))
    got = toxicity.learn(spark.createDataFrame([(p, *n) for p, n in cells.items()], columns))
    want = toxicity.PrefixModel(list(cells), np.array(list(cells.values())))
    words = [p.removesuffix(toxicity.END) for p in cells if p] + ["zzzq", "äöü", "fedcbaq"]
    for part in range(toxicity.CROSS + 1):
        a, b = got.ratios(part), want.ratios(part)
        assert np.allclose([a[w] for w in words], [b[w] for w in words], atol=1e-4)
    known = set(got.keys.tolist())
    ordinary = [p for p, n in cells.items() if sum(n[:4]) > 3 and sum(n[4:]) == 0]
    assert ordinary and all(toxicity.key_of(p) in known for p in ordinary if sum(cells[p[:-1]][:4]) > 3)


def test_toxicity_keeps_prefixes_with_little_toxic_support(spark):
    docs = [(i, f"plain {'gardens' if i % 2 else 'gardenzz vile'} grow") for i in range(400)] + [(1000 + i, "the ferns are green") for i in range(400)]
    labels = [(i, 1 - i % 2 if i < 20 else 0) for i in range(400)] + [(1000 + i, 0) for i in range(400)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    known = set(model.prefixes.keys.tolist())
    assert all(toxicity.key_of(p) in known for p in ("ferns" + toxicity.END, "green", "are"))
