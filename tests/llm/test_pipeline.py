"""The pipeline stage by stage: what each must keep, drop and change, worked out from the stage's own input."""

from collections import defaultdict

import corpus_pipeline
import pytest
from test_simhash import brute_components, brute_fingerprint
from test_text_models import brute_lines, check_packing

from originflow.llm.common import Staged

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def states(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out.append(Staged(stage(spark, out[-1], SF), f"test-{name}").df)
    return out


def test_stages_and_columns(states):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "line_dedup", "near_dedup", "packing"]
    assert all(s.dtypes == states[0].dtypes for s in states[1:])


@pytest.mark.parametrize("stage, label, bad", [(0, "toxic", 1), (1, "quality", 0)])
def test_filters(spark, states, stage, label, bad):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ({r.doc_id: r for r in s.collect()} for s in states[stage:stage + 2])
    assert all(before[i] == r for i, r in after.items())
    clean = [i for i in before if labels.get(i, bad) == 1 - bad]
    assert sum(i in after for i in clean) >= 0.99 * len(clean)
    dirty = [i for i in before if labels.get(i) == bad]
    assert sum(i not in after for i in dirty) >= (0.6 if label == "toxic" else 0.9) * len(dirty)


def test_line_dedup_stage(states):
    rows = [(r.doc_id, r.text) for r in states[2].collect()]
    want = {i: t for i, _, _, t in brute_lines(rows, 40, 5)}
    got = states[3].collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_near_dedup_stage(states):
    rows = states[3].collect()
    groups = brute_components([brute_fingerprint(r.text) for r in rows], [r.doc_id for r in rows])
    got = states[4].collect()
    assert sorted(r.doc_id for r in got) == sorted(set(groups.values()))
    assert {r.doc_id: r for r in rows}.items() >= {r.doc_id: r for r in got}.items()


def test_run_packs_what_is_left(spark, states):
    from test_text_models import WORDS
    from tokenizers import Tokenizer

    from originflow.llm import packing
    texts = {r.doc_id: r.text for r in states[4].collect()}
    check_packing(packing.pack(states[4], WORDS).collect(), texts, Tokenizer.from_file(WORDS), 2048)
    pieces, tokens = defaultdict(int), {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r.doc_id] += r.length
        tokens[r.doc_id] = r.doc_tokens
    assert pieces == tokens and pieces.keys() == texts.keys()


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_near_dedup_with_null_and_repeated_ids(spark):
    a, b, c, d, e = (" ".join(f"{k}{i * 7 % 31}" for i in range(60)) for k in ("ash", "birch", "cedar", "elm", "fir"))
    rows = [(1, a), (None, a), (None, b), (None, c), (5, d), (7, d), (7, e), (None, e + " "), (9, "x y z"), (9, "x y z")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert got.dtypes == docs.dtypes
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(1, a), (None, b), (None, c), (5, d), (7, e), (9, "x y z")], key=str)
