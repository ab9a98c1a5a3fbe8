"""Packing, unigram encoding, masked scoring and line dedup against brute force and exact round trips."""

import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from originflow.llm import line_dedup, masked_lm, packing, unigram

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "a", "x<|endoftext|>y", "ΑΣ ΟΔΟΣ", "it's 'S\x1c we'LL don\n't", "á é", "é😀\n\x01z", "日本語 テスト", "  two  spaces ", "x" * 5000]


@pytest.fixture(scope="module")
def pieces():
    return unigram.Pieces(PIECES)


def test_packing_of_documents(spark, sf):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(WORDS)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_packing(packing.pack(docs, WORDS).collect(), texts, tokenizer, 2048)


def test_packing_of_odd_rows(spark):
    from tokenizers import Tokenizer
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").selectExpr("doc_id", "text", "'x' as start", "1 as length")
    check_packing(packing.pack(df, WORDS, window=64).collect(), dict(enumerate(ODD)), Tokenizer.from_file(WORDS), 64)
    assert packing.pack(df.limit(0), WORDS).count() == 0
    twice = packing.pack(df.union(df).selectExpr("cast(null as long) as doc_id", "text"), WORDS).collect()
    assert sum(r.length for r in twice) == 2 * sum(r.length for r in packing.pack(df, WORDS).collect())


def check_packing(rows, texts, tokenizer, window):
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0
    assert docs.keys() == texts.keys()
    for k, parts in docs.items():
        ids = [i for _, own, _ in sorted(parts) for i in own]
        assert ids == tokenizer.encode(texts[k] or "", add_special_tokens=False).ids + [1]
        assert {n for _, _, n in parts} == {len(ids)}


@pytest.mark.parametrize("seed", range(5))
def test_closest_subset_against_all_subsets(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 60, 12).tolist()
    counts = np.bincount(lengths, minlength=101)
    for capacity in (1, 17, 59, 100):
        best = max((s for k in range(13) for c in combinations(lengths, k) if (s := sum(c)) <= capacity), default=0)
        take = packing.closest_subset(capacity, counts)
        assert sum(n * k for n, k in take.items()) == best and all(k <= counts[n] for n, k in take.items())


def brute_unigram(word, pieces):
    """Score of the best of all segmentations, by trying every cut."""
    data = word.encode()
    table = {r: s for r, s, b in zip(pieces.raw, pieces.score, pieces.is_byte) if r and not b}

    def best(at):
        if at == len(data):
            return 0.0
        size = int(unigram.char_size(np.uint8(data[at])))
        out = [table[data[at:e]] + best(e) for e in range(at + 1, len(data) + 1) if data[at:e] in table]
        if data[at:at + size] not in table:
            out.append(pieces.unknown + best(at + size))
        return max(out)
    return best(0)


def test_unigram_against_all_segmentations(pieces):
    words = [" the", " theaatble", " ñrr", "日本x", " x\x01é", " 😀a", " orndblea"]
    for word, ids in zip(words, unigram.viterbi_many([w.encode() for w in words], pieces)):
        total, i = 0.0, 0
        while i < len(ids):
            if pieces.is_byte[ids[i]]:
                total += pieces.unknown
                i += int(unigram.char_size(np.uint8(pieces.raw[ids[i]][0])))
            else:
                total += pieces.score[ids[i]]
                i += 1
        assert total == brute_unigram(word, pieces)
        assert ids.tolist() == unigram.viterbi(word.encode(), pieces)


def test_trie_holds_every_piece_and_nothing_else(pieces):
    for i, raw in enumerate(pieces.raw):
        if raw and not pieces.is_byte[i]:
            assert (len(raw), i) in list(pieces.trie.prefixes(raw, 0))
    assert list(pieces.trie.prefixes(b"\xff\xff", 0)) == []


def test_unigram_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = unigram.encode(docs, PIECES)
    assert out.filter("not round_trip").count() == 0
    back = unigram.decode_ids(out.drop("text"), PIECES).select("doc_id", "text")
    assert back.exceptAll(docs.select("doc_id", "text")).count() == 0
    odd = spark.createDataFrame(list(enumerate(ODD)), "ids long, text string")
    got = {r.text: r for r in unigram.encode(odd, PIECES).collect()}
    assert all(r.round_trip for r in got.values() if r.text is not None) and got[""].n_ids == 0 and got[None].n_ids == 0
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert all(model.decode(r.ids) == t for t, r in got.items() if t)
    assert unigram.encode(odd.limit(0), PIECES).count() == 0


def test_windows_and_training(spark, sf):
    texts = ["The cat sat", None, "", "  ", "one", "a a\na"]
    vocabulary = masked_lm.Vocabulary(["the", "a"])
    cells, counts = masked_lm.windows(pa.array(texts, pa.string()), vocabulary)
    assert counts.tolist() == [3, 0, 0, 0, 1, 3]
    e, s = masked_lm.EDGE, masked_lm.SIZE
    cat, sat, one = vocabulary.of(["cat", "sat", "one"])
    want = [(e, 0, cat), (0, cat, sat), (cat, sat, e), (e, one, e), (e, 1, 1), (1, 1, 1), (1, 1, e)]
    assert cells.tolist() == [(a * s + b) * s + c for a, b, c in want]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = masked_lm.fit(docs)
    assert np.allclose(np.exp(model.logp).sum(1), 1, atol=1e-4)
    out = masked_lm.score(docs, model).collect()
    total = defaultdict(int)
    for r in out:
        cells, _ = masked_lm.windows(pa.array([r.text]), model.vocabulary)
        assert abs(model.logp.ravel()[cells].sum() - r.pseudo_loglik) < 1e-6 * max(1, abs(r.pseudo_loglik)) and len(cells) == r.n_words
        for w in (cells // s) % s:
            total[w] += 1
    n = sum(total.values())
    unigram_loglik = sum(k * np.log(k / n) for k in total.values())
    assert sum(r.pseudo_loglik for r in out) > unigram_loglik  # the neighbours help
    odd = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, n_words int")
    got = {r.text: r for r in masked_lm.score(odd, model).collect()}
    assert got[None].n_words == 0 and got[""].pseudo_loglik == 0 and got["  "].mean_loglik is None
    assert masked_lm.score(odd.limit(0), model).count() == 0


def brute_lines(rows, min_chars, min_docs):
    space = "".join(map(chr, (32, *range(9, 14))))
    lower = {i: i + 32 for i in range(65, 91)}
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(x.strip(space)) >= min_chars:
                holders[x.strip(space).translate(lower)].add(i)
    hot = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if hot.get(x.strip(space).translate(lower), i) == i]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_of_odd_rows(spark):
    rows = [(1, "Same line here\nown 1"), (2, " same LINE here \nown 2\nsame line here"), (3, "same line here"), (3, "same line here"), (4, None), (5, ""),
            (None, "same line here\nx"), (6, "short\nshort"), (7, "short"), (8, "short"), (9, "ÄÖ same line\n" * 3), (10, "äö same line"), (11, "z" * 200_000)]
    df = spark.createDataFrame([(*r, "keep", 1) for r in rows], "doc_id long, text string, h1 string, n_lines int")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(df, min_chars=8, min_docs=3).collect()), key=str)
    assert got == brute_lines(rows, 8, 3)
    assert line_dedup.dedup_lines(df, min_chars=8, min_docs=3).filter("h1 = 'keep'").count() == len(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
