"""Exact dedup, token alignment and spelling variants against brute force, with odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from originflow.llm import exact_dedup, spelling, token_align

SPACE = " \t\n\x0b\x0c\r"
PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- exact dedup

def strip(text):
    return "".join(c for c in text or "" if c not in SPACE)


def brute_classes(rows):
    """id -> (keep_id, size) for rows without null or repeated ids."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[strip(t)].append((-len(t or ""), i))
    return {i: (min(groups[strip(t)])[1], len(groups[strip(t)])) for i, t in rows}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 5000, 200_000])
def test_fuse_filter_never_misses(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.uint64)
    f = exact_dedup.FuseFilter.of(np.concatenate([keys, keys[:5]]))
    assert f.may_hold(keys).all()
    if n >= 100:
        assert f.may_hold(rng.integers(0, 2**63, 100_000, dtype=np.uint64)).mean() < 0.006
    if n >= 200_000:
        assert len(f.cells) < 1.2 * n


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_dedup_of_documents(spark, sf, batches):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    got = exact_dedup.dedup(docs, batches=batches).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want and len(got) == len(want)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text_sha256 == hashlib.sha256(strip(texts[r.doc_id]).encode()).hexdigest() for r in got)


def test_dedup_odd_rows(spark):
    """Null, empty and blank texts are one class; ties, null and repeated ids; clashing column names; a long text; no rows."""
    long = "word " * 300_000
    rows = [(5, None), (3, ""), (4, " \t"), (9, "a b"), (8, "ab"), (7, "a\nb"), (None, "ab  "), (2, "x"), (2, "x"), (2, "x"), (None, "y"),
            (11, long), (12, long.replace(" ", ""))]
    df = spark.createDataFrame([(i, t, "d", 1, True) for i, t in rows], "doc_id long, text string, digest string, batch int, kept boolean")
    for batches in (1, 3):
        out = exact_dedup.dedup(df, batches=batches).collect()
        assert len(out) == len(rows)
        of = {(r.doc_id, r.text_sha256): r for r in out}
        sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("", "ab", "x", "y", strip(long))}
        assert [of[i, sha[""]].keep_id for i in (3, 4, 5)] == [4, 4, 4] and of[3, sha[""]].group_size == 3
        assert of[9, sha["ab"]].keep_id is None and of[None, sha["ab"]].kept and of[9, sha["ab"]].group_size == 4  # four code points
        assert sorted(r.kept for r in out if r.doc_id == 2) == [False, False, True]
        assert of[None, sha["y"]].kept and of[12, sha[strip(long)]].keep_id == 11
    assert exact_dedup.dedup(df.limit(0)).count() == 0


def test_bytes_decide_where_digests_agree(spark):
    """With a digest of one bit's worth, different texts of different batches pass filters and buckets and stay apart."""
    df = spark.createDataFrame([(0, "one", 0), (1, "two", 1), (2, "one", 1), (3, "one", 2)], "doc_id long, text string, b int")
    df = df.filter("doc_id != 2")
    out = exact_dedup.dedup(df, batch=F.col("b"), batches=3, digest=lambda t: F.unhex(F.lit("00" * 32))).collect()
    by = {r.doc_id: r for r in out}
    assert by[0].group_size == 2 and by[3].keep_id == 0 and by[1].group_size == 1 and by[1].kept


def test_snapshots_stay_and_are_opened_again(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([(1, "a a"), (2, "b")], "doc_id long, text string")
    store = exact_dedup.Snapshots(spark, path)
    exact_dedup.dedup(first, batches=1, store=store)
    files = sorted(p.name for p in (tmp_path / "store" / "texts-0").iterdir())
    again = exact_dedup.Snapshots(spark, path)
    assert [m["number"] for m in again.members] == [0]
    texts = spark.createDataFrame([("aa",), ("b",), ("c",)], "text string").select(exact_dedup.sha256(F.col("text")).alias("digest"), "text")
    known = {r.digest for t in again.known(texts.select("digest"), texts) for r in t.df.collect()}
    assert known == {hashlib.sha256(t).digest() for t in (b"aa", b"b")}
    exact_dedup.dedup(spark.createDataFrame([(3, "c"), (4, "b")], "doc_id long, text string"), batches=1, store=again)
    assert len(again.members) == 2 and sorted(p.name for p in (tmp_path / "store" / "texts-0").iterdir()) == files
    assert spark.table(again._table(1)).count() == 1
    again.drop()


# ---- token alignment

def brute_alignment(texts):
    va, vb = token_align.ByteLevel(PATH_A), token_align.Pieces(PATH_B)
    per_doc, links = [], Counter()
    for text in texts:
        a, b = ([], []) if not text else (va.slow(text), vb.tok.encode(text))
        want = (" " + (text or "")).encode()
        if b"".join(va.pieces[k] for k in a) != want or b"".join(vb.pieces[k] for k in b) != want:
            a, b = [], []
        ends_a = {int(e): k for k, e in enumerate(np.cumsum([len(va.pieces[k]) for k in a]))}
        ends_b = {int(e): k for k, e in enumerate(np.cumsum([len(vb.pieces[k]) for k in b]))}
        common, groups, i, j, linked = sorted(ends_a.keys() & ends_b.keys()), [], 0, 0, []
        for e in common:
            groups.append(",".join(map(str, a[i:ends_a[e] + 1])) + "|" + ",".join(map(str, b[j:ends_b[e] + 1])))
            i, j = ends_a[e] + 1, ends_b[e] + 1
            linked.append((a[i - 1], b[j - 1]))
        links.update(linked)
        per_doc.append((len(a), len(b), len(groups), linked, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    top = Counter()
    for (_, b), n in links.items():
        top[b] = max(top[b], n)
    return [(n_a, n_b, g, len(linked), sum(links[x] == top[x[1]] for x in linked), sum(links[x] for x in linked), sha)
            for n_a, n_b, g, linked, sha in per_doc]


ODD = [None, "", " ", "a ", "  two  spaces ", "<s>x</s> <|endoftext|> <unk>", "▁ mark", "tab\tnew\n\nline", "naïve café", "日本語 текст 🎉 ok",
       "áb", "0x1F 3.14", "same text", "same text", "x" * 3000]


@pytest.mark.parametrize("known", [token_align.KNOWN_PAIRS, 3])
def test_alignment_against_brute_force(spark, sf, known):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()] + ODD
    df = spark.createDataFrame([(k, t, 7, "z") for k, t in enumerate(texts)], "doc_id long, text string, links int, row string")
    got = {r.doc_id: r for r in token_align.statistics(df, PATH_A, PATH_B, known_pairs=known).collect()}
    for k, want in enumerate(brute_alignment(texts)):
        r = got[k]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want, texts[k]


def test_alignment_of_null_ids_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two")], "doc_id long, text string")
    rows = token_align.statistics(df, PATH_A, PATH_B).collect()
    assert len(rows) == 3 and len({(r.n_a, r.count_sum, r.groups_sha256) for r in rows}) == 1 and rows[0].count_sum == 3 * rows[0].n_links
    assert token_align.statistics(df.limit(0), PATH_A, PATH_B).count() == 0


def test_kept_groups_spell_the_text(spark):
    df = spark.createDataFrame([(1, "Kept groups spell  the text, naïvely.")], "doc_id long, text string")
    r = token_align.align(df, PATH_A, PATH_B).first()
    va, vb = token_align.ByteLevel(PATH_A), token_align.Pieces(PATH_B)
    i = j = 0
    out = b""
    for x, y in zip(r.end_a, r.end_b):
        left = b"".join(va.pieces[k] for k in r.ids_a[i:x + 1])
        assert left == b"".join(vb.pieces[k] for k in r.ids_b[j:y + 1])
        out, i, j = out + left, x + 1, y + 1
    assert out.decode() == " Kept groups spell  the text, naïvely."


@pytest.mark.parametrize("seed", range(6))
def test_run_skipping_on_random_ends(seed):
    rng = np.random.default_rng(seed)
    top = int(rng.integers(1, 60_000))
    share = [0.02, 0.5, 0.98, 0.999, 1.0, 0.9995][seed]
    base = rng.random(top) < share
    a, b = base ^ (rng.random(top) < 0.001), base ^ (rng.random(top) < 0.001)
    a[-1] = b[-1] = True
    ends_a, ends_b = np.flatnonzero(a) + 1, np.flatnonzero(b) + 1
    at_a, at_b = token_align.common_ends(ends_a, ends_b)
    want = np.intersect1d(ends_a, ends_b)
    assert np.array_equal(ends_a[at_a], want) and np.array_equal(ends_b[at_b], want)


# ---- spelling

def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words):
    best, out = {}, {}
    for w, n in words.items():
        found = sorted((-m, v) for v, m in words.items() if near(w, v))
        best[w] = (len(found), found[0] if found and -found[0][0] >= 2 * n else None)
    for w, n in words.items():
        root = w
        while best[root][1]:
            root = best[root][1][1]
        count, form = best[w]
        out[w] = (n, count, form[1] if form else None, -form[0] if form else None, root)
    return out


@pytest.mark.parametrize("limits", [{}, {"round_bytes": 1, "slice_words": 40}])
def test_variants_against_all_pairs(spark, limits):
    """Random words over few letters, so that near words, equal-letter runs, ties and chains abound; all filters in one round,
    and one filter of about 40 words a round."""
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abcé"), rng.integers(1, 8))): int(2 ** rng.integers(0, 9)) for _ in range(700)}
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()] + [(None, 4, "x"), ("nulls", None, "x")],
                               "word string, n long, root string")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(df, **limits).collect()}
    assert got == brute_variants(words)


def test_word_counts_and_damage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    counts, letters = Counter(), {*map(chr, range(97, 123)), *map(chr, range(65, 91)), *map(chr, range(0xC0, 0x100))}
    for r in docs.collect():
        run = ""
        for c in (r.text or "") + " ":
            if c in letters:
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{r.doc_id}:{run}".encode())
                if h % 97 == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                counts[run] += 1
                run = ""
    got = {r.word: r.n for r in spelling.word_counts(docs, damage_every=97).collect()}
    assert got == {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_spelling_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "Ünder ÜNDER Ünder under", 3), (3, "under " * 50_000, 4), (4, "undér" * 3, 5)],
                               "doc_id long, text string, word int")
    got = {r.word: r.n for r in spelling.word_counts(df).collect()}
    assert got == {"under": 50_001, "Ünder": 3} and spelling.word_counts(df, min_count=1).count() == 3
    out = {r.word: r for r in spelling.variants(spelling.word_counts(df, min_count=1)).collect()}
    assert out["Ünder"].form == "under" and out["Ünder"].n_near == 1 and out["under"].form is None and out["Ünder"].root == "under"
    assert spelling.variants(spelling.word_counts(df.limit(0))).count() == 0
