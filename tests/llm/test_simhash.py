"""SimHash components against all pairs, and the chain filter against the full Hamming check."""

import numpy as np
import pytest
import xxhash

from originflow.llm import components, simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(codes, ids):
    root = dict(zip(ids, ids))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(ids):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= 3:
                x, y = find(a), find(ids[j])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    codes = [brute_fingerprint(r.text) for r in rows]
    want = brute_components(codes, [r.doc_id for r in rows])
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    for r, c in zip(rows, codes):
        assert got[r.doc_id].fingerprint == f"{c:016x}" and got[r.doc_id].component_id == want[r.doc_id]


def test_odd_rows(spark):
    df = spark.createDataFrame([(5, None, "x"), (3, "", "y"), (9, "One\tTWO", "z"), (8, "one two", "z"), (8, "one two", "q"),
                                (None, "one two", "n"), (1, "w " * 200_000, "long")], "doc_id long, text string, code string")
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()
                 if r.doc_id is not None)
    assert [g[1] for g in got] == [1, 3, 5, 8, 8, 9]
    by = {g[1]: g for g in got}
    assert by[3][2] == by[5][2] == "0" * 16 and by[5][3] == 3 and by[9][3] == 8 and by[9][2] == by[8][2]
    assert by[1][2] == f"{brute_fingerprint('w w w'):016x}"
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_chain_keeps_every_near_pair(seed):
    """Near codes with 0 to 5 flipped bits, all runs as the operator forms them: roots equal those of all pairs."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    codes = [base]
    for _ in range(6):
        flips = np.zeros(60, np.uint64)
        for i in range(60):
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                flips[i] |= np.uint64(1) << np.uint64(b)
        codes.append(base ^ flips)
    codes = np.unique(np.concatenate(codes))
    ids = list(range(len(codes)))
    want = brute_components([int(c) for c in codes], ids)
    links = []
    for pos in range(4):
        turn = np.uint64(pos * 16)
        ring = (codes << turn) | ((codes >> ((np.uint64(64) - turn) & np.uint64(63))) if pos else np.uint64(0))
        order = np.argsort(ring >> np.uint64(48), kind="stable")
        seg = (ring >> np.uint64(48))[order]
        sets = components.LocalSets(len(codes))
        simhash.chain_pairs(ring[order], np.searchsorted(seg, seg, side="right"), sets, 3)
        roots = sets.roots()
        links += [(int(order[i]), int(order[r])) for i, r in enumerate(roots) if i != r]
    root = dict(zip(ids, ids))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {i: find(i) for i in ids} == want


def test_hot_segment_is_split_without_loss(spark):
    """3,000 codes of one segment group in chains of one-bit steps, with blocks of 128 rows."""
    rng = np.random.default_rng(0)
    low = rng.choice(2**20, 3000, replace=False).astype(np.int64)
    df = spark.createDataFrame([(int(v), 0, 7) for v in low], "code long, pos int, segment int")
    keys = ["pos", "segment", "pair_a", "pair_b"]
    from pyspark.sql import functions as F

    from originflow.llm.common import split_hot
    dealt = split_hot(df, ["pos", "segment"], F.xxhash64("code"), 128)
    assert dealt.groupBy(*keys).count().agg(F.max("count")).first()[0] < 400
    links = dealt.repartition(*keys).sortWithinPartitions(*keys).select("code", *keys).mapInArrow(simhash._links_of(3), "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    want = brute_components([int(v) for v in low], [int(v) for v in low])
    assert all(got.get(int(v), int(v)) == want[int(v)] for v in low)


def test_components_of_a_path_and_a_hub(spark):
    rows = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1200)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 100 + 199
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
