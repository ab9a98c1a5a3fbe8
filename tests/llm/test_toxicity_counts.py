"""Prefix counts of slices against counting one prefix at a time, and their cost."""

import time
from collections import Counter

import numpy as np
import pyarrow as pa

from originflow.llm import toxicity as tox


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()),
                                       pa.array([i % 2 for i in range(len(texts))], pa.int32())], ["i", "t", "y"])


def test_prefix_counts_equal_single_counts(monkeypatch):
    texts = ["The cat, the catalogue", "ÄÖ äö Straße a", None, "", "12 !", "extraordinarily extraordinary", "日本 cat"] * 3
    want = Counter()
    for i, t in enumerate(texts):
        slot = i % 2 * tox.CROSS + tox.crc_of(i) // 64 % tox.CROSS
        for w in set(tox.words_of(t)):
            want.update((f"{w}{tox.END}"[:k], slot) for k in range(min(len(w) + len(tox.END), tox.DEPTH) + 1))
    for words in (2, 1 << 14):
        monkeypatch.setattr(tox, "BATCH_WORDS", words)
        got = Counter()
        for b in tox._counts_of(tox.DEPTH)([batch(texts)]):
            for row in b.to_pylist():
                for k in range(2 * tox.CROSS):
                    got[row["prefix"], k] += row[f"n{k}"]
        assert +got == want
    assert sum(b.num_rows for b in tox._counts_of(tox.DEPTH)([batch([None, ""])])) == 0


def test_prefixes_cost_less_than_a_loop_over_them():
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, x)) for x in rng.integers(97, 123, (30_000, 9))]
    data = batch([" ".join(words[i:i + 1000]) for i in range(0, len(words), 1000)])

    def loop():
        cells = {}
        for w in words:
            n = [1] + [0] * (2 * tox.CROSS - 1)
            for i in range(min(len(w) + 1, tox.DEPTH) + 1):
                if (c := cells.get((w + tox.END)[:i])) is None:
                    cells[(w + tox.END)[:i]] = list(n)
                else:
                    for k, v in enumerate(n):
                        c[k] += v

    def seconds(f):
        best = 1e9
        for _ in range(3):
            t = time.process_time()
            f()
            best = min(best, time.process_time() - t)
        return best
    assert seconds(lambda: list(tox._counts_of(tox.DEPTH)([data]))) < seconds(loop)
