"""SimHash near-dedup with pigeonring candidates.

A 64-bit fingerprint is a ring of four 16-bit segments. If two fingerprints differ in at most three bits, some segment starts
a chain whose cumulative differences stay within the proportional budget: none in the first segment, at most one in the first
two, two in the first three, three in all. Fingerprints are therefore brought together by each segment's value, and pairs
must pass the chain from that segment before the full check.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from originflow.llm.common import Staged, split_hot
from originflow.llm.components import LocalSets, components

SHINGLE, SEED, MAX_BITS, SEGMENTS = 3, 42, 3, 4
BLOCK, CHUNK = 1024, 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of all word shingles; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:len(words) - k + 1].tolist()
    ends = (ends[k - 1:] - 1).tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, len(starts), CHUNK):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i:i + CHUNK], ends[i:i + CHUNK])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def _fingerprints_of(shingle):
    def run(texts: pa.Array) -> pa.Array:
        codes = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
        return pa.array(codes.view(np.int64))
    return run


def chain_pairs(ring: np.ndarray, ends: np.ndarray, sets: LocalSets, max_bits: int) -> None:
    """Unite rows of a run whose fingerprints pass the chain that starts at their shared segment.

    ``ring`` holds the fingerprints turned so that the shared segment comes first, run after run; ``ends[i]`` is the end of
    the run of row i. All pairs at one distance are checked at a time; pairs already united are left out.
    """
    width = 64 // SEGMENTS
    at, d = np.arange(len(ring)), 0
    while True:
        d += 1
        at = at[ends[at] > at + d]
        if not len(at):
            return
        a, x = at, ring[at] ^ ring[at + d]
        for m in range(2, SEGMENTS + 1):
            fits = np.bitwise_count(x >> np.uint64(64 - m * width)) <= m * max_bits // SEGMENTS
            a, x = a[fits], x[fits]
        if len(a):
            roots = sets.roots()
            new = roots[a] != roots[a + d]
            sets.link(a[new], a[new] + d)


def _links_of(max_bits):
    def flush(t: pa.Table):
        code = t["code"].to_numpy().view(np.uint64)
        key = np.stack([t[c].to_numpy().astype(np.int64) for c in ("pos", "segment", "pair_a", "pair_b")])
        new_run = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])
        edges = np.append(np.flatnonzero(new_run), len(code))
        ends = np.repeat(edges[1:], np.diff(edges))
        turn = (key[0] * (64 // SEGMENTS)).astype(np.uint64)
        ring = (code << turn) | np.where(turn > 0, code >> ((np.uint64(64) - turn) & np.uint64(63)), np.uint64(0))
        sets = LocalSets(len(code))
        chain_pairs(ring, ends, sets, max_bits)
        roots = sets.roots()
        own = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.RecordBatch.from_arrays([pa.array(code[own].view(np.int64)), pa.array(code[roots[own]].view(np.int64))], ["a", "b"])

    def run(batches):
        waiting = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if waiting is not None:
                t = pa.concat_tables([waiting, t]).combine_chunks()
            # the last run may go on in the next batch
            n, same = len(t), np.ones(len(t), bool)
            for c in ("pos", "segment", "pair_a", "pair_b"):
                v = t[c].to_numpy()
                same &= v == v[-1] if n else same
            cut = n - int(same[::-1].argmin()) if n and not same.all() else 0
            if cut:
                yield flush(t.slice(0, cut))
            waiting = t.slice(cut)
        if waiting is not None and len(waiting):
            yield flush(waiting)
    return run


def _placed(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows as ``doc_id, code`` and the distinct codes as ``code, first, root``."""
    if max_bits >= SEGMENTS:
        raise ValueError("max_bits must be below the number of segments")
    code = arrow_udf(_fingerprints_of(shingle), "long")
    rows = Staged(docs.select(F.col(id_col).alias("doc_id"), code(F.col(text_col).cast("string")).alias("code")), "simhash").df
    distinct = Staged(rows.groupBy("code").agg(F.min("doc_id").alias("first")), "simhash-codes").df
    width = 64 // SEGMENTS
    keyed = distinct.select("code", F.posexplode(F.array(*[
        F.shiftrightunsigned("code", 64 - width * (i + 1)).bitwiseAND(F.lit((1 << width) - 1)).cast("int") for i in range(SEGMENTS)
    ])).alias("pos", "segment"))
    dealt = split_hot(keyed, ["pos", "segment"], F.xxhash64("code"), BLOCK)
    keys = ["pos", "segment", "pair_a", "pair_b"]
    links = dealt.repartition(*keys).sortWithinPartitions(*keys).select("code", *keys).mapInArrow(_links_of(max_bits), "a long, b long")
    roots = components(links)
    return rows, distinct.join(roots, distinct["code"] == roots["node"], "left") \
        .select("code", "first", F.coalesce("root", "code").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest id linked through near fingerprints.

    Documents with equal fingerprints become one before any comparison, so copies cost one row; each of the rest goes to four
    segment groups, a hot segment is split into blocks whose pairs are checked apart, and a task gives only links that join
    something, at most one per row it read. No link is lost: connectivity is that of all pairs. ``max_bits`` below the number
    of segments is required for the chain's exact first segment. Defined cases: null and empty texts have fingerprint zero
    and are linked like others; null ids get a fingerprint and, as ids, count last (null only if no other is reachable);
    rows that repeat an id are kept; other columns are not read; an empty table gives no rows.
    """
    rows, placed = _placed(docs, id_col, text_col, shingle, max_bits)
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of_code = placed.join(smallest, "root").select(F.col("code").alias("_code"), "component_id")
    return rows.join(of_code, F.col("code") == F.col("_code")).select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each component of near fingerprints: that with the smallest id, null ids last.

    Rows are judged one by one, not by their ids: rows that share an id or have none stay unless their own text is a near
    copy. Equal ids in a component are ordered by fingerprint and then by the hash of the row. Rows of a fingerprint are
    reduced before the shuffle, so copies do not meet in one task.
    """
    _, placed = _placed(docs, id_col, text_col, shingle, max_bits)
    chosen = placed.groupBy("root").agg(F.min_by("code", F.struct(F.isnull("first"), "first", "code")).alias("_chosen")).select("_chosen")
    code = arrow_udf(_fingerprints_of(shingle), "long")
    row = F.min_by(F.struct(*docs.columns), F.struct(F.isnull(id_col), id_col, F.xxhash64(*docs.columns)))
    # never null, which Spark is told: else the join's null check would have each task fingerprint every text a second time
    own = F.coalesce(code(F.col(text_col).cast("string")), F.lit(0))
    first = docs.withColumn("_code", own).groupBy("_code").agg(row.alias("_row"))
    return first.join(chosen, F.col("_code") == F.col("_chosen"), "left_semi").select("_row.*")
