"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters of the vocabulary.

Every word of the vocabulary generates its deletions and its replacements by larger letters (an insertion is a deletion seen
from the other word, so each near pair is generated exactly once). The edits' hashes are probed against blocked Bloom filters
kept by word length; what passes is joined to the vocabulary exactly, which removes the false positives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originflow.llm.common import Staged

MIN_CHARS, MIN_COUNT = 5, 3
BITS_PER_WORD = 16
SLICE_WORDS = 1 << 20  # words of one filter at most, give or take the spread of the hash: 2 MB
ROUND_BYTES = 64 << 20  # filters broadcast at once; a larger vocabulary is probed in several rounds
CELLS = 1 << 20  # edits hashed at once

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """Hashes of words of one length as sums of letter terms, so that the hash of an edit follows from that of the word.

    A word is ``sum(mix(c_i) * base**i)`` modulo 2**64; the keys are these sums, mixed once more with the length.
    """

    def __init__(self, words: list[str]):
        self.length = len(words[0])
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), self.length)
        self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.length - 1, _BASE)]), dtype=np.uint64)
        terms = self.letter(self.codes) * self.power
        self.upto = np.cumsum(terms, axis=1, dtype=np.uint64)  # letters 0..i
        self.before = self.upto - terms
        self.total = self.upto[:, -1]

    @staticmethod
    def letter(codes: np.ndarray) -> np.ndarray:
        return _mix(codes.astype(np.uint64) + _BASE)

    @staticmethod
    def keys(sums: np.ndarray, length: int) -> np.ndarray:
        return _mix(sums + np.uint64(length * 0xD6E8FEB86659FD93 % 2**64))

    def own(self) -> np.ndarray:
        return self.keys(self.total, self.length)

    def deletions(self):
        """``(word, position, keys)`` of the distinct deletions: of a run of equal letters only the first."""
        first = np.ones(self.codes.shape, bool)
        first[:, 1:] = self.codes[:, 1:] != self.codes[:, :-1]
        w, p = np.nonzero(first)
        return w, p, self.keys(self.before[w, p] + (self.total[w] - self.upto[w, p]) * _BACK, self.length - 1)

    def replacements(self, alphabet: np.ndarray):
        """Chunks of ``(word, position, letter index, keys)``: each letter replaced by every larger one of the alphabet."""
        value, rows = self.letter(alphabet), max(1, CELLS // max(1, len(alphabet)))
        for lo in range(0, self.codes.size, rows):
            w, p = np.divmod(np.arange(lo, min(lo + rows, self.codes.size)), self.length)
            old = self.codes[w, p]
            r, k = np.nonzero(alphabet[None, :] > old[:, None])
            sums = self.total[w][r] + (value[k] - self.letter(old)[r]) * self.power[p][r]
            yield w[r], p[r], k, self.keys(sums, self.length)


class BlockedBloom:
    """Blocks of 512 bits; a key sets one bit in each of the eight words of its block."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.reshape(-1, 8)

    @classmethod
    def of(cls, keys: np.ndarray) -> BlockedBloom:
        out = cls(np.zeros(8 * max(1, -(-len(keys) * BITS_PER_WORD // 512)), np.uint64))
        block, spread = out._places(keys)
        for i in range(8):
            np.bitwise_or.at(out.bits, (block, i), out._bit(spread, i))
        return out

    def _places(self, keys):
        return ((keys >> np.uint64(32)) * np.uint64(len(self.bits)) >> np.uint64(32)).astype(np.int64), _mix(keys)

    @staticmethod
    def _bit(spread, i):
        return np.uint64(1) << (spread >> np.uint64(6 * i) & np.uint64(63))

    def found(self, keys: np.ndarray) -> np.ndarray:
        """Indices of the keys that may be present."""
        at = np.arange(len(keys))
        block, spread = self._places(keys)
        for i in range(8):
            hit = (self.bits[block, i] & self._bit(spread, i)) != 0
            at, block, spread = at[hit], block[hit], spread[hit]
        return at


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return ((_mix(keys ^ _BASE) >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def _by_length(words: list[str]):
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for lo in range(0, len(at), max(1, CELLS // int(n))):
            part = at[lo:lo + max(1, CELLS // int(n))]
            yield part, WordHashes([words[i] for i in part])


def _keys_of(slices: dict[int, int]):
    def run(batches):
        for b in batches:
            words = b.column("word").to_pylist()
            if not words:
                continue
            key, part = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64)
            for at, hashes in _by_length(words):
                key[at] = hashes.own()
                part[at] = slice_of(key[at], slices[hashes.length])
            yield pa.RecordBatch.from_arrays(
                [b.column("word"), b.column("n"), pa.array([len(w) for w in words], pa.int32()), pa.array(part, pa.int32()),
                 pa.array(key.view(np.int64), pa.int64())], ["word", "n", "length", "slice", "key"])
    return run


def _filter_of(key, table):
    bits = BlockedBloom.of(table["key"].to_numpy().view(np.uint64)).bits.tobytes()
    return pa.table({"length": pa.array([key[0].as_py()], pa.int32()), "slice": pa.array([key[1].as_py()], pa.int32()),
                     "bytes": pa.array([len(bits)], pa.int64()), "bits": pa.array([bits], pa.binary())})


def _probe_of(filters, slices: dict[int, int], alphabet: np.ndarray):
    """Edits of each word that may be words, as keys; ``filters`` broadcasts ``{(length, slice): bits}``."""
    letters = np.array([chr(c) for c in alphabet] or [""], object)

    def passed(blooms, keys, length):
        if slices.get(length, 1) == 1:
            return blooms[length, 0].found(keys) if (length, 0) in blooms else np.zeros(0, np.int64)
        part = slice_of(keys, slices[length])
        hits = [np.zeros(0, np.int64)]
        for (n, k), bloom in blooms.items():
            if n == length:
                mine = np.flatnonzero(part == k)
                hits.append(mine[bloom.found(keys[mine])])
        return np.concatenate(hits)

    def run(batches):
        blooms = {k: BlockedBloom(np.frombuffer(v, np.uint64)) for k, v in filters.value.items()}
        lengths = {n for n, _ in blooms}
        for b in batches:
            words = b.column("word").to_pylist()
            for _, h in _by_length(words) if words else ():
                own = h.own().view(np.int64)
                edits = []
                if h.length - 1 in lengths:
                    w, p, keys = h.deletions()
                    at = passed(blooms, keys, h.length - 1)
                    edits.append((w[at], p[at], np.full(len(at), "", object), keys[at]))
                if h.length in lengths:
                    for w, p, k, keys in h.replacements(alphabet):
                        at = passed(blooms, keys, h.length)
                        edits.append((w[at], p[at], letters[k[at]], keys[at]))
                for w, p, letter, keys in edits:
                    if len(w):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own[w], pa.int64()), pa.array(keys.view(np.int64), pa.int64()), pa.array(p, pa.int32()),
                             pa.array(letter, pa.string())], ["own", "key", "pos", "letter"])
    return run


def near_pairs(words: DataFrame, round_bytes: int = ROUND_BYTES, slice_words: int = SLICE_WORDS) -> Staged:
    """A written table ``a, n_a, b, n_b``: each unordered pair of words of ``words(word, n)`` that differ by one inserted, deleted or replaced
    code point, once. Words are distinct and at least one code point long.

    Filters are built in tasks, one per (length, slice). They are broadcast in rounds of at most ``round_bytes`` (or one
    filter), whatever the size of the vocabulary; a round probes only edits of its lengths. Candidates travel as two keys, a
    position and a letter; the joins on the keys are checked on the words themselves.
    """
    spark = words.sparkSession
    per_length = {r[0]: r[1] for r in words.groupBy(F.length("word").cast("int")).count().collect()}
    if not per_length:
        return Staged(spark.createDataFrame([], "a string, n_a long, b string, n_b long"), "spelling-pairs")
    slices = {n: -(-k // slice_words) for n, k in per_length.items()}
    alphabet = np.array(sorted(ord(r[0]) for r in words.select(F.explode(F.split("word", ""))).distinct().collect() if r[0]), np.uint32)
    keyed = Staged(words.select("word", "n").mapInArrow(_keys_of(slices), "word string, n long, length int, slice int, key long"),
                   "spelling-keys")
    filters = Staged(keyed.df.select("length", "slice", "key").groupBy("length", "slice")
                     .applyInArrow(_filter_of, "length int, slice int, bytes long, bits binary"), "spelling-filters")
    rounds, size = [[]], 0
    for r in filters.df.select("length", "slice", "bytes").orderBy("length", "slice").collect():
        if rounds[-1] and size + r.bytes > round_bytes:
            rounds.append([])
            size = 0
        rounds[-1].append((r.length, r.slice))
        size += r.bytes
    found = []
    for members in rounds:
        asked = spark.createDataFrame(members, "length int, slice int")
        bits = {(r.length, r.slice): bytes(r.bits) for r in filters.df.join(F.broadcast(asked), ["length", "slice"]).collect()}
        sent = spark.sparkContext.broadcast(bits)
        lengths = sorted({n + d for n, _ in members for d in (0, 1)})
        probe = keyed.df.filter(F.col("length").isin(lengths)).select("word")
        if probe.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
            probe = probe.repartition(spark.sparkContext.defaultParallelism)
        found.append(Staged(probe.mapInArrow(_probe_of(sent, slices, alphabet), "own long, key long, pos int, letter string"),
                            "spelling-edits"))
        sent.destroy()
    edits = found[0].df
    for more in found[1:]:
        edits = edits.union(more.df)
    target = keyed.df.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    source = keyed.df.select(F.col("key").alias("own"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    edited = F.concat(F.expr("substring(a, 1, pos)"), "letter", F.expr("substring(a, pos + 2)"))
    pairs = Staged(edits.join(target, "key").join(source, "own").filter(edited == F.col("b")).select("a", "n_a", "b", "n_b"),
                   "spelling-pairs")
    for t in (*found, filters, keyed):
        t.drop()
    return pairs


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT, damage_every: int | None = None) -> DataFrame:
    """``word, n``: runs of letters (A-Z in lower case, U+00C0 to U+00FF as they are) of all texts, with their occurrences.

    With ``damage_every`` a run whose ``crc32("<id>:<run>")`` that number divides loses its code point number ``crc32 %
    length`` first: misspellings at a known rate. Null texts have no runs; a null id is written as an empty string. Runs
    are counted by grouped aggregates, combined before the shuffle, so a frequent word costs one row a task.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
                       F.translate(F.col(text_col).cast("string"), upper, upper.lower()).alias("_text")) \
        .select("_id", F.explode(F.regexp_extract_all("_text", F.lit(f"[a-zÀ-ÿ]{{{min_chars},}}"), F.lit(0))).alias("word"))
    if damage_every:
        runs = runs.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary"))) \
            .withColumn("word", F.expr(f"if(_h % {damage_every} = 0, concat(substring(word, 1, cast(_h % length(word) as int)), "
                                       "substring(word, cast(_h % length(word) as int) + 2)), word)")) \
            .filter(F.length("word") >= min_chars)
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def variants(words: DataFrame, ratio: int = 2, **limits) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for each row of ``words(word, n)``, whose words are distinct.

    ``form`` is the near word of largest ``n`` (ties: smallest in code-point order) if that is at least ``ratio`` times the
    word's own, else null; ``root`` is where the forms lead, the word itself without one. Counts grow along forms by
    ``ratio`` (2 or more), so chains end and pointers double only as often as the largest count allows.
    Defined cases: null words and null counts are left out; an empty table gives no rows; other columns are not read.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    given = Staged(words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n"))
                   .filter("word is not null and n is not null and word != ''"), "spelling-words")
    words, near = given.df, near_pairs(given.df, **limits)
    pairs = near.df
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("neg"), F.col("b").alias("near")).alias("by")) \
        .union(pairs.select(F.col("b"), F.struct((-F.col("n_a")).alias("neg"), F.col("a").alias("near"))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("by").alias("by"))
    fits = -F.col("by.neg") >= F.lit(ratio) * F.col("n")
    out = Staged(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("by.near")).alias("form"),
        F.when(fits, -F.col("by.neg")).alias("form_n")), "spelling-forms").df
    given.drop()
    near.drop()
    top = out.agg(F.max("n"), F.min("n")).first()
    hops = int(np.log2(max(1, top[0]) / max(1, top[1]))) + 1 if top[0] else 1
    roots, reach = Staged(out.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots"), 1
    while reach < hops:
        onward = roots.df.select(F.col("word").alias("root"), F.col("root").alias("next"))
        old, roots = roots, Staged(roots.df.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")),
                                   "spelling-roots")
        old.drop()
        reach *= 2
    return out.join(roots.df, "word", "left").withColumn("root", F.coalesce("root", "word"))


ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT unnest(range(256)) AS i, unnest(range(256)) AS c, 0 AS step
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8
), lowered AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zÀ-ÿ]+')) AS run FROM lowered) GROUP BY doc_id, run
), bytes AS (
  SELECT doc_id, run, k, hex(encode(concat(doc_id, ':', run))) AS h FROM runs
), hashed AS (
  SELECT doc_id, run, k, xor(4294967295, list_reduce(list_transform(range(1, length(h), 2), lambda j: ('0x' || substr(h, j, 2))::BIGINT),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) AS h
  FROM bytes, crc
), damaged AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k
  FROM hashed
), words AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), holes AS MATERIALIZED (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS cut
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), pairs AS (
  SELECT a.word AS a, a.n AS n_a, b.word AS b, b.n AS n_b FROM holes a JOIN holes b ON a.cut = b.cut AND a.p = b.p AND a.word <> b.word
  UNION
  SELECT a.word, a.n, b.word, b.n FROM holes a JOIN words b ON a.cut = b.word
  UNION
  SELECT b.word, b.n, a.word, a.n FROM holes a JOIN words b ON a.cut = b.word
), best AS (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY n_b DESC, b) AS near, max(n_b) AS near_n FROM pairs GROUP BY a
), forms AS MATERIALIZED (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form,
         CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word
), walk AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL
  SELECT w.word, w.next, f.form FROM walk w JOIN forms f ON w.next = f.word
)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN walk ON forms.word = walk.word AND walk.next IS NULL
"""
