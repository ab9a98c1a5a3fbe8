"""Alignment of two tokenizers over the same bytes by diagonal run skipping, and corpus-wide counts of linked ids.

Both token sequences of a text are arrays of byte ends. As long as the arrays agree at the present index shift, tokens map one
to one; exponential probing skips such stretches. Where they disagree, the side that lags steps on until both end together:
an irregular group, after which the shift is another one.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originflow.llm.common import Staged

BATCH_ROWS = 1000  # rows of an Arrow batch at most
SLICE_BYTES = 2 << 20  # text tokenized at once
LINKS_AT_ONCE = 1 << 18  # links looked up at once
FIRST_PROBE, ARRAY_PROBE, LAST_PROBE = 4, 32, 4096  # tokens that the first, the first array and the longest probe of a stretch compare
OLD_SCRIPTS = 0x0530  # below, character classes are the same in every Unicode version in use
KNOWN_PAIRS = 2_000_000  # pairs broadcast with their counts at most; rarer pairs are joined


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tokens of ``a`` and of ``b`` that end together. Both arrays rise strictly and end with the same value."""
    starts_a, starts_b, runs = [], [], []
    list_a, list_b = a.tolist(), b.tolist()
    a, b = np.append(a, np.full(LAST_PROBE, -1)), np.append(b, np.full(LAST_PROBE, -2))  # probes stop behind the last token
    i = j = 0
    n, m = len(list_a), len(list_b)
    while i < n and j < m:
        x, y = list_a[i], list_b[j]
        if x == y:
            run, probe = 1, FIRST_PROBE
            while probe < ARRAY_PROBE:  # short stretches: list slices cost less than arrays
                left, right = list_a[i + run:i + run + probe], list_b[j + run:j + run + probe]
                if left != right or len(left) < probe:
                    for p, q in zip(left, right):
                        if p != q:
                            break
                        run += 1
                    probe = 0
                    break
                run += probe
                probe *= 2
            while probe:  # the shift j - i holds; look ahead twice as far each time until the ends differ
                differ = a[i + run:i + run + probe] != b[j + run:j + run + probe]
                first = int(differ.argmax())
                if differ[first]:
                    run += first
                    break
                run += probe
                probe = min(2 * probe, LAST_PROBE, n - i - run + LAST_PROBE, m - j - run + LAST_PROBE)
            starts_a.append(i)
            starts_b.append(j)
            runs.append(run)
            i += run
            j += run
        elif x < y:
            i += 1
        else:
            j += 1
    runs = np.array(runs, np.int64)
    within = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    return np.repeat(np.array(starts_a, np.int64), runs) + within, np.repeat(np.array(starts_b, np.int64), runs) + within


def byte_level_bytes() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others count up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Vocabulary:
    """Bytes of each id and their lengths."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.size = pieces, len(pieces)
        self.lengths = np.array([len(p) for p in pieces], np.int64)

    def decimals(self, width: int, inner: bytes, last: bytes) -> np.ndarray:
        """Rows of ``width`` bytes: all ids followed by ``inner``, then all followed by ``last``, filled up with zeros."""
        text = b"".join((str(k).encode() + sep).ljust(width, b"\0") for sep in (inner, last) for k in range(self.size))
        return np.frombuffer(text, np.uint8).reshape(-1, width)


class ByteLevel(_Vocabulary):
    """A byte-level BPE file of the ``tokenizers`` library.

    Its vocabulary orders tokens by merge, so ``tiktoken`` gives the same ids from it, several times faster. Texts with
    letters of newer or rarer scripts, whose character classes depend on a library's Unicode version, are left to the file's
    own library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        table = byte_level_bytes()
        special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        names = [self.tok.id_to_token(k) or "" for k in range(self.tok.get_vocab_size(with_added_tokens=True))]
        super().__init__([p.encode() if p in special else bytes(table[c] for c in p) for p in names])
        ranks = {p: k for k, p in enumerate(self.pieces) if names[k] not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [self.fast.encode_ordinary(" " + t) if t.isascii() or max(t) < chr(OLD_SCRIPTS) else self.slow(t) for t in texts]

    def slow(self, text: str) -> list[int]:
        return self.tok.encode(" " + text, add_special_tokens=False).ids


class Pieces(_Vocabulary):
    """A piece model of the ``sentencepiece`` library, which puts the space before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.tok = SentencePieceProcessor(model_file=path)

        def decode(k):
            piece = self.tok.id_to_piece(k)
            return bytes([int(piece[3:5], 16)]) if self.tok.is_byte(k) else piece.replace("▁", " ").encode()
        super().__init__([decode(k) for k in range(self.tok.get_piece_size())])

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.tok.encode(texts, num_threads=1)


_LOADED: dict = {}


def _load(kind, path):
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def _parts(sizes: pa.Array, most: int):
    """Consecutive ranges of rows whose sizes add up to about ``most``, or single rows."""
    total = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most)))
        yield at, end
        at = end


class GroupText:
    """``a1,a2|b1;a3|b2,b3``: ids of a group divided by commas, sides by a bar, groups by semicolons."""

    def __init__(self, va: _Vocabulary, vb: _Vocabulary):
        width = len(str(max(va.size, vb.size))) + 1
        self.rows = np.concatenate([va.decimals(width, b",", b"|"), vb.decimals(width, b",", b";")])
        self.size_a, self.size_b = va.size, vb.size

    def of(self, ids_a, ids_b, end_a, end_b) -> bytes:
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[end_a], last_b[end_b] = 1, 1
        before_b, upto_a = np.concatenate([[0], end_b + 1]), end_a + 1  # tokens of b before a group, of a up to and with it
        row = np.empty(len(ids_a) + len(ids_b), np.int64)
        row[np.arange(len(ids_a)) + before_b[np.cumsum(last_a) - last_a]] = ids_a + self.size_a * last_a
        row[np.arange(len(ids_b)) + upto_a[np.cumsum(last_b) - last_b]] = 2 * self.size_a + ids_b + self.size_b * last_b
        flat = self.rows[row].ravel()
        return flat[flat != 0].tobytes()[:-1]  # without the last semicolon


def align_text(va: _Vocabulary, vb: _Vocabulary, text: str, ids_a: list[int], ids_b: list[int]):
    """``(ids_a, ids_b, end_a, end_b)`` of one text, or None where the tokens' bytes are not those of the text."""
    want = (" " + text).encode("utf-8", "surrogatepass")
    if b"".join(map(va.pieces.__getitem__, ids_a)) != want or b"".join(map(vb.pieces.__getitem__, ids_b)) != want:
        return None
    a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
    return a, b, *common_ends(np.cumsum(va.lengths[a]), np.cumsum(vb.lengths[b]))


def _align_of(path_a: str, path_b: str, keep: bool):
    def run(batches):
        va, vb = _load(ByteLevel, path_a), _load(Pieces, path_b)
        group_text = GroupText(va, vb)
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        for batch in batches:
            for lo, hi in _parts(pc.binary_length(batch.column(1)), SLICE_BYTES):
                ids = batch.column(0).slice(lo, hi - lo)
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                full = [k for k, t in enumerate(texts) if t]
                asked = [texts[k] for k in full]
                n = len(texts)
                sizes, sha, links = np.zeros((3, n), np.int64), [""] * n, [[] for _ in range(n)]
                kept = [[[] for _ in range(n)] for _ in range(4)]
                for k, text, ia, ib in zip(full, asked, va.ids(asked), vb.ids(asked)):
                    found = align_text(va, vb, text, ia, ib)
                    if found is None:
                        continue
                    a, b, end_a, end_b = found
                    sizes[:, k] = len(a), len(b), len(end_a)
                    sha[k] = hashlib.sha256(group_text.of(*found)).hexdigest()
                    links[k] = a[end_a] * vb.size + b[end_b]
                    if keep:
                        for column, values in zip(kept, found):
                            column[k] = values
                cols = [ids, *(pa.array(s, pa.int64()) for s in sizes), pa.array(sha, pa.string()), pa.array(links, longs)]
                names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"]
                if keep:
                    cols += [pa.array([np.asarray(v, np.int32) for v in column], ints) for column in kept]
                    names += ["ids_a", "ids_b", "end_a", "end_b"]
                yield pa.RecordBatch.from_arrays(cols, names)
    return run


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups_sha256, links`` for each row; with ``keep`` also the ids of both sides and, group by
    group, the index of the last token (``ids_a, ids_b, end_a, end_b``), from which every group's span follows.

    ``links`` holds one number a group: ``id_a * size_b + id_b`` of the two tokens that end together. Defined cases: null and
    empty texts, and texts whose tokens do not spell the text with a space before it, have no tokens (zeros, empty lists, an
    empty string); null and repeated ids are rows of their own; other columns are not read. A map without shuffle; texts are
    tokenized in slices of about ``SLICE_BYTES`` (or one text).
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>"
    if keep:
        schema += ", ids_a array<int>, ids_b array<int>, end_a array<int>, end_b array<int>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(_align_of(path_a, path_b, keep), schema)


class PairTable:
    """Counts of broadcast pairs, sorted by pair, behind a table of slots in which the more frequent pair stays."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
        self.pairs, self.counts, self.best = pairs, counts, best
        self.slots = np.zeros(1 << 20, np.int64)
        order = np.argsort(counts, kind="stable")
        self.slots[self._slot(pairs[order])] = order

    @staticmethod
    def _slot(pairs):
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def find(self, asked: np.ndarray):
        """``(known, count, best)`` of each pair asked for."""
        if not len(self.pairs):
            return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        at = self.slots[self._slot(asked)]
        far = np.flatnonzero(self.pairs[at] != asked)
        at[far] = np.minimum(np.searchsorted(self.pairs, asked[far]), len(self.pairs) - 1)
        known = self.pairs[at] == asked
        return known, np.where(known, self.counts[at], 0), known & self.best[at]


def _look_up_of(sent, whole: bool):
    """Adds up the counts of each row's links; ``rest`` has the links that are not among the broadcast pairs."""
    def run(batches):
        table = PairTable(*sent.value)
        for batch in batches:
            for lo, hi in _parts(pc.list_value_length(batch.column("links")), LINKS_AT_ONCE):
                b = batch.slice(lo, hi - lo)
                links = b.column("links")
                flat, ends = links.flatten().to_numpy().astype(np.int64), np.cumsum(pc.list_value_length(links).to_numpy())
                hit, n, top = table.find(flat)
                sums = [np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x)])[ends]])) for x in (top.astype(np.int64), n)]
                names = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
                cols = [b.column(k) for k in names] + [pa.array(s, pa.int64()) for s in sums]
                names = [*names, "n_best", "count_sum"]
                if not whole:
                    miss = np.concatenate([[0], np.cumsum(~hit)])[np.concatenate([[0], ends])].astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(miss, pa.int32()), pa.array(flat[~hit], pa.int64())))
                    names.append("rest")
                yield pa.RecordBatch.from_arrays(cols, names)
    return run


def link_statistics(aligned: DataFrame, size_b: int, known_pairs: int = KNOWN_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row of ``align``.

    A pair's count is the number of links of the whole input that hold it. Counts are grouped aggregates. The most frequent
    pairs (all with a count of at least some power of two, chosen so that they are at most ``known_pairs``) are broadcast and
    looked up where the links are; the rarer links, none of which is hot, are exploded and joined to their counts.
    """
    spark = aligned.sparkSession
    rows = Staged(aligned.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "groups_sha256",
                                 "links"), "align-rows")
    counts = Staged(rows.df.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "align-counts")
    of_b = (F.col("pair") % size_b).alias("b")
    top = counts.df.groupBy(of_b).agg(F.max("n").alias("top"))
    pairs = Staged(counts.df.withColumn("b", of_b).join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")),
                   "align-pairs")
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("level")
    least, total, levels = 63, 0, {r[0]: r[1] for r in pairs.df.groupBy(level).count().collect()}
    while least > 0 and total + levels.get(least - 1, 0) <= known_pairs:
        least -= 1
        total += levels.get(least, 0)
    common = pairs.df.filter(F.col("n") >= 2 ** least).toArrow()
    order = np.argsort(common["pair"].to_numpy())
    sent = spark.sparkContext.broadcast((common["pair"].to_numpy()[order], common["n"].to_numpy()[order],
                                         common["best"].to_numpy(zero_copy_only=False).astype(bool)[order]))
    del common
    schema = "row long, doc_id {}, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long" \
        .format(rows.df.schema["doc_id"].dataType.simpleString())
    whole = least == 0
    looked = Staged(rows.df.mapInArrow(_look_up_of(sent, whole), schema + ("" if whole else ", rest array<long>")), "align-looked")
    sent.destroy()
    out = looked.df
    if not whole:
        rare = pairs.df.filter(F.col("n") < 2 ** least)
        more = out.select("row", F.explode("rest").alias("pair")).groupBy("pair", "row").agg(F.count("*").alias("k")).join(rare, "pair") \
            .groupBy("row").agg(F.sum(F.col("k") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("_best"))
        joined = Staged(out.drop("rest").join(more, "row", "left")
                        .withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
                        .withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).drop("_sum", "_best"), "align-joined")
        looked.drop()
        out = joined.df
    for t in (rows, counts, pairs):
        t.drop()
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def statistics(docs: DataFrame, path_a: str, path_b: str, **options) -> DataFrame:
    """``link_statistics`` of ``align`` with the vocabulary size of ``path_b``."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"  # texts and links are wide rows: small batches keep workers small
    if not 0 < int(docs.sparkSession.conf.get(key)) <= BATCH_ROWS:
        docs.sparkSession.conf.set(key, str(BATCH_ROWS))
    known = {k: options.pop(k) for k in ("known_pairs",) if k in options}
    return link_statistics(align(docs, path_a, path_b, keep=False, **options), _load(Pieces, path_b).size, **known)
