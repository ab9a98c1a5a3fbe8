"""Toxicity from two class-conditional letter models of words with absolute discounts.

Each class has a model of words, letter by letter from the word's start: the history of a letter is the prefix before
it, and letters after the first ``DEPTH`` are not read. Counts are numbers of distinct (document, word) pairs of the class in
which the word has that prefix. A fixed discount is taken from each count and the freed mass goes to the counts shared by both classes, so an expression too rare in a class
scores as it does in both together and speaks for neither. Prefixes of both classes are learned; one that neither class has
more often than the discount scores under its history as a prefix never seen does. The two log-likelihoods of a word are
compared; what exceeds the document's own median by a margin is summed and divided by the number of words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from originflow.llm.common import Staged, crc_of
from originflow.llm.labelled import fit_logistic_table, held_out, learning_rows, with_labels

WORD = re.compile(r"[^\W\d_]+")
END = "\x03"
DEPTH, DISCOUNT, MARGIN, PRIOR_WORDS = 10, 2.5, 2.0, 5
CROSS = 4
BROADCAST_IDS = 2_000_000  # labelled ids that are broadcast to meet their documents, some 32 MB
BATCH_WORDS = 1 << 14  # distinct words whose prefixes a task holds at once
SLICE_CHARS = 1 << 20  # text whose distinct words are looked up at once
HEAD = 2  # letters that the prefixes of one task share
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _counts_of(depth):
    """Counts of prefixes by class and cross-fitting part, summed over slices of about ``BATCH_WORDS`` distinct words."""
    def emitted(words):
        ended, n = pa.array([w + END for w in words], pa.string()), np.array(list(words.values()), np.int64).reshape(-1, 2 * CROSS)
        lengths = pc.utf8_length(ended).to_numpy(zero_copy_only=False)
        prefixes, sums = [pa.array([], pa.string())], [np.zeros((0, 2 * CROSS), np.int64)]
        for length in range(min(depth, lengths.max(initial=-1)) + 1):
            rows = np.flatnonzero(lengths >= length)
            coded = pc.utf8_slice_codeunits(ended.take(pa.array(rows)), 0, length).dictionary_encode()
            at = coded.indices.to_numpy()
            prefixes.append(coded.dictionary)
            sums.append(np.stack([np.bincount(at, c, len(coded.dictionary)) for c in n[rows].T], 1).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(prefixes), *map(pa.array, np.vstack(sums).T.copy())],
                                          ["prefix", *(f"n{i}" for i in range(2 * CROSS))])

    def run(batches):
        words: dict[str, list[int]] = {}
        for b in batches:
            for doc_id, text, label in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                slot = label * CROSS + crc_of(doc_id) // 64 % CROSS
                for w in set(words_of(text.as_py())):
                    if (n := words.get(w)) is None:
                        n = words[w] = [0] * (2 * CROSS)
                    n[slot] += 1
                if len(words) >= BATCH_WORDS:
                    yield emitted(words)
                    words = {}
        yield emitted(words)
    return run


def prefix_ratios(prefixes: list[str], counts: np.ndarray, discount: float, start: np.ndarray | float = 0.0):
    """``order, total, escape, told`` of all prefixes under the shortest of them, whose own ratios are ``start``.

    Columns are the cross-fitting parts and the last is all parts together; ``order`` sorts by length. ``told`` is false
    where the prefix may be left out: no part has more of it than the discount in a class, so no part tells it from the rest
    of its history, or no part knows its history.
    """
    order = sorted(range(len(prefixes)), key=lambda i: (len(prefixes[i]), prefixes[i]))
    prefixes, counts = [prefixes[i] for i in order], counts[order]
    at = {p: i for i, p in enumerate(prefixes)}
    parent = np.array([at.get(p[:-1], 0) for p in prefixes], np.int64)
    depth = np.array(list(map(len, prefixes)), np.int64)
    n, live = len(prefixes), np.arange(len(prefixes)) > 0
    total, escape = np.zeros((n, CROSS + 1)), np.zeros((n, CROSS + 1))
    total[:1] = start
    told = np.zeros(n, bool)
    for part in range(CROSS + 1):
        c = [counts[:, k * CROSS:(k + 1) * CROSS].sum(1) - (counts[:, k * CROSS + part] if part < CROSS else 0) for k in (0, 1)]
        mass = c  # every pair goes on to one letter or to the end of its word
        kept = [np.where(live, np.maximum(x - discount, 0), 0.0) for x in c]
        free = [np.maximum(1 - np.bincount(parent, k, n) / np.maximum(m, 1), 0) for k, m in zip(kept, mass)]
        both = c[0] + c[1]
        shared = both / np.maximum(both, 1)[parent]
        known = mass[0] > discount  # beyond it the classes share everything
        with np.errstate(divide="ignore", invalid="ignore"):
            p = [k / np.maximum(m, 1)[parent] + np.where(m[parent] > 0, f[parent], 1.0) * shared for k, m, f in zip(kept, mass, free)]
            step = np.where(live & known[parent] & (both > 0), np.log(p[1]) - np.log(p[0]), 0.0)
            esc = np.where(known & (free[0] > 1e-9) & (np.where(mass[1] > 0, free[1], 1.0) > 1e-9),
                           np.log(np.where(mass[1] > 0, free[1], 1.0)) - np.log(free[0]), 0.0)
        step = np.where(np.isfinite(step), step, 0.0)
        step = np.where(live & (c[0] <= discount) & (c[1] <= discount), esc[parent], step)  # as a prefix never seen
        for d in range(int(depth[:1].max(initial=0)) + 1, int(depth.max(initial=0)) + 1):
            rows = depth == d
            total[rows, part] = total[parent[rows], part] + step[rows]
        escape[:, part] = esc
        told |= known[parent] & ((c[0] > discount) | (c[1] > discount))
    told[:1] = True
    return order, total, escape, told


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all prefixes (of length 1 and more) of the words, one after the other, and where each word ends in them.

    A hash is a sum over letters, so those of a word's prefixes are running sums.
    """
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    place = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(lengths.max(initial=0)), _BASE)]), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(codes + _BASE) * power[place], dtype=np.uint64)])
    return _mix(sums[1:] - np.repeat(sums[ends - lengths], lengths) + (place + 1).astype(np.uint64) * _BASE), ends


def keys_of(prefixes: list[str]) -> np.ndarray:
    """The hash of each prefix as a whole; 0 for the empty one."""
    keys, ends = prefix_keys(prefixes)
    return np.where(np.diff(ends, prepend=0) > 0, np.concatenate([np.zeros(1, np.uint64), keys])[ends], np.uint64(0))


def key_of(prefix: str) -> int:
    return int(keys_of([prefix])[0])


class PrefixModel:
    """Log-likelihood ratios of prefixes, one column per cross-fitting part and the last for all parts together.

    ``total[i]`` is the ratio of the prefix with hash ``keys[i]``, ``escape[i]`` what is added when the word leaves the known
    prefixes there. Prefixes are known by 64-bit hashes in ascending order, which takes a few bytes instead of a string each.
    """

    def __init__(self, prefixes: list[str], counts: np.ndarray, discount: float = DISCOUNT):
        order, total, escape, told = prefix_ratios(prefixes, counts, discount)
        self._hold(keys_of([prefixes[i] for i in order])[told], total[told], escape[told])

    @classmethod
    def of(cls, keys: np.ndarray, total: np.ndarray, escape: np.ndarray) -> PrefixModel:
        """A model of ratios worked out elsewhere."""
        model = cls.__new__(cls)
        model._hold(keys, total, escape)
        return model

    def _hold(self, keys, total, escape):
        at = np.argsort(keys, kind="stable")
        self.keys, self.total, self.escape = keys[at], total[at], escape[at]

    def only(self, part: int) -> PrefixModel:
        """The model of one part, which is all that scoring reads."""
        return PrefixModel.of(self.keys, self.total[:, part:part + 1], self.escape[:, part:part + 1])

    def ratios(self, part: int, depth: int = DEPTH) -> Ratios:
        return Ratios(self.keys, self.total[:, part], self.escape[:, part], depth)


class Ratios:
    """Log-likelihood ratios of words by one part of a model."""

    def __init__(self, keys, total, escape, depth):
        self.keys, self.total, self.escape, self.depth = keys, total, escape, depth
        self.root = int(np.searchsorted(keys, np.uint64(key_of(""))))

    def of(self, words: list[str]) -> np.ndarray:
        """Each word is followed along its prefixes to the last one known; leaving it there adds that prefix's escape."""
        if not words:
            return np.zeros(0)
        want, ends = prefix_keys([(w + END)[:self.depth] for w in words])
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        lengths = np.diff(ends, prepend=0)
        starts = ends - lengths
        place = np.arange(len(want)) - np.repeat(starts, lengths)
        known = np.minimum(np.minimum.reduceat(np.where(self.keys[at] == want, len(want), place), starts), lengths)
        node = np.where(known > 0, at[starts + np.maximum(known, 1) - 1], self.root)
        return self.total[node].astype(np.float64) + np.where(known < lengths, self.escape[node], 0.0)

    def __getitem__(self, word: str) -> float:
        return float(self.of([word])[0])


def learn(counted: DataFrame, discount: float = DISCOUNT) -> PrefixModel:
    """The model of a table ``prefix, n0..``, worked out in tasks by the first ``HEAD`` letters.

    Only prefixes up to that length are counted on the driver; the rest comes back as hashes and ratios.
    """
    names = [f"n{i}" for i in range(2 * CROSS)]
    top = counted.filter(F.length("prefix") <= HEAD).toPandas()
    prefixes = top["prefix"].tolist()
    order, total, escape, told = prefix_ratios(prefixes, top[names].to_numpy(np.int64), discount)
    prefixes = [prefixes[i] for i in order]
    starts = counted.sparkSession.sparkContext.broadcast({p: total[i] for i, p in enumerate(prefixes) if len(p) == HEAD})
    columns = [*(f"t{i}" for i in range(CROSS + 1)), *(f"e{i}" for i in range(CROSS + 1))]

    def grow(group: pa.Table) -> pa.Table:
        words = group["prefix"].to_pylist()
        order, total, escape, told = prefix_ratios(words, np.stack([group[c].to_numpy() for c in names], 1), discount,
                                                   starts.value[min(words, key=len)])
        keys = keys_of([words[i] for i in order])[told].view(np.int64)
        return pa.table({"key": keys} | {c: v.astype(np.float32) for c, v in zip(columns, np.hstack([total, escape])[told].T)})
    grown = counted.filter(F.length("prefix") >= HEAD).groupBy(F.substring("prefix", 1, HEAD).alias("_head")) \
        .applyInArrow(grow, "key long, " + ", ".join(f"{c} float" for c in columns)).toArrow()
    starts.destroy()
    own = told & np.array([len(p) < HEAD for p in prefixes])
    ratios = np.stack([grown[c].to_numpy() for c in columns], 1)
    head = np.hstack([total, escape])[own].astype(np.float32)
    keys = keys_of([p for p, ok in zip(prefixes, own) if ok])
    ratios, keys = np.vstack([head, ratios]), np.concatenate([keys, grown["key"].to_numpy().view(np.uint64)])
    return PrefixModel.of(keys, ratios[:, :CROSS + 1], ratios[:, CROSS + 1:])


def evidences(texts: list[str | None], ratios: Ratios, margin: float = MARGIN) -> np.ndarray:
    """For each text the excess of its words' ratios over their median, per word; square root, which spreads the small values.

    Texts are taken in slices of about ``SLICE_CHARS``; the distinct words of a slice are looked up together.
    """
    out, at = np.zeros(len(texts)), 0
    while at < len(texts):
        index, rows, size, first = {}, [], 0, at
        while at < len(texts) and (not rows or size < SLICE_CHARS):
            rows.append(np.array([index.setdefault(w, len(index)) for w in words_of(texts[at])], np.int64))
            size += len(texts[at] or "")
            at += 1
        told = ratios.of(list(index))
        for k, row in enumerate(rows):
            if len(row):
                r = told[row]
                out[first + k] = np.sqrt(np.maximum(r - np.median(r) - margin, 0).sum() / (len(r) + PRIOR_WORDS))
    return out


def evidence(text: str | None, ratios: Ratios, margin: float = MARGIN) -> float:
    return float(evidences([text], ratios, margin)[0])


class ToxicityModel:
    """A fitted model: ``prefixes`` and the slope and intercept that turn evidence into a probability."""

    def __init__(self, prefixes: PrefixModel | None, slope: float, intercept: float):
        self.prefixes, self.slope, self.intercept = prefixes, slope, intercept


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        folds: int = FOLDS, fold: int = HELD_OUT) -> ToxicityModel:
    """Fit on all labelled documents (whole texts), none from the held-out fold.

    The calibration uses evidence from models that have not seen the document (``CROSS`` parts). Without both classes the
    model gives the smoothed share of the one there is.
    """
    rows = learning_rows(labels, label_col, folds, fold)
    train = Staged(with_labels(docs, rows, id_col, text_col, rows.count() <= BROADCAST_IDS).select("_lid", "_text", "_label"), "toxicity-train")
    names = [f"n{i}" for i in range(2 * CROSS)]
    counted = Staged(train.df.mapInArrow(_counts_of(DEPTH), "prefix string, " + ", ".join(f"{c} long" for c in names))
                     .groupBy("prefix").agg(*[F.sum(c).alias(c) for c in names]), "toxicity-counts")
    classes = train.df.select("_label").distinct().count()
    if classes < 2 or counted.df.isEmpty():
        calibration = fit_logistic_table(train.df.select(F.lit(0.0).alias("x"), F.col("_label").alias("y")))
        train.drop()
        counted.drop()
        return ToxicityModel(None, *calibration)
    model = learn(counted.df)
    counted.drop()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def cross(batches):
        tables = [held.value.ratios(k) for k in range(CROSS)]
        for b in batches:
            part = np.array([crc_of(i) // 64 % CROSS for i in b.column(0).to_pylist()], np.int64)
            texts, x = b.column(1).to_pylist(), np.zeros(b.num_rows)
            for k in range(CROSS):
                rows = np.flatnonzero(part == k)
                x[rows] = evidences([texts[i] for i in rows], tables[k])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column(2)], ["x", "y"])
    seen = Staged(train.df.mapInArrow(cross, "x double, y int"), "toxicity-seen")
    train.drop()
    held.destroy()
    calibration = fit_logistic_table(seen.df)
    seen.drop()
    return ToxicityModel(model.only(CROSS), *calibration)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
          folds: int = FOLDS, fold: int = HELD_OUT) -> DataFrame:
    """``docs`` with ``score`` (probability of label 1 from the whole text), ``predicted`` (score >= threshold) and ``held_out``.

    Defined cases: null and empty texts and texts without letters have no evidence and get the score of none; very long texts
    are read whole; rows that repeat an id are scored each; a null id counts as held out; other columns are kept, input columns
    named like the three are replaced; an empty table stays empty. The broadcast model holds the prefixes that tell the classes apart, 64-bit hashes and two numbers each.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: pa.Array) -> pa.Array:
        m = held.value
        x = evidences(texts.to_pylist(), m.prefixes.ratios(0)) if m.prefixes else np.zeros(len(texts))
        return pa.array(1 / (1 + np.exp(-np.clip(m.slope * x + m.intercept, -500, 500))), pa.float64())
    return docs.withColumn("score", arrow_udf(scores, "double")(F.col(text_col).cast("string"))) \
        .withColumns({"predicted": (F.col("score") >= threshold).cast("int"), "held_out": held_out(id_col, folds, fold)})
