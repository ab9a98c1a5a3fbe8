"""Packing: documents become token sequences of one fixed window with next to no padding.

Each scan partition packs its own documents, so nothing is shuffled. A document gives full windows and one remainder. The
remainders wait in a pool, from which minimum bin slack fills one window at a time: the longest remainder is the anchor, a
bitset dynamic program over the other lengths finds the reachable sum closest to the space left, and backtracking through
the saved bitsets gives how many remainders of each length to take.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, END_ID, POOL = 2048, 1, 2048
PUNCTUATION = ".,!$%&#*|?;:()-"
BATCH_BYTES = 4 << 20
KEPT_WORDS = 200_000  # some 30 MB a task


class WordIds:
    """Token ids of many texts. Distinct words are tokenized once and kept for later batches, up to ``KEPT_WORDS`` of them.

    The tokenizer never merges across white space, so the ids of a text are those of its words in a row, and lower-cases
    everything, so A-Z may be lowered before words are compared. A word of letters followed by punctuation is two units to
    it, so words that differ in punctuation share their letters' ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for k, i in vocab.items() if k.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.units, self.flat, self.starts = None, np.zeros((0, 2), np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _units(self, words: pa.Array) -> np.ndarray:
        """The numbers of the two units of each distinct word; words not met before are tokenized."""
        if self.known is not None and len(self.known) + len(words) > KEPT_WORDS:
            self._forget()
        at = pc.index_in(words, value_set=self.known) if self.known is not None else None
        new = words if at is None else words.filter(pc.is_null(at))
        if len(new):
            units, flat, starts = self._table(new)
            self.units = np.concatenate([self.units, units + (len(self.starts) - 1)])
            self.starts = np.concatenate([self.starts, starts[1:] + len(self.flat)])
            self.flat = np.concatenate([self.flat, flat])
            self.known = new if at is None else pa.concat_arrays([self.known, new])
            at = pc.index_in(words, value_set=self.known)
        return self.units[at.to_numpy()]

    def _each(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _of_letters(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of letters: many in one call, cut apart behind the ids that end a word."""
        out = []
        for i in range(0, len(words), 1024):
            part = words[i:i + 1024]
            ids = np.array(self._each([" ".join(part)])[0], np.int32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                out += np.split(ids, cuts[:-1])
            else:  # a letter that the normaliser takes apart
                out += [np.array(x, np.int32) for x in self._each(part)]
        return out

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct word the numbers of its two units, and the ids of all units end to end with their starts."""
        stems = pc.ascii_rtrim(words, PUNCTUATION)
        letters = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False)
        stems = stems.filter(pa.array(letters)).dictionary_encode()
        texts = words.to_pylist()
        units = self._of_letters(stems.dictionary.to_pylist())
        first, second = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        first[letters] = stems.indices.to_numpy(zero_copy_only=False)
        n_stems, rest = len(units), {"": 0}
        stem_chars = pc.utf8_length(stems.dictionary).to_numpy(zero_copy_only=False)[first[letters]] if n_stems else []
        for i, n in zip(np.flatnonzero(letters), stem_chars):
            if len(texts[i]) > n:
                second[i] = rest.setdefault(texts[i][n:], len(rest))
        for i in np.flatnonzero(~letters):
            first[i] = n_stems + rest.setdefault(texts[i], len(rest))
        second += n_stems
        units += [np.array(x, np.int32) for x in self._each(list(rest))]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        return np.stack([first, second], 1), np.concatenate(units), np.concatenate([[0], np.cumsum(sizes)])

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            return [np.zeros(0, np.int32)] * len(texts)
        units = self._units(coded.dictionary)
        flat, starts = self.flat, self.starts
        codes, bounds = coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = units[codes[a:b]].ravel()
            sizes = starts[own + 1] - starts[own]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if b > a else 0
            out.append(flat[np.arange(total) + np.repeat(starts[own] - (ends - sizes), sizes)])
        return out


def closest_subset(capacity: int, counts: np.ndarray) -> dict[int, int]:
    """How many of each length to take so that their sum is the largest one not above ``capacity``; ``counts[n]`` have length n."""
    reach, steps, mask = 1, [], (1 << (capacity + 1)) - 1
    for length in np.flatnonzero(counts[:capacity + 1])[::-1].tolist():
        left, k = min(int(counts[length]), capacity // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (k * length)) & mask
            left -= k
            k *= 2
        if reach >> capacity & 1:
            break
    total, take = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= k * length
            take[length] = take.get(length, 0) + k
    return take


class Packer:
    """Pools remainders and emits pieces (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.pool: dict[int, list] = {}
        self.counts = np.zeros(window, np.int64)
        self.waiting, self.tokens, self.out = 0, 0, []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        full = n // self.window * self.window
        for s in range(0, full, self.window):
            self._emit([(doc_id, s, ids[s:s + self.window], n)])
        if n > full:
            self._push((doc_id, full, ids[full:].copy(), n))
        if self.waiting >= 2 * POOL:
            while self.waiting > POOL:
                self._window()

    def finish(self) -> None:
        """Fill whole windows while the tokens last; the rest, under one window, goes into sequences whose lengths are powers of two."""
        while self.tokens >= self.window:
            self._window()
        rest = [x for items in self.pool.values() for x in items]
        self.pool, size = {}, self.window
        while self.tokens:
            while size > self.tokens:
                size //= 2
            row, room = [], size
            while room:
                doc_id, start, ids, n = rest.pop()
                row.append((doc_id, start, ids[:room], n))
                if len(ids) > room:
                    rest.append((doc_id, start + room, ids[room:], n))
                room -= len(row[-1][2])
            self.tokens -= size
            self._emit(row)

    def _push(self, item) -> None:
        self.pool.setdefault(len(item[2]), []).append(item)
        self.counts[len(item[2])] += 1
        self.waiting += 1
        self.tokens += len(item[2])

    def _pop(self, length: int):
        items = self.pool[length]
        item = items.pop()
        if not items:
            del self.pool[length]
        self.counts[length] -= 1
        self.waiting -= 1
        self.tokens -= length
        return item

    def _longest(self) -> int:
        return int(np.flatnonzero(self.counts)[-1])

    def _window(self) -> None:
        row = [self._pop(self._longest())]
        room = self.window - len(row[0][2])
        if room:
            for length, k in closest_subset(room, self.counts).items():
                for _ in range(k):
                    row.append(self._pop(length))
                    room -= length
        while room and self.pool:  # no subset is exact: cut one of the longest remainders to fill the slack
            doc_id, start, ids, n = self._pop(self._longest())
            row.append((doc_id, start, ids[:room], n))
            if len(ids) > room:
                self._push((doc_id, start + room, ids[room:], n))
            room -= len(row[-1][2])
        self._emit(row)

    def _emit(self, row) -> None:
        offset = 0
        for doc_id, start, ids, n in row:
            self.out.append((doc_id, start, ids, n, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1


def _slices(batch: pa.RecordBatch):
    """Parts of a batch of about ``BATCH_BYTES`` of text, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES)))
        yield batch.slice(at, end - at)
        at = end


def _pack_of(path: str, window: int, end_id: int, keep_ids: bool):
    def run(batches):
        words = WordIds(path)
        packer = Packer(window, TaskContext.get().partitionId() << 33)
        id_type = None

        def pieces():
            rows, packer.out = packer.out, []
            cols = [pa.array([r[0] for r in rows], id_type), *(pa.array(c, pa.int64()) for c in (
                [r[1] for r in rows], [len(r[2]) for r in rows], [zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows],
                [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows]))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                cols.append(pa.array([r[2] for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            id_type = b.schema.field(0).type
            for part in _slices(b):
                for doc_id, tokens in zip(part.column(0).to_pylist(), words.texts(part.column(1))):
                    packer.add(doc_id, np.append(tokens, np.int32(end_id)))
                if packer.out:
                    yield pieces()
        packer.finish()
        if packer.out:
            yield pieces()
    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked, ``ids``.

    Every id of every document, with ``end_id`` behind each, lies in exactly one piece. All sequences are exactly ``window``
    long but for the last tokens of a partition (fewer than a window), which go into sequences of power-of-two lengths, so
    no sequence needs padding. ``window`` must be a power of two. Defined cases: null and empty texts are the single ``end_id``; a
    null id is kept; rows that repeat an id are documents of their own; other columns are not read; an empty table gives no rows.
    The work of a task is in proportion to its input split, and its memory to the largest document and the pool of ``2 * POOL``
    remainders. Sequence ids carry the partition number, so a task that runs again gives the same pieces.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(_pack_of(tokenizer_path, window, end_id, keep_ids), schema + (", ids array<int>" if keep_ids else ""))
