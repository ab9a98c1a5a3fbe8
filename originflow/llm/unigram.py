"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces, with byte fallback.

White space becomes the marker U+2581 and a text gets one in front. No piece crosses from other characters to a marker, nor a
line feed, so a text is cut there and each distinct chunk of a batch is segmented once, all chunks of a batch side by side.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CHUNK = re.compile(" +[^ \n]*|[^ \n]+|\n")
LONG, SLICE_CHARS, TABLE = 256, 8_000_000, 1 << 14


class DoubleArray:
    """A trie in two arrays: child c of node s is ``base[s] + c`` if ``check`` of that place is s. ``value`` holds piece ids or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        keys = sorted(keys)
        size = 1 << 20
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free_from, wide_from, todo = 257, 0, [(0, 0, 0, len(keys))]
        taken = bytearray(size)
        taken[0] = 1
        while todo:
            node, depth, lo, hi = todo.pop()
            if lo < hi and len(keys[lo][0]) == depth:
                value[node] = keys[lo][1]
                lo += 1
            children, at = [], lo
            while at < hi:
                c, first = keys[at][0][depth], at
                while at < hi and keys[at][0][depth] == c:
                    at += 1
                children.append((c + 1, first, at))
            if not children:
                continue
            if len(children) == 1:  # fits any free place
                while taken[free_from]:
                    free_from += 1
                b = free_from - children[0][0]
            else:
                b, tries = wide_from, 0
                while any(taken[b + c] for c, _, _ in children):
                    b += 1
                    tries += 1
                if tries > 50:  # this stretch is nearly full for wide nodes; single ones still use it
                    wide_from = b
            if b + 512 > len(taken):
                more = len(taken)
                base, check, value = (np.concatenate([a, np.full(more, f, np.int32)]) for a, f in ((base, 0), (check, -1), (value, -1)))
                taken += bytes(more)
            base[node] = b
            for c, first, end in children:
                taken[b + c] = 1
                check[b + c] = node
                todo.append((b + c, depth + 1, first, end))
        used = len(taken) - next(i for i, t in enumerate(reversed(taken)) if t) + 257
        self.base, self.check, self.value = (np.resize(a[:used], used) for a in (base, check, value))

    def prefixes(self, data: bytes, at: int):
        """(end, id) of every key that starts at ``at``."""
        node = 0
        for end in range(at, len(data)):
            child = self.base[node] + data[end] + 1
            if child >= len(self.check) or self.check[child] != node:
                return
            node = child
            if self.value[node] >= 0:
                yield end + 1, int(self.value[node])


class Pieces:
    """Pieces and scores of a model file, and the trie over the ordinary ones."""

    def __init__(self, model_path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.score = np.array([model.get_score(i) for i in range(n)], np.float64)
        self.byte_id = np.zeros(256, np.int64)
        raw = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                b = int(self.names[i][1:-1], 16)
                self.byte_id[b] = i
                raw[i] = bytes([b])
        for i in plain:
            raw[i] = self.names[i].replace(MARK, " ").encode()
            if "\n" in self.names[i] or MARK in self.names[i].lstrip(MARK):
                raise ValueError("a piece crosses a white-space marker or a line feed")
        self.raw = raw
        self.is_byte = np.array([model.is_byte(i) for i in range(n)])
        self.unknown = float(self.score[plain].min()) - UNKNOWN_PENALTY
        # the trie reads a space for the marker, so texts need no rewriting
        self.trie = DoubleArray([(raw[i], i) for i in plain])
        self.longest = max(len(raw[i]) for i in plain)


def char_size(byte):
    return np.where(byte < 0x80, 1, np.where(byte < 0xE0, 2, np.where(byte < 0xF0, 3, 4)))


def viterbi(data: bytes, pieces: Pieces) -> list[int]:
    """Ids of the best segmentation of one chunk."""
    n = len(data)
    best, back = [-np.inf] * (n + 1), [(0, 0)] * (n + 1)
    best[0], at = 0.0, 0
    while at < n:
        size, single = int(char_size(np.uint8(data[at]))), False
        for end, i in pieces.trie.prefixes(data, at):
            single |= end - at == size
            s = best[at] + pieces.score[i]
            if s > best[end]:
                best[end], back[end] = s, (at, i)
        if not single and best[at] + pieces.unknown > best[at + size]:
            best[at + size] = best[at] + pieces.unknown
            for k in range(size):
                back[at + k + 1] = (at + k, int(pieces.byte_id[data[at + k]]))
        at += size
    ids = []
    while n:
        n, i = back[n]
        ids.append(i)
    return ids[::-1]


def viterbi_many(chunks: list[bytes], pieces: Pieces) -> list[np.ndarray]:
    """The same for many chunks side by side, longest first: step ``at`` walks the trie from byte ``at`` of all that have one."""
    out: list = [None] * len(chunks)
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    for i in np.flatnonzero(sizes > LONG):
        out[i] = np.array(viterbi(chunks[i], pieces), np.int32)
    order = np.flatnonzero(sizes <= LONG)
    order = order[np.argsort(-sizes[order], kind="stable")]
    trie, score = pieces.trie, pieces.score
    for lo in range(0, len(order), TABLE):
        rows = order[lo:lo + TABLE]
        n, width, size = len(rows), int(sizes[rows[0]]), sizes[rows]
        text = np.zeros((n, width), np.uint8)
        text[np.arange(width) < size[:, None]] = np.frombuffer(b"".join([chunks[i] for i in rows]), np.uint8)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back_id, back_size = np.zeros((n, width + 1), np.int32), np.ones((n, width + 1), np.int16)
        for at in range(width):
            live = np.flatnonzero((size > at) & ((text[:, at] & 0xC0) != 0x80))
            if not len(live):
                continue
            step = char_size(text[live, at])
            node, single = np.zeros(len(live), np.int64), np.zeros(n, bool)
            row, need = live, step
            for end in range(at, min(width, at + pieces.longest)):
                child = trie.base[node] + text[row, end].astype(np.int64) + 1
                fits = (size[row] > end) & (trie.check[np.minimum(child, len(trie.check) - 1)] == node) & (child < len(trie.check))
                row, node, need = row[fits], child[fits], need[fits]
                if not len(row):
                    break
                ids = trie.value[node]
                hit = ids >= 0
                if hit.any():
                    r, i = row[hit], ids[hit]
                    single[r[need[hit] == end - at + 1]] = True
                    s = best[r, at] + score[i]
                    better = s > best[r, end + 1]
                    r, i = r[better], i[better]
                    best[r, end + 1], back_id[r, end + 1], back_size[r, end + 1] = s[better], i, end + 1 - at
            lost = ~single[live]
            if lost.any():
                r, k = live[lost], step[lost]
                s = best[r, at] + pieces.unknown
                better = s > best[r, at + k]
                r, k = r[better], k[better]
                best[r, at + k] = s[better]
                for j in range(int(k.max(initial=0))):
                    q = r[k > j]
                    back_id[q, at + j + 1], back_size[q, at + j + 1] = pieces.byte_id[text[q, at + j]], 1
        pos, taken = size.copy(), []
        everyone = np.arange(n)
        while (pos > 0).any():
            taken.append(np.where(pos > 0, back_id[everyone, pos], -1))
            pos = np.where(pos > 0, pos - back_size[everyone, pos], 0)
        ids = np.array(taken[::-1], np.int32).T.reshape(n, -1)
        keep = ids >= 0
        for i, own in zip(rows, np.split(ids[keep], np.cumsum(keep.sum(1))[:-1])):
            out[i] = own
    return out


def encode_texts(texts: list[str], pieces: Pieces) -> list[np.ndarray]:
    class Numbers(dict):
        def __missing__(self, chunk):
            self[chunk] = len(self)
            return len(self) - 1
    number = Numbers()
    coded = [np.fromiter(map(number.__getitem__, words), np.int64, len(words))
             for words in (CHUNK.findall(" " + t) if t else [] for t in texts)]
    if not number:
        return [np.zeros(0, np.int32) for _ in texts]
    ids = viterbi_many([c.encode() for c in number], pieces)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat, start = np.concatenate(ids), np.cumsum(sizes) - sizes
    out = []
    for own in coded:
        k = sizes[own]
        ends = np.cumsum(k)
        out.append(flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[own] - (ends - k), k)])
    return out


def decode(ids, pieces: Pieces) -> str:
    """Text of ids: markers become spaces, runs of byte pieces UTF-8 (bad bytes U+FFFD), and the first space goes."""
    text = b"".join(map(pieces.raw.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def _slices(texts: pa.Array):
    part, chars = [], 0
    for t in texts:
        part.append(t.as_py() or "")
        chars += len(part[-1])
        if chars > SLICE_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """``docs`` with ``n_ids``, ``n_bytes`` (byte pieces among them), ``ids_crc32`` (little-endian unsigned 32-bit), ``round_trip``
    (decoding gives the text again) and, if asked, ``ids``.

    Defined cases: null and empty texts have no ids and decode to the empty text (``round_trip`` is true); characters that no
    piece holds become bytes; the text's own U+2581 decodes to a space, as in the format; very long texts and very long words
    are segmented whole; rows and other columns are kept, input columns named like the new ones are replaced; an empty table
    stays empty. The broadcast trie is that of the model file.
    """
    held = docs.sparkSession.sparkContext.broadcast(Pieces(model_path))

    def run(texts: pa.Array) -> pa.Array:
        pieces, cols = held.value, [[], [], [], [], []]
        for part in _slices(texts):
            for text, ids in zip(part, encode_texts(part, pieces)):
                values = (len(ids), int(pieces.is_byte[ids].sum()), zlib.crc32(ids.astype("<u4").tobytes()),
                          decode(ids.tolist(), pieces) == text, ids if keep_ids else None)
                for c, v in zip(cols, values):
                    c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["n_ids", "n_bytes", "ids_crc32", "round_trip", "ids"])
    udf = arrow_udf(run, "struct<n_ids long, n_bytes long, ids_crc32 long, round_trip boolean, ids array<int>>")
    names = ["n_ids", "n_bytes", "ids_crc32", "round_trip"] + ["ids"] * keep_ids
    return docs.withColumn("_op9", udf(F.col(text_col).cast("string"))).withColumns({c: F.col(f"_op9.{c}") for c in names}).drop("_op9")


def decode_ids(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``text`` decoded from ``ids_col``; null ids give the empty text, null members are left out."""
    held = rows.sparkSession.sparkContext.broadcast(Pieces(model_path))

    def run(ids: pa.Array) -> pa.Array:
        return pa.array([decode([i for i in x.as_py() or () if i is not None], held.value) for x in ids], pa.string())
    return rows.withColumn("text", arrow_udf(run, "string")(F.col(ids_col)))
