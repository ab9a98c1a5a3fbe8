"""Line dedup: lines that many documents share are dropped everywhere but in one document.

The lines of each text are exploded into keys, hashed to 128 bits and counted over distinct documents; lines whose key is
over the threshold are dropped and the rest joined again by position.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from originflow.llm.common import Staged

SPACE = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]
MIN_CHARS, MIN_DOCS = 40, 5
SALTS = 16  # parts of a key's documents when they meet the hot keys, of which each then has that many rows


def line_key(line: str) -> str:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip(SPACE).encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def key_hash(key: str) -> tuple[int, int]:
    """128 bits as two signed longs."""
    d = xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _keys_of(min_chars):
    def run(batches):
        for b in batches:
            ids, h1, h2 = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                seen = set()
                for line in (text.as_py() or "").split("\n"):
                    if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                        seen.add(key_hash(key))
                for a, c in seen:
                    ids.append(doc_id)
                    h1.append(a)
                    h2.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(h1, pa.int64()),
                                              pa.array(h2, pa.int64())], ["doc_id", "h1", "h2"])
    return run


def _keep_of(min_chars):
    def keep(texts: pa.Array, drops: pa.Array) -> pa.Array:
        kept, total, dropped = [], [], []
        for text, drop in zip(texts, drops):
            lines = (text.as_py() or "").split("\n")
            out = lines
            if gone := {(d["h1"], d["h2"]) for d in drop.as_py() or ()}:
                out = [x for x in lines if len(x) < min_chars or len(k := line_key(x)) < min_chars or key_hash(k) not in gone]
            kept.append("\n".join(out))
            total.append(len(lines))
            dropped.append(len(lines) - len(out))
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())],
                                          ["text", "n_lines", "n_dropped"])
    return keep


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text_col`` reduced to the kept lines, ``n_lines`` (before) and ``n_dropped`` (both long).

    A key of at least ``min_chars`` code points found in at least ``min_docs`` distinct ids loses all its lines except in the
    largest id that holds it. Defined cases: a null or empty text is one empty line and gives an empty text. Rows that share
    an id count as one document, and all of them are treated alike. A row with a null id never counts and is never the one
    that keeps a line. Other columns stay; input columns named ``n_lines`` or ``n_dropped`` are replaced. An empty table
    gives an empty table.

    Plan: distinct counts are combined before the shuffle, so a line that all documents share sends one row per task; when
    line keys meet hot keys, a key's documents are dealt into ``SALTS`` parts; no list is longer than a document.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    keys = Staged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
                  .mapInArrow(_keys_of(min_chars), f"doc_id {id_type}, h1 long, h2 long"), "line-keys").df
    hot = keys.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")) \
        .filter(F.col("n") >= min_docs).select("h1", "h2", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    drops = salted.join(hot, ["h1", "h2", "salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))) \
        .groupBy(F.col("doc_id").alias("_op5_id")).agg(F.collect_list(F.struct("h1", "h2")).alias("_op5_drops"))
    keep = arrow_udf(_keep_of(min_chars), "struct<text string, n_lines long, n_dropped long>")
    out = docs.join(drops, docs[id_col].eqNullSafe(F.col("_op5_id")), "left") \
        .withColumn("_op5", keep(F.col(text_col).cast("string"), F.col("_op5_drops")))
    return out.withColumns({text_col: F.col("_op5.text"), "n_lines": F.col("_op5.n_lines"), "n_dropped": F.col("_op5.n_dropped")}) \
        .drop("_op5", "_op5_id", "_op5_drops")


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM lines
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), hot AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.*, hot.key IS NOT NULL AND k.doc_id <> hot.keeper AS gone FROM k LEFT JOIN hot ON k.key = hot.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
