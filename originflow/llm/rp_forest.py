"""Embedding near-dedup with a random-projection tree forest.

In each tree every level splits the nodes of a label in two by a random direction through the label's centroid, again and
again until a leaf holds about ``LEAF`` vectors. A vector close to a plane spills over to both sides. Vectors are compared
within leaves only, in double precision, and links are united.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originflow.llm.common import Staged, split_hot, usable_vector
from originflow.llm.components import components

THRESHOLD, TREES, LEAF, SPILL, MAX_SPILLED, SEED = 0.93, 8, 1024, 0.5, 6, 7
MAX_LEVELS = 48
SHRINK = 2 / 1.16  # a level with this spill divides a node by about that


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _sums(batches):
    """Sums of unit vectors by label and length."""
    for b in batches:
        t = pa.Table.from_batches([b])
        out = []
        for key in {(r["label"], r["dim"]) for r in t.select(["label", "dim"]).group_by(["label", "dim"]).aggregate([]).to_pylist()}:
            mask = (t["label"].to_numpy() == key[0]) & (t["dim"].to_numpy() == key[1])
            x = matrix(t["e"].filter(pa.array(mask)).combine_chunks(), key[1])
            x /= np.sqrt((x * x).sum(1))[:, None]
            out += [(key[0], key[1], i, s, len(x)) for i, s in enumerate(x.sum(0).tolist())]
        cols = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, (b.schema.field("label").type, pa.int32(), pa.int32(),
                                                                                  pa.float64(), pa.int64()))],
                                         ["label", "dim", "i", "s", "n"])


def levels_for(n: int, leaf: int) -> int:
    return int(min(MAX_LEVELS, max(0, np.ceil(np.log(max(n, 1) / leaf) / np.log(SHRINK)))))


def sides(unit: np.ndarray, centre: np.ndarray, levels: int, trees: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row and tree the levels at which it may go left and right, as bit masks."""
    dim = unit.shape[1]
    left, right = np.zeros((len(unit), trees), np.int64), np.zeros((len(unit), trees), np.int64)
    near = SPILL * np.sqrt((2 - 2 * threshold) / dim)
    bits = np.int64(1) << np.arange(levels, dtype=np.int64)
    for t in range(trees):
        r = np.random.default_rng([SEED, dim, t]).standard_normal((MAX_LEVELS, dim))[:levels]
        p = (unit - centre) @ (r / np.linalg.norm(r, axis=1, keepdims=True)).T
        gap = np.abs(p)
        spilled = (gap < near) & (gap.argsort(1).argsort(1) < MAX_SPILLED)
        left[:, t] = ((p < 0) | spilled) @ bits
        right[:, t] = ((p >= 0) | spilled) @ bits
    return left, right


def leaves_of(left: int, right: int, levels: int) -> list[int]:
    """All leaves of one row in one tree: bit i of a leaf is set where it went right at level i."""
    out = [right & ~left]
    for i in range(levels):
        if left & right & 1 << i:
            out += [x | 1 << i for x in out]
    return out


def _leaves(trees, leaf, threshold):
    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            keys = t.select(["label", "dim"]).group_by(["label", "dim"]).aggregate([]).to_pylist()
            for key in keys:
                part = t.filter(pa.array((t["label"].to_numpy() == key["label"]) & (t["dim"].to_numpy() == key["dim"]))).combine_chunks()
                dim, levels = key["dim"], levels_for(part["n"][0].as_py(), leaf)
                x = matrix(part["e"].chunk(0), dim)
                x /= np.sqrt((x * x).sum(1))[:, None]
                left, right = sides(x, np.array(part["centre"][0].as_py()), levels, trees, threshold)
                rows, tree, node = [], [], []
                for i in range(len(x)):
                    for k in range(trees):
                        for leaf_id in leaves_of(int(left[i, k]), int(right[i, k]), levels):
                            rows.append(i)
                            tree.append(k)
                            node.append(leaf_id)
                for at in range(0, len(rows), 20_000):
                    own = rows[at:at + 20_000]
                    got = part.select(["label", "dim", "rid", "copies", "e"]).take(pa.array(own, pa.int64())).combine_chunks()
                    yield pa.RecordBatch.from_arrays(
                        [*(c.chunk(0) for c in got.columns), pa.array([levels] * len(own), pa.int32()), pa.array(tree[at:at + 20_000], pa.int32()),
                         pa.array(node[at:at + 20_000], pa.int64()), pa.array(list(left[own]), pa.list_(pa.int64())),
                         pa.array(list(right[own]), pa.list_(pa.int64()))],
                        ["label", "dim", "rid", "copies", "e", "levels", "tree", "leaf", "left", "right"])
    return run


def spanning_roots(linked: np.ndarray) -> np.ndarray:
    """The first row that each row of a symmetric link matrix reaches."""
    root = np.full(len(linked), -1)
    for i in np.flatnonzero(linked.any(1)):
        if root[i] < 0:
            todo = np.array([i])
            root[i] = i
            while len(todo):
                todo = np.flatnonzero(linked[todo].any(0) & (root < 0))
                root[todo] = i
    return root


def _compare(threshold):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rid, copies, own = (group[c].to_numpy() for c in ("rid", "copies", "own_block"))
        dim, levels, tree, leaf = (group[c][0].as_py() for c in ("dim", "levels", "tree", "leaf"))
        a_block, b_block = group["pair_a"][0].as_py(), group["pair_b"][0].as_py()
        x = matrix(group["e"].chunk(0), dim)
        x /= np.sqrt((x * x).sum(1))[:, None]
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if a_block != b_block:  # pairs inside a block have a group of their own
            linked &= own[:, None] != own[None, :]
        roots = spanning_roots(linked)
        # a pair is counted in the first tree where it shares a leaf, in its leftmost shared leaf there
        i, j = np.nonzero(np.triu(linked))
        left, right = (np.array(group[c].to_pylist(), np.int64).reshape(len(rid), -1) for c in ("left", "right"))
        full = np.int64((1 << levels) - 1)
        first = (full & ~(left[i, tree] & left[j, tree])) == leaf
        for t in range(tree):
            first &= ((left[i, t] & left[j, t]) | (right[i, t] & right[j, t])) != full
        i, j = i[first], j[first]
        n = np.bincount(i, copies[j], len(rid)) + np.bincount(j, copies[i], len(rid))
        rows = np.flatnonzero(roots >= 0)
        return pa.table({"a": rid[rows], "b": rid[roots[rows]], "n": n[rows].astype(np.int64)})
    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row; links join vectors of one label with cosine >= ``threshold``.

    No pair below the threshold is linked; a pair at the threshold is missed by one tree with a probability of about 2.5 % a
    level and by all trees with its ``trees``-th power, closer pairs far less. Equal vectors of a label are one vector with a
    number of copies before anything is compared. A leaf that stays large is split into blocks whose pairs are compared in
    groups of their own. Groups give one row per linked vector (its count and one spanning link), never pairs: each pair is
    counted once, which its two rows can tell from their sides alone.

    Defined cases: vectors that are null, zero or hold null or non-finite components, and rows with a null label, have no
    links and are their own component; so are rows with a null id (component null, not kept). Only vectors of equal length
    are compared. Rows that repeat an id are vectors of their own. Other columns are not read; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("e")) \
        .withColumn("ok", usable_vector("e") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()) \
        .withColumns({"h1": F.when(F.col("ok"), F.xxhash64("e")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit("b"), "e"))})
    key = ["label", "h1", "h2"]
    reps = Staged(rows.filter("ok").groupBy(*key).agg(F.min("vec_id").alias("rid"), F.count("*").alias("copies"), F.first("e").alias("e"))
                  .withColumn("dim", F.size("e")), "forest-vectors").df
    sums = reps.select("label", "dim", "e").mapInArrow(_sums, f"label {reps.schema['label'].dataType.simpleString()}, dim int, i int, s double, n long")
    centres = sums.groupBy("label", "dim", "i").agg((F.sum("s") / F.sum("n")).alias("c"), F.sum("n").alias("n")) \
        .groupBy("label", "dim").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "c"))).alias("cs")) \
        .select("label", "dim", "n", F.expr("transform(cs, x -> x.c)").alias("centre"))
    kinds = {f.name: f.dataType.simpleString() for f in reps.schema}
    leaves = reps.select("label", "dim", "rid", "copies", "e").join(Staged(centres, "forest-centres").df, ["label", "dim"]).mapInArrow(
        _leaves(trees, leaf, threshold),
        f"label {kinds['label']}, dim int, rid {kinds['rid']}, copies long, e {kinds['e']}, levels int, tree int, leaf long, "
        "left array<long>, right array<long>")
    groups = ["label", "dim", "tree", "leaf"]
    found = Staged(split_hot(leaves, groups, F.xxhash64("rid"), leaf).groupBy(*groups, "pair_a", "pair_b")
                   .applyInArrow(_compare(threshold), f"a {kinds['rid']}, b {kinds['rid']}, n long"), "forest-links").df
    roots = components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n"))
    placed = reps.select(*key, "rid", "copies").join(counts, "rid", "left").join(roots, F.col("rid") == F.col("node"), "left") \
        .select(*key, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "rid").alias("c"))
    return rows.select("vec_id", *key).join(placed, key, "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("c", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.vec_id = c.vec_id
"""
