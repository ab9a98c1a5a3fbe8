"""Order-dependent aggregates that stay distributed when one group is very large.

A plain window over ``PARTITION BY key ORDER BY x`` sends the whole group to one task. The helpers
here use two levels instead: rows of a group are cut into consecutive blocks, each block is handled
on its own, and a small per-block table carries prefix totals from one block to the next. A group
that fits one block costs the same shuffle as the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from originflow.session import Written

BLOCK = 4096
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 65_536, 64, 4096

_COMBINE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
_LOCAL = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def block_of(ordinal: Column | str, size: int = BLOCK) -> Column:
    """Block number of a dense 0-based ordinal."""
    c = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.floor(c / F.lit(size)).cast("int")


def running(
    df: DataFrame,
    keys: list[str],
    block: str,
    order: list,
    specs: dict[str, tuple[str, Column]],
    inclusive: bool = False,
) -> DataFrame:
    """Add running aggregates over earlier rows of the group (``inclusive``: up to the row itself).

    ``block`` must be non-decreasing along ``order`` inside a group. ``specs`` maps an output name
    to ``(kind, expression)`` with kind one of sum, count, max, min. Empty prefixes give NULL for
    max/min and 0 for sum/count.
    """
    end = 0 if inclusive else -1
    local = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    carry = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, block).agg(
        *[_LOCAL[kind](expr).alias(f"_t_{name}") for name, (kind, expr) in specs.items()]
    )
    totals = totals.select(
        *keys, block,
        *[_COMBINE[kind](f"_t_{name}").over(carry).alias(f"_c_{name}") for name, (kind, _) in specs.items()],
    )
    out = df.select(
        "*", *[_LOCAL[kind](expr).over(local).alias(f"_l_{name}") for name, (kind, expr) in specs.items()]
    ).join(totals, [*keys, block], "left")
    added = []
    for name, (kind, _) in specs.items():
        loc, car = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind in ("sum", "count"):
            added.append((F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0))).alias(name))
        elif kind == "max":
            added.append(F.greatest(loc, car).alias(name))
        else:
            added.append(F.least(loc, car).alias(name))
    return out.select(*df.columns, *added)


def attach_group(
    df: DataFrame, keys: list[str], ordinal: Column | str, aggs: dict[str, Column], block: int = BLOCK
) -> DataFrame:
    """Attach group-level aggregates to every row without sending a hot group to one task.

    The aggregates are computed with map-side combine, then joined on ``keys`` plus the row's
    block; a group of ``n`` rows has ``ceil(n / block)`` copies of its one aggregate row.
    """
    stats = df.groupBy(*keys).agg(
        *[a.alias(n) for n, a in aggs.items()], F.max(block_of(ordinal, block)).alias("_last")
    )
    stats = stats.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.col("_last")))).drop("_last")
    return df.withColumn("_blk", block_of(ordinal, block)).join(stats, [*keys, "_blk"]).drop("_blk")


def value_edges(df: DataFrame, value: str, n: int | None = None) -> list[float]:
    """Distinct approximate quantiles of a column, ``n - 1`` at most.

    Without ``n`` their number follows the rows, from ``LEAST_BUCKETS`` to ``MOST_BUCKETS`` buckets of about ``BUCKET_ROWS`` rows.
    One aggregate with map-side sketches; at most ``MOST_BUCKETS`` numbers reach the driver.
    """
    most = n or MOST_BUCKETS
    probs = [i / most for i in range(1, most)]
    rows, edges = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")).agg(
        F.count("v"), F.percentile_approx("v", probs, max(2000, 4 * most))).first()
    if n is None:
        step = MOST_BUCKETS // min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS)))
        edges = (edges or [])[step - 1::step]
    return sorted(set(edges or []))


def with_value_bucket(df: DataFrame, value: str, name: str = "_b", n: int | None = None) -> DataFrame:
    """Add a bucket number that is monotone in ``value``; edges are approximate quantiles of the column.

    Odd buckets hold exactly one value (an edge), even ones the values between two edges, so a value with more rows than a
    bucket should have gets a bucket of its own. Edges only balance the work: results that use the buckets are exact whatever
    the edges are. A row finds its place by binary search, in built-in functions.
    """
    edges = value_edges(df, value, n)
    v = F.col(value).cast("double")
    if not edges:
        return df.withColumn(name, F.when(v.isNotNull(), 2).otherwise(0).cast("int"))
    sorted_edges = F.array(*[F.lit(e) for e in edges])
    steps = [1 << k for k in reversed(range(len(edges).bit_length()))]
    below = F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), lambda at, k: F.when(  # edges below v; get is null beyond the last
        F.get(sorted_edges, at + k - 1) < v, at + k).otherwise(at))
    d = df.withColumn("_below", below)
    same = F.coalesce(F.get(sorted_edges, F.col("_below")) == v, F.lit(False)).cast("int")
    return d.withColumn(name, F.when(v.isNotNull(), 2 * (F.col("_below") + 1) + same).otherwise(0).cast("int")).drop("_below")


def range_blocks(df: DataFrame, order: list, name: str = "_b", rows: int | None = None) -> DataFrame:
    """Add a block number that rises along ``order``, with about ``rows`` (``BUCKET_ROWS``) rows a block, whatever the values are.

    Rows are range-partitioned by all columns of ``order``, so that rows with equal leading values are split by those behind.
    The blocks are written: a second sampling pass could cut elsewhere.
    """
    parts = max(1, -(-df.count() // (rows or BUCKET_ROWS)))
    return Written(df.repartitionByRange(parts, *order).withColumn(name, F.spark_partition_id()), "range-blocks").df


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, qs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation at position q(n-1), one row per group.

    Histogram selection: distinct values are counted, bucketed, and only the buckets that hold a
    wanted position are ordered. No group is collected; ``weight`` is an optional row multiplicity.
    """
    src = df.select(*keys, F.col(value).cast("double").alias("_v"),
                    (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    vals = src.filter(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*keys, "_v").agg(F.sum("_w").alias("n"))
    vals = with_value_bucket(vals, "_v")
    per_b = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    heads = vals.groupBy(*keys, "_b").agg(F.sum("n").alias("_bn")).select(
        *keys, "_b", "_bn",
        F.coalesce(F.sum("_bn").over(per_b), F.lit(0)).alias("_before"),
        F.sum("_bn").over(every).alias("_total"),
    )

    # each quantile asks for one or two positions; only buckets and rows that hold one are looked at
    total = F.col("_total") - 1
    asked = F.transform(F.array(*[F.lit(float(q)) for q in qs.values()]), lambda q, i: F.struct(
        i.alias("i"), F.floor(q * total).alias("lo"), F.ceil(q * total).alias("hi"), (q * total - F.floor(q * total)).alias("f")))
    heads = heads.withColumn("_asked", F.filter(asked, lambda p: (
        (p["lo"] < F.col("_before") + F.col("_bn")) & (p["hi"] >= F.col("_before"))))).filter(F.size("_asked") > 0)
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    hit = vals.join(heads.drop("_bn"), [*keys, "_b"]).withColumn(
        "_cum", F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    end = F.col("_cum") + F.col("n")
    hit = hit.select(*keys, "_v", "n", "_cum", "_total", F.explode(F.filter("_asked", lambda p: (
        (p["lo"] < end) & (p["hi"] >= F.col("_cum"))))).alias("p"))
    at = lambda p: F.max(F.when((F.col("_cum") <= p) & (p < end), F.col("_v")))
    per = hit.groupBy(*keys, "p.i").agg(
        at(F.col("p.lo")).alias("_vl"), at(F.col("p.hi")).alias("_vh"), F.max("p.f").alias("_f"), F.max("_total").alias("_t"))
    value_at = F.col("_vl") + (F.col("_vh") - F.col("_vl")) * F.col("_f")
    return per.groupBy(*keys).agg(
        *[F.max(F.when(F.col("i") == i, value_at)).alias(name) for i, name in enumerate(qs)], F.max("_t").alias("n"))
