"""Reading scored and listwise model responses, with the fallbacks for damaged JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BARE_NUMBER = r"(?<=[:,\[\s])-?(NaN|Infinity)(?=[,\]}\s])"


def _loose(c: Column) -> Column:
    """The JSON text: the whole response when valid, else its outermost braces when those are, else NULL."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), BARE_NUMBER, "null")
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(t).isNotNull(), t).when(F.try_parse_json(inner).isNotNull(), inner)


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``, also where the optimizer inlines columns."""
    return F.transform(F.array(value), body)[0]


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def parse_scores(df: DataFrame, response: str, n_items: Column | int) -> DataFrame:
    """Add ``scores``: array of (id, adoption_score, reach_score), clipped to 0..100.

    Items are objects or lists. Items that lack a finite number or have an id outside 0..n-1 are
    skipped; of repeated ids the last one counts.
    """
    n = F.lit(n_items) if isinstance(n_items, int) else n_items
    d = df.withColumn("_v", F.try_parse_json(_loose(F.col(response))))
    d = d.withColumn("_items", F.coalesce(_get(F.col("_v"), "$.scores", "array<variant>"), F.array().cast("array<variant>")))
    num = lambda x, a, b: F.coalesce(_get(x, a, "double"), _get(x, b, "double"))
    clip = lambda x: F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))
    read = F.transform("_items", lambda x: F.struct(
        num(x, "$.id", "$[0]").cast("int").alias("id"), num(x, "$.adoption_score", "$[1]").alias("a"),
        num(x, "$.reach_score", "$[2]").alias("r")))
    inf = F.lit(float("inf"))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)
    d = d.withColumn("_n", n)
    kept = F.filter(read, lambda x: x["id"].isNotNull() & (x["id"] >= 0) & (x["id"] < F.col("_n")) & good(x["a"]) & good(x["r"]))
    last = lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda z: z["id"] == x["id"]))
    return d.withColumn("scores", _bind(kept, lambda all_: F.transform(last(all_), lambda x: F.struct(
        x["id"].alias("id"), clip(x["a"]).alias("adoption_score"), clip(x["r"]).alias("reach_score"))))).drop("_v", "_items", "_n")


def parse_selection(df: DataFrame, response: str, candidates: str, r: int) -> DataFrame:
    """Add ``selected`` (id, attention, attention_norm, reason) and ``status`` for a choice of ``r`` ids.

    ``candidates`` is an array column of allowed ids. Status is empty when all is well, else json_decode,
    json_recovered, missing_selected or too_few_selected.
    """
    text = F.coalesce(F.col(response), F.lit(""))
    d = df.withColumn("_v", F.try_parse_json(_loose(F.col(response))))
    lists = [_get(F.col("_v"), f"$.{k}", "array<variant>") for k in ("selected", "selections")]
    other = [_get(F.col("_v"), f"$.{k}", "variant") for k in ("selected", "selections")]
    some = lambda a: F.when(F.size(a) > 0, a)
    truthy = lambda v: v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(True))
    wrong = (truthy(other[0]) & lists[0].isNull()) | (
        some(lists[0]).isNull() & truthy(other[1]) & lists[1].isNull())
    d = d.withColumn("_items", F.coalesce(some(lists[0]), some(lists[1]), F.array().cast("array<variant>")))
    d = d.withColumn("_wrong", F.col("_v").isNotNull() & F.coalesce(wrong, F.lit(False)))
    read = F.transform("_items", lambda x: F.struct(
        _get(x, "$.id", "double").cast("int").alias("id"),
        F.coalesce(_get(x, "$.attention", "double"), _get(x, "$.attention_points", "double"), F.lit(0.0)).alias("attention"),
        F.coalesce(_get(x, "$.reason", "string"), F.lit("")).alias("reason")))
    pattern = r'(?s)"id"\s*:\s*(\d+).*?"attention"\s*:\s*([0-9.]+)'
    found = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2),
        lambda a, b: F.struct(a.cast("int").alias("id"), b.try_cast("double").alias("attention"), F.lit("").alias("reason")))
    d = d.withColumn("_read", F.when(F.col("_v").isNotNull(), read).otherwise(found))
    allowed = F.filter("_read", lambda x: x["id"].isNotNull() & F.array_contains(F.col(candidates), x["id"]))
    first = lambda ok: F.filter(ok, lambda x, i: ~F.exists(F.slice(ok, 1, i), lambda z: z["id"] == x["id"]))
    d = d.withColumn("_pick", _bind(allowed, lambda ok: F.slice(first(ok), 1, r)))
    enough = F.size("_pick") >= r
    status = (F.when(F.col("_v").isNull(), F.when(enough, "json_recovered").otherwise("json_decode"))
              .when(F.col("_wrong"), "missing_selected").when(~enough, "too_few_selected").otherwise(""))
    d = d.withColumn("status", status)
    d = d.withColumn("_pick", F.when(F.col("status").isin("json_decode", "missing_selected"), F.slice("_pick", 1, 0))
                     .otherwise(F.col("_pick")))
    pos = lambda x: F.greatest(F.lit(0.0), x["attention"])
    d = d.withColumn("_tot", F.aggregate("_pick", F.lit(0.0), lambda a, x: a + pos(x)))
    norm = lambda x: (F.when(F.col("status") == "too_few_selected", F.lit(None).cast("double"))
                      .when(F.col("_tot") > 0, pos(x) / F.col("_tot"))
                      .when(F.col("status") == "json_recovered", F.lit(0.0))
                      .otherwise(F.lit(1.0) / F.size("_pick")))
    return d.withColumn("selected", F.transform("_pick", lambda x: F.struct(
        x["id"].alias("id"), x["attention"].alias("attention"), norm(x).alias("attention_norm"),
        x["reason"].alias("reason")))).drop("_v", "_items", "_wrong", "_read", "_pick", "_tot")
