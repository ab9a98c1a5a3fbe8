"""Report tables over long results: costs, wins, regional means, families, baselines, p-values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originflow.functions.special import Z90, norm_cdf_col
from originflow.operators.metrics import finite
from originflow.operators.ordered import exact_quantiles


def cost_rollup(calls: DataFrame) -> DataFrame:
    """Per model: calls, item successes and failures, parse and API failures, latency and tokens per batch and item.

    ``calls``: model, batch_size, success_items, failed_items, parse_fail, api_fail, latency_ms, prompt_tokens,
    completion_tokens, total_tokens.
    """
    basic = calls.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("success_items").alias("success_items"),
        F.sum("failed_items").alias("failed_items"), F.sum("parse_fail").alias("parse_fail_batches"),
        F.sum("api_fail").alias("api_fail_batches"), F.max("batch_size").alias("batch_size"),
        *[F.avg(c).alias(f"{c}_mean") for c in ("latency_ms", "prompt_tokens", "completion_tokens", "total_tokens")])
    lat = exact_quantiles(calls, ["model"], "latency_ms", {"latency_ms_median": 0.5, "latency_ms_p90": 0.9}).drop("n")
    per = lambda c: F.col(f"{c}_mean") / F.greatest(F.lit(1), F.col("batch_size"))
    return basic.join(lat, "model", "left").withColumns({
        "latency_ms_per_item": per("latency_ms"), "prompt_tokens_per_item": per("prompt_tokens")})


def win_tally(cis: DataFrame, keys: list[str]) -> DataFrame:
    """Over settings: intervals above zero, below zero and across it; intervals without limits do not count."""
    lo, hi = F.col("lo"), F.col("hi")
    d = cis.filter(lo.isNotNull() & hi.isNotNull())
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_settings"), F.count_if(lo > 0).alias("positive_ci"),
        F.count_if((lo <= 0) & (hi < 0)).alias("negative_ci"), F.count_if((lo <= 0) & (hi >= 0)).alias("cross_zero"))


def region_mean(results: DataFrame, region: Column, keys: list[str] = ["method", "target", "metric"]) -> DataFrame:
    return results.filter(region & finite("value")).groupBy(*keys).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_settings"))


def delta_summary(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Size, mean and number of wins; a difference that is zero to nine decimals is one of summation order and no win."""
    d = deltas.filter(finite("delta"))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean_delta"),
                                F.count_if(F.round("delta", 9) > 0).alias("n_positive"))


def pvalue_from_ci(df: DataFrame) -> DataFrame:
    """Approximate standard error, z and p-values from an observed value and its 5 % / 95 % limits."""
    se = (F.col("hi") - F.col("lo")) / (2.0 * Z90)
    d = df.withColumn("se", se).withColumn(
        "z", F.when(F.col("se") > 0, F.col("observed") / F.col("se")).otherwise(F.lit(float("inf"))))
    d = d.withColumn("_c", norm_cdf_col(F.col("z")))
    return d.withColumn("p_one_sided", 1.0 - F.col("_c")).withColumn(
        "p_two_sided", F.least(F.lit(1.0), 2.0 * F.least("_c", 1.0 - F.col("_c")))).drop("_c")


def family_average(effects: DataFrame, keys: list[str]) -> DataFrame:
    """Mean effect of a family; its error joins the within-member errors and the spread between members."""
    g = effects.groupBy(*keys).agg(F.avg("observed").alias("observed"), F.count(F.lit(1)).alias("n"),
                                   F.sum(F.col("se") * F.col("se")).alias("_w"), F.stddev_pop("observed").alias("_b"))
    se = F.sqrt(F.col("_w") / (F.col("n") * F.col("n")) + F.col("_b") * F.col("_b") / F.col("n"))
    return g.withColumn("se", se).drop("_w", "_b").withColumns(
        {"lo": F.col("observed") - Z90 * F.col("se"), "hi": F.col("observed") + Z90 * F.col("se")})


def delta_vs_baseline(means: DataFrame, baseline: str, metrics: list[str], method: str = "method") -> DataFrame:
    """Metric table of all methods with differences to one named method (a single row)."""
    base = means.filter(F.col(method) == baseline)
    out = means
    for m in metrics:
        out = out.withColumn(f"delta_{m}", F.col(m) - base.select(m).scalar())
    return out
