"""Shortlist workflow: item payloads and keys, candidate pools, prompts, and capture of the outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from originflow.functions.text import anonymize, content_key, rounded
from originflow.operators.ordered import running

PAYLOAD = {  # payload field: panel column (fixed values)
    "followers_log1p": "origin_logfoll", "origin_rank_log": "log_origin_rank", "elapsed_hours": "elapsed_hours",
    "stance": "origin_stance", "global_novelty": "novelty_global", "event_novelty": "novelty_event",
    "historical_origin_count_log1p": "hist_log_origin_count", "historical_mean_adoption_log1p": "hist_mean_log_adopt",
    "historical_success_rate": "hist_success_rate",
}


def item_payload(text: Column) -> Column:
    """The twelve fields an outside scorer may see, in name order: anonymised text and rounded context."""
    cells = {name: rounded(F.col(col)) for name, col in PAYLOAD.items()}
    cells["text"] = anonymize(text)
    cells["verified"] = (F.col("origin_verified") > 0).cast("int")
    cells["prior_frame_count"] = F.col("prior_frame_count").cast("int")
    return F.struct(*[cells[k].alias(k) for k in sorted(cells)])


def with_item_key(panel: DataFrame, text: str = "text") -> DataFrame:
    return panel.withColumn("payload", item_payload(F.col(text))).withColumn("uid", content_key(F.col("payload")))


def _digest(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[F.lit(str(p)) if not isinstance(p, Column) else p.cast("string") for p in parts]))


def candidate_pools(
    panel: DataFrame, scores: dict[str, str], uid: str = "uid", y: str = "log_future_reach", raw: str = "future_reach",
    ks: tuple[int, ...] = (10, 20, 30), shortlists: tuple[int, ...] = (10, 20), seed: int = 50, split: str = "test",
    limit_days: int | None = None,
) -> DataFrame:
    """Tasks per test day: a seeded pool of max(ks) candidates and the ids each policy shows.

    Days need max(ks) candidates. ``limit_days`` keeps the densest days (a report option). Pools are cut
    before the shuffle; everything after works on at most max(ks) rows per day.
    """
    top = max(ks)
    rows = panel.filter((F.col("split") == split) & F.col(y).isNotNull()).select(
        "day", F.col(uid).alias("uid"), "event_id", "frame_j", F.col(y).alias("y"), F.col(raw).alias("raw"),
        *[F.col(c).alias(f"s_{n}") for n, c in scores.items()])
    days = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n_day")).filter(F.col("n_day") >= top)
    if limit_days is not None:
        days = days.orderBy(F.desc("n_day"), "day").limit(limit_days)
    shuffled = Window.partitionBy("day").orderBy(_digest(seed, F.col("uid")), "event_id", "frame_j")
    pool = rows.join(days, "day").withColumn("pos", F.row_number().over(shuffled)).filter(F.col("pos") <= top)
    w = Window.partitionBy("day")
    cols = {}
    for b in shortlists:
        cols[f"o_random_b{b}"] = F.row_number().over(w.orderBy(_digest(seed, b, F.col("uid")), "event_id", "frame_j"))
    for n in scores:
        cols[f"o_{n}"] = F.when(F.col(f"s_{n}").isNotNull(), F.row_number().over(w.orderBy(F.desc_nulls_last(f"s_{n}"), "uid", "event_id", "frame_j")))
    pool = pool.withColumns(cols)
    policies = []
    none = F.lit(None).cast("int")

    def policy(name, family, k, b, place, limit):
        return F.struct(F.lit(name).alias("policy"), F.lit(family).alias("family"), F.lit(k).alias("k"), b.alias("shortlist"),
                        F.when(place <= limit, place - 1).cast("int").alias("cid"))

    for k in ks:
        policies.append(policy(f"full_k{k}", "full", k, none, F.col("pos"), k))
    for b in shortlists:
        policies.append(policy(f"random_b{b}", "random", top, F.lit(b), F.col(f"o_random_b{b}"), b))
        for n in scores:
            policies.append(policy(f"{n}_b{b}", n, top, F.lit(b), F.col(f"o_{n}"), b))
    return pool.select("day", "uid", "event_id", "frame_j", "y", "raw", "pos", F.explode(F.array(*policies)).alias("p")).select(
        "day", "p.*", "uid", "event_id", "frame_j", "y", "raw", "pos").filter(F.col("cid").isNotNull())


def capture(tasks: DataFrame, selections: DataFrame) -> DataFrame:
    """Per (day, policy): outcome caught by the selected ids against the best possible among the shown and the pool.

    ``selections``: (day, policy, cid, attention_norm). The pool of a day is its largest full task.
    """
    keys = ["day", "policy"]
    shown = tasks.join(selections.select(*keys, "cid", "attention_norm"), [*keys, "cid"], "left")
    w = Window.partitionBy(*keys)
    shown = shown.withColumns({
        "r": F.count("attention_norm").over(w),
        "by_y": F.row_number().over(w.orderBy(F.desc("y"), "uid", "event_id", "frame_j")),
        "by_raw": F.row_number().over(w.orderBy(F.desc("raw"), "uid", "event_id", "frame_j"))})
    p = F.greatest(F.lit(0.0), F.col("attention_norm"))
    picked = F.col("attention_norm").isNotNull()
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0.0))
    per = shown.groupBy(*keys, "family", "k", "shortlist").agg(
        F.max("r").alias("r"), total(picked, "y").alias("selected_log_reach"), total(picked, "raw").alias("selected_raw_reach"),
        total(F.col("by_y") <= F.col("r"), "y").alias("_best"), total(F.col("by_raw") <= F.col("r"), "raw").alias("_best_raw"),
        F.sum(F.when(p > 0, -p * F.log(p))).alias("_h"))
    full = tasks.filter(F.col("family") == "full")
    pool = full.groupBy("day", "event_id", "frame_j", "uid").agg(F.max("y").alias("y"))
    place = Window.partitionBy("day").orderBy(F.desc("y"), "uid", "event_id", "frame_j")
    best = pool.withColumn("i", F.row_number().over(place)).withColumn(
        "top_sum", F.sum("y").over(place.rowsBetween(Window.unboundedPreceding, 0))).select("day", F.col("i").alias("r"), "top_sum")
    floor = lambda c: F.greatest(c, F.lit(1e-12))
    return per.join(best, ["day", "r"], "left").select(
        *keys, "family", "k", "shortlist", "r", "selected_log_reach", "selected_raw_reach",
        (F.col("selected_log_reach") / floor(F.col("_best"))).alias("capture_within_shown"),
        (F.col("selected_raw_reach") / floor(F.col("_best_raw"))).alias("raw_capture_within_shown"),
        (F.col("selected_log_reach") / floor(F.coalesce("top_sum", F.lit(0.0)))).alias("selected_vs_full_pool_oracle"),
        F.when(F.col("_h").isNotNull(), F.col("_h") / floor(F.log(F.col("r").cast("double")))).alias("attention_entropy"))


def build_prompts(items: DataFrame, by: list[str], order: str, payload: str, head: list[str]) -> DataFrame:
    """One prompt per (bounded) task: the instruction lines, then the payloads with ids as one JSON list."""
    cell = F.struct(F.col(order).alias("id"), F.col(payload).alias("p"))
    got = items.groupBy(*by).agg(F.array_sort(F.collect_list(cell)).alias("_l"))
    inner = [f.name for f in items.schema[payload].dataType.fields]
    rows = F.transform("_l", lambda x: F.struct(x["id"].alias("id"), *[x["p"][f].alias(f) for f in inner]))
    return got.select(*by, F.size("_l").alias("n_items"), F.concat_ws(
        "\n", *[F.lit(h) for h in head], F.to_json(rows, {"ignoreNullFields": "false"})).alias("prompt"))


def batched(items: DataFrame, key: str, size: int = 10) -> DataFrame:
    """Batches of ``size`` items in key order, from exact distributed positions."""
    from originflow.operators.actors import dense_position

    d = dense_position(items, [], F.col(key), key)
    return d.withColumn("batch", F.floor((F.col("_pos") - 1) / size)).withColumn(
        "id", ((F.col("_pos") - 1) % size).cast("int")).drop("_pos")


def eval_candidates(panel: DataFrame, y: str = "log_future_reach", split: str = "test") -> DataFrame:
    """Rows of events with at least two candidates, all outcomes known and the best one positive."""
    rows = panel.filter(F.col("split") == split)
    ok = rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.count(y).alias("m"), F.max(y).alias("t")).filter(
        (F.col("n") >= 2) & (F.col("n") == F.col("m")) & (F.col("t") > 0)).select("event_id")
    return rows.join(ok, "event_id", "left_semi")


def spread_sample(rows: DataFrame, n: int, group: list[str], order: list[str]) -> DataFrame:
    """``n`` evenly spaced rows in (group, order) order; all rows when there are not more.

    Positions come from prefix counts over groups plus the place inside a group.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    first = group[0]
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("c"))
    sizes = running(sizes, [], first, group[1:] or [first], {"off": ("sum", F.col("c"))}).drop("c")
    total = rows.agg(F.count(F.lit(1))).scalar()
    d = rows.withColumn("_r", F.row_number().over(w)).join(sizes, group).withColumn("_n", total)
    d = d.withColumn("_i", F.col("off") + F.col("_r") - 1)
    # index j of the sample is floor(j (N - 1) / (n - 1)); row i is taken when some j lands on it
    j = F.ceil(F.col("_i") * (n - 1) / (F.col("_n") - 1))
    hit = (j <= n - 1) & (F.floor(j * (F.col("_n") - 1) / (n - 1)) == F.col("_i"))
    return d.filter((F.col("_n") <= n) | hit).drop("_r", "off", "_n", "_i")
