"""Shortlist workflow, model responses and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originflow.catalog.core import _anonymize_sql
from originflow.catalog.modelling import _DELTA_SQL, _deltas
from originflow.catalog.ranking import events as method_events
from originflow.catalog.registry import query
from originflow.catalog.shared import Shared, big, rounded6
from originflow.catalog.sql import PIECES, compose, q, r6
from originflow.functions.responses import parse_scores as read_scores, parse_selection as read_selection
from originflow.functions.text import rounded as round_half_even
from originflow.operators import reports, shortlist
from originflow.session import cut
from originflow.sources import stores

# ---- item keys and pools ---------------------------------------------------------------------

_FIELDS = {
    "elapsed_hours": "elapsed_hours", "event_novelty": "novelty_event", "followers_log1p": "origin_logfoll", "global_novelty": "novelty_global",
    "historical_mean_adoption_log1p": "hist_mean_log_adopt", "historical_origin_count_log1p": "hist_log_origin_count",
    "historical_success_rate": "hist_success_rate", "origin_rank_log": "log_origin_rank", "stance": "origin_stance"}
_CELLS = {k: f"round_even({c}, 3) + 0.0" for k, c in _FIELDS.items()}
_CELLS |= {"prior_frame_count": "CAST(prior_frame_count AS INTEGER)", "text": _anonymize_sql("text"), "verified": "CASE WHEN origin_verified > 0 THEN 1 ELSE 0 END"}
PIECES["uid"] = (["panel"], "uid AS (SELECT p.*, sha1(CAST(to_json({" + ", ".join(f"'{k}': {_CELLS[k]}" for k in sorted(_CELLS)) + "}) AS VARCHAR)) AS uid FROM panel p JOIN documents USING (doc_id))")


def keyed_panel(s: Shared) -> DataFrame:
    if "keyed_panel" not in s.__dict__:
        s.__dict__["keyed_panel"] = cut(shortlist.with_item_key(s.panel.join(s.table("documents").select("doc_id", "text"), "doc_id")).drop("text"))
    return s.__dict__["keyed_panel"]


@query("item_key", compose("SELECT event_id, CAST(frame_j AS BIGINT) AS frame_j, uid FROM uid", "uid"))
def item_key(spark, sf) -> DataFrame:
    return big(keyed_panel(Shared.of(spark, sf)).select("event_id", "frame_j", "uid"), "frame_j")


@query("rounded_half_even", "SELECT event_id, round_even(value / 7, 3) + 0.0 AS v FROM events")
def rounded_half_even(spark, sf) -> DataFrame:
    return Shared.of(spark, sf).table("events").select("event_id", round_half_even(F.col("value") / 7).alias("v"))


KS, SHORT, SEED = (10, 20, 30), (10, 20), 50
_SCORES = {"trait": "origin_ol", "followers": "origin_logfoll"}
_UNION = [f"SELECT day, 'full_k{k}' AS policy, 'full' AS family, {k} AS k, NULL::INTEGER AS shortlist, pos - 1 AS cid, uid, event_id, frame_j, y, raw, pos FROM pool WHERE pos <= {k}" for k in KS]
_UNION += [f"SELECT day, 'random_b{b}', 'random', 30, {b}, o_random_b{b} - 1, uid, event_id, frame_j, y, raw, pos FROM pool WHERE o_random_b{b} <= {b}" for b in SHORT]
_UNION += [f"SELECT day, '{n}_b{b}', '{n}', 30, {b}, o_{n} - 1, uid, event_id, frame_j, y, raw, pos FROM pool WHERE o_{n} <= {b}" for n in _SCORES for b in SHORT]
PIECES["tasks"] = (["uid"], f"""pool AS (SELECT *, {', '.join(f"row_number() OVER (PARTITION BY day ORDER BY md5('{SEED}:{b}:' || uid), event_id, frame_j) AS o_random_b{b}" for b in SHORT)},
 {', '.join(f"row_number() OVER (PARTITION BY day ORDER BY s_{n} DESC, uid, event_id, frame_j) AS o_{n}" for n in _SCORES)} FROM (
 SELECT day, uid, event_id, frame_j, log_future_reach AS y, future_reach AS raw, {', '.join(f'{c} AS s_{n}' for n, c in _SCORES.items())},
 row_number() OVER (PARTITION BY day ORDER BY md5('{SEED}:' || uid), event_id, frame_j) AS pos, count(*) OVER (PARTITION BY day) AS nd FROM uid WHERE split = 'test') WHERE nd >= 30 AND pos <= 30),
tasks AS ({' UNION ALL '.join(_UNION)})""")


def tasks(spark, sf) -> DataFrame:
    return shortlist.candidate_pools(keyed_panel(Shared.of(spark, sf)), _SCORES, ks=KS, shortlists=SHORT, seed=SEED)


@query("candidate_pools", compose("SELECT day, policy, family, CAST(k AS BIGINT) AS k, CAST(coalesce(shortlist, 0) AS BIGINT) AS shortlist, CAST(cid AS BIGINT) AS cid, event_id, CAST(frame_j AS BIGINT) AS frame_j FROM tasks", "tasks"))
def candidate_pools(spark, sf) -> DataFrame:
    return big(tasks(spark, sf).fillna(0, ["shortlist"]).select("day", "policy", "family", "k", "shortlist", "cid", "event_id", "frame_j"), "k", "shortlist", "cid", "frame_j")


_CAP = """SELECT day, policy, sum(CASE WHEN cid < 3 THEN y ELSE 0 END) AS sy, sum(CASE WHEN cid < 3 THEN raw ELSE 0 END) AS sr, sum(CASE WHEN by_y <= 3 THEN y ELSE 0 END) AS best,
 sum(CASE WHEN by_raw <= 3 THEN raw ELSE 0 END) AS best_raw FROM (SELECT *, row_number() OVER (PARTITION BY day, policy ORDER BY y DESC, uid, event_id, frame_j) AS by_y,
 row_number() OVER (PARTITION BY day, policy ORDER BY raw DESC, uid, event_id, frame_j) AS by_raw FROM tasks) GROUP BY day, policy"""


@query("capture", compose(f"""SELECT a.day, a.policy, {r6('sy', 'selected_log_reach')}, {r6('sr', 'selected_raw_reach')}, {r6('sy / greatest(best, 1e-12)', 'capture_within_shown')}, {r6('sr / greatest(best_raw, 1e-12)', 'raw_capture_within_shown')},
 {r6('sy / greatest(full_best, 1e-12)', 'selected_vs_full_pool_oracle')}, {r6('-(0.5*ln(0.5) + 0.3*ln(0.3) + 0.2*ln(0.2)) / ln(3)', 'attention_entropy')} FROM ({_CAP}) a
 JOIN (SELECT day, best AS full_best FROM ({_CAP}) WHERE policy = 'full_k30') f USING (day)""", "tasks"))
def capture(spark, sf) -> DataFrame:
    """Outcome caught when the first three shown ids get 50, 30 and 20 points."""
    t = cut(tasks(spark, sf))
    pick = F.when(F.col("cid") == 0, 0.5).when(F.col("cid") == 1, 0.3).otherwise(0.2)
    sel = t.filter("cid < 3").select("day", "policy", "cid", pick.alias("attention_norm"))
    cols = ["selected_log_reach", "selected_raw_reach", "capture_within_shown", "raw_capture_within_shown", "selected_vs_full_pool_oracle", "attention_entropy"]
    return rounded6(shortlist.capture(t, sel).select("day", "policy", *cols), *cols)


@query("build_prompts", compose("""SELECT day, count(*) AS n_items, true AS ordered FROM tasks WHERE policy = 'full_k10' GROUP BY day""", "tasks"))
def build_prompts(spark, sf) -> DataFrame:
    """One prompt per full_k10 task; the check counts its items and that ids run from 0 in order."""
    s = Shared.of(spark, sf)
    t = tasks(spark, sf).filter("policy = 'full_k10'").join(keyed_panel(s).select("event_id", "frame_j", "payload"), ["event_id", "frame_j"])
    head = ["Select exactly 3 narratives for further research.", "Return only JSON with the chosen ids.", "CANDIDATES:"]
    p = shortlist.build_prompts(t, ["day"], "cid", "payload", head)
    ids = F.regexp_extract_all("prompt", F.lit(r'\{"id":(\d+),'), 1)
    want = F.transform(F.sequence(F.lit(0), F.col("n_items") - 1), lambda x: x.cast("string"))
    return big(p.select("day", "n_items", (ids == want).alias("ordered")), "n_items")


@query("score_lookup", compose(f"""SELECT event_id, CAST(frame_j AS BIGINT) AS frame_j, {r6("CASE WHEN split = 'test' THEN value END", 'score')} FROM uid LEFT JOIN (
 SELECT user_id, max_by(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id) ON user_id = actor""", "uid"))
def score_lookup(spark, sf) -> DataFrame:
    """External scores by key (here: the actor's last purchase value) for test rows only."""
    s = Shared.of(spark, sf)
    log = s.table("events").filter("event_type = 'purchase'").select(F.col("user_id").alias("actor"), F.col("event_id").alias("seq"), "value")
    d = stores.score_lookup(keyed_panel(s), stores.latest_by_key(log, "actor", "seq", ["value"]), "actor", "value", ["val", "test"])
    return big(rounded6(d.select("event_id", "frame_j", "score"), "score"), "frame_j")


# ---- responses -------------------------------------------------------------------------------

# One response per ten posts, with the kinds of damage the readers must survive.
_SC_ITEM = """CASE batch % 6 WHEN 2 THEN '[' || i || ',' || a || ',' || r || ']' WHEN 3 THEN '{"id":' || (i - i % 2) || ',"adoption_score":' || a || ',"reach_score":' || r || '}'
 WHEN 4 THEN '{"id":' || (i + 5) || ',"adoption_score":"' || a || '","reach_score":' || CASE WHEN i % 3 = 0 THEN 'NaN' ELSE r END || '}'
 ELSE '{"id":' || i || ',"adoption_score":' || a || ',"reach_score":' || r || '}' END"""
_ITEMS_SQL = """rs0 AS (SELECT event_id // 10 AS batch, CAST(event_id % 10 AS VARCHAR) AS is_, event_id % 10 AS i, CAST((event_id * 7) % 131 - 10 AS VARCHAR) AS a, CAST((event_id * 11) % 127 AS VARCHAR) AS r FROM events)"""
_RESPONSE_SQL = _ITEMS_SQL + f""",
rs1 AS (SELECT batch, '{{"scores":[' || string_agg({_SC_ITEM}, ',' ORDER BY i) || ']}}' AS body FROM rs0 GROUP BY batch),
rs AS (SELECT batch, CASE batch % 6 WHEN 1 THEN 'Here you are:' || chr(10) || body || ' done' WHEN 5 THEN body[1:60] ELSE body END AS response FROM rs1)"""


def _responses(spark, sf) -> DataFrame:
    e = Shared.of(spark, sf).table("events")
    b, i = F.floor(F.col("event_id") / 10), F.col("event_id") % 10
    a, r = (F.col("event_id") * 7 % 131 - 10).cast("string"), (F.col("event_id") * 11 % 127).cast("string")
    d = e.select(b.alias("batch"), i.alias("i"), a.alias("a"), r.alias("r"))
    k, n = F.col("batch") % 6, lambda x: x.cast("string")
    cc = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    obj = lambda i_, a_, r_: cc('{"id":', i_, ',"adoption_score":', a_, ',"reach_score":', r_, '}')
    i, a, r = F.col("i"), F.col("a"), F.col("r")
    item = (F.when(k == 2, cc("[", n(i), ",", a, ",", r, "]")).when(k == 3, obj(n(i - i % 2), a, r))
            .when(k == 4, obj(n(i + 5), cc('"', a, '"'), F.when(i % 3 == 0, "NaN").otherwise(r))).otherwise(obj(n(i), a, r)))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("i", "item"))), lambda x: x["item"])  # ten per batch
    g = d.withColumn("item", item).groupBy("batch").agg(cells.alias("c"))
    body = cc('{"scores":[', F.concat_ws(",", "c"), "]}")
    k = F.col("batch") % 6
    return g.select("batch", F.when(k == 1, cc("Here you are:\n", body, " done")).when(k == 5, F.substring(body, 1, 60)).otherwise(body).alias("response"))


@query("parse_scores", f"""WITH {_ITEMS_SQL},
x AS (SELECT batch, i, CASE batch % 6 WHEN 3 THEN i - i % 2 WHEN 4 THEN i + 5 ELSE i END AS id, CAST(a AS DOUBLE) AS a, CASE WHEN batch % 6 = 4 AND i % 3 = 0 THEN NULL ELSE CAST(r AS DOUBLE) END AS r FROM rs0 WHERE batch % 6 <> 5)
SELECT batch, CAST(id AS BIGINT) AS id, least(100, greatest(0, a)) + 0.0 AS adoption_score, least(100, greatest(0, r)) + 0.0 AS reach_score FROM x
WHERE id < 10 AND r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY batch, id ORDER BY i DESC) = 1""")
def parse_scores(spark, sf) -> DataFrame:
    d = read_scores(_responses(spark, sf), "response", 10)
    return big(d.select("batch", F.inline("scores")), "id")


_SEL_SQL = """ss AS (SELECT event_id // 5 AS batch, event_id % 5 AS i, (event_id * 3) % 7 AS id, (event_id * 11) % 41 - 10 AS att FROM events)"""


def _selections(spark, sf) -> DataFrame:
    e = Shared.of(spark, sf).table("events")
    d = e.select(F.floor(F.col("event_id") / 5).alias("batch"), (F.col("event_id") % 5).alias("i"),
                 (F.col("event_id") * 3 % 7).cast("string").alias("id"), (F.col("event_id") * 11 % 41 - 10).cast("string").alias("att"))
    k = F.col("batch") % 5
    item = F.when(k == 1, F.concat(F.lit('{"id":'), "id", F.lit(',"attention_points":'), "att", F.lit(',"reason":"r"}'))).otherwise(
        F.concat(F.lit('{"id":'), "id", F.lit(',"attention":'), F.abs(F.col("att").cast("int")).cast("string"), F.lit("}")))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("i", "item"))), lambda x: x["item"])  # five per batch
    g = d.withColumn("item", item).groupBy("batch").agg(F.concat_ws(",", cells).alias("c"))
    k = F.col("batch") % 5
    text = (F.when(k == 0, F.concat(F.lit('{"selected":['), "c", F.lit("]}")))
            .when(k == 1, F.concat(F.lit('ok {"selections":['), "c", F.lit("]} bye")))
            .when(k == 2, F.concat(F.lit('{"selected":['), "c"))
            .when(k == 3, F.lit('{"selected":"none"}')).otherwise(F.lit("no answer")))
    return g.select("batch", text.alias("response"))


@query("parse_selection", f"""WITH {_SEL_SQL},
c AS (SELECT batch, id, i, CASE WHEN batch % 5 = 1 THEN att ELSE abs(att) END AS att FROM ss WHERE batch % 5 < 3 AND id < 6 QUALIFY row_number() OVER (PARTITION BY batch, id ORDER BY i) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY i) AS z, count(*) OVER (PARTITION BY batch) AS m FROM c QUALIFY z <= 3),
t AS (SELECT batch, count(*) AS n, sum(greatest(0, att)) AS total, max(m) AS m FROM p GROUP BY batch)
SELECT b.batch, CASE b.batch % 5 WHEN 2 THEN CASE WHEN coalesce(m, 0) >= 3 THEN 'json_recovered' ELSE 'json_decode' END WHEN 3 THEN 'missing_selected' WHEN 4 THEN 'json_decode' ELSE CASE WHEN coalesce(m, 0) < 3 THEN 'too_few_selected' ELSE '' END END AS status,
 CAST(CASE WHEN b.batch % 5 = 2 AND coalesce(m, 0) < 3 THEN 0 ELSE coalesce(n, 0) END AS BIGINT) AS n, coalesce(CASE WHEN b.batch % 5 = 2 AND coalesce(m, 0) < 3 THEN NULL ELSE f.first_id END, -1) AS first_id,
 round(CASE WHEN coalesce(m, 0) < 3 THEN NULL WHEN total > 0 THEN greatest(0, f.first_att) / CAST(total AS DOUBLE) WHEN b.batch % 5 = 2 THEN 0 ELSE 1.0 / n END, 6) + 0.0 AS first_norm
FROM (SELECT DISTINCT batch FROM ss) b LEFT JOIN t USING (batch) LEFT JOIN (SELECT batch, id AS first_id, att AS first_att FROM p WHERE z = 1) f USING (batch)""")
def parse_selection(spark, sf) -> DataFrame:
    d = _selections(spark, sf).withColumn("cands", F.array(*[F.lit(x) for x in range(6)]))
    d = read_selection(d, "response", "cands", 3)
    first = F.try_element_at("selected", F.lit(1))
    return big(rounded6(d.select("batch", "status", F.size("selected").alias("n"), F.coalesce(first["id"], F.lit(-1)).alias("first_id"), first["attention_norm"].alias("first_norm")), "first_norm"), "n", "first_id")


@query("attention_entropy", f"""WITH {_SEL_SQL} SELECT batch, round(-sum(p * ln(p)) / ln(count(*)), 6) + 0.0 AS entropy FROM (SELECT batch, (id + 1) / CAST(sum(id + 1) OVER (PARTITION BY batch) AS DOUBLE) AS p FROM ss) GROUP BY batch""")
def attention_entropy(spark, sf) -> DataFrame:
    d = Shared.of(spark, sf).table("events").select(F.floor(F.col("event_id") / 5).alias("batch"), (F.col("event_id") * 3 % 7 + 1).alias("w"))
    # -sum(p ln p) = ln W - sum(w ln w) / W, so one combinable aggregate
    g = d.groupBy("batch").agg(F.sum("w").cast("double").alias("t"), F.sum(F.col("w") * F.log("w")).alias("x"), F.count(F.lit(1)).alias("n"))
    return rounded6(g.select("batch", ((F.log("t") - F.col("x") / F.col("t")) / F.log("n")).alias("entropy")), "entropy")


# ---- reports ---------------------------------------------------------------------------------


@query("cost_rollup", f"""SELECT event_type AS model, count(*) AS calls, CAST(sum(10 - user_id % 3) AS BIGINT) AS success_items, CAST(sum(user_id % 3) AS BIGINT) AS failed_items,
 CAST(count(*) FILTER (user_id % 3 > 0) AS BIGINT) AS parse_fail_batches, {r6('avg(value)', 'latency_ms_mean')}, {r6('median(value)', 'latency_ms_median')}, {r6('quantile_cont(value, 0.9)', 'latency_ms_p90')},
 {r6('avg(value) / 10', 'latency_ms_per_item')}, {r6('avg(length(props)) / 10', 'prompt_tokens_per_item')} FROM events GROUP BY event_type""")
def cost_rollup(spark, sf) -> DataFrame:
    e = Shared.of(spark, sf).table("events")
    fails = F.col("user_id") % 3
    calls = e.select(F.col("event_type").alias("model"), F.lit(10).alias("batch_size"), (10 - fails).alias("success_items"), fails.alias("failed_items"),
                     (fails > 0).cast("int").alias("parse_fail"), F.lit(0).alias("api_fail"), F.col("value").alias("latency_ms"),
                     F.length("props").alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), F.lit(1).alias("total_tokens"))
    d = reports.cost_rollup(calls)
    cols = ["latency_ms_mean", "latency_ms_median", "latency_ms_p90", "latency_ms_per_item", "prompt_tokens_per_item"]
    return rounded6(d.select("model", "calls", "success_items", "failed_items", "parse_fail_batches", *cols), *cols)


_CI = """ci AS (SELECT comparison, metric, sym, avg(delta) AS observed, avg(delta) - stddev_pop(delta) / sqrt(count(*)) AS lo, avg(delta) + stddev_pop(delta) / sqrt(count(*)) AS hi, stddev_pop(delta) / sqrt(count(*)) AS se FROM dl GROUP BY 1, 2, 3)"""


def _cis(spark, sf) -> DataFrame:
    """Per symbol (the settings): mean delta with one standard error to each side."""
    d = _deltas(spark, sf).groupBy("comparison", "metric", "sym").agg(
        F.avg("delta").alias("observed"), (F.stddev_pop("delta") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return d.withColumn("lo", F.col("observed") - F.col("se")).withColumn("hi", F.col("observed") + F.col("se"))


@query("win_tally", compose("""SELECT comparison, metric, count(*) AS n_settings, count(*) FILTER (lo > 0) AS positive_ci, count(*) FILTER (lo <= 0 AND hi < 0) AS negative_ci, count(*) FILTER (lo <= 0 AND hi >= 0) AS cross_zero
FROM ci GROUP BY 1, 2""", "em", extra=_DELTA_SQL + ",\n" + _CI))
def win_tally(spark, sf) -> DataFrame:
    return reports.win_tally(_cis(spark, sf), ["comparison", "metric"])


@query("family_average", compose(f"""SELECT metric, {r6('observed', 'observed')}, n, {r6('se', 'se')}, {r6('observed - 1.6448536269514722 * se', 'lo')}, {r6('observed + 1.6448536269514722 * se', 'hi')} FROM (
 SELECT metric, avg(observed) AS observed, count(*) AS n, sqrt(sum(se*se) / (count(*) * count(*)) + var_pop(observed) / count(*)) AS se FROM ci GROUP BY metric)""", "em", extra=_DELTA_SQL + ",\n" + _CI))
def family_average(spark, sf) -> DataFrame:
    return rounded6(reports.family_average(_cis(spark, sf), ["metric"]), "observed", "se", "lo", "hi")


@query("pvalue_from_ci")
def pvalue_from_ci(spark, sf) -> DataFrame:
    return reports.pvalue_from_ci(_cis(spark, sf))


@query("delta_summary", compose(f"SELECT comparison, metric, count(*) AS n, {r6('avg(delta)', 'mean_delta')}, count(*) FILTER (round(delta, 9) > 0) AS n_positive FROM dl GROUP BY 1, 2", "em", extra=_DELTA_SQL))
def delta_summary(spark, sf) -> DataFrame:
    return rounded6(reports.delta_summary(_deltas(spark, sf), ["comparison", "metric"]), "mean_delta")


def _results(spark, sf) -> DataFrame:
    e = method_events(spark, sf)
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("ndcg3", "hit1", "mass3", "js")])
    long = e.select("sym", "method", F.explode(cells).alias("c")).select("sym", "method", "c.*")
    return long.groupBy(F.col("sym").alias("setting"), F.lit("log_future_reach").alias("target"), "method", "metric").agg(F.avg("value").alias("value"))


_RES = "res AS (" + " UNION ALL ".join(f"SELECT sym AS setting, method, '{m}' AS metric, avg({m}) AS value FROM em GROUP BY sym, method" for m in ("ndcg3", "hit1", "mass3", "js")) + ")"


@query("region_mean", compose(f"SELECT method, 'log_future_reach' AS target, metric, {r6('avg(value)', 'value')}, count(*) AS n_settings FROM res WHERE setting <> 'error' GROUP BY method, metric", "em", extra=_RES))
def region_mean(spark, sf) -> DataFrame:
    return rounded6(reports.region_mean(_results(spark, sf), F.col("setting") != "error"), "value")


@query("read_result", compose(f"SELECT {r6('coalesce(max(value), -1)', 'value')} FROM res WHERE setting = 'click' AND method = 'trait' AND metric = 'ndcg3'", "em", extra=_RES))
def read_result(spark, sf) -> DataFrame:
    return rounded6(stores.read_result(_results(spark, sf), -1.0, setting="click", method="trait", metric="ndcg3"), "value")
