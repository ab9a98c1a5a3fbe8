"""Ranking metrics, labels and evaluation over the candidate panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originflow.catalog import solve
from originflow.catalog.registry import query
from originflow.catalog.shared import Shared, big, is_train, rounded6
from originflow.catalog.sql import PIECES, compose, r6
from originflow.operators import metrics as mx, reports, resample, shortlist

METHODS = {"followers": "origin_logfoll", "trait": "origin_ol", "earliest": "neg_rank", "novelty": "novelty_6"}  # rounded: equal posts differ only by summation order
Y = "log_future_reach"
KS = (1, 2, 3, 5)
METRIC_COLS = [f"{m}{k}" for k in KS for m in ("ndcg", "hit", "mass")] + ["js"]

_SQL_SCORE = {"neg_rank": "-log_origin_rank", "novelty_6": "round(novelty_global, 6)"}

PIECES["sc"] = (["panel"], "sc AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS method, event_id, sym, split, frame_j, log_future_reach AS y, future_reach AS raw, {_SQL_SCORE.get(c, c)} AS s FROM panel"
    for m, c in METHODS.items()) + ")")
_AGG = ", ".join(
    f"sum(CASE WHEN rs <= {k} THEN y / log2(rs + 1) ELSE 0 END) / greatest(sum(CASE WHEN ry <= {k} THEN y / log2(ry + 1) ELSE 0 END), 1e-12) AS ndcg{k}, "
    f"max(CASE WHEN rs <= {k} AND y = ymax THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit{k}, sum(CASE WHEN rs <= {k} THEN y ELSE 0 END) / greatest(max(ysum), 1e-12) AS mass{k}" for k in KS)
_PART = lambda a, b: f"CASE WHEN {a} > 0 THEN 0.5 * {a} * ln({a} / greatest(({a} + {b}) * 0.5, 1e-12)) ELSE 0 END"
PIECES["em"] = (["sc"], f"""em0 AS (SELECT *, count(*) OVER w AS n, max(y) OVER w AS ymax, sum(y) OVER w AS ysum, max(s) OVER w AS smax,
 row_number() OVER (PARTITION BY method, event_id ORDER BY s DESC, frame_j) AS rs, row_number() OVER (PARTITION BY method, event_id ORDER BY y DESC, frame_j) AS ry
 FROM sc WHERE split = 'test' AND s IS NOT NULL AND isfinite(s) WINDOW w AS (PARTITION BY method, event_id)),
em1 AS (SELECT *, y / greatest(ysum, 1e-12) AS p, e / greatest(sum(e) OVER (PARTITION BY method, event_id), 1e-12) AS q FROM (
 SELECT *, exp(greatest(s - smax, -50)) AS e FROM em0 WHERE n >= 2 AND ymax > 0)),
em AS (SELECT method, event_id, sym, max(n) AS n, {_AGG}, sum({_PART('p', 'q')} + {_PART('q', 'p')}) AS js FROM em1 GROUP BY method, event_id, sym)""")


def long_scores(panel: DataFrame) -> DataFrame:
    p = panel.withColumns({"neg_rank": -F.col("log_origin_rank"), "novelty_6": F.round("novelty_global", 6)})
    cells = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("s")) for m, c in METHODS.items()])
    return p.select("event_id", "sym", "split", "frame_j", F.col(Y).alias("y"), F.col("future_reach").alias("raw"),
                    F.explode(cells).alias("c")).select("*", "c.*").drop("c")


def test_scores(spark, sf) -> DataFrame:
    return long_scores(Shared.of(spark, sf).panel.filter("split = 'test'"))


def events(spark, sf, bounded: bool = True) -> DataFrame:
    return mx.event_metrics(test_scores(spark, sf), "y", "s", ["method", "event_id", "sym"], ks=KS, bounded=bounded)


_EM = compose(f"SELECT method, event_id, sym, n, {', '.join(r6(c, c) for c in METRIC_COLS)} FROM em", "em")


@query("event_metrics", _EM)
def event_metrics(spark, sf) -> DataFrame:
    return rounded6(events(spark, sf), *METRIC_COLS)


@query("event_metrics_large_groups", _EM)
def event_metrics_large_groups(spark, sf) -> DataFrame:
    """The form for groups of any size: top-k cut before the shuffle, totals joined by blocks."""
    return rounded6(events(spark, sf, bounded=False), *METRIC_COLS)


@query("event_distribution", compose(f"""SELECT method, event_id, sym, n, {r6('CASE WHEN sqrt(vra * vrb) > 1e-12 THEN cab / sqrt(vra * vrb) END', 'spearman')},
 {r6('CASE WHEN sqrt(vp * vq) > 1e-12 THEN cpq / sqrt(vp * vq) END', 'pearson_dist')}, {r6('js', 'js')}, {r6('mass3', 'mass3')} FROM (
 SELECT method, event_id, sym, max(n) AS n, sum((ra - mra) * (rb - mrb)) AS cab, sum((ra - mra) ** 2) AS vra, sum((rb - mrb) ** 2) AS vrb,
 sum((p - mp) * (q - mq)) AS cpq, sum((p - mp) ** 2) AS vp, sum((q - mq) ** 2) AS vq, sum({_PART('p', 'q')} + {_PART('q', 'p')}) AS js,
 sum(CASE WHEN rs <= 3 THEN p END) AS mass3 FROM (
 SELECT *, avg(ra) OVER w AS mra, avg(rb) OVER w AS mrb, avg(p) OVER w AS mp, avg(q) OVER w AS mq FROM (
 SELECT *, rank() OVER (PARTITION BY method, event_id ORDER BY y) + (count(*) OVER (PARTITION BY method, event_id, y) - 1) / 2.0 AS ra,
 rank() OVER (PARTITION BY method, event_id ORDER BY s) + (count(*) OVER (PARTITION BY method, event_id, s) - 1) / 2.0 AS rb FROM em1)
 WINDOW w AS (PARTITION BY method, event_id)) GROUP BY method, event_id, sym)""", "em"))
def event_distribution(spark, sf) -> DataFrame:
    d = mx.event_distribution(test_scores(spark, sf), "y", "s", ["method", "event_id", "sym"])
    return rounded6(d, "spearman", "pearson_dist", "js", "mass3")


_M4 = ["ndcg3", "hit1", "mass3", "js"]
ORIGIN_WINDOWS = {"first3": 3, "first5": 5, "first10": 10, "all": None}
_EVERY_RANK = {k: (PIECES[k][0], PIECES[k][1].replace(" AND rank <= 10", "")) for k in ("nov", "panel")}
_WINDOW_SQL = "owp AS (" + " UNION ALL ".join(
    f"SELECT '{w}' AS win, '{m}' AS method, event_id, sym, frame_j, log_future_reach AS y, {_SQL_SCORE.get(c, c)} AS s FROM panel "
    f"WHERE split = 'test' AND {_SQL_SCORE.get(c, c)} IS NOT NULL{f' AND rank <= {n}' if n else ''}"
    for w, n in ORIGIN_WINDOWS.items() for m, c in METHODS.items()) + "), " + solve.metric_table("ow")


@query("origin_windows", compose(f"SELECT win AS \"window\", {solve.TABLE} FROM owt", "panel", extra=_WINDOW_SQL, swap=_EVERY_RANK))
def origin_windows(spark, sf) -> DataFrame:
    """The scalar rankers on the first 3, 5 and 10 posts' frames of each event and on all frames, from one panel of every rank."""
    p = Shared.of(spark, sf).whole_panel.filter("split = 'test'")
    inside = F.array(*[F.when(F.col("rank") <= n, w) if n else F.lit(w) for w, n in ORIGIN_WINDOWS.items()])
    kept = [c for c in p.columns if c not in ("split", "block")]
    p = p.select(*kept, "split", F.explode(inside).alias("window")).filter("window is not null")
    d = p.withColumns({"neg_rank": -F.col("log_origin_rank"), "novelty_6": F.round("novelty_global", 6)})
    cells = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("s")) for m, c in METHODS.items()])
    d = d.select("window", "event_id", "sym", "frame_j", F.col(Y).alias("y"), F.explode(cells).alias("c")).select("*", "c.*").drop("c")
    ev = mx.event_metrics(d, "y", "s", ["window", "method", "event_id", "sym"], ks=(1, 3), bounded=False)
    return rounded6(mx.symbol_mean(ev, _M4, ["window", "method"]), *_M4)


@query("pooled_mean", compose(f"SELECT method, count(*) AS n_events, {', '.join(r6(f'avg({m})', m) for m in _M4)} FROM em GROUP BY method", "em"))
def pooled_mean(spark, sf) -> DataFrame:
    return rounded6(mx.pooled_mean(events(spark, sf), _M4, ["method"]), *_M4)


_SM = f"""SELECT method, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_symbols, {', '.join(f'avg({m}) AS {m}' for m in _M4)} FROM (
 SELECT method, sym, count(*) AS n, {', '.join(f'avg({m}) AS {m}' for m in _M4)} FROM em GROUP BY method, sym) GROUP BY method"""


@query("symbol_balanced_mean", compose(f"SELECT method, n_events, n_symbols, {', '.join(r6(m, m) for m in _M4)} FROM ({_SM})", "em"))
def symbol_balanced_mean(spark, sf) -> DataFrame:
    return rounded6(mx.symbol_mean(events(spark, sf), _M4, ["method"]), *_M4)


@query("delta_vs_baseline", compose(
    f"SELECT a.method, {', '.join(r6('a.' + m, m) for m in ('ndcg3', 'hit1'))}, {', '.join(r6(f'a.{m} - b.{m}', f'delta_{m}') for m in ('ndcg3', 'hit1'))} "
    f"FROM ({_SM}) a, (SELECT * FROM ({_SM}) WHERE method = 'followers') b", "em"))
def delta_vs_baseline(spark, sf) -> DataFrame:
    means = mx.symbol_mean(events(spark, sf), ["ndcg3", "hit1"], ["method"]).select("method", "ndcg3", "hit1")
    return rounded6(reports.delta_vs_baseline(means, "followers", ["ndcg3", "hit1"]), "ndcg3", "hit1", "delta_ndcg3", "delta_hit1")


@query("metric_deltas", compose(
    f"SELECT event_id, sym, {', '.join(r6(('b.js - a.js' if m == 'js' else f'a.{m} - b.{m}'), m) for m in _M4)} "
    "FROM (SELECT * FROM em WHERE method = 'trait') a JOIN (SELECT * FROM em WHERE method = 'followers') b USING (event_id, sym)", "em"))
def metric_deltas(spark, sf) -> DataFrame:
    e = events(spark, sf)
    return rounded6(resample.metric_deltas(e.filter("method = 'trait'"), e.filter("method = 'followers'")), *_M4)


PIECES["lb"] = (["panel"], """lb AS (SELECT *, CAST(CASE WHEN log_future_reach >= (SELECT quantile_cont(log_future_reach, 0.9) FROM panel WHERE split = 'train') THEN 1 ELSE 0 END AS INTEGER) AS label FROM panel)""")


def labelled(spark, sf) -> DataFrame:
    return mx.quantile_label(Shared.of(spark, sf).panel, Y, is_train(), 0.9)


@query("quantile_label", compose("SELECT event_id, CAST(frame_j AS BIGINT) AS frame_j, CAST(label AS BIGINT) AS label FROM lb", "lb"))
def quantile_label(spark, sf) -> DataFrame:
    return big(labelled(spark, sf).select("event_id", "frame_j", "label"), "frame_j", "label")


@query("quantile_grade", compose("""SELECT event_id, CAST(frame_j AS BIGINT) AS frame_j, CAST(least(len(list_filter(e[2:len(e)-1], lambda x: x <= log_future_reach)), greatest(1, len(e) - 2)) AS BIGINT) AS grade
FROM panel, (SELECT list_sort(list_distinct(quantile_cont(log_future_reach, """ + str([i / 32 for i in range(33)]) + """))) AS e FROM panel WHERE split = 'train')""", "panel"))
def quantile_grade(spark, sf) -> DataFrame:
    return big(mx.quantile_grade(Shared.of(spark, sf).panel, Y, is_train()).select("event_id", "frame_j", "grade"), "frame_j", "grade")


_AUC = """SELECT {keys} count(*) AS n, CAST(sum(label) AS DOUBLE) AS n_pos, (sum(CASE WHEN label = 1 THEN mid END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auc,
 sum(CASE WHEN label = 1 THEN prec END) / sum(label) AS ap FROM (
 SELECT *, rank() OVER ({part} ORDER BY s) + (count(*) OVER ({tie}) - 1) / 2.0 AS mid,
 sum(label) OVER ({part} ORDER BY s DESC RANGE UNBOUNDED PRECEDING) / CAST(count(*) OVER ({part} ORDER BY s DESC RANGE UNBOUNDED PRECEDING) AS DOUBLE) AS prec
 FROM (SELECT *, {score} AS s FROM lb WHERE {where})) {group}"""


@query("auc_ap", compose("SELECT n, n_pos, " + r6("auc", "auc") + ", " + r6("ap", "ap") + " FROM (" + _AUC.format(
    keys="", part="", tie="PARTITION BY s", score="origin_logfoll", where="split = 'test'", group="") + ")", "lb"))
def auc_ap(spark, sf) -> DataFrame:
    """Global ROC-AUC and average precision; follower scores tie within an actor."""
    return rounded6(mx.auc_ap(labelled(spark, sf).filter("split = 'test'"), "label", "origin_logfoll"), "auc", "ap")


@query("auc_ap_by_symbol", compose("SELECT sym, n, n_pos, " + r6("auc", "auc") + ", " + r6("ap", "ap") + " FROM (" + _AUC.format(
    keys="sym,", part="PARTITION BY sym", tie="PARTITION BY sym, s", score="origin_ol", where="TRUE", group="GROUP BY sym") + ")", "lb"))
def auc_ap_by_symbol(spark, sf) -> DataFrame:
    return rounded6(mx.auc_ap(labelled(spark, sf), "label", "origin_ol", ["sym"]), "auc", "ap")


@query("average_precision_rows", compose(f"""SELECT {r6('sum(label * h / c) / sum(label)', 'ap')} FROM (SELECT label, sum(label) OVER w AS h, CAST(row_number() OVER w AS DOUBLE) AS c
 FROM lb WINDOW w AS (ORDER BY origin_logfoll DESC, event_id, frame_j ROWS UNBOUNDED PRECEDING))""", "lb"))
def average_precision_rows(spark, sf) -> DataFrame:
    return rounded6(mx.average_precision_rows(labelled(spark, sf), "label", "origin_logfoll", ["event_id", "frame_j"]), "ap")


@query("mid_ranks", compose(f"SELECT event_id, CAST(frame_j AS BIGINT) AS frame_j, {r6('rank() OVER (ORDER BY hist_success_rate) + (count(*) OVER (PARTITION BY hist_success_rate) - 1) / 2.0', 'mid')} FROM panel", "panel"))
def mid_ranks(spark, sf) -> DataFrame:
    d = mx.mid_ranks(Shared.of(spark, sf).panel.select("event_id", "frame_j", F.round("hist_success_rate", 12).alias("v")), "v", "mid")
    return big(rounded6(d.select("event_id", "frame_j", "mid"), "mid"), "frame_j")


@query("spearman_by_symbol", compose(f"""SELECT sym, count(*) AS n, {r6('corr(a, b)', 'rho')} FROM (SELECT sym, rank() OVER (PARTITION BY sym ORDER BY origin_ol) + (count(*) OVER (PARTITION BY sym, origin_ol) - 1) / 2.0 AS a,
 rank() OVER (PARTITION BY sym ORDER BY future_adopt) + (count(*) OVER (PARTITION BY sym, future_adopt) - 1) / 2.0 AS b FROM panel) GROUP BY sym""", "panel"))
def spearman_by_symbol(spark, sf) -> DataFrame:
    return rounded6(mx.corr_rank(Shared.of(spark, sf).panel, "origin_ol", "future_adopt", ["sym"]), "rho")


# small groups and groups of one class are skipped, as the operator states
_TQ = """tq AS (SELECT * FROM (SELECT p.*, CAST(CASE WHEN future_reach >= c.q THEN 1 ELSE 0 END AS INTEGER) AS label FROM (SELECT * FROM panel WHERE split = 'test') p
 JOIN (SELECT sym, quantile_cont(future_reach, 0.9) AS q FROM panel WHERE split = 'test' GROUP BY sym HAVING count(*) >= 30) c USING (sym)) QUALIFY min(label) OVER (PARTITION BY sym) < max(label) OVER (PARTITION BY sym))"""
PIECES["tq"] = (["panel"], _TQ)


def topq(spark, sf) -> DataFrame:
    return mx.topq_label(Shared.of(spark, sf).panel.filter("split = 'test'"), "future_reach", 0.1, ["sym"])


@query("topq_label", compose("SELECT event_id, CAST(frame_j AS BIGINT) AS frame_j, CAST(label AS BIGINT) AS label FROM tq", "tq"))
def topq_label(spark, sf) -> DataFrame:
    return big(topq(spark, sf).select("event_id", "frame_j", "label"), "frame_j", "label")


@query("classification_at_p", compose(f"""SELECT sym, count(*) AS n, CAST(max(np) AS BIGINT) AS n_pos, {r6('avg(CASE WHEN z <= np THEN label END)', 'r_precision')}, {r6('avg(CASE WHEN z <= 50 THEN label END)', 'precision_at_top')},
 {r6('max(np) / CAST(count(*) AS DOUBLE)', 'base_rate')}, {r6('avg(CASE WHEN z <= np THEN label END) / (max(np) / CAST(count(*) AS DOUBLE))', 'lift')} FROM (
 SELECT sym, label, sum(label) OVER (PARTITION BY sym) AS np, row_number() OVER (PARTITION BY sym ORDER BY origin_ol DESC, event_id, frame_j) AS z FROM tq) GROUP BY sym""", "tq"))
def classification_at_p(spark, sf) -> DataFrame:
    d = mx.at_p(topq(spark, sf), "label", "origin_ol", ["event_id", "frame_j"], ["sym"])
    return rounded6(d, "r_precision", "precision_at_top", "base_rate", "lift")


@query("relational_features", compose(f"""SELECT event_id, CAST(frame_j AS BIGINT) AS frame_j, {r6('CASE WHEN n > 1 THEN (z - 1) / (n - 1.0) ELSE 0.5 END', 'ol_rank')}, {r6('origin_ol - mx', 'ol_gapmax')}, {r6('origin_ol - mn', 'ol_minusmean')},
 CASE WHEN origin_ol >= mx THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ol_istop FROM (SELECT *, count(*) OVER w AS n, max(origin_ol) OVER w AS mx, avg(origin_ol) OVER w AS mn,
 row_number() OVER (PARTITION BY event_id ORDER BY origin_ol, frame_j) AS z FROM panel WINDOW w AS (PARTITION BY event_id))""", "panel"))
def relational_features(spark, sf) -> DataFrame:
    d = mx.relational(Shared.of(spark, sf).panel.select("event_id", "frame_j", "origin_ol"), "origin_ol", "ol").drop("origin_ol")
    return big(rounded6(d, "ol_rank", "ol_gapmax", "ol_minusmean"), "frame_j")


@query("within_demean", compose(f"""SELECT event_id, CAST(frame_j AS BIGINT) AS frame_j, {r6('origin_ol - avg(origin_ol) OVER w', 'origin_ol')}, {r6('log_future_reach - avg(log_future_reach) OVER w', 'log_future_reach')}
FROM panel WINDOW w AS (PARTITION BY event_id) QUALIFY count(*) OVER w >= 2""", "panel"))
def within_demean(spark, sf) -> DataFrame:
    d = mx.within_demean(Shared.of(spark, sf).panel.select("event_id", "frame_j", "origin_ol", Y), ["origin_ol", Y])
    return big(rounded6(d, "origin_ol", Y), "frame_j")


@query("median_impute", compose(f"""SELECT event_id, CAST(frame_j AS BIGINT) AS frame_j, {r6("coalesce(novelty_event, (SELECT median(novelty_event) FROM panel WHERE split = 'train'))", 'novelty_event')} FROM panel""", "panel"))
def median_impute(spark, sf) -> DataFrame:
    d = Shared.of(spark, sf).panel
    d = mx.median_impute(d, "novelty_event", is_train()).select("event_id", "frame_j", "novelty_event")
    return big(rounded6(d, "novelty_event"), "frame_j")


@query("summary_stats", compose(f"""SELECT sym, count(*) AS n, {r6('avg(future_reach)', 'mean')}, {r6('min(future_reach)', 'min')}, {r6('max(future_reach)', 'max')}, {r6('quantile_cont(future_reach, 0.1)', 'p10')},
 {r6('median(future_reach)', 'median')}, {r6('quantile_cont(future_reach, 0.9)', 'p90')} FROM panel GROUP BY sym""", "panel"))
def summary_stats(spark, sf) -> DataFrame:
    return rounded6(mx.summary_stats(Shared.of(spark, sf).panel, ["sym"], "future_reach"), "mean", "min", "max", "p10", "median", "p90")


# a mean is a quotient of whole millionths, which add up alike in every order: equal means compare equal
@query("pareto_frontier", """WITH t AS (SELECT user_id, CAST(sum(CAST(round(value * 1000000) AS BIGINT)) AS DOUBLE) / count(value) AS cost, count(*) AS quality FROM events GROUP BY user_id)
SELECT user_id, quality, NOT EXISTS (SELECT 1 FROM t b WHERE b.cost <= a.cost AND b.quality >= a.quality AND (b.cost < a.cost OR b.quality > a.quality)) AS pareto FROM t a""")
def pareto_frontier(spark, sf) -> DataFrame:
    micros = F.sum(F.round(F.col("value") * 1000000).cast("long"))
    t = Shared.of(spark, sf).table("events").groupBy("user_id").agg((micros.cast("double") / F.count("value")).alias("cost"), F.count(F.lit(1)).alias("quality"))
    return mx.pareto(t, "cost", "quality").select("user_id", "quality", "pareto")


@query("eval_candidates", compose("""SELECT event_id, CAST(frame_j AS BIGINT) AS frame_j FROM panel WHERE split = 'test' QUALIFY count(*) OVER (PARTITION BY event_id) >= 2 AND max(log_future_reach) OVER (PARTITION BY event_id) > 0""", "panel"))
def eval_candidates(spark, sf) -> DataFrame:
    return big(shortlist.eval_candidates(Shared.of(spark, sf).panel).select("event_id", "frame_j"), "frame_j")


@query("spread_sample", """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_type, CAST(ts AS DATE), event_id) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT event_id FROM r WHERE i IN (SELECT CAST(floor(j * (n - 1) / 199.0) AS BIGINT) FROM range(200) t(j), (SELECT max(n) AS n FROM r))""")
def spread_sample(spark, sf) -> DataFrame:
    """200 evenly spaced posts in (symbol, day, id) order; the sample size is the operator's parameter."""
    rows = Shared.of(spark, sf).posts.select("sym", "day", F.col("post_id").alias("event_id"))
    return shortlist.spread_sample(rows, 200, ["sym", "day"], ["event_id"]).select("event_id")
