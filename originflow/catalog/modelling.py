"""Models, graph scores, resampling and structure tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originflow.catalog import solve
from originflow.catalog.ranking import events as method_events
from originflow.catalog.registry import query
from originflow.catalog.shared import Shared, big, inner_dev, inner_fit, is_train, rounded6
from originflow.catalog.sql import CUTOFFS, INNER, MIN_ACTORS, PIECES, compose, r6
from originflow.functions import features as ft
from originflow.functions.special import t_sf2
from originflow.operators import actors, boosting, events as evs, frames as fr, graph, metrics as mx, models, panel as pn, resample
from originflow.operators.events import first_posts, rank_posts
from originflow.session import cut

Y = "log_future_reach"
# fixed values: penalties and weights of the residual model
VECTOR_ALPHAS = [0.1, 1.0, 10.0, 100.0, 1000.0]
LAMBDAS = [0.0, 0.05, 0.10, 0.20, 0.35, 0.50, 0.75, 1.00, 1.50, -0.05, -0.10, -0.20]
ALPHAS = [0.1, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0]

# ---- moments and ridge -----------------------------------------------------------------------

_X = ["origin_logfoll", "log_origin_rank", "elapsed_hours", "hist_success_rate"]


@query("cross_products", compose("SELECT i, j, round(sum(x[i + 1] * x[j + 1]), 4) + 0.0 AS value FROM (SELECT ["
       + ", ".join(["CAST(1 AS DOUBLE)", *_X, Y]) + "] AS x FROM panel WHERE split = 'train'), range(0, 6) a(i), range(0, 6) b(j) GROUP BY i, j", "panel"))
def cross_products(spark, sf) -> DataFrame:
    p = Shared.of(spark, sf).panel.filter(is_train())
    g = models.cross_products(p.select(F.array(F.lit(1.0), *_X, Y).alias("v")), "v")[()]
    rows = [(i, j, float(round(g[i, j], 4))) for i in range(len(g)) for j in range(len(g))]
    return spark.createDataFrame(rows, "i bigint, j bigint, value double")


def _imputed(c: str, where: str = "split = 'train'") -> str:
    return f"coalesce({c}, (SELECT median({c}) FROM panel WHERE {where}), 0)"


@query("column_moments", compose(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r6(f'(SELECT median({c}) FROM panel WHERE split = {chr(39)}train{chr(39)})', 'median')}, {r6(f'avg({_imputed(c)})', 'mean')}, {r6(f'stddev_pop({_imputed(c)})', 'sd')} FROM panel WHERE split = 'train'"
    for c in ft.CONTEXT), "panel"))
def column_moments(spark, sf) -> DataFrame:
    m = models.moments(Shared.of(spark, sf).panel, ft.CONTEXT, [Y], is_train())
    mu, sd, *_ = m.standardised(ft.CONTEXT, Y, "add")
    rows = [(f, m.med[f], m.med[f] + float(a), float(b)) for f, a, b in zip(ft.CONTEXT, mu, sd)]
    return rounded6(spark.createDataFrame(rows, "feature string, median double, mean double, sd double"), "median", "mean", "sd")


_RIDGE2 = f"""z AS (SELECT event_id, frame_j, split, log_future_reach AS y, (a - ma) / (sa + 1e-12) AS a, (b - mb) / (sb + 1e-12) AS b FROM (
 SELECT *, origin_ol AS a, {_imputed('novelty_event')} AS b FROM panel), (SELECT avg(origin_ol) AS ma, stddev_pop(origin_ol) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM (
 SELECT origin_ol, {_imputed('novelty_event')} AS b FROM panel WHERE split = 'train'))),
g AS (SELECT sum(a*a) + 3 AS aa, sum(a*b) AS ab, sum(b*b) + 3 AS bb, sum(a*(y-my)) AS ay, sum(b*(y-my)) AS byy, max(my) AS my FROM (SELECT *, avg(y) OVER () AS my FROM z WHERE split = 'train'))"""


@query("ridge_two_features", compose("SELECT event_id, CAST(frame_j AS BIGINT) AS frame_j, " + r6("my + (ay*bb - ab*byy)/(aa*bb - ab*ab)*a + (aa*byy - ab*ay)/(aa*bb - ab*ab)*b", "score")
                                     + " FROM z, g", "panel", extra=_RIDGE2))
def ridge_two_features(spark, sf) -> DataFrame:
    """Ridge with two features, where the closed form fits a query."""
    p = Shared.of(spark, sf).panel
    m = models.ridge_sets(p, {"two": ["origin_ol", "novelty_event"]}, Y, is_train())["two"]
    return big(rounded6(p.select("event_id", "frame_j", m.column().alias("score")), "score"), "frame_j")


_LINEAR = sorted({f for sets in (ft.ABLATION_SETS, ft.ORIGIN_SETS) for fs in sets.values() for f in fs})


def _rows(fit: str, names: list[str] = _LINEAR, where: str = "TRUE") -> str:
    return f"SELECT 'main' AS win, {fit} AS fit, event_id, sym, frame_j, {Y} AS y, {solve.features(names)} AS xs FROM panel WHERE {where}"


_TRAIN = "split = 'train'"
_INNER = f"split = 'train' AND day < DATE '{INNER}'"
_PARAMETERS = ",\n".join([solve.moments("mo", _rows(_TRAIN), "add"), solve.solved("pa", "mo", solve.sets_values({"f": ft.ORIGIN_SETS["ol_origin"]}, _LINEAR))])


@query("ridge_parameters", compose("SELECT '(intercept)' AS feature, " + r6("max(ym)", "coef_std") + ", CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS mean, "
       "CAST(NULL AS DOUBLE) AS sd, " + r6("max(ym) - sum(b / sd * mu)", "coef_raw") + " FROM pab JOIN mos USING (win, i) JOIN moy USING (win) HAVING count(*) > 0 UNION ALL SELECT "
       f"{_LINEAR!r}[i + 1], " + ", ".join([r6("b", "coef_std"), r6("med", "median"), r6("mu", "mean"), r6("sd", "sd"), r6("b / sd", "coef_raw")])
       + " FROM pab JOIN mos USING (win, i)", "panel", extra=_PARAMETERS))
def ridge_parameters(spark, sf) -> DataFrame:
    m = models.ridge_sets(Shared.of(spark, sf).panel, {"f": ft.ORIGIN_SETS["ol_origin"]}, Y, is_train())
    out = spark.createDataFrame(m["f"].parameters() if m else [], models.PARAMETER_SCHEMA)
    return rounded6(out, "coef_std", "median", "mean", "sd", "coef_raw")


def _set_means(p: DataFrame, sets: dict[str, models.Linear]) -> DataFrame:
    scored = models.score_sets(p.filter("split = 'test'"), sets, ["event_id", "sym", "frame_j", Y])
    return mx.symbol_mean(mx.event_metrics(scored, Y, "score", ["method", "event_id", "sym"], ks=(1, 3)), ["ndcg3", "hit1", "mass3", "js"], ["method"])


@query("ridge_ablation", compose(f"SELECT {solve.TABLE} FROM abt", "panel", extra=",\n".join([
    solve.moments("mo", _rows(_TRAIN), "add"), solve.solved("ab", "mo", solve.sets_values(ft.ABLATION_SETS, _LINEAR)), solve.scores("ab", "mo", "NOT fit"),
    solve.metric_table("ab")])))
def ridge_ablation(spark, sf) -> DataFrame:
    """Six feature sets from one cross-product pass, scored and evaluated in one job."""
    p = Shared.of(spark, sf).panel
    return rounded6(_set_means(p, models.ridge_sets(p, ft.ABLATION_SETS, Y, is_train())), *solve.METRICS)


# every penalty of every set on the held-out training days, then the chosen penalty on all training days
_GRID = f"(SELECT t.method AS name, t.method || '|' || CAST(a AS VARCHAR) AS method, ix, a AS alpha FROM {solve.sets_values(ft.ORIGIN_SETS, _LINEAR)} t, (SELECT unnest({ALPHAS!r}) AS a) u)"
_SELECT = ",\n".join([
    solve.moments("mi", _rows(_INNER, where=_TRAIN), "strict"), solve.solved("in_", "mi", _GRID), solve.scores("in_", "mi", "NOT fit"), solve.metric_table("in_"),
    f"best AS MATERIALIZED (SELECT name AS method, ix, alpha FROM {_GRID} g JOIN in_t USING (method) QUALIFY row_number() OVER (PARTITION BY name ORDER BY round(ndcg3, 12) DESC, alpha DESC) = 1)",
    solve.moments("mo", _rows(_TRAIN), "strict"), solve.solved("fi_", "mo", "(SELECT method, ix, alpha FROM best)"), solve.scores("fi_", "mo", "NOT fit"),
    solve.metric_table("fi_")])


@query("ridge_select", compose(f"SELECT {solve.TABLE} FROM fi_t", "panel", extra=_SELECT))
def ridge_select(spark, sf) -> DataFrame:
    p = Shared.of(spark, sf).panel
    found, search = models.ridge_select(p, ft.ORIGIN_SETS, Y, inner_fit(), inner_dev(), is_train(), ALPHAS)
    return rounded6(_set_means(p, found), *solve.METRICS)


# generalised cross-validation: residual sum from the solution, degrees of freedom from the trace of the inverse
_GCV = ",\n".join([
    solve.moments("mo", _rows(_TRAIN), "strict"),
    solve.solved("gc", "mo", f"(SELECT CAST(a AS VARCHAR) AS method, ix, a AS alpha FROM {solve.sets_values({'f': ft.ORIGIN_SETS['ol_origin']}, _LINEAR)} t, "
                             f"(SELECT unnest({VECTOR_ALPHAS!r}) AS a) u)", inverse=True, spare=None),
    """gq AS (SELECT x.method, sum(x.b * y.b * g) AS q FROM gcb x JOIN gcb y USING (win, method) JOIN mog ON mog.win = x.win AND mog.i = x.i AND mog.j = y.i GROUP BY x.method),
gv AS (SELECT method, max(alpha) AS alpha, (max(yy) - 2 * sum(b * r) + max(q)) / greatest(max(n) - (1 + count(*) - max(alpha) * sum(a)), 1e-9) ** 2 AS gcv
 FROM gcb JOIN mor USING (win, i) JOIN moy USING (win) JOIN gq USING (method) GROUP BY method),
gw AS (SELECT method, alpha FROM gv ORDER BY gcv, alpha LIMIT 1)""", solve.scores("gc", "mo", "TRUE")])


@query("ridge_gcv", compose("SELECT event_id, CAST(frame_j AS BIGINT) AS frame_j, " + r6("s", "score") + ", alpha FROM gcp JOIN gw USING (method)", "panel", extra=_GCV))
def ridge_gcv(spark, sf) -> DataFrame:
    p = Shared.of(spark, sf).panel
    mom = models.moments(p, ft.ORIGIN_SETS["ol_origin"], [Y], is_train())
    m, alpha = models.solve_ridge_gcv(mom, ft.ORIGIN_SETS["ol_origin"], Y, VECTOR_ALPHAS)
    return big(rounded6(p.select("event_id", "frame_j", m.column().alias("score")), "score"), "frame_j").withColumn("alpha", F.lit(alpha))


def _with_vectors(s: Shared) -> DataFrame:
    n_vec = s.vectors.agg(F.count(F.lit(1))).scalar()
    return s.panel.withColumn("vec_id", F.col("post_id") % n_vec).join(s.vectors, "vec_id")


def _vector_rows(fit: str, where: str) -> str:
    return f"SELECT 'main' AS win, {fit} AS fit, event_id, sym, frame_j, {Y} AS y, CAST(embedding AS DOUBLE[]) AS xs FROM panel JOIN embeddings USING (vec_id) WHERE {where}"


_DIM = f"(SELECT CAST(a AS VARCHAR) AS method, range(0, (SELECT max(len(embedding)) FROM embeddings)) AS ix, a AS alpha FROM (SELECT unnest({VECTOR_ALPHAS!r}) AS a))"
_VECTOR = ",\n".join([
    solve.moments("vi", _vector_rows(_INNER, _TRAIN), "loose", impute=False), solve.solved("vs", "vi", _DIM, spare=None), solve.scores("vs", "vi", "NOT fit"),
    solve.metric_table("vs"),
    f"vbest AS MATERIALIZED (SELECT method, ix, alpha FROM {_DIM} d JOIN vst USING (method) ORDER BY round(ndcg3, 12) DESC, alpha DESC LIMIT 1)",
    solve.moments("vo", _vector_rows(_TRAIN, "TRUE"), "loose", impute=False), solve.solved("vf", "vo", "(SELECT method, ix, alpha FROM vbest)", spare=None),
    solve.scores("vf", "vo", "TRUE")])


@query("vector_ridge", compose("SELECT event_id, CAST(frame_j AS BIGINT) AS frame_j, " + r6("s", "score") + ", alpha FROM vfp, (SELECT max(alpha) AS alpha FROM vbest)",
                               "panel", extra=_VECTOR))
def vector_ridge(spark, sf) -> DataFrame:
    s = Shared.of(spark, sf)
    scored, alpha = models.vector_ridge_select(_with_vectors(s), "emb", Y, inner_fit(), inner_dev(), is_train(), VECTOR_ALPHAS)
    return big(rounded6(scored.select("event_id", "frame_j", "score"), "score"), "frame_j").withColumn("alpha", F.lit(alpha))


_BASE = "(SELECT method, ix, alpha FROM vbest)"
_RESID = lambda fit, base, where: f"""SELECT 'main' AS win, {fit} AS fit, event_id, panel.sym, frame_j, {Y} - b.s AS y, {solve.features(ft.CONTEXT)} AS xs
 FROM panel JOIN {base} b USING (event_id, frame_j) WHERE {where}"""
_CONTEXT = f"(SELECT CAST(a AS VARCHAR) AS method, range(0, {len(ft.CONTEXT)}) AS ix, a AS alpha FROM (SELECT unnest({VECTOR_ALPHAS!r}) AS a))"
_RESIDUAL = ",\n".join([
    _VECTOR, solve.solved("rb", "vi", _BASE, spare=None), solve.scores("rb", "vi", "TRUE"),  # the inner base on all training rows
    solve.moments("ri", _RESID(_INNER, "rbp", _TRAIN), "loose"), solve.solved("rr", "ri", _CONTEXT), solve.scores("rr", "ri", "NOT fit"),
    f"""rgp AS MATERIALIZED (SELECT 'main' AS win, r.method || '|' || CAST(l AS VARCHAR) AS method, event_id, sym, frame_j, b.y, b.s + l * r.s AS s
 FROM rrp r JOIN (SELECT event_id, frame_j, y, s FROM rbp) b USING (event_id, frame_j), (SELECT unnest({LAMBDAS!r}) AS l))""", solve.metric_table("rg"),
    f"""rbest AS MATERIALIZED (SELECT c.method, ix, alpha, l FROM {_CONTEXT} c, (SELECT unnest({LAMBDAS!r}) AS l) JOIN rgt g ON TRUE
 WHERE g.method = c.method || '|' || CAST(l AS VARCHAR) ORDER BY round(ndcg3, 12) DESC, alpha DESC, l DESC LIMIT 1)""",
    solve.moments("rz", _RESID(_TRAIN, "vfp", "TRUE"), "loose"), solve.solved("rw", "rz", "(SELECT method, ix, alpha FROM rbest)"), solve.scores("rw", "rz", "TRUE")])


@query("residual_plugin", compose("SELECT event_id, CAST(frame_j AS BIGINT) AS frame_j, " + r6("b.s", "base_score") + ", " + r6("b.s + l * w.s", "score")
       + " FROM vfp b JOIN (SELECT event_id, frame_j, s FROM rwp) w USING (event_id, frame_j), rbest", "panel", extra=_RESIDUAL))
def residual_plugin(spark, sf) -> DataFrame:
    s = Shared.of(spark, sf)
    out, _ = models.residual_plugin(_with_vectors(s), "emb", ft.CONTEXT, Y, inner_fit(), inner_dev(), is_train(),
                                    VECTOR_ALPHAS, LAMBDAS)
    return big(rounded6(out.select("event_id", "frame_j", "base_score", "score"), "base_score", "score"), "frame_j")


def graph_panel(s: Shared) -> DataFrame:
    return pn.attach_graph(s.panel, s.state.degree, ["g_out", "g_in", "g_net", "g_net_rate", "log_g_total"])


@query("listwise_ranker")
def listwise_ranker(spark, sf) -> DataFrame:
    """Four feature sets with the net-lead rate, fitted listwise on train-edge grades."""
    p = cut(mx.quantile_grade(graph_panel(Shared.of(spark, sf)), Y, is_train()))
    sets = {k: models.listwise(p, fs, "grade", is_train()) for k, fs in ft.RATE_SETS.items()}
    return _set_means(p, sets)


@query("tree_ranker")
def tree_ranker(spark, sf) -> DataFrame:
    p = cut(mx.quantile_grade(graph_panel(Shared.of(spark, sf)), Y, is_train()))
    out = models.tree_ranker(p, ft.RATE_SETS["BR_ctx+Ok+rate"], "grade", is_train())
    ev = mx.event_metrics(out.filter("split = 'test'"), Y, "score", ["event_id", "sym"], ks=(1, 3))
    return mx.symbol_mean(ev, ["ndcg3", "hit1", "mass3", "js"])


_TREE_SET = ft.RATE_SETS["BR_ctx+Ok+rate"]
TREE_SIZES = [5, 10, 20]  # every level of a tree is a job over the rows: the registered query keeps the trees few


def _nine_decimals(c: str) -> Column:
    """Rounded in doubles, halves away from zero, as the check query does. ``F.round`` goes by the decimal digits: it may take
    another neighbour where these end in a half at the tenth place, as every eighteenth number of microseconds does in hours."""
    x = F.col(c).cast("double")
    scaled = F.abs(x) * 1e9
    even = F.rint(scaled)
    return F.signum(x) * (even + F.when(scaled - even == 0.5, 1.0).otherwise(0.0)) / 1e9


def _graded(spark, sf) -> DataFrame:
    """Panel with grades; numbers equal to nine decimals are equal, so that bins do not hang on the order of sums."""
    p = graph_panel(Shared.of(spark, sf))
    return cut(mx.quantile_grade(p.withColumns({c: _nine_decimals(c) for c in [*_TREE_SET, Y]}), Y, is_train()))


@query("listwise_trees")
def listwise_trees(spark, sf) -> DataFrame:
    """Listwise boosted trees, their number chosen on the inner split, scored on the test days."""
    p = _graded(spark, sf)
    model, size, _ = boosting.select_trees(p, _TREE_SET, "grade", Y, inner_fit(), inner_dev(), is_train(), TREE_SIZES, rate=0.1, depth=3)
    ev = mx.event_metrics(model.score(p.filter("split = 'test'")), Y, "score", ["event_id", "sym"], ks=(1, 3))
    return mx.symbol_mean(ev, ["ndcg3", "hit1", "mass3", "js"]).withColumn("n_trees", F.lit(size))


@query("listwise_tree_losses", f"SELECT unnest(range(1, {TREE_SIZES[-1] + 1})) AS tree, true AS falls, true AS below_uniform")
def listwise_tree_losses(spark, sf) -> DataFrame:
    """The training loss after each tree, grown on all events and features: below the one before and below that of equal scores."""
    model = boosting.fit_trees(_graded(spark, sf).filter(is_train()), _TREE_SET, "grade", TREE_SIZES[-1], rate=0.1, depth=3, subsample=1.1,
                               colsample=1.0)
    rows = [(i, b < a, b < model.losses[0]) for i, (a, b) in enumerate(zip(model.losses, model.losses[1:]), 1)]
    return spark.createDataFrame(rows, "tree bigint, falls boolean, below_uniform boolean")


_SPLITS = """ge AS (SELECT list_sort(list_distinct(quantile_cont(round(log_future_reach, 9), """ + str([i / 32 for i in range(33)]) + """))) AS e FROM panel WHERE split = 'train'),
gr AS MATERIALIZED (SELECT event_id, p / sum(p) OVER w AS p, 1.0 / count(*) OVER w AS q, xs FROM (SELECT event_id,
 exp(least(len(list_filter(e[2:len(e)-1], lambda x: x <= round(log_future_reach, 9))), greatest(1, len(e) - 2))) AS p, [""" + ", ".join(
    f"round(CAST({'coalesce(g_net_rate, 0)' if f == 'g_net_rate' else f} AS DOUBLE), 9)" for f in _TREE_SET) + """] AS xs
 FROM panel LEFT JOIN deg USING (cutoff, actor), ge WHERE split = 'train') WINDOW w AS (PARTITION BY event_id)),
fx AS MATERIALIZED (SELECT unnest(xs) AS x, unnest(range(len(xs))) AS i, q - p AS g, q * (1 - q) AS h FROM gr),
be AS (SELECT i, unnest(list_distinct(quantile_cont(x, """ + str([i / 32 for i in range(1, 32)]) + """))) AS edge FROM fx GROUP BY i),
tot AS (SELECT i, sum(g) AS g, sum(h) AS h, count(*) AS n FROM fx GROUP BY i),
cand AS (SELECT be.i, edge, sum(fx.g) AS gl, sum(fx.h) AS hl, count(*) AS nl FROM be JOIN fx ON fx.i = be.i AND (x <= edge OR x IS NULL) GROUP BY be.i, edge
 UNION ALL SELECT i, CAST('-infinity' AS DOUBLE), sum(g), sum(h), count(*) FROM fx WHERE x IS NULL GROUP BY i),
gained AS (SELECT i, nl, gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1) AS gain FROM cand JOIN tot USING (i) WHERE nl >= 20 AND n - nl >= 20),
top AS (SELECT i, max(gain) AS gain, min(nl) FILTER (gain > best - 1e-9) AS nl FROM (SELECT *, max(gain) OVER (PARTITION BY i) AS best FROM gained) GROUP BY i)"""


@query("listwise_first_split", compose("SELECT f AS feature, " + r6("CASE WHEN gain > 1e-9 THEN gain ELSE 0 END", "gain")
       + ", CAST(CASE WHEN gain > 1e-9 THEN nl ELSE 0 END AS BIGINT) AS n_left FROM (SELECT unnest(" + str(_TREE_SET) + ") AS f, unnest(range("
       + str(len(_TREE_SET)) + ")) AS i) LEFT JOIN top USING (i)", "panel", "deg", extra=_SPLITS))
def listwise_first_split(spark, sf) -> DataFrame:
    """Gain and rows left of each feature's best first split: the histograms of the first level, which a query can state."""
    rows = boosting.root_splits(_graded(spark, sf).filter(is_train()), _TREE_SET, "grade")
    return rounded6(spark.createDataFrame(rows, "feature string, gain double, n_left bigint"), "gain")


_OLS = """zz AS (SELECT event_id, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b, log_future_reach - avg(log_future_reach) OVER w AS y FROM (
 SELECT event_id, log_future_reach, (origin_ol - ma) / (sa + 1e-12) AS a, (log_origin_rank - mb) / (sb + 1e-12) AS b FROM panel,
 (SELECT avg(origin_ol) AS ma, stddev_pop(origin_ol) AS sa, avg(log_origin_rank) AS mb, stddev_pop(log_origin_rank) AS sb FROM panel WHERE split = 'train') WHERE split = 'test')
 WINDOW w AS (PARTITION BY event_id) QUALIFY count(*) OVER w >= 2),
gg AS (SELECT sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*y) AS ay, sum(b*y) AS byy, sum(y*y) AS yy, count(*) AS n, count(DISTINCT event_id) AS g FROM zz),
bb_ AS (SELECT *, (ay*bb - ab*byy)/(aa*bb - ab*ab) AS b1, (aa*byy - ab*ay)/(aa*bb - ab*ab) AS b2, aa*bb - ab*ab AS det FROM gg),
mm AS (SELECT sum(s1*s1) AS m11, sum(s1*s2) AS m12, sum(s2*s2) AS m22, sum(u2) AS ssr FROM (SELECT sum(a*u) AS s1, sum(b*u) AS s2, sum(u*u) AS u2 FROM (SELECT zz.*, y - b1*a - b2*b AS u FROM zz, bb_) GROUP BY event_id))"""
_V = {"origin_ol": ("b1", "bb*(bb*m11 - ab*m12) - ab*(bb*m12 - ab*m22)"), "log_origin_rank": ("b2", "aa*(aa*m22 - ab*m12) - ab*(aa*m12 - ab*m11)")}


@query("within_event_ols", compose(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, n, g AS n_clusters, {r6(b, 'coef')}, {r6(f'sqrt(({v}) / (det*det) * (g / (g - 1.0)) * ((n - 1.0) / (n - 2)))', 'cluster_se')}, {r6('1 - ssr / yy', 'r2_within')} FROM bb_, mm"
    for f, (b, v) in _V.items()), "panel", extra=_OLS))
def within_event_ols(spark, sf) -> DataFrame:
    """Event fixed effects with event-clustered errors; two features, where the closed form fits a query."""
    p = Shared.of(spark, sf).panel
    fs = ["origin_ol", "log_origin_rank"]
    fit = models.within_ols(p, fs, Y, F.col("split") == "test", models.moments(p, fs, [Y], is_train()))
    rows = [(f, fit.n, fit.groups, float(b), float(e), float(fit.r2)) for f, b, e in zip(fs, fit.beta, fit.se)]
    return rounded6(spark.createDataFrame(rows, "feature string, n bigint, n_clusters bigint, coef double, cluster_se double, r2_within double"),
                    "coef", "cluster_se", "r2_within")


@query("nested_test")
def nested_test(spark, sf) -> DataFrame:
    """Context against context plus trait terms inside events, per split."""
    p = Shared.of(spark, sf).panel
    full = ft.ORIGIN_SETS["ol_origin"]
    added = [f for f in full if f not in ft.CONTEXT]
    mom = models.moments(p, full, [Y], is_train())
    rows = []
    for split in ("train", "test"):
        mask = F.col("split") == split
        a = models.within_ols(p, ft.CONTEXT, Y, mask, mom)
        b = models.within_ols(p, full, Y, mask, mom)
        w = models.nested_wald(a, b, added)
        for f in added:
            i = full.index(f)
            t = float(b.beta[i] / b.se[i]) if b.se[i] > 0 else None
            rows.append((split, f, float(b.beta[i]), float(b.se[i]), t, t_sf2(t, max(b.groups - 1, 1)) if t is not None else None,
                         a.r2, b.r2, w["delta_r2_within"], w["ssr_reduction"], w["wald_chi2"], w["p_value"]))
    return spark.createDataFrame(rows, "split string, feature string, coef double, cluster_se double, t double, p double, r2_base double, "
                                       "r2_full double, delta_r2 double, ssr_reduction double, wald_chi2 double, wald_p double")


# ---- graph -----------------------------------------------------------------------------------

PIECES["edges"] = (["rk", "cutoffs"], """gk AS MATERIALIZED (SELECT cutoff, sym, day, actor, rank, k FROM rk JOIN cutoffs ON day < cutoff),
edges AS MATERIALIZED (SELECT a.cutoff, a.actor AS src, b.actor AS dst, CAST(count(*) AS DOUBLE) AS w FROM gk a JOIN gk b
 ON a.cutoff = b.cutoff AND a.sym = b.sym AND a.day = b.day AND a.rank < b.rank GROUP BY 1, 2, 3),
nodes AS MATERIALIZED (SELECT cutoff, actor, CAST(sum(k - rank) AS DOUBLE) AS o, CAST(sum(rank - 1) AS DOUBLE) AS i,
 count(*) OVER (PARTITION BY cutoff) AS n FROM gk GROUP BY cutoff, actor)""")
# recursions to the operators' own stop rules: every round sees the one before, the last round of a cutoff is its result
PIECES["pr"] = (["edges"], """prw AS (SELECT 0 AS it, cutoff, actor, n, i, 1.0 / n AS x, CAST(1e9 AS DOUBLE) AS err FROM nodes UNION ALL
 SELECT it, cutoff, actor, n, i, x, sum(abs(x - was)) OVER (PARTITION BY cutoff) AS err FROM (
 SELECT p.it + 1 AS it, p.cutoff, p.actor, p.n, p.i, p.x AS was, 0.85 * (coalesce(s.y, 0) + coalesce(l.lost, 0) / p.n) + 0.15 / p.n AS x FROM prw p
 LEFT JOIN (SELECT e.cutoff, src, sum(w * q.x / q.i) AS y FROM edges e JOIN prw q ON q.cutoff = e.cutoff AND q.actor = dst GROUP BY e.cutoff, src) s
  ON s.cutoff = p.cutoff AND s.src = p.actor
 LEFT JOIN (SELECT cutoff, sum(x) AS lost FROM prw WHERE i = 0 GROUP BY cutoff) l ON l.cutoff = p.cutoff
 WHERE p.err >= p.n * 1e-6 AND p.it < 100)),
pr AS MATERIALIZED (SELECT cutoff, actor, x AS g_pr FROM prw QUALIFY it = max(it) OVER (PARTITION BY cutoff))""")
PIECES["hub"] = (["edges"], """hw AS (SELECT 0 AS it, cutoff, actor, 1.0 / n AS x, CAST(1e9 AS DOUBLE) AS err FROM nodes UNION ALL
 SELECT it, cutoff, actor, x, sum(abs(x - was)) OVER (PARTITION BY cutoff) AS err FROM (
 SELECT it, cutoff, actor, was, y / sum(y) OVER (PARTITION BY cutoff) AS x FROM (
 SELECT p.it + 1 AS it, p.cutoff, p.actor, p.x AS was, coalesce(s.y, 0) AS y FROM hw p LEFT JOIN (
  SELECT e.cutoff, e.src, sum(e.w * a.x) AS y FROM edges e JOIN (
   SELECT f.cutoff, f.dst, sum(f.w * q.x) AS x FROM edges f JOIN hw q ON q.cutoff = f.cutoff AND q.actor = f.src GROUP BY f.cutoff, f.dst) a
  ON a.cutoff = e.cutoff AND a.dst = e.dst GROUP BY e.cutoff, e.src) s ON s.cutoff = p.cutoff AND s.src = p.actor
 WHERE p.err >= 1e-8 AND p.it < 500))),
hub AS MATERIALIZED (SELECT cutoff, actor, x AS g_hub FROM hw QUALIFY it = max(it) OVER (PARTITION BY cutoff))""")
PIECES["inf"] = (["edges"], """iw AS (SELECT 0 AS it, cutoff, actor, n, o, i, CAST(1 AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS b FROM nodes UNION ALL
 SELECT it, cutoff, actor, n, o, i, a / sum(a) OVER (PARTITION BY cutoff) * n AS a, b / sum(b) OVER (PARTITION BY cutoff) * n AS b FROM (
 SELECT p.it + 1 AS it, p.cutoff, p.actor, p.n, p.o, p.i, CASE WHEN o > 0 THEN coalesce(l.y, 0) / o ELSE 0 END AS a,
  CASE WHEN i > 0 THEN coalesce(t.y, 0) / i ELSE 0 END AS b FROM iw p
 LEFT JOIN (SELECT e.cutoff, src, sum(w * q.b) AS y FROM edges e JOIN iw q ON q.cutoff = e.cutoff AND q.actor = dst GROUP BY e.cutoff, src) l
  ON l.cutoff = p.cutoff AND l.src = p.actor
 LEFT JOIN (SELECT e.cutoff, dst, sum(w * q.a) AS y FROM edges e JOIN iw q ON q.cutoff = e.cutoff AND q.actor = src GROUP BY e.cutoff, dst) t
  ON t.cutoff = p.cutoff AND t.dst = p.actor WHERE p.it < 100)),
inf AS MATERIALIZED (SELECT cutoff, actor, a AS influence, b AS passivity FROM iw WHERE it = 100)""")
_LAST = f"cutoff = DATE '{CUTOFFS[1]}'"


def lead_graph(s: Shared) -> graph.LeadGraph:
    if "lead_graph" not in s.__dict__:
        s.__dict__["lead_graph"] = graph.LeadGraph(s.ranked.filter(F.col("day") < F.lit(CUTOFFS[1]).cast("date")), MIN_ACTORS)
    return s.__dict__["lead_graph"]


def _r10(d: DataFrame, *cols: str) -> DataFrame:
    return d.withColumns({c: F.round(c, 9) for c in cols})


@query("pagerank_reversed", compose(f"SELECT actor, round(g_pr, 9) + 0.0 AS g_pr FROM pr WHERE {_LAST}", "pr"))
def pagerank_reversed(spark, sf) -> DataFrame:
    return _r10(graph.pagerank_reversed(lead_graph(Shared.of(spark, sf))), "g_pr")


@query("hits_hub", compose(f"SELECT actor, {r6('g_hub', 'g_hub')} FROM hub WHERE {_LAST}", "hub"))
def hits_hub(spark, sf) -> DataFrame:
    return rounded6(graph.hits_hub(lead_graph(Shared.of(spark, sf))), "g_hub")


@query("influence_passivity", compose(f"SELECT actor, {r6('influence', 'influence')}, {r6('passivity', 'passivity')} FROM inf WHERE {_LAST}", "inf"))
def influence_passivity(spark, sf) -> DataFrame:
    return rounded6(graph.influence_passivity(lead_graph(Shared.of(spark, sf))), "influence", "passivity")


_GRAPH = ["g_out", "g_in", "g_net", "g_net_rate", "g_pr", "g_hub", "influence", "passivity"]


@query("graph_features_panel", compose(f"""SELECT event_id, CAST(frame_j AS BIGINT) AS frame_j, split, {', '.join(r6(f'coalesce({c}, 0)', c) for c in _GRAPH)}
 FROM panel LEFT JOIN deg USING (cutoff, actor) LEFT JOIN pr USING (cutoff, actor) LEFT JOIN hub USING (cutoff, actor) LEFT JOIN inf USING (cutoff, actor)""",
       "panel", "deg", "pr", "hub", "inf"))
def graph_features_panel(spark, sf) -> DataFrame:
    """Every graph score of the panel's actors at the row's own cutoff: the graphs of all cutoffs settle in one batch."""
    s = Shared.of(spark, sf)
    g = graph.graph_features(lead_graph(s), CUTOFFS)
    out = pn.attach_graph(s.panel, g, _GRAPH)
    return big(rounded6(out.select("event_id", "frame_j", "split", *_GRAPH), *_GRAPH), "frame_j")


# the Laplacian of the comparisons with one actor grounded, solved by elimination, then centred
_POTENTIAL = f"""pk AS MATERIALIZED (SELECT * FROM gk WHERE {_LAST}),
pn AS MATERIALIZED (SELECT actor, row_number() OVER (ORDER BY actor) AS p, count(*) OVER () AS n, CAST(sum(k - 1) AS DOUBLE) AS d,
 CAST(sum(rank - 1) - sum(k - rank) AS DOUBLE) AS r FROM pk GROUP BY actor),
pc AS (SELECT a.actor AS x, b.actor AS y, -CAST(count(*) AS DOUBLE) AS c FROM pk a JOIN pk b USING (sym, day) WHERE a.actor <> b.actor GROUP BY 1, 2),
pl AS (SELECT a.p, list_append(list(CASE WHEN a.p = b.p THEN a.d ELSE coalesce(c, 0) END ORDER BY b.p), max(a.r)) AS line
 FROM pn a JOIN pn b ON a.p < a.n AND b.p < b.n LEFT JOIN pc ON x = a.actor AND y = b.actor GROUP BY a.p),
pe AS (SELECT 1 AS k, list(line ORDER BY p) AS m FROM pl
 UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(m[k], lambda x: x / m[k][k])
  ELSE list_transform(list_zip(r, m[k]), lambda q: q[1] - r[k] / m[k][k] * q[2]) END) FROM pe WHERE k <= len(m)),
px AS (SELECT actor, CASE WHEN p < n THEN m[p][n] ELSE 0 END AS s FROM pn, (SELECT m FROM pe WHERE k = len(m) + 1))"""


@query("precedence_potential", compose("SELECT actor, " + r6("s - avg(s) OVER ()", "potential") + ", " + r6("avg(s) OVER () - s", "leadership")
                                       + " FROM px", "edges", extra=_POTENTIAL))
def precedence_potential(spark, sf) -> DataFrame:
    out, _ = graph.precedence_potential(lead_graph(Shared.of(spark, sf)))
    return rounded6(out.select("actor", "potential", "leadership"), "potential", "leadership")


@query("random_walks")
def random_walks(spark, sf) -> DataFrame:
    return graph.random_walks(lead_graph(Shared.of(spark, sf)), walks=10, length=20)


@query("node_embeddings")
def node_embeddings(spark, sf) -> DataFrame:
    return graph.node_embeddings(lead_graph(Shared.of(spark, sf)), dim=64, walks=10, length=20)


@query("graph_panel", compose(f"""SELECT event_id, CAST(frame_j AS BIGINT) AS frame_j, {r6('coalesce(g_out, 0)', 'g_out')}, {r6('coalesce(g_in, 0)', 'g_in')}, {r6('coalesce(g_net, 0)', 'g_net')},
 {r6('coalesce(g_net_rate, 0)', 'g_net_rate')} FROM panel LEFT JOIN deg USING (cutoff, actor)""", "panel", "deg"))
def graph_panel_query(spark, sf) -> DataFrame:
    cols = ["g_out", "g_in", "g_net", "g_net_rate"]
    return big(rounded6(graph_panel(Shared.of(spark, sf)).select("event_id", "frame_j", *cols), *cols), "frame_j")


# ---- resampling ------------------------------------------------------------------------------

_M4 = ["ndcg3", "hit1", "mass3", "js"]


def _deltas(spark, sf) -> DataFrame:
    e = cut(method_events(spark, sf))
    parts = []
    for a, b in (("trait", "followers"), ("novelty", "earliest")):
        d = resample.metric_deltas(e.filter(F.col("method") == a), e.filter(F.col("method") == b))
        parts.append(resample.long_deltas(d).withColumn("comparison", F.lit(f"{a}_vs_{b}")))
    return cut(parts[0].unionByName(parts[1]))


@query("bootstrap_symbols")
def bootstrap_symbols(spark, sf) -> DataFrame:
    return resample.bootstrap(_deltas(spark, sf), ["comparison", "metric"], B=600, levels=2)


@query("bootstrap_pooled")
def bootstrap_pooled(spark, sf) -> DataFrame:
    return resample.bootstrap(_deltas(spark, sf), ["comparison", "metric"], B=600, levels=1)


_DELTA_SQL = "dl AS (" + " UNION ALL ".join(
    f"SELECT '{a}_vs_{b}' AS comparison, '{m}' AS metric, sym, {'b.js - a.js' if m == 'js' else f'a.{m} - b.{m}'} AS delta FROM (SELECT * FROM em WHERE method = '{a}') a JOIN (SELECT * FROM em WHERE method = '{b}') b USING (event_id, sym)"
    for a, b in (("trait", "followers"), ("novelty", "earliest")) for m in _M4) + ")"


@query("bootstrap_observed", compose(f"""SELECT comparison, metric, {r6('avg(m)', 'observed')}, CAST(count(*) AS BIGINT) AS n_symbols, CAST(sum(n) AS BIGINT) AS n_events, true AS inside FROM (
 SELECT comparison, metric, sym, avg(delta) AS m, count(*) AS n FROM dl GROUP BY 1, 2, 3) GROUP BY 1, 2""", "em", extra=_DELTA_SQL))
def bootstrap_observed(spark, sf) -> DataFrame:
    """The exact part of the two-level bootstrap, and that its interval holds the observed mean."""
    d = resample.bootstrap(_deltas(spark, sf), ["comparison", "metric"], B=600, levels=2)
    inside = (F.col("lo") - 1e-9 <= F.col("observed")) & (F.col("observed") <= F.col("hi") + 1e-9)
    return big(rounded6(d.select("comparison", "metric", "observed", "n_symbols", "n_events", inside.alias("inside")), "observed"), "n_symbols", "n_events")


@query("bootstrap_auc")
def bootstrap_auc(spark, sf) -> DataFrame:
    from originflow.catalog.ranking import topq
    t = topq(spark, sf).withColumn("row_id", F.xxhash64("event_id", "frame_j"))
    cells = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("score")) for m, c in (("trait", "origin_ol"), ("followers", "origin_logfoll"))])
    long = t.select("sym", "row_id", "label", F.explode(cells).alias("c")).select("sym", "row_id", "label", "c.*")
    draws = resample.bootstrap_auc(long, "label", "row_id", B=2000)
    return resample.auc_intervals(draws, [("trait", "followers")])


@query("permutation_hierarchy")
def permutation_hierarchy(spark, sf) -> DataFrame:
    return resample.permutation_hierarchy(Shared.of(spark, sf).ranked, n=1000)


_BIN = "CAST(floor(date_diff('day', DATE '2024-01-01', day) / 10) AS INTEGER)"


def _group_trait_sql(group: str, expr: str) -> str:
    body = PIECES["trait"][1].replace("tj", "gtj").replace("tsum", "gtsum").replace("tcoef", "gtcoef").replace("trait AS", "gtrait AS")
    body = body.replace("FROM rawl r JOIN meta m", "FROM grawl r JOIN gmeta m").replace("cutoff", group)
    return f"""grawl AS (SELECT {expr} AS {group}, actor, avg(net_lead) AS raw_lead, count(*) AS n_events FROM rk GROUP BY 1, 2 HAVING count(*) >= 4),
gmeta AS (SELECT {expr} AS {group}, actor, median(hour) AS medhour FROM posts GROUP BY 1, 2),
{body}"""


def _bins(s: Shared):
    b = lambda d: d.withColumn("bin", F.floor(F.datediff("day", F.lit("2024-01-01")) / 10).cast("int"))
    return actors.group_traits(b(s.ranked), b(s.posts), "bin", min_events=4)


_RHO = """SELECT {keys} count(*) AS n, round(corr(ra, rb), 6) + 0.0 AS rho FROM (SELECT *, rank() OVER ({part} ORDER BY a) + (count(*) OVER (PARTITION BY {tie} a) - 1) / 2.0 AS ra,
 rank() OVER ({part} ORDER BY b) + (count(*) OVER (PARTITION BY {tie} b) - 1) / 2.0 AS rb FROM ({src})) {group}"""


@query("persistence", compose(_RHO.format(keys="bin,", part="PARTITION BY bin", tie="bin,", group="GROUP BY bin",
       src="SELECT x.bin, x.actor, x.oltrait AS a, y.oltrait AS b FROM gtrait x JOIN gtrait y ON y.actor = x.actor AND y.bin = x.bin + 1"), "rk", "posts", extra=_group_trait_sql("bin", _BIN)))
def persistence(spark, sf) -> DataFrame:
    """Lag-1 Spearman of the trait across ten-day bins."""
    t = cut(_bins(Shared.of(spark, sf)).select("bin", "actor", F.col("oltrait").alias("trait")))
    return rounded6(resample.persistence(t, 1), "rho")


@query("persistence_hour_matched", compose(_RHO.format(keys="bin,", part="PARTITION BY bin", tie="bin,", group="GROUP BY bin",
       src="""SELECT x.bin, x.actor, x.oltrait AS a, y.oltrait AS b FROM gtrait x JOIN nh ON nh.actor = x.actor JOIN gtrait y ON y.actor = nh.match AND y.bin = x.bin + 1"""),
       "rk", "posts", "meta", extra=_group_trait_sql("bin", _BIN) + f""",
nh AS (SELECT actor, match FROM (SELECT a.actor, b.actor AS match, row_number() OVER (PARTITION BY a.actor ORDER BY abs(a.medhour - b.medhour), b.actor) AS z
 FROM (SELECT * FROM meta WHERE cutoff = DATE '{CUTOFFS[1]}') a JOIN (SELECT * FROM meta WHERE cutoff = DATE '{CUTOFFS[1]}') b ON a.actor <> b.actor) WHERE z = 1)"""))
def persistence_hour_matched(spark, sf) -> DataFrame:
    """The same with the later value of the nearest-hour other actor: the null for shared posting hours."""
    s = Shared.of(spark, sf)
    t = cut(_bins(s).select("bin", "actor", F.col("oltrait").alias("trait")))
    near = actors.nearest_hour(s.state.meta.filter(F.col("cutoff") == F.lit(CUTOFFS[1]).cast("date")))
    return rounded6(resample.persistence(t, 1, near), "rho")


@query("cross_group_consistency", compose(_RHO.format(keys="", part="", tie="", group="",
       src="SELECT x.actor, x.oltrait AS a, y.oltrait AS b FROM gtrait x JOIN gtrait y ON x.actor = y.actor AND x.grp = 'A' AND y.grp = 'B'"),
       "rk", "posts", extra=_group_trait_sql("grp", "CASE WHEN sym IN ('click', 'error', 'purchase') THEN 'A' ELSE 'B' END")))
def cross_group_consistency(spark, sf) -> DataFrame:
    s = Shared.of(spark, sf)
    g = lambda d: d.withColumn("grp", F.when(F.col("sym").isin("click", "error", "purchase"), "A").otherwise("B"))
    t = cut(actors.group_traits(g(s.ranked), g(s.posts), "grp"))
    a = t.filter("grp = 'A'").select("actor", F.col("oltrait").alias("a"))
    b = t.filter("grp = 'B'").select("actor", F.col("oltrait").alias("b"))
    return rounded6(mx.corr_rank(a.join(b, "actor"), "a", "b"), "rho")


_PROXY = ["med_followers", "n_events", "n_posts", "medhour"]


@query("orthogonality", compose(" UNION ALL ".join(
    f"SELECT '{c}' AS proxy, n, rho FROM (" + _RHO.format(keys="", part="", tie="", group="",
    src=f"SELECT t.oltrait AS a, CAST({'t' if c == 'n_events' else 'm'}.{c} AS DOUBLE) AS b FROM trait t JOIN meta m USING (cutoff, actor) WHERE cutoff = DATE '{CUTOFFS[1]}'") + ")"
    for c in _PROXY), "trait", "meta"))
def orthogonality(spark, sf) -> DataFrame:
    """Spearman of the trait with account size, activity and posting hour; all proxies in one grouped job."""
    st = Shared.of(spark, sf).state
    at = F.col("cutoff") == F.lit(CUTOFFS[1]).cast("date")
    d = st.trait.filter(at).drop("medhour").join(st.meta.filter(at), ["cutoff", "actor"])
    long = d.select("oltrait", F.explode(F.array(*[F.struct(F.lit(c).alias("proxy"), F.col(c).cast("double").alias("b")) for c in _PROXY])).alias("p")).select("oltrait", "p.*")
    return rounded6(mx.corr_rank(long, "oltrait", "b", ["proxy"]), "rho")


@query("partial_rank_corr", compose(f"""SELECT n, {r6('(r_ab - r_ac * r_bc) / sqrt((1 - r_ac * r_ac) * (1 - r_bc * r_bc))', 'partial')} FROM (SELECT count(*) AS n, corr(a, b) AS r_ab, corr(a, c) AS r_ac, corr(b, c) AS r_bc FROM (
 SELECT rank() OVER (ORDER BY oltrait) + (count(*) OVER (PARTITION BY oltrait) - 1) / 2.0 AS a, rank() OVER (ORDER BY log_followers) + (count(*) OVER (PARTITION BY log_followers) - 1) / 2.0 AS b,
 rank() OVER (ORDER BY n_posts) + (count(*) OVER (PARTITION BY n_posts) - 1) / 2.0 AS c FROM trait JOIN meta USING (cutoff, actor) WHERE cutoff = DATE '{CUTOFFS[1]}'))""", "trait", "meta"))
def partial_rank_corr(spark, sf) -> DataFrame:
    st = Shared.of(spark, sf).state
    at = F.col("cutoff") == F.lit(CUTOFFS[1]).cast("date")
    d = st.trait.filter(at).join(st.meta.filter(at).drop("medhour"), ["cutoff", "actor"]).withColumn("n_posts", F.col("n_posts").cast("double"))
    return rounded6(resample.partial_rank_corr(d, "oltrait", "log_followers", "n_posts").select("n", "partial"), "partial")


_SUB = {"all": "TRUE", "verified": "verified > 0", "quiet_days": "day IN (SELECT day FROM posts GROUP BY day HAVING count(*) <= (SELECT median(c) FROM (SELECT count(*) AS c FROM posts GROUP BY day)))"}
_SUB_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS subset, {g} AS min_actors, sym, round(sum(s * s / CAST(n AS DOUBLE)), 6) + 0.0 AS statistic, count(*) AS actors FROM (SELECT sym, actor, sum(k + 1 - 2 * rank) AS s, count(*) AS n FROM ("
    f"SELECT sym, actor, row_number() OVER (PARTITION BY sym, day ORDER BY us, first_seen, post_id) AS rank, count(*) OVER (PARTITION BY sym, day) AS k FROM (SELECT * FROM fp WHERE {w})) WHERE k >= {g} GROUP BY sym, actor HAVING count(*) >= 4) GROUP BY sym"
    for n, w in _SUB.items() for g in (3, 10))


@query("subset_robustness", compose(_SUB_SQL, "fp"))
def subset_robustness(spark, sf) -> DataFrame:
    """The hierarchy statistic on subsets of posts and days, and for other event gates."""
    s = Shared.of(spark, sf)
    days = s.posts.groupBy("day").agg(F.count(F.lit(1)).alias("c"))
    mid = days.agg(F.percentile("c", F.lit(0.5))).scalar()  # one row per day
    quiet = days.withColumn("m", mid).filter("c <= m").select("day")
    fp = first_posts(s.posts)
    subsets = {"all": fp, "verified": fp.filter("verified > 0"), "quiet_days": fp.join(quiet, "day", "left_semi")}
    out = None
    for n, f in subsets.items():
        r = rank_posts(f)
        for g in (3, 10):
            d = actors.hierarchy_statistic(r, min_actors=g).select(F.lit(n).alias("subset"), F.lit(g).alias("min_actors"), "sym", "statistic", "actors")
            out = d if out is None else out.unionByName(d)
    return rounded6(out, "statistic")
