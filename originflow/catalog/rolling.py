"""Feature-set ablations over five overlapping train/test windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originflow.catalog import solve
from originflow.catalog.registry import query
from originflow.catalog.shared import Shared, big, rounded6
from originflow.catalog.sql import MIN_ACTORS, PIECES, THR, compose, r6
from originflow.functions import features as ft
from originflow.operators import ablation, actors, graph, metrics as mx, panel as pn
from originflow.operators.windows import RollingWindow, cutoffs
from originflow.plans import pit
from originflow.plans.rolling import rolling_panel
from originflow.session import cut

Y = "log_future_reach"
WINDOWS = [RollingWindow(f"w{i + 1}", f"2024-01-{d - 6:02d}", f"2024-01-{d:02d}", f"2024-01-{d + 4:02d}", f"2024-01-{d - 2:02d}")
           for i, d in enumerate((11, 15, 19, 23, 27))]
AT = cutoffs(WINDOWS)
RELATIONAL = [*ft.OL_RELATIONAL, *ft.SHUFFLED_RELATIONAL]
SHUFFLED_GRAPH = [f"s{c}" for c in ft.GRAPH]
GRAPH_COLUMNS = [*ft.GRAPH, "g_net_rate", "log_g_total"]
REGISTRIES = {"origin": ft.ABLATION_SETS, "graph": ft.GRAPH_SETS, "rate": ft.RATE_SETS, "activity": ft.ACTIVITY_SETS,
              "relational": ft.RELATIONAL_SETS,
              "shuffled": {"A_context": ft.CONTEXT, "B_ctx+Ok": [*ft.CONTEXT, "origin_ol"],
                           "BG_ctx+Ok+graph": ft.GRAPH_SETS["BG_ctx+Ok+graph"], "BS_ctx+Ok+shufgraph": [*ft.CONTEXT, "origin_ol", *SHUFFLED_GRAPH]}}
SETS = {f"{r}:{k}": fs for r, sets in REGISTRIES.items() for k, fs in sets.items()}
METRICS = solve.METRICS


def build(s: Shared) -> DataFrame:
    """The rolling panel with graph scores at each row's cutoff, the same scores dealt to other actors, and places inside the event."""
    if "rolling" in s.__dict__:
        return s.__dict__["rolling"]
    state = pit.PitState(s.posts, s.vectors, ["vec_id"], AT, THR, MIN_ACTORS)
    # ranks and frames do not depend on cutoffs: share those of the other queries
    state.__dict__.update(ranked=s.state.ranked, frames=s.state.frames, labels=s.state.labels)
    p = rolling_panel(state, WINDOWS, s.stances)
    g = graph.LeadGraph(s.ranked.filter(F.col("day") < F.lit(AT[-1]).cast("date")), MIN_ACTORS)
    scores = cut(graph.graph_features(g, AT, influence=False))
    g.close()
    p = pn.attach_graph(p, scores, GRAPH_COLUMNS)
    other = actors.shuffle_control(scores.select("cutoff", "actor", *ft.GRAPH), "actor", ft.GRAPH, 61)
    p = pn.attach_graph(p, other.select("cutoff", "actor", *[F.col(c).alias(f"s{c}") for c in ft.GRAPH]), SHUFFLED_GRAPH)
    for src, prefix in (("origin_ol", "ol"), ("origin_ol_shuffled", "sh")):
        p = mx.relational(p, src, prefix, ["window", "event_id"])
    s.__dict__["rolling"] = cut(p)
    return s.__dict__["rolling"]


# ---- the same in SQL: pieces with the windows' cutoffs, normal equations solved by elimination -----------------

_WIN = ", ".join(f"('{w.name}', '{split}', DATE '{a}', DATE '{b}')" for w in WINDOWS
                 for split, a, b in (("train", w.train_start, w.test_start), ("test", w.test_start, w.test_end)))
_FEATURES = sorted({f for fs in SETS.values() for f in fs})
_SWAP = {
    "cutoffs": ([], "cutoffs AS (SELECT * FROM (VALUES " + ", ".join(f"(DATE '{c}')" for c in AT) + ") t(cutoff)), "
                    f"wins AS (SELECT * FROM (VALUES {_WIN}) t(win, split, cutoff, stop))"),
    "nov": (["cents", "fr", "vec", "cutoffs"], """span AS (SELECT win, min(cutoff) AS lo, max(stop) AS hi FROM wins GROUP BY win),
memo AS (SELECT win, c.*, row_number() OVER (PARTITION BY win, sym ORDER BY day, frame_j) AS q FROM cents c JOIN span ON day >= lo AND day < hi),
base AS (SELECT win, sym, day, min(q) - 1 AS b FROM memo GROUP BY win, sym, day),
nov AS (SELECT base.win, o.sym, o.day, o.rank, 1 - max(list_dot_product(v.v, m.centroid)) AS novelty_global
 FROM (SELECT * FROM fr WHERE is_new AND rank <= 10) o JOIN vec v USING (vec_id) JOIN base USING (sym, day)
 JOIN memo m ON m.win = base.win AND m.sym = o.sym AND m.q <= base.b AND m.q > base.b - 1000 GROUP BY base.win, o.sym, o.day, o.rank)"""),
}
_head, _tail = PIECES["panel"][1].split("SELECT f.sym || ':'", 1)
_tail = "SELECT f.sym || ':'" + _tail
_tail = _tail[:_tail.index("FROM (SELECT *, CASE WHEN day")] + """FROM (SELECT fr.*, wins.win, wins.split, wins.cutoff FROM fr JOIN wins ON day >= wins.cutoff AND day < wins.stop WHERE is_new AND rank <= 10) f
 JOIN lab l USING (sym, day, frame_j) JOIN trait t USING (cutoff, actor) LEFT JOIN meta m USING (cutoff, actor)
 LEFT JOIN hist h USING (cutoff, actor) LEFT JOIN shuf z USING (cutoff, actor) LEFT JOIN nov n USING (win, sym, day, rank) LEFT JOIN stance s USING (doc_id)))"""
_SWAP["panel"] = (PIECES["panel"][0], _head + _tail.replace("f.split, f.cutoff,", "f.win, f.split, f.cutoff,", 1))


def _relational(src: str, prefix: str) -> str:
    w = "PARTITION BY win, event_id"
    return (f"CASE WHEN count(*) OVER ({w}) > 1 THEN (row_number() OVER ({w} ORDER BY {src}, frame_j) - 1) / (count(*) OVER ({w}) - 1) ELSE 0.5 END AS {prefix}_rank, "
            f"{src} - max({src}) OVER ({w}) AS {prefix}_gapmax, {src} - avg({src}) OVER ({w}) AS {prefix}_minusmean, "
            f"CASE WHEN {src} >= max({src}) OVER ({w}) THEN 1.0 ELSE 0.0 END AS {prefix}_istop")


PIECES["rolling"] = (["panel", "deg", "pr", "hub"], f"""gs AS (SELECT cutoff, actor, g_out, g_in, g_net, g_pr, g_hub, g_net_rate, log_g_total FROM deg JOIN pr USING (cutoff, actor) JOIN hub USING (cutoff, actor)),
sgs AS (SELECT a.cutoff, a.actor, {', '.join(f'b.{c} AS s{c}' for c in ft.GRAPH)} FROM
 (SELECT cutoff, actor, row_number() OVER (PARTITION BY cutoff ORDER BY md5('key:' || CAST(actor AS VARCHAR)), actor) AS p FROM gs) a JOIN
 (SELECT *, row_number() OVER (PARTITION BY cutoff ORDER BY md5('61:' || CAST(actor AS VARCHAR)), actor) AS p FROM gs) b USING (cutoff, p)),
rolling AS MATERIALIZED (SELECT p.*, {', '.join(f'coalesce(g.{c}, 0) AS {c}' for c in GRAPH_COLUMNS)}, {', '.join(f'coalesce(s{c}, 0) AS s{c}' for c in ft.GRAPH)},
 {_relational('origin_ol', 'ol')}, {_relational('origin_ol_shuffled', 'sh')}
 FROM panel p LEFT JOIN gs g USING (cutoff, actor) LEFT JOIN sgs USING (cutoff, actor))""")
PIECES["rem"] = (["rolling"], ",\n".join([
    solve.moments("ro", f"SELECT win, split = 'train' AS fit, event_id, sym, frame_j, {Y} AS y, {solve.features(_FEATURES)} AS xs FROM rolling", "add"),
    solve.solved("rs", "ro", solve.sets_values(SETS, _FEATURES)), solve.scores("rs", "ro", "NOT fit"), solve.metric_table("rs", pooled=True)]))


@query("rolling_panel", compose(f"SELECT win AS window, split, event_id, CAST(frame_j AS BIGINT) AS frame_j, {', '.join(r6(c, c) for c in [*_FEATURES, Y])} FROM rolling",
                                "rolling", swap=_SWAP))
def rolling_panel_query(spark, sf) -> DataFrame:
    """All features of the panel for every window a frame belongs to."""
    p = build(Shared.of(spark, sf)).select("window", "split", "event_id", "frame_j", *_FEATURES, Y)
    return big(rounded6(p, *_FEATURES, Y), "frame_j")


def events(s: Shared) -> DataFrame:
    """Metrics of all test events under all registered sets, fitted once per session."""
    if "rolling_events" not in s.__dict__:
        s.__dict__["rolling_events"] = cut(ablation.ablation_events(build(s), SETS, Y)[0])
    return s.__dict__["rolling_events"]


def _table(name: str, registry: str | None):
    where = f"WHERE starts_with(method, '{registry}:')" if registry else ""

    @query(name, compose(f"SELECT win AS window, {solve.TABLE} FROM rst {where}", "rem", swap=_SWAP))
    def table(spark, sf) -> DataFrame:
        e = events(Shared.of(spark, sf))
        if registry:
            e = e.filter(F.col("method").startswith(f"{registry}:"))
        return rounded6(ablation.ablation_table(e, METRICS), *METRICS)


for _name, _registry in (("ablation_matrix", None), ("graph_ablation", "graph"), ("activity_control", "activity"),
                         ("relational_ablation", "relational"), ("shuffled_graph", "shuffled")):
    _table(_name, _registry)
