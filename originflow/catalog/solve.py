"""Ridge models and event metrics in SQL for the check queries: normal equations are solved by elimination over lists."""

from __future__ import annotations

from originflow.catalog.sql import r6

METRICS = ["ndcg3", "hit1", "mass3", "js"]
RULES = {"add": "sd + 1e-12", "strict": "CASE WHEN sd > 1e-8 THEN sd ELSE 1 END", "loose": "CASE WHEN sd > 1e-6 THEN sd ELSE 1 END"}


def features(names: list[str]) -> str:
    return "[" + ", ".join(f"CAST({f} AS DOUBLE)" for f in names) + "]"


def sets_values(sets: dict[str, list[str]], names: list[str], alpha: float = 3.0) -> str:
    """A relation (method, ix, alpha) of named feature sets over the positions of ``names``."""
    return "(SELECT * FROM (VALUES " + ", ".join(
        f"('{k}', [{', '.join(str(names.index(f)) for f in fs)}], {float(alpha)!r})" for k, fs in sets.items()) + ") t(method, ix, alpha))"


def moments(t: str, rows: str, rule: str, impute: bool = True) -> str:
    """Standardised features and products of ``rows(win, fit, event_id, sym, frame_j, y, xs)``; statistics come from fit rows.

    Leaves ``{t}z`` (one row per feature and row), ``{t}y`` (mean and centred square of y), ``{t}s`` (med, mu, sd), ``{t}g`` and ``{t}r``.
    """
    fill = f"(SELECT win, i, median(v) AS med FROM {t}l WHERE fit GROUP BY win, i)" if impute else f"(SELECT DISTINCT win, i, CAST(0 AS DOUBLE) AS med FROM {t}l)"
    return f"""{t}l AS MATERIALIZED (SELECT win, fit, event_id, sym, frame_j, y, unnest(xs) AS v, unnest(range(len(xs))) AS i FROM ({rows})),
{t}f AS MATERIALIZED (SELECT l.* EXCLUDE v, coalesce(med, 0) AS med, coalesce(v, med, 0) AS v FROM {t}l l LEFT JOIN {fill} USING (win, i)),
{t}s AS MATERIALIZED (SELECT win, i, med, mu, {RULES[rule]} AS sd FROM (SELECT win, i, max(med) AS med, avg(v) AS mu, stddev_pop(v) AS sd FROM {t}f WHERE fit GROUP BY win, i)),
{t}z AS MATERIALIZED (SELECT f.* EXCLUDE (v, med), (v - mu) / sd AS z FROM {t}f f JOIN {t}s USING (win, i)),
{t}y AS MATERIALIZED (SELECT win, avg(y) AS ym, var_pop(y) * count(*) AS yy, count(*) AS n FROM {t}l WHERE fit AND i = 0 GROUP BY win),
{t}g AS MATERIALIZED (SELECT a.win, a.i, b.i AS j, sum(a.z * b.z) AS g FROM {t}z a JOIN {t}z b USING (win, event_id, frame_j) WHERE a.fit AND b.fit GROUP BY a.win, a.i, b.i),
{t}r AS MATERIALIZED (SELECT win, i, sum(z * (y - ym)) AS r FROM {t}z JOIN {t}y USING (win) WHERE fit GROUP BY win, i)"""


def solved(t: str, m: str, sets: str, inverse: bool = False, spare: int | None = 30) -> str:
    """``{t}b(win, method, i, b)`` from the moments ``m`` and a relation ``sets(method, ix, alpha)``, which may have a column win.

    Rows of the system are lists; a recursion clears one column a step. With ``inverse`` the unit matrix rides along and
    ``{t}b`` also has the diagonal ``a`` of the inverse. Sets with fewer than ``spare`` fit rows beyond their size have no model.
    """
    unit = f", [CASE WHEN q = a THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR q IN range(1, len(max(ix)) + 1)]" if inverse else ""
    line = f"list_append(list(g + CASE WHEN a = b THEN alpha ELSE 0 END ORDER BY b), max(r))"
    line = f"list_concat({line}{unit})" if inverse else line
    return f"""{t}n AS MATERIALIZED (SELECT y.win, s.method, s.ix, s.alpha FROM {m}y y, {sets} s{f" WHERE y.n >= len(s.ix) + {spare}" if spare is not None else ""}),
{t}c AS (SELECT win, method, alpha, ix, a, ia, unnest(ix) AS ib, generate_subscripts(ix, 1) AS b FROM (
 SELECT win, method, alpha, ix, unnest(ix) AS ia, generate_subscripts(ix, 1) AS a FROM {t}n)),
{t}i AS (SELECT c.win, method, a, {line} AS line FROM {t}c c JOIN {m}g g ON g.win = c.win AND g.i = ia AND g.j = ib JOIN {m}r r ON r.win = c.win AND r.i = ia
 GROUP BY c.win, method, a),
{t}e AS (SELECT win, method, 1 AS k, list(line ORDER BY a) AS m FROM {t}i GROUP BY win, method
 UNION ALL SELECT win, method, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(m[k], lambda x: x / m[k][k])
  ELSE list_transform(list_zip(r, m[k]), lambda q: q[1] - r[k] / m[k][k] * q[2]) END) FROM {t}e WHERE k <= len(m)),
{t}b AS MATERIALIZED (SELECT win, method, alpha, unnest(list_transform(m, lambda r: r[len(m) + 1])) AS b{', unnest(list_transform(m, lambda r, i: r[len(m) + 1 + i])) AS a' if inverse else ''}, unnest(ix) AS i
 FROM {t}e JOIN {t}n USING (win, method) WHERE k = len(m) + 1)"""


def scores(t: str, m: str, where: str) -> str:
    """``{t}p(win, method, event_id, sym, frame_j, y, s)`` of the rows of the moments ``m`` under the models ``{t}b``."""
    return f"""{t}p AS MATERIALIZED (SELECT win, method, event_id, sym, frame_j, max(y) AS y, max(ym) + sum(b * z) AS s
 FROM {m}z JOIN {t}b USING (win, i) JOIN {m}y USING (win) WHERE {where} GROUP BY win, method, event_id, sym, frame_j)"""


def metric_table(t: str, pooled: bool = False) -> str:
    """``{t}m`` (per event) and ``{t}t`` (symbol-balanced) from ``{t}p``; ``pooled`` adds a window of all windows."""
    half = lambda a, b: f"CASE WHEN {a} > 0 THEN 0.5 * {a} * ln({a} / greatest(({a} + {b}) * 0.5, 1e-12)) ELSE 0 END"
    part = "PARTITION BY win, method, event_id"
    source = f"(SELECT * FROM {t}m UNION ALL SELECT * REPLACE ('pooled' AS win) FROM {t}m)" if pooled else f"{t}m"
    return f"""{t}0 AS (SELECT *, count(*) OVER w AS n, max(y) OVER w AS ymax, sum(y) OVER w AS ysum, max(s) OVER w AS smax,
 row_number() OVER ({part} ORDER BY s DESC, frame_j) AS rs, row_number() OVER ({part} ORDER BY y DESC, frame_j) AS ry FROM {t}p WINDOW w AS ({part})),
{t}1 AS (SELECT *, y / greatest(ysum, 1e-12) AS p, e / greatest(sum(e) OVER ({part}), 1e-12) AS q FROM (
 SELECT *, exp(greatest(s - smax, -50)) AS e FROM {t}0 WHERE n >= 2 AND ymax > 0)),
{t}m AS MATERIALIZED (SELECT win, method, event_id, sym,
 sum(CASE WHEN rs <= 3 THEN y / log2(rs + 1) ELSE 0 END) / greatest(sum(CASE WHEN ry <= 3 THEN y / log2(ry + 1) ELSE 0 END), 1e-12) AS ndcg3,
 max(CASE WHEN rs <= 1 AND y = ymax THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit1, sum(CASE WHEN rs <= 3 THEN y ELSE 0 END) / greatest(max(ysum), 1e-12) AS mass3,
 sum({half('p', 'q')} + {half('q', 'p')}) AS js FROM {t}1 GROUP BY win, method, event_id, sym),
{t}t AS MATERIALIZED (SELECT win, method, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_symbols, {', '.join(f'avg({c}) AS {c}' for c in METRICS)} FROM (
 SELECT win, method, sym, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in METRICS)} FROM {source} GROUP BY win, method, sym) GROUP BY win, method)"""


TABLE = "method, n_events, n_symbols, " + ", ".join(r6(m, m) for m in METRICS)
