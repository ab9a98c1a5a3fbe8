"""Shared pieces of the check queries: named CTEs for DuckDB with their dependencies."""

from __future__ import annotations

THR = 0.2
MIN_ACTORS = 5
CUTOFFS = ["2024-01-11", "2024-01-21"]
INNER = "2024-01-17"
END = "2024-01-31"

SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
NOT_SPACE = r"[^\s\x0B\x1C-\x1F\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r6(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {alias}"


def walk(name: str, items: str, thr: float) -> dict[str, tuple[list[str], str]]:
    """Order-dependent frames as a recursive query: state is the list of centroids and their sizes."""
    step = f"""{name}(sym, day, rank, cents, ns, frame_j, is_new, best) AS (
 SELECT sym, day, rank, [v], [1], 0, true, CAST(NULL AS DOUBLE) FROM {items} WHERE rank = 1
 UNION ALL
 SELECT sym, day, rank,
  CASE WHEN b >= {thr} THEN list_concat(list_concat(cents[1:j-1], [list_transform(c, lambda x: x / (sqrt(list_dot_product(c,c)) + 1e-12))]), cents[j+1:]) ELSE list_append(cents, v) END,
  CASE WHEN b >= {thr} THEN list_concat(list_concat(ns[1:j-1], [ns[j]+1]), ns[j+1:]) ELSE list_append(ns, 1) END,
  CASE WHEN b >= {thr} THEN j-1 ELSE len(cents) END, b < {thr}, b
 FROM (SELECT *, list_transform(list_zip(cents[j], v), lambda z: z[1]*ns[j] + z[2]) AS c FROM (
  SELECT sym, day, rank, v, cents, ns, list_max(s) AS b, list_position(s, list_max(s)) AS j FROM (
   SELECT i.sym, i.day, i.rank, i.v, w.cents, w.ns, list_transform(w.cents, lambda q: list_dot_product(q, i.v)) AS s
   FROM {name} w JOIN {items} i ON i.sym = w.sym AND i.day = w.day AND i.rank = w.rank + 1))))"""
    return {name: ([items], step)}


_CUT_VALUES = ", ".join(f"(DATE '{c}')" for c in CUTOFFS)

PIECES: dict[str, tuple[list[str], str]] = {
    "posts": ([], """posts AS (SELECT event_type AS sym, user_id AS actor, epoch_us(ts) AS us, CAST(ts AS DATE) AS day,
 CAST(hour(ts) AS INTEGER) AS hour, event_id AS post_id, value AS followers,
 CASE WHEN user_id % 5 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS verified,
 event_id % (SELECT count(*) FROM documents) AS doc_id, event_id % (SELECT count(*) FROM embeddings) AS vec_id
 FROM events)"""),
    "fp": (["posts"], """fp AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY sym, day, actor ORDER BY us, post_id) AS rn,
 min(post_id) OVER (PARTITION BY sym, day, actor) AS first_seen FROM posts) WHERE rn = 1)"""),
    "rk": (["fp"], f"""rk AS (SELECT *, k + 1 - 2 * rank AS net_lead FROM (SELECT *, row_number() OVER (PARTITION BY sym, day ORDER BY us, first_seen, post_id) AS rank,
 count(*) OVER (PARTITION BY sym, day) AS k, (us - min(us) OVER (PARTITION BY sym, day)) / 3600000000.0 AS elapsed_hours FROM fp) WHERE k >= {MIN_ACTORS})"""),
    "cutoffs": ([], f"cutoffs AS (SELECT * FROM (VALUES {_CUT_VALUES}) t(cutoff))"),
    "meta": (["posts", "cutoffs"], """meta AS (SELECT cutoff, actor, median(hour) AS medhour, coalesce(median(followers) FILTER (followers > 0), 0) AS med_followers,
 ln(1 + coalesce(median(followers) FILTER (followers > 0), 0)) AS log_followers, max(verified) AS verified, count(*) AS n_posts
 FROM posts JOIN cutoffs ON day < cutoff GROUP BY cutoff, actor)"""),
    "rawl": (["rk", "cutoffs"], """rawl AS (SELECT cutoff, actor, avg(net_lead) AS raw_lead, count(*) AS n_events FROM rk JOIN cutoffs ON day < cutoff
 GROUP BY cutoff, actor HAVING count(*) >= 4)"""),
    "trait": (["rawl", "meta"], """tj AS (SELECT r.*, m.medhour, m.medhour - 12.0 AS x FROM rawl r JOIN meta m USING (cutoff, actor)),
tsum AS (SELECT cutoff, CAST(count(*) AS DOUBLE) AS s0, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4,
 sum(raw_lead) AS t0, sum(x*raw_lead) AS t1, sum(x*x*raw_lead) AS t2, count(DISTINCT medhour) AS hours FROM tj GROUP BY cutoff),
tcoef AS (SELECT cutoff,
 (t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / d AS c0,
 (s0*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2)) / d AS c1,
 (s0*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2)) / d AS c2
 FROM (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS d FROM tsum)),
trait AS (SELECT j.*, j.raw_lead - (c0 + c1*x + c2*x*x) AS oltrait FROM tj j JOIN tcoef USING (cutoff))"""),
    "deg": (["rk", "cutoffs"], """deg AS (SELECT *, ln(1+o) AS g_out, ln(1+i) AS g_in, o-i AS g_net, o+i AS g_total, ln(1+o+i) AS log_g_total,
 CASE WHEN o+i > 0 THEN (o-i)/(o+i) ELSE 0 END AS g_net_rate FROM (
 SELECT cutoff, actor, CAST(sum(k-rank) AS DOUBLE) AS o, CAST(sum(rank-1) AS DOUBLE) AS i, CAST(count(*) AS DOUBLE) AS part_count
 FROM rk JOIN cutoffs ON day < cutoff GROUP BY cutoff, actor))"""),
    "vec": ([], """vec AS (SELECT vec_id, list_transform(e, lambda x: x / (sqrt(list_dot_product(e,e)) + 1e-12)) AS v
 FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""),
    "items": (["rk", "vec"], "items AS (SELECT r.*, v.v FROM rk r JOIN vec v USING (vec_id))"),
    **walk("steps", "items", THR),
    "fr": (["steps"], """fr AS (SELECT i.* EXCLUDE v, s.frame_j, s.is_new, s.best AS best_sim FROM items i JOIN steps s USING (sym, day, rank))"""),
    "cents": (["steps"], """cents AS (SELECT sym, day, unnest(range(len(cents))) AS frame_j, unnest(cents) AS centroid, unnest(ns) AS n FROM (
 SELECT sym, day, cents, ns, row_number() OVER (PARTITION BY sym, day ORDER BY rank DESC) AS z FROM steps) WHERE z = 1)"""),
    "lab": (["fr"], """lab AS (SELECT sym, day, frame_j, CAST(count(*) FILTER (us > u0) AS DOUBLE) AS future_adopt,
 coalesce(sum(greatest(0.0, followers)) FILTER (us > u0), 0.0) AS future_reach, CAST(count(*) - 1 AS DOUBLE) AS hist_adopt,
 coalesce(sum(greatest(0.0, followers)) FILTER (NOT is_new), 0.0) AS hist_reach
 FROM (SELECT *, min(us) OVER (PARTITION BY sym, day, frame_j) AS u0 FROM fr) GROUP BY sym, day, frame_j)"""),
    "hist": (["fr", "lab", "cutoffs"], """hist AS (SELECT cutoff, actor, ln(1 + count(*)) AS hist_log_origin_count, avg(ln(1 + hist_adopt)) AS hist_mean_log_adopt,
 avg(ln(1 + hist_reach)) AS hist_mean_log_reach, avg(CASE WHEN hist_adopt >= 1 THEN 1.0 ELSE 0.0 END) AS hist_success_rate
 FROM fr JOIN lab USING (sym, day, frame_j) JOIN cutoffs ON day < cutoff WHERE is_new GROUP BY cutoff, actor)"""),
    "shuf": (["trait"], """shuf AS (SELECT a.cutoff, a.actor, b.oltrait AS shuffled FROM
 (SELECT cutoff, actor, row_number() OVER (PARTITION BY cutoff ORDER BY md5('key:' || CAST(actor AS VARCHAR)), actor) AS p FROM trait) a JOIN
 (SELECT cutoff, oltrait, row_number() OVER (PARTITION BY cutoff ORDER BY md5('61:' || CAST(actor AS VARCHAR)), actor) AS p FROM trait) b USING (cutoff, p))"""),
    "nov": (["cents", "fr", "vec"], f"""memo AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY day, frame_j) AS q FROM cents WHERE day >= DATE '{CUTOFFS[0]}'),
base AS (SELECT sym, day, min(q) - 1 AS b FROM memo GROUP BY sym, day),
nov AS (SELECT o.sym, o.day, o.rank, 1 - max(list_dot_product(v.v, m.centroid)) AS novelty_global
 FROM (SELECT * FROM fr WHERE is_new AND rank <= 10) o JOIN vec v USING (vec_id) JOIN base USING (sym, day)
 JOIN memo m ON m.sym = o.sym AND m.q <= base.b AND m.q > base.b - 1000 GROUP BY o.sym, o.day, o.rank)"""),
    "stance": ([], ""),  # filled below
    "panel": (["fr", "lab", "trait", "meta", "hist", "shuf", "nov", "stance"], f"""panel AS (SELECT *,
 origin_ol * origin_logfoll AS ol_x_visibility, origin_ol * coalesce(novelty_global, 0) AS ol_x_novelty,
 origin_ol_raw * origin_logfoll AS raw_ol_x_visibility, origin_ol_raw * coalesce(novelty_global, 0) AS raw_ol_x_novelty,
 origin_ol_shuffled * origin_logfoll AS shuffled_ol_x_visibility, origin_ol_shuffled * coalesce(novelty_global, 0) AS shuffled_ol_x_novelty,
 origin_logfoll * origin_logfoll AS logfoll_x_visibility, origin_logfoll * coalesce(novelty_global, 0) AS logfoll_x_novelty,
 ln(1 + future_adopt) AS log_future_adopt, ln(1 + future_reach) AS log_future_reach FROM (
 SELECT f.sym || ':' || CAST(f.day AS VARCHAR) AS event_id, f.sym, f.day, f.split, f.cutoff, f.frame_j, f.rank, f.k, f.actor, f.post_id, f.doc_id, f.vec_id,
 t.oltrait AS origin_ol, coalesce(m.log_followers, ln(1 + greatest(0.0, f.followers))) AS origin_logfoll, coalesce(m.verified, f.verified) AS origin_verified,
 ln(f.rank) AS log_origin_rank, f.elapsed_hours, CAST(f.frame_j AS DOUBLE) AS prior_frame_count,
 CAST(coalesce(s.stance, 0) AS DOUBLE) AS origin_stance, CAST(abs(coalesce(s.stance, 0)) AS DOUBLE) AS origin_stance_abs, n.novelty_global, 1 - f.best_sim AS novelty_event,
 coalesce(h.hist_log_origin_count, 0) AS hist_log_origin_count, coalesce(h.hist_mean_log_adopt, 0) AS hist_mean_log_adopt, coalesce(h.hist_success_rate, 0) AS hist_success_rate,
 t.raw_lead AS origin_ol_raw, coalesce(z.shuffled, 0) AS origin_ol_shuffled, l.future_adopt, l.future_reach
 FROM (SELECT *, CASE WHEN day < DATE '{CUTOFFS[1]}' THEN 'train' ELSE 'test' END AS split,
  CASE WHEN day < DATE '{CUTOFFS[1]}' THEN DATE '{CUTOFFS[0]}' ELSE DATE '{CUTOFFS[1]}' END AS cutoff
  FROM fr WHERE is_new AND rank <= 10 AND day >= DATE '{CUTOFFS[0]}' AND day < DATE '{END}') f
 JOIN lab l USING (sym, day, frame_j) JOIN trait t USING (cutoff, actor) LEFT JOIN meta m USING (cutoff, actor)
 LEFT JOIN hist h USING (cutoff, actor) LEFT JOIN shuf z USING (cutoff, actor) LEFT JOIN nov n USING (sym, day, rank) LEFT JOIN stance s USING (doc_id)))"""),
}

from originflow.functions.text import BEAR_WORDS, BULL_WORDS  # noqa: E402


def _hits(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(t, {q(w)}) AS INTEGER)" for w in words)


PIECES["stance"] = ([], f"""stance AS (SELECT doc_id, CAST(CASE WHEN b > a THEN 1 WHEN a > b THEN -1 ELSE 0 END AS BIGINT) AS stance FROM (
 SELECT doc_id, {_hits(BULL_WORDS)} AS b, {_hits(BEAR_WORDS)} AS a FROM (
 SELECT doc_id, regexp_replace(lower(text), {q(f'https?://{NOT_SPACE}+|@{WORD}+')}, ' ', 'g') AS t FROM documents)))""")


def compose(final: str, *needs: str, extra: str = "", swap: dict[str, tuple[list[str], str]] | None = None) -> str:
    """``WITH RECURSIVE`` over the needed pieces and their dependencies, then ``final``. ``swap`` replaces pieces by name."""
    order: list[str] = []
    pieces = PIECES | (swap or {})

    def add(name: str) -> None:
        if name in order:
            return
        for d in pieces[name][0]:
            add(d)
        order.append(name)

    for n in needs:
        add(n)
    parts = [pieces[n][1] for n in order] + ([extra] if extra else [])
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + final
