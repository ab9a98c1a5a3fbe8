"""Sources, text, events, actor state and frames over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from originflow.catalog.registry import query
from originflow.catalog.shared import BLOCKS, Shared, big, rounded6
from originflow.catalog.sql import CUTOFFS, END, MIN_ACTORS, NOT_SPACE, SPACE, THR, compose, q, r6
from originflow.functions import text as tx
from originflow.operators import actors, events, frames as fr, metrics as mx
from originflow.sources import stores
from originflow.sources.posts import bind_posts, spread, table

EVENT_COLS = ["sym", "day"]

# ---- sources ---------------------------------------------------------------------------------


@query("posts_binding", compose(
    f"SELECT sym, day, CAST(hour AS BIGINT) AS hour, actor, us, post_id, {r6('followers', 'followers')}, verified, stance FROM posts JOIN stance USING (doc_id)",
    "posts", "stance"))
def posts_binding(spark, sf) -> DataFrame:
    s = Shared.of(spark, sf)
    d = s.posts.join(s.stances, "doc_id").select("sym", "day", "hour", "actor", "us", "post_id", "followers", "verified", "stance")
    return big(rounded6(d, "followers"), "hour", "stance")


@query("posts_in_range", compose(
    "SELECT sym, day, count(*) AS n, count(DISTINCT actor) AS actors FROM posts WHERE day >= DATE '2024-01-11' AND day < DATE '2024-01-21' GROUP BY sym, day", "posts"))
def posts_in_range(spark, sf) -> DataFrame:
    return bind_posts(spark, sf, CUTOFFS[0], CUTOFFS[1]).groupBy("sym", "day").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("actor").alias("actors"))


_CLEAN = f"trim(regexp_replace(regexp_replace(text, {q(f'https?://{NOT_SPACE}+')}, '', 'g'), {q(SPACE + '+')}, ' ', 'g'))"


@query("vector_lookup", f"""WITH d AS (SELECT doc_id, {_CLEAN} AS key FROM documents),
v AS (SELECT key, min(doc_id) AS pick FROM d JOIN labels USING (doc_id) GROUP BY key),
e AS (SELECT v.key, CAST(embedding AS DOUBLE[]) AS emb FROM v JOIN embeddings ON vec_id = pick % (SELECT count(*) FROM embeddings))
SELECT doc_id, md5(d.key) AS key_md5, round(coalesce(list_dot_product(emb, emb), 0.0), 6) + 0.0 AS norm2, round(coalesce(emb[1], 0.0), 6) + 0.0 AS first
FROM d LEFT JOIN e USING (key)""")
def vector_lookup(spark, sf) -> DataFrame:
    """Vectors keyed by cleaned text; only labelled documents have one, the rest get zeros."""
    s = Shared.of(spark, sf)
    docs = s.table("documents").select("doc_id", tx.clean_text("text").alias("key"))
    n_vec = s.vectors.agg(F.count(F.lit(1))).scalar()
    keyed = docs.join(s.table("labels").select("doc_id"), "doc_id", "left_semi").groupBy("key").agg(F.min("doc_id").alias("pick"))
    vecs = keyed.withColumn("vec_id", F.col("pick") % n_vec).join(s.vectors, "vec_id")
    out = stores.lookup_vectors(docs, vecs, "key", 64)
    e = F.transform("emb", lambda x: x.cast("double"))
    return rounded6(out.select("doc_id", F.md5("key").alias("key_md5"), fr.dot(e, e).alias("norm2"), e[0].alias("first")), "norm2", "first")


@query("response_store_latest", """SELECT key, seq, round(score, 6) + 0.0 AS score FROM (SELECT props AS key, event_id AS seq, value AS score,
 row_number() OVER (PARTITION BY props ORDER BY event_id DESC) AS z FROM events WHERE value IS NOT NULL AND isfinite(value)) WHERE z = 1""")
def response_store_latest(spark, sf) -> DataFrame:
    log = table(spark, sf, "events").select(F.col("props").alias("key"), F.col("event_id").alias("seq"), F.col("value").alias("score"))
    return rounded6(stores.latest_by_key(log, "key", "seq", ["score"]), "score")


@query("missing_keys", f"""WITH d AS (SELECT doc_id, md5({_CLEAN}) AS key FROM documents)
SELECT DISTINCT key FROM d WHERE key NOT IN (SELECT key FROM d JOIN labels USING (doc_id))""")
def missing_keys(spark, sf) -> DataFrame:
    s = Shared.of(spark, sf)
    docs = s.table("documents").select("doc_id", F.md5(tx.clean_text("text")).alias("key"))
    have = docs.join(s.table("labels").select("doc_id"), "doc_id", "left_semi")
    return stores.missing_keys(docs, have, "key").select("key")


# ---- text ------------------------------------------------------------------------------------


@query("stance", compose("SELECT doc_id, stance FROM stance", "stance"))
def stance(spark, sf) -> DataFrame:
    return big(Shared.of(spark, sf).stances, "stance")


@query("clean_text", f"SELECT doc_id, md5({_CLEAN}) AS cleaned, CAST(length({_CLEAN}) AS BIGINT) AS n FROM documents")
def clean_text(spark, sf) -> DataFrame:
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", tx.clean_text("text").alias("c"))
    return d.select("doc_id", F.md5("c").alias("cleaned"), F.length("c").cast("bigint").alias("n"))


def _anonymize_sql(col: str) -> str:
    e = f"regexp_replace(coalesce({col}, ''), {q(f'https?://{NOT_SPACE}+')}, ' <URL> ', 'g')"
    e = f"regexp_replace({e}, '@[A-Za-z0-9_]+', '<USER>', 'g')"
    e = rf"regexp_replace({e}, '\$[A-Za-z][A-Za-z0-9._-]*', '<ASSET>', 'g')"
    for words in (tx.TICKERS, tx.COMPANY_NAMES):
        pattern = r"\b(?:" + "|".join(words) + r")\b"
        e = f"regexp_replace({e}, {q(pattern)}, '<ASSET>', 'gi')"
    return f"trim(regexp_replace({e}, {q(SPACE + '+')}, ' ', 'g'))"


@query("anonymize", f"SELECT doc_id, md5({_anonymize_sql('text')}) AS anonymous FROM documents")
def anonymize(spark, sf) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.md5(tx.anonymize("text")).alias("anonymous"))


def _n(pattern: str, col: str = "text") -> str:
    return f"CAST(len(regexp_extract_all({col}, {q(pattern)})) AS DOUBLE)"


_KW = ", ".join(
    f"CASE WHEN {' OR '.join(f'contains(p, {q(w)})' for w in words)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS kw_{g}"
    for g, words in tx.KEYWORD_GROUPS.items())


@query("surface_features", rf"""SELECT doc_id, {r6('ln(1 + length(text))', 'log_chars')}, {r6('ln(1 + ' + _n('[A-Za-z0-9_$#%]+') + ')', 'log_tokens')},
 {r6(_n(chr(92) + 'p{Lu}') + ' / greatest(1.0, ' + _n(chr(92) + 'p{L}') + ')', 'upper_ratio')},
 {_n(chr(92) + '$[A-Za-z][A-Za-z0-9_]*')} AS n_cashtags, {_n('#[A-Za-z][A-Za-z0-9_]*')} AS n_hashtags, {_n('@[A-Za-z][A-Za-z0-9_]*')} AS n_mentions,
 {_n('https?://' + NOT_SPACE + '+|www' + chr(92) + '.' + NOT_SPACE + '+')} AS n_urls,
 CAST(len(regexp_extract_all(regexp_replace(text, '[A-Za-z]+[0-9]+(?:\.[0-9]+)?', ' ', 'g'), '[-+]?[0-9]+(?:\.[0-9]+)?%?')) AS DOUBLE) AS n_numbers,
 CASE WHEN contains(text, '?') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_question, CASE WHEN contains(text, '!') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_exclaim,
 CASE WHEN contains(text, '%') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_percent,
 CASE WHEN regexp_matches(lower(text), '(^|[^a-z])\$?' || lower(source) || '([^a-z]|$)') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS contains_sym, {_KW}
FROM (SELECT *, ' ' || lower(text) || ' ' AS p FROM documents)""")
def surface_features(spark, sf) -> DataFrame:
    f = tx.surface_features("text", "source")
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "source"))
    d = docs.select("doc_id", *[c.alias(n) for n, c in f.items()])
    return rounded6(d, "log_chars", "log_tokens", "upper_ratio")


@query("symbol_onehot", "SELECT post_id, " + ", ".join(
    f"CASE WHEN sym = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_{s}" for s in ("click", "error", "purchase", "signup", "view"))
    + " FROM (SELECT event_id AS post_id, event_type AS sym FROM events)")
def symbol_onehot(spark, sf) -> DataFrame:
    names = ["click", "error", "purchase", "signup", "view"]
    d = bind_posts(spark, sf).select("post_id", tx.symbol_onehot("sym", names).alias("v"))
    return d.select("post_id", *[F.col("v")[i].alias(f"is_{n}") for i, n in enumerate(names)])


@query("model_slug", r"""SELECT DISTINCT source, lang, lower(regexp_replace(regexp_replace(trim(source || ' / ' || lang || '!'), '[^A-Za-z0-9._-]+', '__', 'g'), '^_+|_+$', '', 'g')) AS slug FROM documents""")
def model_slug(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("source", "lang").distinct()
    return d.withColumn("slug", tx.model_slug(F.concat("source", F.lit(" / "), "lang", F.lit("!"))))


# ---- events ----------------------------------------------------------------------------------


@query("first_posts", compose("SELECT sym, day, actor, us, post_id, first_seen, round(followers, 6) + 0.0 AS followers FROM fp", "fp"))
def first_posts(spark, sf) -> DataFrame:
    d = events.first_posts(bind_posts(spark, sf))
    return rounded6(d.select("sym", "day", "actor", "us", "post_id", "first_seen", "followers"), "followers")


@query("event_rank", compose(f"SELECT sym, day, actor, k, rank, net_lead, {r6('elapsed_hours', 'elapsed_hours')} FROM rk", "rk"))
def event_rank(spark, sf) -> DataFrame:
    return rounded6(Shared.of(spark, sf).ranked.select("sym", "day", "actor", "k", "rank", "net_lead", "elapsed_hours"), "elapsed_hours")


@query("event_rank_ties", """WITH fp AS (SELECT o_orderpriority AS sym, CAST(o_orderdate AS DATE) AS day, o_custkey AS actor, min(o_orderkey) AS post_id FROM orders GROUP BY 1, 2, 3)
SELECT sym, day, actor, row_number() OVER (PARTITION BY sym, day ORDER BY post_id) AS rank, count(*) OVER (PARTITION BY sym, day) AS k FROM fp""")
def event_rank_ties(spark, sf) -> DataFrame:
    """Day-resolution times: every rank is decided by the first-seen id."""
    o = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    posts = o.select(F.col("o_orderpriority").alias("sym"), day.alias("day"), F.col("o_custkey").alias("actor"),
                     (F.datediff(day, F.lit("1970-01-01")).cast("bigint") * 86_400_000_000).alias("us"), F.col("o_orderkey").alias("post_id"))
    return events.rank_posts(events.first_posts(posts, carry=())).select("sym", "day", "actor", "rank", "k")


@query("early_split", compose("""SELECT sym, day, actor, rank, 'first10' AS mode, rank <= 10 AS early FROM rk WHERE k > 10
UNION ALL SELECT sym, day, actor, rank, 'first6h', elapsed_hours <= 6.0 FROM rk""", "rk"))
def early_split(spark, sf) -> DataFrame:
    r = Shared.of(spark, sf).ranked
    pick = lambda kind, v, name: events.early_split(r, kind, v).select("sym", "day", "actor", "rank", F.lit(name).alias("mode"), "early")
    return pick("count", 10, "first10").unionByName(pick("hours", 6.0, "first6h"))


@query("pair_weights", compose("""SELECT a.actor AS src, b.actor AS dst, sum(CASE WHEN a.rank < b.rank THEN 1 ELSE 0 END)::BIGINT AS lead_weight, count(*) AS together
FROM rk a JOIN rk b ON a.sym = b.sym AND a.day = b.day AND a.actor <> b.actor
WHERE (a.actor, b.actor) IN (SELECT x.actor, y.actor FROM rk x JOIN rk y ON x.sym = y.sym AND x.day = y.day AND y.rank = x.rank + 1) GROUP BY 1, 2""", "rk"))
def pair_weights(spark, sf) -> DataFrame:
    """Lead weights of all pairs that ever post one after the other."""
    r = Shared.of(spark, sf).ranked
    return events.pair_weights(r, events.adjacent_pairs(r))


@query("cooccur_weights", compose("""SELECT least(a.actor, b.actor) AS a, greatest(a.actor, b.actor) AS b, count(*) AS weight
FROM rk a JOIN rk b ON a.sym = b.sym AND a.day = b.day AND a.actor < b.actor
WHERE (least(a.actor, b.actor), greatest(a.actor, b.actor)) IN (SELECT least(x.actor, y.actor), greatest(x.actor, y.actor) FROM rk x JOIN rk y ON x.sym = y.sym AND x.day = y.day AND y.rank = x.rank + 1)
GROUP BY 1, 2""", "rk"))
def cooccur_weights(spark, sf) -> DataFrame:
    """Shared-event counts of unordered pairs that ever post one after the other."""
    r = Shared.of(spark, sf).ranked
    p = events.adjacent_pairs(r).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return events.pair_weights(r, p).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("together").alias("weight"))


@query("assign_block", compose(f"""SELECT block, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM (SELECT day, CASE
 WHEN day >= DATE '{CUTOFFS[0]}' AND day < DATE '{CUTOFFS[1]}' THEN 'train' WHEN day >= DATE '{CUTOFFS[1]}' AND day < DATE '{END}' THEN 'test' END AS block FROM posts)
WHERE block IS NOT NULL GROUP BY block""", "posts"))
def assign_block(spark, sf) -> DataFrame:
    d = bind_posts(spark, sf).withColumn("block", events.assign_block("day", [(b.name, b.start, b.end) for b in BLOCKS]))
    return d.filter("block IS NOT NULL").groupBy("block").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n"))


# ---- actor state -----------------------------------------------------------------------------


@query("actor_metadata", compose(f"""SELECT cutoff, actor, {r6('medhour', 'medhour')}, {r6('med_followers', 'med_followers')}, {r6('log_followers', 'log_followers')},
 verified, n_posts FROM meta""", "meta"))
def actor_metadata(spark, sf) -> DataFrame:
    return rounded6(actors.metadata(bind_posts(spark, sf), CUTOFFS), "medhour", "med_followers", "log_followers")


@query("raw_lead", compose(f"SELECT cutoff, actor, {r6('raw_lead', 'raw_lead')}, n_events FROM rawl", "rawl"))
def raw_lead(spark, sf) -> DataFrame:
    return rounded6(actors.raw_lead(Shared.of(spark, sf).ranked, CUTOFFS), "raw_lead")


@query("oltrait", compose(f"SELECT cutoff, actor, n_events, {r6('raw_lead', 'raw_lead')}, {r6('oltrait', 'oltrait')} FROM trait", "trait"))
def oltrait(spark, sf) -> DataFrame:
    s = Shared.of(spark, sf)
    d = actors.oltrait(actors.raw_lead(s.ranked, CUTOFFS), actors.metadata(s.posts, CUTOFFS))
    return rounded6(d.select("cutoff", "actor", "n_events", "raw_lead", "oltrait"), "raw_lead", "oltrait")


@query("hour_decile_residual", compose(f"""SELECT cutoff, actor, CAST(bin AS BIGINT) AS bin, {r6('raw_lead - avg(raw_lead) OVER (PARTITION BY cutoff, bin)', 'oltrait')}
FROM (SELECT *, ntile(10) OVER (PARTITION BY cutoff ORDER BY medhour, actor) AS bin FROM tj)""", "trait"))
def hour_decile_residual(spark, sf) -> DataFrame:
    s = Shared.of(spark, sf).state
    return big(rounded6(actors.oltrait(s.raw, s.meta, "decile").select("cutoff", "actor", "bin", "oltrait"), "oltrait"), "bin")


@query("lead_degree", compose(f"""SELECT cutoff, actor, o AS g_out_w, i AS g_in_w, part_count, {r6('g_out', 'g_out')}, {r6('g_in', 'g_in')}, g_net, g_total,
 {r6('log_g_total', 'log_g_total')}, {r6('g_net_rate', 'g_net_rate')} FROM deg""", "deg"))
def lead_degree(spark, sf) -> DataFrame:
    return rounded6(actors.lead_degree(Shared.of(spark, sf).ranked, CUTOFFS), "g_out", "g_in", "log_g_total", "g_net_rate")


@query("shuffle_control", compose(f"SELECT cutoff, actor, {r6('shuffled', 'shuffled')} FROM shuf", "shuf"))
def shuffle_control(spark, sf) -> DataFrame:
    return rounded6(Shared.of(spark, sf).state.shuffled.select("cutoff", "actor", F.col("oltrait").alias("shuffled")), "shuffled")


@query("nearest_hour_match", compose("""SELECT cutoff, actor, match, round(gap, 6) + 0.0 AS gap FROM (SELECT a.cutoff, a.actor, b.actor AS match, abs(a.medhour - b.medhour) AS gap,
 row_number() OVER (PARTITION BY a.cutoff, a.actor ORDER BY abs(a.medhour - b.medhour), b.actor) AS z
 FROM meta a JOIN meta b ON a.cutoff = b.cutoff AND a.actor <> b.actor) WHERE z = 1""", "meta"))
def nearest_hour_match(spark, sf) -> DataFrame:
    d = actors.nearest_hour(Shared.of(spark, sf).state.meta)
    return rounded6(d.select("cutoff", "actor", "match", "gap"), "gap")


# ---- frames ----------------------------------------------------------------------------------


@query("online_frames", compose(f"SELECT sym, day, rank, actor, CAST(frame_j AS BIGINT) AS frame_j, is_new, {r6('best_sim', 'best_sim')} FROM fr", "fr"))
def online_frames(spark, sf) -> DataFrame:
    d = Shared.of(spark, sf).state.frames.select("sym", "day", "rank", "actor", "frame_j", "is_new", "best_sim")
    return big(rounded6(d, "best_sim"), "frame_j")


@query("frame_centroids", compose(f"""SELECT sym, day, CAST(frame_j AS BIGINT) AS frame_j, CAST(n AS BIGINT) AS n, {r6('centroid[1]', 'c_first')}, {r6('centroid[64]', 'c_last')},
 {r6('list_dot_product(centroid, centroid)', 'norm2')} FROM cents""", "cents"))
def frame_centroids(spark, sf) -> DataFrame:
    c = fr.centroids(Shared.of(spark, sf).state.frames)
    d = c.select("sym", "day", "frame_j", "n", F.col("centroid")[0].alias("c_first"), F.col("centroid")[63].alias("c_last"),
                 fr.dot("centroid", "centroid").alias("norm2"))
    return big(rounded6(d, "c_first", "c_last", "norm2"), "frame_j", "n")


@query("future_labels", compose(f"""SELECT sym, day, CAST(frame_j AS BIGINT) AS frame_j, future_adopt, {r6('future_reach', 'future_reach')}, {r6('ln(1 + future_adopt)', 'log_future_adopt')},
 {r6('ln(1 + future_reach)', 'log_future_reach')}, hist_adopt, {r6('hist_reach', 'hist_reach')} FROM lab""", "lab"))
def future_labels(spark, sf) -> DataFrame:
    d = fr.future_labels(Shared.of(spark, sf).state.frames)
    return big(rounded6(d, "future_reach", "log_future_adopt", "log_future_reach", "hist_reach"), "frame_j")


@query("origin_history", compose(f"""SELECT cutoff, actor, {r6('hist_log_origin_count', 'hist_log_origin_count')}, {r6('hist_mean_log_adopt', 'hist_mean_log_adopt')},
 {r6('hist_mean_log_reach', 'hist_mean_log_reach')}, {r6('hist_success_rate', 'hist_success_rate')} FROM hist""", "hist"))
def origin_history(spark, sf) -> DataFrame:
    names = ["hist_log_origin_count", "hist_mean_log_adopt", "hist_mean_log_reach", "hist_success_rate"]
    return rounded6(Shared.of(spark, sf).state.hist.select("cutoff", "actor", *names), *names)


@query("novelty_global", compose(f"SELECT sym, day, rank, {r6('novelty_global', 'novelty_global')} FROM nov", "nov"))
def novelty_global(spark, sf) -> DataFrame:
    from originflow.plans import pit
    s = Shared.of(spark, sf)
    return rounded6(pit.novelty(s.state, CUTOFFS[0], 10), "novelty_global")


@query("frame_mean_pool", compose(f"""SELECT sym, day, CAST(frame_j AS BIGINT) AS frame_j, {r6('m[1] / (sqrt(list_dot_product(m, m)) + 1e-12)', 'p_first')},
 {r6('m[64] / (sqrt(list_dot_product(m, m)) + 1e-12)', 'p_last')} FROM (SELECT sym, day, frame_j, list(x ORDER BY i) AS m FROM (
 SELECT sym, day, frame_j, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM fr JOIN embeddings USING (vec_id), range(1, 65) t(i) GROUP BY ALL) GROUP BY ALL)""", "fr"))
def frame_mean_pool(spark, sf) -> DataFrame:
    s = Shared.of(spark, sf)
    m = s.state.frames.select(*fr.FRAME, "vec_id").join(s.vectors, "vec_id")
    d = fr.mean_pool(m, fr.FRAME, "emb").select(*fr.FRAME, F.col("pooled")[0].alias("p_first"), F.col("pooled")[63].alias("p_last"))
    return big(rounded6(d, "p_first", "p_last"), "frame_j")


@query("assign_to_seeds", compose(f"""SELECT sym, day, CAST(frame_j AS BIGINT) AS frame_j, CAST(count(*) AS DOUBLE) AS future_adopt, {r6('sum(greatest(0.0, followers))', 'future_reach')}
FROM (SELECT i.sym, i.day, i.rank, i.followers, s.frame_j, list_dot_product(i.v, s.centroid) AS sim,
 row_number() OVER (PARTITION BY i.sym, i.day, i.rank ORDER BY list_dot_product(i.v, s.centroid) DESC, s.frame_j) AS z
 FROM items i JOIN (SELECT sym, day, rank - 1 AS frame_j, v AS centroid FROM items WHERE rank <= 5) s USING (sym, day) WHERE i.rank > 5)
WHERE z = 1 AND sim >= {THR} GROUP BY 1, 2, 3""", "items"))
def assign_to_seeds(spark, sf) -> DataFrame:
    """Posts after the fifth, sent to the most similar of the event's first five posts."""
    s = Shared.of(spark, sf)
    v = s.ranked.join(s.vectors, "vec_id").select("sym", "day", "rank", "followers", fr.unit("emb").alias("vec"))
    seeds = v.filter("rank <= 5").select("sym", "day", (F.col("rank") - 1).alias("frame_j"), F.col("vec").alias("centroid"))
    return big(rounded6(fr.assign_to_seeds(v.filter("rank > 5"), seeds, EVENT_COLS, THR), "future_reach"), "frame_j")


@query("unit_vectors", """SELECT vec_id, round(sqrt(list_dot_product(u, u)), 6) + 0.0 AS norm, round(list_dot_product(u, w), 6) + 0.0 AS cos_first FROM (
SELECT vec_id, list_transform(e, lambda x: x / (sqrt(list_dot_product(e,e)) + 1e-12)) AS u, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0) AS w
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))""")
def unit_vectors(spark, sf) -> DataFrame:
    v = Shared.of(spark, sf).vectors
    one = v.filter("vec_id = 0").select(F.transform("emb", lambda x: x.cast("double"))).scalar()
    d = v.select("vec_id", fr.unit("emb").alias("u")).withColumn("w", one)
    return rounded6(d.select("vec_id", F.sqrt(fr.dot("u", "u")).alias("norm"), fr.dot("u", "w").alias("cos_first")), "norm", "cos_first")


# ---- panel -----------------------------------------------------------------------------------

PANEL_COLS = [
    "origin_ol", "origin_logfoll", "origin_verified", "log_origin_rank", "elapsed_hours", "prior_frame_count", "origin_stance",
    "origin_stance_abs", "novelty_global", "novelty_event", "hist_log_origin_count", "hist_mean_log_adopt", "hist_success_rate",
    "future_adopt", "future_reach", "log_future_adopt", "log_future_reach", "origin_ol_raw", "origin_ol_shuffled",
    "ol_x_visibility", "ol_x_novelty", "raw_ol_x_visibility", "raw_ol_x_novelty", "shuffled_ol_x_visibility", "shuffled_ol_x_novelty",
    "logfoll_x_visibility", "logfoll_x_novelty"]


@query("pit_origin_panel", compose(
    f"SELECT event_id, sym, day, split, cutoff, CAST(frame_j AS BIGINT) AS frame_j, rank, actor, {', '.join(r6(c, c) for c in PANEL_COLS)} FROM panel", "panel"))
def pit_origin_panel(spark, sf) -> DataFrame:
    d = Shared.of(spark, sf).panel.select("event_id", "sym", "day", "split", "cutoff", "frame_j", "rank", "actor", *PANEL_COLS)
    return big(rounded6(d, *PANEL_COLS), "frame_j")


@query("panel_profile", compose("""SELECT split, split AS block, count(*) AS n_rows, count(DISTINCT event_id) AS n_events, count(DISTINCT sym) AS n_symbols,
 count(DISTINCT actor) AS n_actors, max(day) AS last_day FROM panel GROUP BY split""", "panel"))
def panel_profile(spark, sf) -> DataFrame:
    from originflow.operators.panel import panel_profile as profile
    return profile(Shared.of(spark, sf).panel)
