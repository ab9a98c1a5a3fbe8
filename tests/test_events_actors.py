"""Sources, events, actor state, point-in-time rules and text."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from originflow.functions import text as tx
from originflow.functions.responses import parse_scores, parse_selection
from originflow.operators import actors, events as ev, ordered
from originflow.sources import posts as src, stores

DAY = dt.date(2024, 1, 1)
US0 = 1_704_067_200_000_000
POST = "sym string, actor string, us long, post_id long, followers double, verified double"


def post_table(spark, rows):
    df = spark.createDataFrame(rows, POST)
    return df.withColumn("day", src.day_of(F.col("us"))).withColumn("hour", src.hour_of(F.col("us")))


def random_posts(spark, n=400, seed=0, days=8):
    g = np.random.default_rng(seed)
    return [(f"s{int(g.integers(0, 2))}", f"a{int(g.integers(0, 12))}", US0 + int(g.integers(0, days * 86_400)) * 1_000_000, i,
             float(g.integers(0, 40)), float(g.integers(0, 2))) for i in range(n)]


def test_lines_keep_the_order_of_the_file(spark, tmp_path):
    """Two files cut into many blocks: line numbers rise along each file, equal times follow it, and identical lines are two posts."""
    g = np.random.default_rng(0)
    for name in ("AAA", "BBB"):
        lines = []
        for i in range(400):
            rec = {"created_at": "2024-01-02T10:00:00Z", "kol_username": f"u{int(g.integers(60))}", "author_followers": i, "text": "x" * int(g.integers(5, 200))}
            lines.append(json.dumps(rec))
        lines[7] = lines[6]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    orders = []
    try:
        for size in ("4kb", "128mb"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            posts = src.read_posts(spark, str(tmp_path))
            assert size != "4kb" or posts.rdd.getNumPartitions() > 20
            rows = posts.select("sym", "line_no", "followers", "post_id").collect()
            assert len(rows) == 800 and len({(r.sym, r.post_id) for r in rows}) == 800
            for name in ("AAA", "BBB"):
                mine = [r.followers for r in sorted((r for r in rows if r.sym == name), key=lambda r: r.line_no)]
                assert [int(v) for v in mine if v != 6] == [i for i in range(400) if i not in (6, 7)] and mine.count(6) == 2
            ranked = ev.rank_posts(ev.first_posts(posts), 1)
            orders.append([(r.sym, r["rank"], r.actor) for r in ranked.orderBy("sym", "rank").collect()])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert orders[0] == orders[1]
    seen = []
    for line in (tmp_path / "AAA.jsonl").read_text().splitlines():
        if (actor := json.loads(line)["kol_username"]) not in seen:
            seen.append(actor)
    assert [a for s, _, a in orders[0] if s == "AAA"] == seen


def test_read_posts(spark, tmp_path):
    good = {"created_at": "2024-01-02T03:04:05Z", "kol_username": "k1", "author_followers": 12, "author_verified": True, "text": "buy https://sell.x now", "tweet_id": "1"}
    lines = [json.dumps(good), "{broken", json.dumps({**good, "created_at": None}), json.dumps({**good, "kol_username": ""}),
             json.dumps({**good, "created_at": "2024-01-02T03:04:05+0100", "author_followers": "many", "author_verified": None}),
             json.dumps({**good, "created_at": "2024-01-02T03:04:05.250+01:00", "author_followers": 1.5}), json.dumps({**good, "created_at": "yesterday"})]
    (tmp_path / "AAPL.jsonl").write_text("\n".join(lines))
    got = sorted(src.read_posts(spark, str(tmp_path)).collect(), key=lambda r: -r["us"])
    assert [r["us"] for r in got] == [1704164645000000, 1704161045250000, 1704161045000000]
    assert [(r["sym"], r["hour"], r["followers"], r["verified"], r["stance"]) for r in got] == [
        ("AAPL", 3, 12.0, 1.0, 1), ("AAPL", 2, 1.5, 1.0, 1), ("AAPL", 2, 0.0, 0.0, 1)]


def test_partitioned_sink_prunes(spark, tmp_path):
    p = post_table(spark, random_posts(spark))
    src.write_posts(p, str(tmp_path / "t"))
    back = src.load_posts(spark, str(tmp_path / "t"), "2024-01-03", "2024-01-05")
    assert back.count() == p.filter("day >= '2024-01-03' AND day < '2024-01-05'").count()
    assert "PartitionFilters: [isnotnull(day" in back._jdf.queryExecution().toString()


def test_range_filter_reaches_the_scan(spark, sf):
    plan = src.bind_posts(spark, sf, "2024-01-05", "2024-01-09")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_session_zone_does_not_matter(spark, sf):
    rows = lambda: src.bind_posts(spark, sf).select("post_id", "us", "day", "hour").orderBy("post_id").collect()
    utc = rows()
    raw = {r[0]: r[1] for r in src.table(spark, sf, "events").select("event_id", F.col("ts").cast("string")).collect()}
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert rows() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for r in utc:
        t = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=r["us"])
        assert t == dt.datetime.fromisoformat(raw[r["post_id"]]) and (t.date(), t.hour) == (r["day"], r["hour"])


def test_ranks_ties_and_invariants(spark):
    rows = [("s", "b", US0, 5, 1.0, 0.0), ("s", "a", US0, 3, 1.0, 0.0), ("s", "c", US0 + 5, 1, 1.0, 0.0), ("s", "b", US0 + 9, 2, 1.0, 0.0), ("t", "z", US0, 9, 1.0, 0.0)]
    got = {(r["sym"], r["actor"]): r for r in ev.rank_posts(ev.first_posts(post_table(spark, rows))).collect()}
    # equal times: b was seen first (its lowest id is 2)
    assert [got[("s", x)]["rank"] for x in "bac"] == [1, 2, 3] and got[("t", "z")]["k"] == 1
    r = ev.rank_posts(ev.first_posts(post_table(spark, random_posts(spark))))
    assert r.groupBy("sym", "day").agg(F.sum("net_lead").alias("s")).filter("s <> 0").count() == 0
    many = ev.rank_posts(ev.first_posts(post_table(spark, random_posts(spark)).repartition(16)))
    key = ["sym", "day", "actor", "rank", "k"]
    assert sorted(map(tuple, r.select(*key).collect())) == sorted(map(tuple, many.select(*key).collect()))


def test_one_time_stamp_for_all_is_cut_by_first_seen(spark, monkeypatch):
    rows = [("s", f"a{i:03d}", US0, int(j), 1.0, 0.0) for i, j in enumerate(np.random.default_rng(0).permutation(97) * 10**15)]
    monkeypatch.setattr(ev, "BLOCK", 8)
    got = ev.rank_posts(ev.first_posts(post_table(spark, rows))).collect()
    assert [r["post_id"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(r[3] for r in rows)
    assert sorted(r["rank"] for r in got) == list(range(1, 98))


def test_degrees_equal_pair_counts(spark):
    r = ev.rank_posts(ev.first_posts(post_table(spark, random_posts(spark))), 5)
    deg = {x["actor"]: x for x in actors.lead_degree(r, ["2024-02-01"]).collect()}
    ranks = {}
    for x in r.collect():
        ranks.setdefault((x["sym"], x["day"]), []).append((x["rank"], x["actor"]))
    out, inn = {}, {}
    for members in ranks.values():
        for ra, a in members:
            for rb, b in members:
                if ra < rb:
                    out[a] = out.get(a, 0) + 1
                    inn[b] = inn.get(b, 0) + 1
    assert {a: d["g_out_w"] for a, d in deg.items() if d["g_out_w"]} == out
    assert {a: d["g_in_w"] for a, d in deg.items() if d["g_in_w"]} == inn


def state(spark, rows, cutoffs):
    p = post_table(spark, rows)
    r = ev.rank_posts(ev.first_posts(p), 5)
    m = actors.metadata(p, cutoffs)
    return actors.oltrait(actors.raw_lead(r, cutoffs, min_events=2), m).join(
        actors.lead_degree(r, cutoffs), ["cutoff", "actor"]).join(m.drop("medhour"), ["cutoff", "actor"])


def test_state_ignores_rows_from_the_cutoff_on(spark):
    rows = random_posts(spark)
    cut = US0 + 4 * 86_400_000_000
    changed = [r if r[2] < cut else (r[0], "intruder", r[2], r[3], 9e6, 1.0) for r in rows]
    # sums of doubles may differ in the last digits with the row order
    rows_of = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
    a = rows_of(state(spark, rows, ["2024-01-05"]))
    assert a and a == rows_of(state(spark, changed, ["2024-01-05"]))
    assert a == rows_of(state(spark, rows, ["2024-01-05", "2024-01-08"]).filter("cutoff = '2024-01-05'"))


@pytest.mark.parametrize("hours", [[5, 5, 5, 5], [3, 3, 9, 9], [1, 7, 13, 20]])
def test_oltrait_residual(spark, hours):
    lead = [1.0, -2.0, 0.5, 4.0]
    d = dt.date(2024, 1, 1)
    raw = spark.createDataFrame([(d, f"a{i}", v, 9) for i, v in enumerate(lead)], "cutoff date, actor string, raw_lead double, n_events long")
    meta = spark.createDataFrame([(d, f"a{i}", float(h)) for i, h in enumerate(hours)], "cutoff date, actor string, medhour double")
    got = [r["oltrait"] for r in actors.oltrait(raw, meta).orderBy("actor").collect()]
    h = np.array(hours, float)
    a = np.vstack([np.ones(4), h, h * h]).T
    assert np.allclose(got, lead - a @ np.linalg.lstsq(a, np.array(lead), rcond=None)[0], atol=1e-7)


def test_running_with_carry(spark):
    g = np.random.default_rng(1)
    v = g.integers(-9, 9, 53).astype(float)
    df = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate(v)], "g string, i int, v double").withColumn("b", F.floor(F.col("i") / 7).cast("int"))
    spec = {"s": ("sum", F.col("v")), "c": ("count", F.when(F.col("v") > 0, 1)), "m": ("max", F.col("v")), "n": ("min", F.struct("v", "i"))}
    for r in ordered.running(df, ["g"], "b", ["i"], spec).collect():
        past = v[: r["i"]]
        assert r["s"] == past.sum() and r["c"] == (past > 0).sum()
        assert r["m"] == (past.max() if len(past) else None)
        assert (r["n"]["i"] if r["n"] else None) == (int(past.argmin()) if len(past) else None)


def test_text_rules(spark):
    rows = [("address the issue", 1), ("Sell @buyer http://buy.me/long SHORT", -1), ("", 0), (None, 0), ("buy sell", 0), ("🚀 to the MOON", 1)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r[0] for r in df.select(tx.stance("t")).collect()] == [s for _, s in rows]
    one = spark.createDataFrame([("  see https://x.y/z?q $TSLA\tand tesla, @Joe_1 aapl AAPLX ",)], "t string")
    r = one.select(tx.anonymize("t"), tx.clean_text("t")).first()
    assert r[0] == "see <URL> <ASSET> and <ASSET>, <USER> <ASSET> AAPLX" and r[1] == "see $TSLA and tesla, @Joe_1 aapl AAPLX"
    f = one.select(*[c.alias(n) for n, c in tx.surface_features("t", F.lit("TSLA")).items()]).first()
    assert (f["n_cashtags"], f["n_mentions"], f["n_urls"], f["contains_sym"], f["has_question"]) == (1, 1, 1, 1, 1)


def test_damaged_responses(spark):
    texts = ['{"scores":[{"id":0,"adoption_score":150,"reach_score":-3},{"id":0,"adoption_score":7,"reach_score":8},{"id":9,"adoption_score":1,"reach_score":1}]}',
             'x {"scores":[[1,2,3],["a",1,2]]} y', '{"scores":[{"id":1', None, '{"scores":7}', '{"scores":[{"id":1,"adoption_score":NaN,"reach_score":2}]}', "[1,2]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, r string")
    got = {r["i"]: [tuple(s) for s in r["scores"]] for r in parse_scores(df, "r", 3).collect()}
    assert got == {0: [(0, 7.0, 8.0)], 1: [(1, 2.0, 3.0)], 2: [], 3: [], 4: [], 5: [], 6: []}
    sel = ['{"selected":[{"id":1,"attention":3},{"id":1,"attention":9},{"id":8},{"id":0,"attention":1}]}', '{"selections":[{"id":0},{"id":1}]}', '{"selected":[{"id":0,"attention":1}]}',
           '{"selected":[{"id":1,"attention":30},{"id":0,"attention":10}', "none", '{"selected":"no"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sel)], "i int, r string").withColumn("c", F.array(F.lit(0), F.lit(1)))
    got = {r["i"]: (r["status"], [(s["id"], s["attention_norm"]) for s in r["selected"]]) for r in parse_selection(df, "r", "c", 2).collect()}
    assert got == {0: ("", [(1, 0.75), (0, 0.25)]), 1: ("", [(0, 0.5), (1, 0.5)]), 2: ("too_few_selected", [(0, None)]),
                   3: ("json_recovered", [(1, 0.75), (0, 0.25)]), 4: ("json_decode", []), 5: ("missing_selected", [])}


def test_stores(spark, tmp_path):
    log = spark.createDataFrame([("k", 1, 5.0), ("k", 3, float("nan")), ("k", 2, 6.0), ("m", 1, None)], "key string, seq int, v double")
    assert [tuple(r) for r in stores.latest_by_key(log, "key", "seq", ["v"]).collect()] == [("k", 2, 6.0)]
    items = spark.createDataFrame([("k",), ("n",), ("n",)], "key string")
    assert [r[0] for r in stores.missing_keys(items, log, "key").collect()] == ["n"]
    stores.append_log(log, str(tmp_path / "log"))
    stores.append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 8
    stores.write_csv(items, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    res = spark.createDataFrame([("s1", "y", "m", "ndcg3", 0.5)], "setting string, target string, method string, metric string, value double")
    stores.write_results(res, str(tmp_path / "res"))
    back = spark.read.parquet(str(tmp_path / "res"))
    assert stores.read_result(back, setting="s1", metric="ndcg3").first()[0] == 0.5
    assert stores.read_result(back, -1.0, setting="s2").first()[0] == -1.0
