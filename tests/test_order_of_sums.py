"""Queries whose answers must not hang on the order in which rows are added up."""

import datetime as dt
import shutil

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from originflow.catalog import modelling
from originflow.operators import boosting, reports

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def folder(tmp_path, sf):
    """The small tables with an events table of one's own."""
    def make(events: pd.DataFrame) -> str:
        for t in ("documents", "embeddings"):
            shutil.copy(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
        c = duckdb.connect()
        c.register("e", events)
        c.execute(f"COPY (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, props FROM e ORDER BY event_id) TO '{tmp_path}/events.parquet'")
        return str(tmp_path)
    return make


def duck_of(path: str):
    c = duckdb.connect()
    for t in ("events", "documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return c


def test_pareto_of_equal_means(spark, folder):
    values = [[0.1, 0.2, 0.3], [0.3, 0.2, 0.1], [0.2, 0.3, 0.1]]  # means that differ in the last bit when added up as doubles
    rows = [(v, u) for u, vs in enumerate(values) for v in vs] + [(0.1, 3), (0.7, 4), (0.7, 4), (0.7, 4)]
    e = pd.DataFrame({"event_id": range(len(rows)), "ts": [START + dt.timedelta(seconds=i) for i in range(len(rows))],
                      "user_id": [u for _, u in rows], "event_type": "view", "value": [v for v, _ in rows], "props": "{}"})
    path = folder(e)
    got = {r["user_id"]: r["pareto"] for r in entry.queries()["pareto_frontier"](spark, path).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False}
    want = duck_of(path).sql(entry.oracle_sql()["pareto_frontier"]).df()
    assert got == dict(zip(want["user_id"].tolist(), want["pareto"].tolist()))


def test_wins_of_summation_order(spark):
    deltas = [2.2e-16, -2.2e-16, 0.0, 0.25, -0.5]
    d = spark.createDataFrame([("a", "mass3", v) for v in deltas], "comparison string, metric string, delta double")
    assert [(r["n"], r["n_positive"]) for r in reports.delta_summary(d, ["comparison", "metric"]).collect()] == [(5, 1)]
    c = duckdb.connect()
    c.register("dl", d.toPandas())
    got = c.sql(entry.oracle_sql()["delta_summary"].rsplit("\n", 1)[1]).df()
    assert (got["n"].tolist(), got["n_positive"].tolist()) == ([5], [1])


def test_first_of_equal_splits():
    g, h = [1.0, 1e-13, -1.0 - 1e-13], [1.0, 1.0, 1.0]  # both cuts gain 1/2 + 1/3 but for the last digits
    gain, last = boosting.best_split(np.array([*g, *h, 30.0, 30.0, 30.0]), 1.0, 20)
    assert abs(gain - 5 / 6) < 1e-9 and last == 0


def test_first_split_of_halves_at_the_ninth_decimal(spark, monkeypatch):
    """Posts two microseconds apart: 15,443,358,255 are 4.2898217375 hours, which the check query rounds down."""
    sides = [(15443358255, 0.0), (15443358257, 1.0)]
    d = pd.DataFrame([(f"e{e}", 1, 2 * e + i, "train", us / 3.6e9, y) for e in range(22) for i, (us, y) in enumerate(sides)],
                     columns=["event_id", "cutoff", "actor", "split", "elapsed_hours", modelling.Y])
    d = d.assign(**{f: 0.0 for f in modelling._TREE_SET if f != "elapsed_hours"})
    monkeypatch.setattr(modelling, "graph_panel", lambda shared: spark.createDataFrame(d))
    got = {r["feature"]: (r["gain"], r["n_left"]) for r in entry.queries()["listwise_first_split"](spark, "made").collect()}
    c = duckdb.connect()
    c.register("panel", d.drop(columns="g_net_rate"))
    c.register("deg", d[["cutoff", "actor", "g_net_rate"]])
    sql = entry.oracle_sql()["listwise_first_split"]
    want = {f: (gain, n) for f, gain, n in c.sql("WITH " + sql[sql.index("ge AS (SELECT"):]).fetchall()}
    assert want["elapsed_hours"][1] == 22 and got == want


def test_nine_decimals_as_in_the_check_query(spark):
    us = list(range(15443358246, 15443358273)) + [58809528837, 30847064625, 60039725499]
    values = [s * u / 3.6e9 for u in us for s in (1, -1)] + [0.0, 1e-16, 5e-10, 2.5e-9, 1 / 1024, 752.1234567895, float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(modelling._nine_decimals("x")).collect()]
    c = duckdb.connect()
    want = [c.execute("SELECT round(CAST(? AS DOUBLE), 9)", [v]).fetchone()[0] for v in values]
    assert [str(v + 0.0) if v is not None else None for v in got] == [str(v + 0.0) if v is not None else None for v in want]
