"""Pair weights from lists of events: against all pairs of rows, over several blocks, and what is moved for them."""

import datetime as dt
import itertools

import numpy as np
import pytest

from originflow.operators import events

DAY = dt.date(2024, 1, 1)


def world(spark, n_events=40, n_actors=8):
    g, rows, want = np.random.default_rng(3), [], {}
    for e in range(n_events):
        order = g.choice(n_actors, int(g.integers(1, n_actors + 1)), replace=False).tolist()
        rows += [(f"s{e % 2}", DAY + dt.timedelta(days=e), a, i + 1) for i, a in enumerate(order)]
        for i, j in itertools.permutations(range(len(order)), 2):
            w = want.setdefault((order[i], order[j]), [0, 0])
            w[0] += i < j
            w[1] += 1
    return spark.createDataFrame(rows, "sym string, day date, actor long, rank long"), want


@pytest.mark.parametrize("block", [512, 7, 1])
def test_pair_weights_of_lists(spark, block):
    ranked, want = world(spark)
    asked = [(a, b) for a in range(8) for b in range(8) if a != b] + [(0, 99)]
    got = events.pair_weights(ranked, spark.createDataFrame(asked + asked[:5], "src long, dst long"), block=block).collect()
    assert {(r["src"], r["dst"]): [r["lead_weight"], r["together"]] for r in got} == want


def test_a_pair_is_not_moved_once_an_event(spark):
    ranked, _ = world(spark)
    out = events.pair_weights(ranked, spark.createDataFrame([(0, 1)], "src long, dst long"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = [line for line in plan.splitlines() if "Join" in line]
    assert join and not any("day" in line for line in join)
